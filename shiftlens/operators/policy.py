"""Action, reason and labels per event. Gates are one chain of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.schemas import DESTRUCTIVE

BLAST_RADIUS_CAP = 25.0
MAX_EVENTS = 10
WINDOW_SECONDS = 3600

KILL_REASON = "kill switch active"


def has_impact(*counts: str) -> Column:
    """True when any of the impact counts is above zero."""
    hit = F.lit(False)
    for c in counts:
        hit = hit | (F.coalesce(F.col(c), F.lit(0)) > 0)
    return hit


def takes_slot(impact: Column) -> Column:
    """Whether an event would use a place in the rate-limit window if it is let through."""
    return (
        F.col("change_type").isin(*DESTRUCTIVE)
        | F.col("severity").isin("high", "medium")
        | ((F.col("severity") == "low") & impact)
    )


def decide(
    events: DataFrame,
    impact: Column,
    *,
    cap: float = BLAST_RADIUS_CAP,
    kill_switch: bool = False,
    limited: Column | None = None,
    max_events: int = MAX_EVENTS,
    window_seconds: int = WINDOW_SECONDS,
    kill_reason: str = KILL_REASON,
) -> DataFrame:
    """Adds ``action``, ``reason`` and ``labels``; gates apply in the order they are written.

    Needs ``change_type``, ``severity``, ``blast_radius_score``, ``fan_out_conservative``;
    ``impact`` says whether anything is affected, ``limited`` whether the window is full.
    """
    limited = F.lit(False) if limited is None else F.coalesce(limited, F.lit(False))
    change, severity, score = F.col("change_type"), F.col("severity"), F.col("blast_radius_score")
    destructive = change.isin(*DESTRUCTIVE)
    large = score > cap
    quiet = (severity == "low") & ~impact
    killed = F.lit(kill_switch)
    human = destructive | (severity == "high") | large

    action = (
        F.when(killed, "ignore")
        .when(limited, "alert_only")
        .when(destructive | (severity == "high"), "open_draft_pr")
        .when(quiet, "alert_only")
        .when(large, "open_draft_pr")
        .otherwise("open_pr")
    )
    over_cap = F.format_string("blast_radius %.1f > cap %.1f", score, F.lit(float(cap)))
    # The reason texts.
    reason = (
        F.when(killed, kill_reason)
        .when(limited, f"rate limit exceeded (>{max_events}/{window_seconds:.0f}s)")
        .when(destructive, F.format_string("destructive change '%s' requires human review", change))
        .when(severity == "high", "HIGH severity")
        .when((severity == "medium") & large, F.concat(F.lit("MEDIUM severity with "), over_cap))
        .when(severity == "medium", "MEDIUM severity within blast cap")
        .when(quiet, "LOW severity with no downstream impact")
        .when(large, F.concat(F.lit("LOW severity but "), over_cap))
        .otherwise("LOW severity with downstream impact")
    )
    needs_human = human & ~quiet | destructive
    full = F.array_compact(
        F.array(
            F.concat(F.lit("drift:"), change),
            F.concat(F.lit("severity:"), severity),
            F.when(F.coalesce("fan_out_conservative", F.lit(False)), "fan-out-widened"),
            F.when(needs_human, "requires-human"),
            F.when(destructive, "destructive"),
            F.when(~destructive & (severity != "high") & ~quiet & large, "large-blast"),
        )
    )
    labels = (
        F.when(killed, F.array(F.lit("kill-switch"))).when(limited, F.array(F.lit("rate-limited"))).otherwise(full)
    )
    return events.withColumns({"action": action, "reason": reason, "labels": labels})


def merge_labels(labels: Column, extra: Column) -> Column:
    """Labels and extras without repeats, first seen first."""
    return F.array_distinct(F.concat(labels, extra))
