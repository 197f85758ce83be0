"""Counters, cumulative histograms and draft costs as grouped tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Histogram bounds (seconds, US dollars).
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
COST_BOUNDS = (0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0)


def counters(df: DataFrame, labels: Sequence[str], value: str = "n") -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias(value))


def event_counters(events: DataFrame) -> DataFrame:
    return counters(events, ["change_type", "severity"])


def action_counters(decisions: DataFrame) -> DataFrame:
    return counters(decisions, ["action", "severity"])


def pr_counters(decisions: DataFrame) -> DataFrame:
    """Opened proposals by draft flag."""
    opened = decisions.where(F.col("action").isin("open_pr", "open_draft_pr"))
    return opened.groupBy((F.col("action") == "open_draft_pr").cast("string").alias("is_draft")).agg(
        F.count(F.lit(1)).alias("n")
    )


def error_counters(errors: DataFrame) -> DataFrame:
    return counters(errors, ["component"])


def token_counters(drafts: DataFrame) -> DataFrame:
    """Tokens by direction, provider and model."""
    sums = drafts.groupBy("provider", "model").agg(F.sum("tokens_in").alias("in"), F.sum("tokens_out").alias("out"))
    return sums.unpivot(["provider", "model"], ["in", "out"], "direction", "tokens")


def histogram(df: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """(labels, le, n, total, observations): cumulative counts per bound, then +Inf.

    All bounds are counted in one pass; the grouped row is unfolded afterwards.
    """
    v = F.col(value)
    counted = df.groupBy(*labels).agg(
        *[F.count_if(v <= b).alias(f"__b{i}") for i, b in enumerate(bounds)],
        F.count(v).alias("observations"),
        F.sum(v).alias("total"),
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"__b{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("n")))
    return counted.select(*labels, F.explode(F.array(*rows)).alias("__r"), "total", "observations").select(
        *labels, "__r.le", "__r.n", "total", "observations"
    )


# --- draft costs ------------------------------------------------------------


def draft_costs(drafts: DataFrame, prices: DataFrame, default: Column) -> DataFrame:
    """Adds ``cost_usd`` from US dollars per million tokens; ``default`` is a struct(rate_in, rate_out).

    ``prices(provider, model, rate_in, rate_out)`` is a price list; AQE decides whether to broadcast it.
    """
    priced = drafts.join(prices, ["provider", "model"], "left")
    rate_in = F.coalesce("rate_in", default["rate_in"])
    rate_out = F.coalesce("rate_out", default["rate_out"])
    return priced.withColumn(
        "cost_usd", (F.col("tokens_in") * rate_in + F.col("tokens_out") * rate_out) / 1_000_000.0
    ).drop("rate_in", "rate_out")


def cost_rollup(costs: DataFrame, labels: Sequence[str] = ("provider", "model")) -> DataFrame:
    """Attempts, failures and cost per label set, with subtotals; failed attempts cost too."""
    return costs.rollup(*labels).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def cost_per_event(costs: DataFrame) -> DataFrame:
    return costs.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum("cost_usd").alias("total_cost_usd"),
        F.bool_or("ok").alias("succeeded"),
    )
