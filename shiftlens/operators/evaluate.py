"""Scoring of change-detection methods: predictions, baselines, recall, F1, confusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.operators.classify import classify_batch, event_order, top_event

# Residues of the hashed id that are held out, label of "no prediction".
HELD_OUT = (7, 8, 9)
NONE = "<none>"


def held_out(scenario_id: Column) -> Column:
    """First 8 hex digits of sha-256 of the id, modulo 10."""
    number = F.conv(F.substring(F.sha2(scenario_id, 256), 1, 8), 16, 10).cast("long")
    return (number % 10).isin(*HELD_OUT)


# --- methods ----------------------------------------------------------------
# Each takes (expected rows, raw changes with scenario_id and position) and returns
# (scenario_id, expected_*, predicted_change_type, predicted_severity).


def _predict(scenarios: DataFrame, found: DataFrame) -> DataFrame:
    picked = found.select("scenario_id", "predicted_change_type", "predicted_severity")
    return scenarios.select("scenario_id", "expected_change_type", "expected_severity").join(
        picked, "scenario_id", "left"
    )


def rule_method(scenarios: DataFrame, changes: DataFrame, **rank_options: int) -> DataFrame:
    """Batch classification, then the most severe event of the scenario."""
    events = classify_batch(changes, ["scenario_id", "table_identifier"], ["position"], **rank_options)
    best = top_event(events, ["scenario_id"])
    return _predict(
        scenarios,
        best.select(
            "scenario_id",
            F.col("change_type").alias("predicted_change_type"),
            F.col("severity").alias("predicted_severity"),
        ),
    )


def _first_hit(scenarios: DataFrame, changes: DataFrame, severity: Column) -> DataFrame:
    hits = changes.withColumn("__s", severity).where(F.col("__s").isNotNull())
    first = hits.groupBy("scenario_id").agg(F.min_by("__s", "position").alias("predicted_severity"))
    return _predict(scenarios, first.withColumn("predicted_change_type", F.lit("unknown")))


def _value_severity() -> Column:
    kind = F.col("kind")
    return F.when(kind == "removed", "high").when(kind == "modified", "medium")


def _model_severity() -> Column:
    kind, b, a = F.col("kind"), F.col("column_before"), F.col("column_after")
    plain = lambda c: F.substring_index(c["data_type"], "(", 1)
    return F.when(kind == "removed", "high").when(
        kind == "modified",
        F.when(b["nullable"] & ~a["nullable"], "medium").when(plain(b) != plain(a), "high"),
    )


def value_test_baseline(scenarios: DataFrame, changes: DataFrame) -> DataFrame:
    """Value tests see a missing or changed column but cannot name the change."""
    return _first_hit(scenarios, changes, _value_severity())


def model_test_baseline(scenarios: DataFrame, changes: DataFrame) -> DataFrame:
    """Model tests see a missing column, a tightened one, or a changed type name."""
    return _first_hit(scenarios, changes, _model_severity())


def all_methods(scenarios: DataFrame, changes: DataFrame, **rank_options: int) -> DataFrame:
    """``rule``, ``value_test`` and ``model_test`` of every scenario, as the three functions give them, in one grouping by scenario."""
    events = classify_batch(changes, ["scenario_id", "table_identifier"], ["position"], **rank_options)

    def hit(name: str, severity: Column) -> Column:
        return F.when(severity.isNotNull() & F.col("position").isNotNull(), F.struct("position", severity.alias("s"))).alias(name)

    expected = scenarios.select("scenario_id", F.struct("expected_change_type", "expected_severity").alias("e"))
    rows = (
        expected.unionByName(events.select("scenario_id", event_order().alias("rule")), allowMissingColumns=True)
        .unionByName(changes.select("scenario_id", hit("value", _value_severity()), hit("model", _model_severity())), allowMissingColumns=True)
    )
    found = rows.groupBy("scenario_id").agg(F.collect_list("e").alias("e"), *[F.min(c).alias(c) for c in ("rule", "value", "model")])

    def method(name: str, change_type: Column, severity: Column) -> Column:
        return F.struct(F.lit(name).alias("method"), change_type.alias("predicted_change_type"), severity.alias("predicted_severity"))

    unnamed = lambda c: F.when(F.col(c).isNotNull(), F.lit("unknown"))
    methods = F.array(
        method("rule", F.col("rule.change_type"), F.col("rule.severity")),
        method("value_test", unnamed("value"), F.col("value.s")),
        method("model_test", unnamed("model"), F.col("model.s")),
    )
    each = found.withColumn("e", F.explode("e")).select("scenario_id", "e.*", F.explode(methods).alias("m"))
    return each.select("scenario_id", "expected_change_type", "expected_severity", "m.predicted_change_type", "m.predicted_severity", "m.method")


# --- scores -----------------------------------------------------------------


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def recall_precision(results: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Detection recall, classification recall and precision per method, in one grouping.

    Predicting nothing where nothing is expected is correct, but no detection.
    """
    total = F.count(F.lit(1))
    detected = F.count("predicted_change_type")
    correct = F.count_if(F.col("predicted_change_type").eqNullSafe(F.col("expected_change_type")))
    return results.groupBy(*keys).agg(
        total.alias("total"),
        detected.alias("detected"),
        correct.alias("correct"),
        _ratio(detected, total).alias("drift_recall"),
        _ratio(correct, total).alias("classification_recall"),
        _ratio(correct, detected).alias("classification_precision"),
    )


def confusion(results: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """(expected, predicted, n) cells; a scenario that expects nothing has the label of no prediction."""
    return results.groupBy(
        *keys,
        F.coalesce("expected_change_type", F.lit(NONE)).alias("expected"),
        F.coalesce("predicted_change_type", F.lit(NONE)).alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_margins(cells: DataFrame) -> DataFrame:
    """Cells of each method with row, column and grand totals; a NULL label is a total."""
    return (
        cells.cube("method", "expected", "predicted")
        .agg(F.sum("n").alias("n"), F.grouping("method").alias("__all"), F.grouping_id("method", "expected", "predicted").alias("margin"))
        .where(F.col("__all") == 0)
        .drop("__all")
    )


def severity_macro_f1(results: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Unweighted mean F1 over the classes expected or predicted.

    Confusion cells are counted first, so every later step works on a handful of rows.
    """
    cells = results.groupBy(
        *keys,
        F.coalesce("expected_severity", F.lit(NONE)).alias("e"),
        F.coalesce("predicted_severity", F.lit(NONE)).alias("p"),
    ).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("e") == F.col("p")
    zero = F.lit(0).cast("long")
    sides = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.col("e").alias("c"),
                    F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
                    zero.alias("fp"),
                    F.when(hit, zero).otherwise(F.col("n")).alias("fn"),
                ),
                F.struct(
                    F.col("p").alias("c"), zero.alias("tp"), F.when(hit, zero).otherwise(F.col("n")).alias("fp"), zero.alias("fn")
                ),
            )
        ).alias("__s"),
    ).select(*keys, "__s.*")
    per_class = sides.groupBy(*keys, "c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    f1 = _ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    return per_class.groupBy(*keys).agg(F.avg(f1).alias("severity_macro_f1"))


def impact_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Recall and precision of affected (name, column) rows per scenario, counted as rows.

    Both sides are grouped together, so no set is ever gathered into an array.
    """
    row = ["scenario_id", "name", "column"]
    both = (
        expected.select(*row).distinct().withColumn("__e", F.lit(1)).withColumn("__p", F.lit(0))
        .unionByName(predicted.select(*row).distinct().withColumn("__e", F.lit(0)).withColumn("__p", F.lit(1)))
        .groupBy(*row)
        .agg(F.max("__e").alias("e"), F.max("__p").alias("p"))
    )
    hit = F.sum(F.col("e") * F.col("p"))
    return both.groupBy("scenario_id").agg(
        _ratio(hit, F.sum("e")).alias("recall"), _ratio(hit, F.sum("p")).alias("precision")
    )


def compare_methods(results: DataFrame, latency: str | None = None) -> DataFrame:
    """One row per method: all ratios, macro F1 and, when supplied, the mean latency."""
    out = recall_precision(results).join(severity_macro_f1(results), "method")
    if latency:
        out = out.join(results.groupBy("method").agg(F.avg(latency).alias("mean_latency_ms")), "method")
    return out
