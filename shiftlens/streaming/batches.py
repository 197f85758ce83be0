"""Streams whose step is a whole batch job: polling cycles, rate limiting, payload schemas.

Each micro-batch writes its own folder, named by the stream's id and the batch, overwriting it on a retry, and reads
only the folders before it: a batch that runs twice leaves one result. A stream keeps its id in its checkpoint; one
with a new checkpoint has a new id, so what earlier streams left in the store stays and comes before its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shiftlens.operators.classify import classify_single
from shiftlens.operators.diff import history_diff
from shiftlens.operators.limiter import rate_limit
from shiftlens.operators.snapshots import latest, sequence, stored
from shiftlens.schemas import SPEC_FIELDS, spec_of
from shiftlens.sources.payload import DOCUMENT, value_type
from shiftlens.streaming.cdc import STATE_PROVIDER


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


PLACE = [T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.IntegerType())]


def _run(batch: DataFrame) -> str:
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def _earlier(batch: DataFrame, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """Rows of earlier streams and of this one's earlier batches, with ``run_id`` and ``batch_id``."""
    held = stored(batch.sparkSession, T.StructType([*schema.fields, *PLACE]), path)
    return held.where((F.col("run_id") != _run(batch)) | (F.col("batch_id") < batch_id))


def _folder(batch: DataFrame, path: str, batch_id: int) -> str:
    return f"{path}/run_id={_run(batch)}/batch_id={batch_id}"


def _write(df: DataFrame, batch: DataFrame, path: str, batch_id: int) -> None:
    df.drop("run_id", "batch_id").write.mode("overwrite").parquet(_folder(batch, path, batch_id))


# --- polling ----------------------------------------------------------------


def polling_step(store: str, events_path: str) -> Callable[[DataFrame, int], None]:
    """capture -> previous -> persist -> diff -> classify, for every source in the micro-batch.

    Rows: (source_identifier, snapshot_id, captured_at, table_identifier, column spec). Each
    source's newest stored snapshot comes before its arriving ones; a source never seen before
    only sets its baseline.
    """
    keys = ["source_identifier", "snapshot_id", "captured_at"]
    header_path, column_path = f"{store}/headers", f"{store}/columns"

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*keys, "table_identifier", *SPEC_FIELDS)
        headers = _earlier(batch, header_path, rows.select(*keys).schema, batch_id)
        fresh = rows.join(headers.select("snapshot_id"), "snapshot_id", "left_anti").select(*rows.columns)
        _write(fresh, batch, column_path, batch_id)
        fresh = batch.sparkSession.read.schema(rows.schema).parquet(_folder(batch, column_path, batch_id))
        _write(fresh.select(*keys).distinct(), batch, header_path, batch_id)
        # Only the newest stored snapshot of the arriving sources is read back, from its batch folder.
        last = latest(headers.join(fresh.select("source_identifier").distinct(), "source_identifier", "left_semi"))
        held = _earlier(batch, column_path, rows.schema, batch_id)
        before = held.join(last.select("run_id", "batch_id", "snapshot_id"), ["run_id", "batch_id", "snapshot_id"], "left_semi")
        together = fresh.unionByName(before.select(*rows.columns))
        headers = sequence(together.select(*keys).distinct())
        tables = together.select("source_identifier", "snapshot_id", "table_identifier").distinct()
        raw = history_diff(headers, tables, together.drop("captured_at"))
        named = headers.select("source_identifier", "seq", "snapshot_id", "captured_at")
        events = classify_single(raw).join(named, ["source_identifier", "seq"])
        _write(events.drop("seq"), batch, events_path, batch_id)

    return step


# --- rate limiting ----------------------------------------------------------


def limiter_step(
    admitted_path: str, out_path: str, slot_taker: str, *, scope: str | None = None, max_events: int = 10, window_seconds: int = 3600
) -> Callable[[DataFrame, int], None]:
    """Rate limit of each micro-batch, starting from what earlier batches let through."""

    def step(batch: DataFrame, batch_id: int) -> None:
        id_type = batch.schema["event_id"].dataType.simpleString()
        schema = T.StructType.fromDDL(f"scope string, t bigint, id {id_type}")
        start = batch.agg(F.unix_micros(F.min("detected_at").cast("timestamp"))).first()[0]
        earlier = _earlier(batch, admitted_path, schema, batch_id)
        prior = earlier.where(F.col("t") >= F.lit((start or 0) - window_seconds * 1_000_000)).select("scope", "t")
        judged, passed = rate_limit(
            batch, slot_taker, scope=scope, max_events=max_events, window_seconds=window_seconds, prior=prior
        )
        _write(passed, batch, admitted_path, batch_id)
        _write(judged, batch, out_path, batch_id)

    return step


# --- payload schemas --------------------------------------------------------


def payload_windows(rows: DataFrame, source: str, time: str, payload: str, width: str, lateness: str) -> DataFrame:
    """(source_identifier, window_start, is_total, name, present, non_null, low, high) per closed window.

    The row with ``is_total`` counts the payloads; a key of no letters is a name like any other. Rows later than ``lateness`` are dropped
    by the watermark; a window is emitted once, when it can no longer change.
    """
    entry = "array<struct<is_total:boolean,key:string,value:variant>>"
    nothing = F.struct(F.lit(True).alias("is_total"), F.lit("").alias("key"), F.lit(None).cast("variant").alias("value"))
    found = F.map_entries(F.from_json(F.col(payload), DOCUMENT))
    entries = F.transform(found, lambda e: F.struct(F.lit(False).alias("is_total"), e["key"].alias("key"), e["value"].alias("value")))
    named = rows.withWatermark(time, lateness).select(
        F.col(source).alias("source_identifier"),
        F.col(time),
        F.explode(F.concat(F.array(nothing), F.coalesce(entries, F.array().cast(entry)))).alias("__e"),
    ).select("source_identifier", time, F.col("__e.is_total").alias("is_total"), F.col("__e.key").alias("name"), F.col("__e.value").alias("__value"))
    return (
        named.withColumn("__type", value_type(F.col("__value")))
        .groupBy(F.window(time, width).alias("__w"), "source_identifier", "is_total", "name")
        .agg(
            F.count(F.lit(1)).alias("present"),
            F.count("__type").alias("non_null"),
            F.min("__type").alias("low"),
            F.max("__type").alias("high"),
        )
        .select("source_identifier", F.col("__w.start").alias("window_start"), "is_total", "name", "present", "non_null", "low", "high")
    )


def window_columns(windows: DataFrame) -> DataFrame:
    """Closed windows -> column rows (type, nullability, missing share), as the batch capture gives them."""
    totals = windows.where("is_total").select(
        "source_identifier", "window_start", F.col("present").alias("payloads")
    )
    return windows.where("not is_total").join(totals, ["source_identifier", "window_start"]).select(
        "source_identifier",
        "window_start",
        "name",
        F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("text").alias("data_type"),
        (F.col("non_null") < F.col("payloads")).alias("nullable"),
        (1 - F.col("non_null") / F.col("payloads")).alias("missing_share"),
        "payloads",
    )


class LastWindow(StatefulProcessor):
    """Holds the last closed schema of a source; a closing window is compared with it, name by name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._closed = handle.getValueState("closed", "start timestamp, names array<string>, types array<string>, nullables array<boolean>")

    @staticmethod
    def _schema(rows: pd.DataFrame) -> dict[str, tuple[str | None, bool]]:
        """name -> (type, nullable) of one window's counts, as :func:`window_columns` gives them."""
        payloads = int(rows.loc[rows["is_total"], "present"].iloc[0])
        named = rows[~rows["is_total"]]
        kinds = [low if isinstance(low, str) and low == high else "text" for low, high in zip(named["low"], named["high"], strict=True)]
        return dict(zip(named["name"], zip(kinds, (named["non_null"] < payloads).tolist(), strict=True), strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        before = None
        if self._closed.exists():
            at, names, types, nullables = self._closed.get()
            before = pd.Timestamp(at), dict(zip(names, zip(types, nullables, strict=True), strict=True))
        for start, window in arrived.groupby("window_start"):  # in order of time
            after = self._schema(window)
            if before is not None:
                yield self._compared(key[0], start, before, after)
            before = start, after
        names = list(before[1])
        self._closed.update((before[0].to_pydatetime(), names, [before[1][n][0] for n in names], [before[1][n][1] for n in names]))

    @staticmethod
    def _compared(source: str, start: pd.Timestamp, before: tuple[pd.Timestamp, dict], after: dict) -> pd.DataFrame:
        at, old = before
        changed = [n for n in {**old, **after} if old.get(n) != after.get(n)]
        side = lambda schema, i: [schema[n][i] if n in schema else None for n in changed]
        columns = {
            "source_identifier": [source] * len(changed),
            "window_start": [start] * len(changed),
            "previous_start": [at] * len(changed),
            "name": changed,
            "type_before": side(old, 0),
            "nullable_before": side(old, 1),
            "type_after": side(after, 0),
            "nullable_after": side(after, 1),
        }
        return pd.DataFrame({c: pd.Series(v, dtype=None if c.endswith("_start") else object) for c, v in columns.items()})

    def close(self) -> None:
        pass


_COMPARED = """source_identifier string, window_start timestamp, previous_start timestamp, name string,
    type_before string, nullable_before boolean, type_after string, nullable_after boolean"""


def payload_drift(windows: DataFrame) -> DataFrame:
    """Changes from window to window of each source, out of the stream of :func:`payload_windows`.

    A second stateful step behind the window counts: a window reaches it once, when the watermark has closed it, and is
    compared with the source's last closed window; windows in which a source was silent are passed over. The first
    window of a source only sets its baseline. Rows are raw changes that ``classify_single`` takes, with
    ``window_start`` and ``previous_start``.
    """
    windows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    found = windows.groupBy("source_identifier").transformWithStateInPandas(
        statefulProcessor=LastWindow(), outputStructType=_COMPARED, outputMode="Append", timeMode="None"
    )

    def spec(side: str):
        made = {"name": F.col("name"), "data_type": F.col(f"type_{side}"), "nullable": F.col(f"nullable_{side}"), "is_primary_key": F.lit(False), "ordinal_position": F.lit(0)}
        return F.when(F.col(f"nullable_{side}").isNotNull(), spec_of(made))

    kind = F.when(F.col("nullable_before").isNull(), "added").when(F.col("nullable_after").isNull(), "removed").otherwise("modified")
    return found.select(
        "source_identifier",
        "window_start",
        "previous_start",
        F.lit("payload").alias("table_identifier"),
        kind.alias("kind"),
        "name",
        spec("before").alias("column_before"),
        spec("after").alias("column_after"),
    )
