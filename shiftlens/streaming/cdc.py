"""Change-data messages as a stream: last schema per topic in keyed state, changes as rows.

Two levels keep a hot topic out of one task. First every chunk of offsets that a micro-batch brings is marked by itself;
only its first message, whose predecessor lies outside, goes on with the chunk's last schema to the topic's own key. There
the few firsts are put in order, compared with each other and with the schema in state. All other rows pass through under
keys of their chunks, so no task sees more than a chunk of a topic's messages and the firsts of its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shiftlens.sources.cdc import FIELD, canonical_schema, decode, order_columns

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OFFSETS_PER_CHUNK = 10_000

MARKED = "topic string, partition int, offset bigint, schema string, previous string, is_change boolean"
_ROUTED = "topic string, chunk bigint, partition int, offset bigint, schema string, previous string, last string, end bigint"
_TOPIC_KEY = -1


def mark_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    """One chunk of one partition: every message next to the one before; the first goes to the topic's key with the last schema."""
    out = rows.sort_values("offset", kind="stable").reset_index(drop=True)
    out["previous"] = out["schema"].shift(1)
    out["last"], out["end"] = None, out["offset"].iloc[-1]
    out.loc[0, "chunk"], out.loc[0, "last"] = _TOPIC_KEY, out["schema"].iloc[-1]
    return out[["topic", "chunk", "partition", "offset", "schema", "previous", "last", "end"]]


class LastSchema(StatefulProcessor):
    """Keeps one schema text per topic, with its place; a message equal to it is a duplicate.

    What a micro-batch brings is taken in the order of (partition, offset).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "partition int, offset bigint, schema string")

    @staticmethod
    def _marked(rows: pd.DataFrame) -> pd.DataFrame:
        text = {c: rows[c].to_numpy(object) for c in ("topic", "schema", "previous")}
        changed = [a != b for a, b in zip(text["schema"], text["previous"], strict=True)]
        out = rows[["partition", "offset"]].reset_index(drop=True).assign(**text, is_change=changed)
        return out[["topic", "partition", "offset", "schema", "previous", "is_change"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1] != _TOPIC_KEY:
            yield from (self._marked(part) for part in rows)
            return
        firsts = pd.concat(list(rows)).sort_values(["partition", "offset"], kind="stable")
        held = self._last.get()[2] if self._last.exists() else None
        firsts["previous"] = [held, *firsts["last"].iloc[:-1]]
        end = firsts.iloc[-1]
        self._last.update((int(end["partition"]), int(end["end"]), end["last"]))
        yield self._marked(firsts)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._last.update((None, None, initialState["schema"].iloc[0]))

    def close(self) -> None:
        pass


def marked_stream(messages: DataFrame, primed: DataFrame | None = None, chunk: int = OFFSETS_PER_CHUNK) -> DataFrame:
    """Streaming twin of ``cdc_changes.mark_changes``.

    ``primed(topic, record_schema)`` seeds the state, so the first change after a start
    is compared with the schema known before it.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    decoded = decode(messages)
    partition = F.col("partition").cast("int") if len(order_columns(decoded)) > 1 else F.lit(0)
    slim = decoded.select(
        "topic", partition.alias("partition"), "offset", F.floor(F.col("offset") / chunk).alias("chunk"), canonical_schema(F.col("record_schema")).alias("schema")
    )
    routed = slim.groupBy("topic", "partition", "chunk").applyInPandas(mark_chunk, _ROUTED)
    initial = None
    if primed is not None:
        schema = canonical_schema(F.col("record_schema")).alias("schema")
        initial = primed.select("topic", F.lit(_TOPIC_KEY).cast("long").alias("chunk"), schema).groupBy("topic", "chunk")
    return routed.groupBy("topic", "chunk").transformWithStateInPandas(
        statefulProcessor=LastSchema(),
        outputStructType=MARKED,
        outputMode="Append",
        timeMode="None",
        initialState=initial,
    )


def current_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(topic, partition, offset, record_schema, fields): the schema that a stream of :func:`marked_stream` holds for each topic.

    Read from the state store under its checkpoint. A stream that holds nothing is an error, not an empty catalogue:
    that would look as if every table had been dropped. ``offset`` is NULL while the schema is still the primed one.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    held = state.select("key.topic", "value.partition", "value.offset", F.col("value.schema").alias("record_schema"))
    if held.isEmpty():
        raise ValueError("no schema is known: prime the stream or run it before reading its state")
    return held.withColumn("fields", F.from_json("record_schema", f"struct<fields:array<{FIELD}>>")["fields"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all available input into a Parquet table (exactly once) and read it."""
    spark: SparkSession = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
