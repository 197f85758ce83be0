"""Change-shaped relations derived from the star-schema tables, for the registered queries.

Everything grows with the tables. Nothing here is needed by the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shiftlens.functions.durable import cut
from shiftlens.schemas import SPEC_FIELDS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table, read as stored."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# --- catalogue pair from lineitem -------------------------------------------


def catalogue_base(spark: SparkSession, d: str) -> DataFrame:
    """One monitored column per (l_orderkey, l_linenumber), with the numbers its changes follow from."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
        .agg(F.min("l_partkey").alias("a"), F.max("l_suppkey").alias("b"))
        .withColumn("i", F.col("a") % 6)
        .withColumn("m", (F.col("a") + F.col("b")) % 13)
    )


def catalogue_pair(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of the pair as rows (source_identifier, seq, is_curr, table_identifier, spec)."""
    c = catalogue_base(spark, d)
    i, m, n = F.col("i"), F.col("m"), F.col("n")
    none = F.lit(None)
    old_type = _pick(i, ["integer", "varchar(25)", "numeric", "date", "char(10)", "bigint"])
    new_type = (
        F.when(m == 3, _pick(i, ["bigint", "text", "numeric", "timestamp", "varchar(10)", "numeric"]))
        .when((m == 4) & (i == 0), "smallint")
        .when((m == 4) & (i == 5), "integer")
        .when(m == 5, "boolean")
        .otherwise(old_type)
    )
    default = F.when(F.col("a") % 2 == 1, "0")
    length = F.when(i == 1, 25).when(i == 4, 10)
    precision, scale = F.when(i == 2, 12), F.when(i == 2, 2)
    enum = F.when(i == 4, F.array(F.lit("A"), F.lit("B")))

    def side(is_curr: bool, **fields: Column) -> Column:
        return F.struct(F.lit(is_curr).alias("is_curr"), *[fields[f].alias(f) for f in SPEC_FIELDS])

    name = F.concat(F.lit("c"), n)
    before = side(
        False,
        name=name,
        data_type=old_type,
        nullable=F.col("a") % 3 != 0,
        default=default,
        is_primary_key=n == 1,
        ordinal_position=n,
        character_max_length=length,
        numeric_precision=precision,
        numeric_scale=scale,
        enum_values=enum,
    )
    after = side(
        True,
        name=name,
        data_type=new_type,
        nullable=F.when(m == 1, False).when(m == 9, True).otherwise(F.col("a") % 3 != 0),
        default=F.when(m == 8, F.when(default.isNull(), "0")).otherwise(default),
        is_primary_key=F.when(m == 0, n != 1).otherwise(n == 1),
        ordinal_position=n,
        character_max_length=F.when(m == 4, F.floor(length / 2).cast("int")).when(m == 6, length * 2).otherwise(length),
        numeric_precision=F.when(m == 7, precision + 2).otherwise(precision),
        numeric_scale=F.when(m == 7, scale + 1).otherwise(scale),
        enum_values=F.when(m == 2, F.concat(enum, F.array(F.lit("C")))).otherwise(enum),
    )
    sides = F.array_compact(
        F.array(F.when(F.col("b") % 11 != 0, before), F.when(F.col("b") % 11 != 1, after))
    )
    return c.select(
        F.concat(F.lit("src"), F.col("k") % 8).alias("source_identifier"),
        F.lit(2).cast("long").alias("seq"),
        F.concat(F.lit("raw.t"), "k").alias("table_identifier"),
        F.explode(sides).alias("s"),
    ).select("source_identifier", "seq", "table_identifier", "s.*").withColumn(
        "ordinal_position", F.col("ordinal_position").cast("int")
    )


def pair_changes(spark: SparkSession, d: str) -> DataFrame:
    from shiftlens.operators.diff import pair_diff

    sides = catalogue_pair(spark, d)
    return pair_diff(sides, sides.select("source_identifier", "seq", "table_identifier", "is_curr"))


def table_sides(spark: SparkSession, d: str) -> DataFrame:
    """Partition and primary keys per table and side; the order of a primary key may turn."""
    per_table = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_partkey").alias("s"))
    keys = lambda *c: F.array(*[F.lit(x) for x in c])
    before = F.struct(F.lit(False).alias("is_curr"), keys("c1").alias("partition_keys"), keys("c1", "c2").alias("primary_key"))
    turned = F.when(F.col("s") % 7 == 0, keys("c2", "c1")).when(F.col("s") % 7 == 1, keys("c1")).otherwise(keys("c1", "c2"))
    after = F.struct(
        F.lit(True).alias("is_curr"),
        F.when(F.col("s") % 5 == 0, keys("c2")).otherwise(keys("c1")).alias("partition_keys"),
        turned.alias("primary_key"),
    )
    return per_table.select(
        F.concat(F.lit("src"), F.col("l_orderkey") % 8).alias("source_identifier"),
        F.lit(2).cast("long").alias("seq"),
        F.concat(F.lit("raw.t"), "l_orderkey").alias("table_identifier"),
        F.explode(F.array(before, after)).alias("s"),
    ).select("source_identifier", "seq", "table_identifier", "s.*")


# --- snapshot history from events -------------------------------------------


def payload_key() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def history_columns(spark: SparkSession, d: str) -> DataFrame:
    """Daily snapshots of 20 sources; a column seen twice a day is a repeated key (last one counts)."""
    e = table(spark, d, "events")
    k = payload_key() % 25
    source = F.concat(F.lit("s"), F.col("user_id") % 20)
    day = F.date_trunc("day", "ts")
    none_int = F.lit(None).cast("int")
    return e.select(
        source.alias("source_identifier"),
        F.concat_ws("@", source, F.date_format(day, "yyyy-MM-dd")).alias("snapshot_id"),
        day.alias("captured_at"),
        F.concat(F.lit("raw."), "event_type").alias("table_identifier"),
        F.struct("ts", "event_id").alias("position"),
        F.concat(F.lit("k"), k).alias("name"),
        _pick(F.floor("value") % 4, ["integer", "bigint", "numeric(10,2)", "text"]).alias("data_type"),
        (F.col("event_id") % 2 == 0).alias("nullable"),
        F.lit(None).cast("string").alias("default"),
        F.lit(False).alias("is_primary_key"),
        k.cast("int").alias("ordinal_position"),
        none_int.alias("character_max_length"),
        none_int.alias("numeric_precision"),
        none_int.alias("numeric_scale"),
        F.lit(None).cast("array<string>").alias("enum_values"),
    )


def history_headers(spark: SparkSession, d: str) -> DataFrame:
    """(source_kind, source_identifier, snapshot_id, captured_at), one per source and day."""
    e = table(spark, d, "events")
    source = F.concat(F.lit("s"), F.col("user_id") % 20)
    day = F.date_trunc("day", "ts")
    return e.select(
        F.lit("kafka").alias("source_kind"),
        source.alias("source_identifier"),
        F.concat_ws("@", source, F.date_format(day, "yyyy-MM-dd")).alias("snapshot_id"),
        day.alias("captured_at"),
    ).distinct()


def history_changes(spark: SparkSession, d: str) -> DataFrame:
    from shiftlens.operators.diff import history_diff
    from shiftlens.operators.snapshots import sequence

    columns = history_columns(spark, d)
    return history_diff(sequence(history_headers(spark, d)), columns, columns, "position")


# --- information_schema shaped rows -----------------------------------------


def information_columns(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue view rows: one column per part, a table for the parts of one brand among each thousand keys."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    return p.select(
        F.when(F.col("p_size") % 3 == 0, "source_raw").when(F.col("p_size") % 3 == 1, "other").otherwise("raw2").alias("table_schema"),
        F.concat(F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit("_"), F.floor(key / 1000)).alias("table_name"),
        F.concat(F.lit("col_"), key).alias("column_name"),
        _pick(key % 5, ["INTEGER", "NUMBER", "VARCHAR", "TEXT", "TIMESTAMP_NTZ"]).alias("data_type"),
        _pick(key % 4, ["int4", "", "varchar", "text"]).alias("udt_name"),
        F.when(key % 3 == 0, "YES").when(key % 3 == 1, "NO").otherwise("yes").alias("is_nullable"),
        F.when(key % 7 == 0, F.col("p_type")).alias("column_default"),
        key.alias("ordinal_position"),
        F.when(key % 5 == 2, F.col("p_size").cast("string")).alias("character_maximum_length"),
        F.when(key % 10 == 1, F.lit("12")).when(key % 10 == 6, F.lit("n/a")).alias("numeric_precision"),
        F.when(key % 20 == 1, F.lit("2")).alias("numeric_scale"),
    )


def information_constraints(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(table_constraints, key_column_usage): every 9th column is in its table's key."""
    c = information_columns(spark, d)
    tables = c.select("table_schema", "table_name").distinct()
    kinds = F.explode(F.array(F.lit("PRIMARY KEY"), F.lit("UNIQUE")))
    constraints = tables.select("table_schema", "table_name", kinds.alias("constraint_type")).withColumn(
        "constraint_name", F.concat_ws("_", "table_name", F.substring("constraint_type", 1, 3))
    )
    usage = c.where(F.col("ordinal_position") % 9 == 0).select(
        F.concat_ws("_", "table_name", F.lit("PRI")).alias("constraint_name"),
        "table_schema",
        "column_name",
        (F.col("ordinal_position") % 11).alias("ordinal_position"),
    )
    return constraints, usage


# --- change-data messages from events ---------------------------------------


def messages(spark: SparkSession, d: str) -> DataFrame:
    """(topic, offset, value): the record schema follows the payload, with tombstones and envelopes."""
    return messages_of(table(spark, d, "events"))


def messages_of(e: DataFrame) -> DataFrame:
    k, eid = payload_key(), F.col("event_id")
    amount = (
        F.when(k % 3 == 0, '{"type":"bytes","logicalType":"decimal","precision":10,"scale":2}')
        .when(k % 3 == 1, '"double"')
        .otherwise('["null","long"]')
    )
    extra = F.when(k % 4 == 0, ',{"name":"email","type":["null","string"]}').otherwise("")
    stamp = F.when(k % 5 < 3, '{"type":"long","logicalType":"timestamp-millis"}').otherwise('"string"')
    record = F.concat(
        F.lit('{"type":"record","fields":[{"name":"id","type":"int"},{"name":"amount","type":'),
        amount,
        F.lit('},{"name":"at","type":'),
        stamp,
        F.lit("}"),
        extra,
        F.lit("]}"),
    )
    value = (
        F.when(eid % 17 == 0, F.lit(None))
        .when(eid % 17 == 1, '{"schema":{"fields":[]},"fields":[{"name":"x","type":"int"}]}')
        .when(eid % 3 == 0, F.concat(F.lit('{"payload":{},"schema":'), record, F.lit("}")))
        .otherwise(record)
    )
    topic = F.concat(F.when(F.col("user_id") % 2 == 0, "dbserver1.").otherwise("eu.db2."), F.lit("public."), "event_type")
    return e.select(topic.alias("topic"), eid.alias("offset"), value.alias("value"))


# --- lineage graph ----------------------------------------------------------


def _id(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("_", *[F.col(c).cast("string") for c in cols]))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): regions and parts are sources, the tables between are models, priorities are exposures.

    Five exposures read every order, so each is a hub. Links of parallel lines repeat.
    """
    t = lambda name: table(spark, d, name)
    region, nation, customer, supplier = t("region"), t("nation"), t("customer"), t("supplier")
    part, orders = t("part"), t("orders")
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    project = F.lit("tpc")

    def node(df: DataFrame, kind: str, node_id: Column, name: Column, schema: Column, order: Column) -> DataFrame:
        return df.select(
            project.alias("project"), node_id.alias("node_id"), F.lit(kind).alias("kind"), name.alias("name"),
            schema.alias("schema"), name.alias("identifier"), order.cast("long").alias("ord"),
        )

    none = F.lit(None).cast("string")
    parts = [
        node(region, "source", _id("source.geo.r", "r_regionkey"), _id("r", "r_regionkey"), F.lit("geo"), F.col("r_regionkey")),
        node(part, "source", _id("source.cat.p", "p_partkey"), _id("p", "p_partkey"), _id("cat", "p_size"), F.col("p_partkey")),
        node(nation, "model", _id("model.n", "n_nationkey"), _id("n", "n_nationkey"), none, F.col("n_nationkey")),
        node(customer, "model", _id("model.c", "c_custkey"), _id("c", "c_custkey"), none, F.col("c_custkey")),
        node(supplier, "model", _id("model.s", "s_suppkey"), _id("s", "s_suppkey"), none, F.col("s_suppkey")),
        node(orders, "model", _id("model.o", "o_orderkey"), _id("o", "o_orderkey"), none, F.col("o_orderkey")),
        node(line.select("l_orderkey", "l_linenumber").distinct(), "model", _id("model.l", "l_orderkey", "l_linenumber"),
             _id("l", "l_orderkey", "l_linenumber"), none, F.col("l_orderkey")),
        node(orders.select("o_orderpriority").distinct(), "exposure", _id("exposure.", "o_orderpriority"),
             F.col("o_orderpriority"), none, F.lit(0)),
    ]
    links = [
        nation.select(_id("source.geo.r", "n_regionkey").alias("src"), _id("model.n", "n_nationkey").alias("dst")),
        customer.select(_id("model.n", "c_nationkey").alias("src"), _id("model.c", "c_custkey").alias("dst")),
        supplier.select(_id("model.n", "s_nationkey").alias("src"), _id("model.s", "s_suppkey").alias("dst")),
        orders.select(_id("model.c", "o_custkey").alias("src"), _id("model.o", "o_orderkey").alias("dst")),
        orders.select(_id("model.o", "o_orderkey").alias("src"), _id("exposure.", "o_orderpriority").alias("dst")),
        line.select(
            F.explode(F.array(_id("model.o", "l_orderkey"), _id("model.s", "l_suppkey"), _id("source.cat.p", "l_partkey"))).alias("src"),
            _id("model.l", "l_orderkey", "l_linenumber").alias("dst"),
        ),
    ]
    nodes, edges = parts[0], links[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    for e in links[1:]:
        edges = edges.unionByName(e)
    return nodes, edges.select(project.alias("project"), "src", "dst")


# --- projections ------------------------------------------------------------


def projection_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Customers are sources with 0-4 declared columns, orders are models over them, lines are models over orders.

    An order's select follows ``o_orderkey % 6``: qualified, ``*``, ``c.*`` plus one, unqualified,
    a CTE, a union (ragged when ``o_orderkey % 12 = 11``). A line's select follows
    ``l_linenumber % 3``: ``*`` over its order, a CTE over a CTE, a qualified column.
    """
    t = lambda name: table(spark, d, name)
    customer = t("customer").select("c_custkey", "c_nationkey")
    orders = t("orders").select("o_orderkey", "o_custkey")
    line = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    project = F.lit("tpc").alias("project")
    cust, order, ln = _id("source.raw.cust", "c_custkey"), _id("model.ord", "o_orderkey"), _id("model.li", "l_orderkey", "l_linenumber")

    def node(df: DataFrame, kind: str, node_id: Column, name: Column, key: str) -> DataFrame:
        return df.select(
            project, node_id.alias("node_id"), F.lit(kind).alias("kind"), name.alias("name"),
            F.lit("raw").alias("schema"), name.alias("identifier"), F.col(key).cast("long").alias("ord"),
        )

    nodes = (
        node(customer, "source", cust, _id("cust", "c_custkey"), "c_custkey")
        .unionByName(node(orders, "model", order, _id("ord", "o_orderkey"), "o_orderkey"))
        .unionByName(node(line, "model", ln, _id("li", "l_orderkey", "l_linenumber"), "l_orderkey"))
    )
    zero = F.lit(0).alias("pos")
    edges = orders.select(project, _id("source.raw.cust", "o_custkey").alias("src"), order.alias("dst"), zero).unionByName(
        line.select(project, _id("model.ord", "l_orderkey").alias("src"), ln.alias("dst"), zero)
    )
    declared = customer.where(F.col("c_nationkey") % 5 > 0).select(
        project,
        cust.alias("node_id"),
        F.posexplode(F.transform(F.sequence(F.lit(0), (F.col("c_nationkey") % 5 - 1).cast("int")), lambda x: F.concat(F.lit("a"), x.cast("string")))).alias(
            "pos", "column"
        ),
    )

    def scope(name: str, leg: int, alias: str | Column, target: Column) -> Column:
        return F.struct(
            F.lit(name).alias("scope"), F.lit(leg).alias("leg"),
            (F.lit(alias) if isinstance(alias, str) else alias).alias("alias"),
            F.lit(0).alias("alias_pos"), target.alias("table_name"),
        )

    def ref(name: str, leg: int, pos: int, out: str | None, alias: str | None, col: str | None, star: bool = False) -> Column:
        s = lambda v: F.lit(v).cast("string")
        return F.struct(
            F.lit(name).alias("scope"), F.lit(leg).alias("leg"), F.lit(pos).alias("pos"), s(out).alias("out_name"),
            s(alias).alias("ref_alias"), s(col).alias("ref_col"), F.lit(star).alias("is_star"),
        )

    v = F.col("o_orderkey") % 6
    src = _id("raw.cust", "o_custkey")
    order_scopes = orders.select(
        project, order.alias("node"),
        F.explode(
            F.when(v == 4, F.array(scope("main", 0, "q", F.lit("q")), scope("q", 0, "c", src)))
            .when(v == 5, F.array(scope("main", 0, "c", src), scope("main", 1, "d", src)))
            .otherwise(F.array(scope("main", 0, "c", src)))
        ).alias("s"),
    ).select("project", "node", "s.*")
    order_refs = orders.select(
        project, order.alias("node"),
        F.explode(
            F.when(v == 0, F.array(ref("main", 0, 0, "x0", "c", "a0"), ref("main", 0, 1, "x1", "C", "a1")))
            .when(v == 1, F.array(ref("main", 0, 0, None, None, None, True)))
            .when(v == 2, F.array(ref("main", 0, 0, None, "c", None, True), ref("main", 0, 1, "extra", "c", "a0")))
            .when(v == 3, F.array(ref("main", 0, 0, "x0", None, "a0"), ref("main", 0, 1, "both", None, "a1"), ref("main", 0, 1, "both", "c", "a2"),
                                  ref("main", 0, 2, "one", None, None)))
            .when(v == 4, F.array(ref("q", 0, 0, "y0", "c", "a0"), ref("q", 0, 1, "y1", None, "a1"),
                                  ref("main", 0, 0, "y0", None, "y0"), ref("main", 0, 1, "z1", "q", "y1"), ref("main", 0, 2, "gone", "q", "y9")))
            .when(F.col("o_orderkey") % 12 == 11, F.array(ref("main", 0, 0, "u0", "c", "a0"), ref("main", 0, 1, "u1", "c", "a1"), ref("main", 1, 0, "w0", "d", "a2")))
            .otherwise(F.array(ref("main", 0, 0, "u0", "c", "a0"), ref("main", 0, 1, "u1", "c", "a1"),
                               ref("main", 1, 0, "w0", "d", "a2"), ref("main", 1, 1, "w1", "d", "a3")))
        ).alias("p"),
    ).select("project", "node", "p.*")
    w = F.col("l_linenumber") % 3
    up = _id("analytics.ord", "l_orderkey")
    line_scopes = line.select(
        project, ln.alias("node"),
        F.explode(
            F.when(w == 1, F.array(scope("main", 0, "f2", F.lit("f2")), scope("f2", 0, "f1", F.lit("f1")), scope("f1", 0, _id("ord", "l_orderkey"), up)))
            .otherwise(F.array(scope("main", 0, "o", up)))
        ).alias("s"),
    ).select("project", "node", "s.*")
    line_refs = line.select(
        project, ln.alias("node"),
        F.explode(
            F.when(w == 0, F.array(ref("main", 0, 0, None, None, None, True)))
            .when(w == 1, F.array(ref("f1", 0, 0, "g", None, "x0"), ref("f2", 0, 0, None, "f1", None, True), ref("main", 0, 0, "h", "f2", "g")))
            .otherwise(F.array(ref("main", 0, 0, "k", "o", "u0"), ref("main", 0, 1, "k2", "nowhere", "u0")))
        ).alias("p"),
    ).select("project", "node", "p.*")
    return {
        "nodes": nodes,
        "edges": edges,
        "source_columns": declared,
        "scopes": order_scopes.unionByName(line_scopes),
        "projections": order_refs.unionByName(line_refs),
    }


# --- decided events ---------------------------------------------------------

CHANGE_OF_EVENT = {
    "view": "column_added_nullable",
    "click": "type_widened",
    "signup": "default_changed",
    "purchase": "column_dropped",
    "error": "pk_changed",
}


def drift_events(spark: SparkSession, d: str) -> DataFrame:
    return drift_events_of(table(spark, d, "events"))


def drift_events_of(e: DataFrame) -> DataFrame:
    """Events as classified changes: type from event_type, score from value, severity from both."""
    kind = (
        F.when((F.col("event_type") == "click") & (payload_key() % 3 == 0), "column_renamed")
        .when((F.col("event_type") == "error") & (payload_key() % 2 == 0), "precision_changed")
        .otherwise(F.create_map(*[F.lit(x) for kv in CHANGE_OF_EVENT.items() for x in kv])[F.col("event_type")])
    )
    from shiftlens.schemas import severity_of

    return e.select(
        "event_id",
        F.col("ts").alias("detected_at"),
        F.concat(F.lit("team"), F.col("user_id") % 7).alias("team"),
        F.concat(F.lit("raw.t"), "user_id", F.lit(".k"), payload_key()).alias("identifier"),
        kind.alias("change_type"),
        severity_of(kind).alias("severity"),
        F.lit(1.0).alias("confidence"),
        F.when(F.col("value") < 5, 0.0).otherwise(F.floor("value").cast("double")).alias("blast_radius_score"),
        F.when(F.col("value") < 5, 0).otherwise((F.floor("value") % 8).cast("int")).alias("models"),
        (payload_key() % 10 == 0).alias("fan_out_conservative"),
    )


def event_models(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, model): as many models as the event's ``models`` count."""
    e = drift_events(spark, d).where(F.col("models") > 0)
    return e.select(
        "event_id",
        F.explode(F.transform(F.sequence(F.lit(1), "models"), lambda x: F.concat(F.lit("m"), x.cast("string")))).alias("model"),
    )


# --- scenarios --------------------------------------------------------------


def scenarios(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(expected rows, raw changes): one scenario per order, its changes numbered by column name.

    The expectation is the event of the scenario's first change in single mode, so a method that
    pairs renames or prefers severity is judged differently from it. An order without an event expects none.
    """
    from shiftlens.operators.classify import classify_single

    raw = pair_changes(spark, d).where(F.col("name").isNotNull())
    keyed = raw.withColumn("scenario_id", F.col("table_identifier")).withColumn(
        "position", F.substring("name", 2, 9).cast("int")
    )
    keyed = cut(keyed, "scenario-changes")  # read by the expectation and by the methods; the diff behind it is far larger
    singles = classify_single(keyed, ["scenario_id", "table_identifier"], ["position"])
    first = singles.groupBy("scenario_id").agg(
        F.min(F.struct("emission.position", "change_type", "severity")).alias("e")
    )
    expected = table(spark, d, "orders").select(F.concat(F.lit("raw.t"), "o_orderkey").alias("scenario_id")).join(first, "scenario_id", "left")
    expected = expected.select("scenario_id", F.col("e.change_type").alias("expected_change_type"), F.col("e.severity").alias("expected_severity"))
    return expected, keyed
