"""Wide rows are dealt to more partitions than the session's before a task sorts them."""

import pytest

from shiftlens.functions.durable import spread
from shiftlens.operators import column_lineage, diff
from pyspark.sql import functions as F


@pytest.fixture
def plain(spark):
    """Without adaptive execution, so that a plan's partitions are those it is given."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_columns_and_tables_of_a_step_are_dealt_finer(plain):
    spec = "'c' || id % 7 name, 'integer' data_type, true nullable, string(null) default, false is_primary_key, int(id) ordinal_position, " \
        "int(null) character_max_length, int(null) numeric_precision, int(null) numeric_scale, array('a') enum_values"
    # a constant part of the key must not bring a second exchange, and with it a sort before it
    sides = plain.range(140).selectExpr("'s' || id % 5 source_identifier", "2L seq", "'t' table_identifier", "id >= 70 is_curr", *spec.split(", "))
    paired, presence = diff.paired_columns(sides), diff.table_presence(sides)
    assert paired.rdd.getNumPartitions() == presence.rdd.getNumPartitions() == 32  # 8 times the session's
    assert paired.columns == ["source_identifier", "seq", "table_identifier", "name", "column_before", "column_after"]
    rows = paired.collect()
    assert len(rows) == 35 and all((r.column_before.ordinal_position, r.column_after.ordinal_position) == (max(i for i in range(70) if (f"s{i % 5}", f"c{i % 7}") == (r.source_identifier, r.name)), max(i for i in range(70, 140) if (f"s{i % 5}", f"c{i % 7}") == (r.source_identifier, r.name))) for r in rows)
    assert [(r.in_prev, r.in_curr) for r in presence.collect()] == [(True, True)] * 5


def test_selects_of_a_model_are_dealt_finer(plain):
    scopes = plain.range(40).selectExpr("'p' project", "'model.m' || id node", "'main' scope", "0 leg", "'A' alias", "0 alias_pos", "'raw.c' || id table_name")
    edges = plain.range(40).selectExpr("'p' project", "'source.raw.c' || id src", "'model.m' || id dst", "0 pos")
    found = column_lineage.resolve_tables(scopes, edges)
    assert found.rdd.getNumPartitions() == 32
    assert sorted((r.node, r.rel_node, r.rel_scope) for r in found.collect()) == sorted((f"model.m{i}", f"source.raw.c{i}", "main") for i in range(40))


def test_finer_partitions_stay_below_those_a_map_task_sorts_for(plain):
    rows = plain.range(10).withColumn("k", F.col("id") % 3)
    for session, want in (("4", 32), ("60", 200), ("300", 300)):
        plain.conf.set("spark.sql.shuffle.partitions", session)
        assert spread(rows, "k").rdd.getNumPartitions() == want
    plain.conf.set("spark.sql.shuffle.partitions", "4")
