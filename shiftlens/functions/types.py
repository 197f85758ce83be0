"""Predicates on monitored type strings, all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Type family -> families it can be widened to. Directed, not transitive.
WIDENS_TO = {
    "smallint": ("integer", "int", "bigint", "numeric", "decimal"),
    "integer": ("bigint", "numeric", "decimal"),
    "int": ("bigint", "numeric", "decimal"),
    "bigint": ("numeric", "decimal"),
    "real": ("double precision", "numeric", "decimal"),
    "float": ("double precision", "numeric", "decimal"),
    "char": ("varchar", "text"),
    "varchar": ("text",),
    "character varying": ("text",),
    "date": ("timestamp", "timestamp without time zone", "timestamptz"),
    "time": ("timestamp", "timestamptz"),
    "timestamp": ("timestamptz",),
    "timestamp without time zone": ("timestamptz", "timestamp with time zone"),
}
_STEPS = [f"{low}>{high}" for low, highs in WIDENS_TO.items() for high in highs]

# Engine spelling -> lattice spelling, used only when asked for.
TYPE_ALIASES = {
    "int2": "smallint",
    "int4": "integer",
    "int8": "bigint",
    "float4": "real",
    "float8": "double precision",
    "bpchar": "char",
    "bool": "boolean",
}


def type_family(data_type: Column) -> Column:
    """Lower-cased type name without a trailing parenthesised parameter list."""
    return F.regexp_replace(F.lower(F.regexp_replace(data_type, r"^\s+|\s+$", "")), r"\s*\(.*\)\s*$", "")


def canonical_type(data_type: Column) -> Column:
    """Opt-in alias mapping; keeps the parameter list."""
    family = type_family(data_type)
    spelled = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])[family]
    params = F.regexp_extract(F.lower(F.trim(data_type)), r"(\(.*\))\s*$", 1)
    return F.when(spelled.isNotNull(), F.concat(spelled, params)).otherwise(data_type)


def is_widening(before_family: Column, after_family: Column) -> Column:
    """True for one step of the lattice; the two families must differ."""
    return F.concat(before_family, F.lit(">"), after_family).isin(_STEPS)


def is_narrowing(before_family: Column, after_family: Column) -> Column:
    return is_widening(after_family, before_family)


def capacity_grew(before: Column, after: Column) -> Column:
    b, a = before["character_max_length"], after["character_max_length"]
    return F.coalesce(a > b, F.lit(False))


def capacity_shrank(before: Column, after: Column) -> Column:
    return capacity_grew(after, before)


def precision_moved(before: Column, after: Column) -> Column:
    """Precision or scale differ, NULL counting as a value (families compared by the caller)."""
    return ~(
        before["numeric_precision"].eqNullSafe(after["numeric_precision"])
        & before["numeric_scale"].eqNullSafe(after["numeric_scale"])
    )


def enum_grew(before: Column, after: Column) -> Column:
    """Strict superset: something added, nothing removed, both sets known."""
    b, a = before["enum_values"], after["enum_values"]
    grew = (F.size(F.array_except(b, a)) == 0) & (F.size(F.array_except(a, b)) > 0)
    return b.isNotNull() & a.isNotNull() & grew
