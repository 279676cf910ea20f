"""Small column helpers used across the package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add computed columns that a later filter will not recompute.

    A filter on a projected column is normally pushed below the projection, with
    the column's expression copied into it. Over a chain of rules that copies
    every step into the next and evaluates all of it twice. The output of a
    generator stays where it is; filters on the other columns still move down.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def float_text(value: Column) -> Column:
    """Shortest decimal text of a double: ``250.0``, ``10000000.5``, ``1e+16``, ``1e-05``.

    Positional notation covers 1e-4 up to 1e16, an exponent form the rest.
    """
    java = value.cast("string")
    fixed = F.regexp_replace(value.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0*$", "$1")
    scientific = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), r"E-(\d)$", "E-0$1"), r"E(\d)", "e+$1"
    )
    return (
        F.when(~F.contains(java, F.lit("E")), java)
        .when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e16), fixed)
        .otherwise(F.replace(scientific, F.lit("E"), F.lit("e")))
    )


def joined(structs: Column, field: str, separator: str) -> Column:
    """Join one field of an already ordered array of structs."""
    return F.array_join(structs[field], separator)


def listed(type_: str, *items: tuple[Column, Column]) -> Column:
    """The values, in order, whose condition holds: an array of ``items``' (condition, value).

    Like ``array_compact`` over an array of ``when``s, but without a lambda, so it is compiled.
    """
    none = F.array().cast(f"array<{type_}>")
    if not items:
        return none
    return F.concat(*[F.when(condition, F.array(value)).otherwise(none) for condition, value in items])
