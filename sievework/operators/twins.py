"""Differences between two copies of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def same_text(c: Column) -> Column:
    """Null equals empty; outer white space never counts."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def same_path(c: Column) -> Column:
    """The kind of slash, doubled slashes and a leading ./ do not count either."""
    return F.regexp_replace(F.regexp_replace(same_text(c), r"[\\/]+", "/"), r"^(?:\./)+", "")


def same_label(c: Column) -> Column:
    """Case and word separators do not count either."""
    return F.regexp_replace(F.lower(same_text(c)), r"[\s_\-]+", "")


def differences(left: DataFrame, right: DataFrame, key: str, fields: dict[str, object], left_name: str, right_name: str) -> DataFrame:
    """One row for each key that a side lacks and for each field that differs.

    Both sides are tagged and unioned, grouped once by key, and one struct per side is kept;
    a generated higher-order expression then compares the structs field by field.
    ``fields`` maps a (nested) column to the normaliser that decides what counts.

    Result: (key, difference, left_value, right_value). difference is ``missing_in_<name>``
    or the field. Repeated rows of a side are no difference: the struct that sorts first
    stands for them, which the aggregate finds before the shuffle, so a key that holds a
    third of all rows moves as one row per task. A null key is a key like any other, on
    either side; other columns are not read; empty sides give the other's keys as missing.
    """
    names = list(fields)

    def tagged(df: DataFrame, side: int) -> DataFrame:
        values = F.struct(*[norm(F.col(n)).alias(f"f{i}") for i, (n, norm) in enumerate(fields.items())])
        return df.select(F.col(key).alias("k"), F.lit(side).alias("side"), values.alias("v"))

    both = tagged(left, 0).unionByName(tagged(right, 1))
    one = both.groupBy("k").agg(F.min(F.when(F.col("side") == 0, F.col("v"))).alias("l"), F.min(F.when(F.col("side") == 1, F.col("v"))).alias("r"))
    pairs = ", ".join(f"named_struct('difference', '{n}', 'left_value', l.f{i}, 'right_value', r.f{i})" for i, n in enumerate(names))
    gone = "array(named_struct('difference', '{}', 'left_value', string(null), 'right_value', string(null)))"
    found = f"""CASE WHEN r IS NULL THEN {gone.format("missing_in_" + right_name)}
                     WHEN l IS NULL THEN {gone.format("missing_in_" + left_name)}
                     ELSE filter(array({pairs}), x -> NOT (x.left_value <=> x.right_value)) END"""
    return one.select(F.col("k").alias(key), F.explode(F.expr(found)).alias("d")).select(key, "d.difference", "d.left_value", "d.right_value")
