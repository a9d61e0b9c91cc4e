"""Checks of findings: citations, expected values, a validator's word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import confidence_of, downgraded
from ..functions.text import rust_lines, strip

CITED = r"line ([0-9]+): ([^;\n]*)"


def citations(findings: DataFrame, near: int = 5) -> DataFrame:
    """(id, cited, verified, rate, confidence): how many of the lines that a finding cites are in its snippet.

    A citation holds if its text is part of a line at most ``near`` from the one it names, or of the
    snippet in any case; an empty text does not. Without citations the rate is a half. Below 0.3
    the confidence is lowered.
    """
    e, snippet = F.coalesce("evidence.explanation", F.lit("")), F.coalesce("evidence.code_snippet", F.lit(""))
    rows = findings.select("id", confidence_of(F.col("confidence")).alias("stated"), F.arrays_zip(F.regexp_extract_all(e, F.lit(CITED), F.lit(1)).alias("n"), F.regexp_extract_all(e, F.lit(CITED), F.lit(2)).alias("t")).alias("c"), rust_lines(snippet).alias("lines"), F.lower(snippet).alias("low"))

    def holds(c: Column) -> Column:
        n, t = c["n"].cast("int"), strip(c["t"])
        around = F.slice(F.col("lines"), F.greatest(n - near, F.lit(1)), F.greatest(n + near - F.greatest(n - near, F.lit(1)) + 1, F.lit(0)))
        return (t != "") & (F.exists(around, lambda x: x.contains(t)) | F.col("low").contains(F.lower(t)))

    counted = rows.select("id", "stated", F.size("c").alias("cited"), F.size(F.filter("c", holds)).alias("verified"))
    rate = F.when(F.col("cited") == 0, 0.5).otherwise(F.col("verified") / F.col("cited"))
    return counted.select("id", "cited", "verified", F.round(rate, 6).alias("rate"), F.when(rate < 0.3, downgraded(F.col("stated"))).otherwise(F.col("stated")).alias("confidence"))


def compared(actual: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, passed): whether each expected field that is not null equals the actual one; null in expected asks for nothing."""
    a = actual.select(F.col(key), F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]).alias("a"))
    e = expected.select(F.col(key), F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]).alias("e"))
    both = a.join(e, key)
    checks = F.array(*[F.col(f"e.f{i}").isNull() | F.col(f"e.f{i}").eqNullSafe(F.col(f"a.f{i}")) for i in range(len(fields))])
    return both.select(key, F.forall(checks, lambda x: x).alias("passed"))


def validated(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, confidence): findings after a validator's verdicts (id, valid, adjusted_confidence).

    Invalid ones go; valid ones take the adjusted confidence; findings without a verdict stay as
    they are. Of several verdicts on one id any invalid one counts, and the least adjustment.
    """
    v = verdicts.groupBy("id").agg(F.min("valid").alias("valid"), F.min("adjusted_confidence").alias("adjusted"), F.lit(True).alias("seen"))
    both = findings.select("id", confidence_of(F.col("confidence")).alias("stated")).join(v, "id", "left")
    keep = F.coalesce("valid", F.lit(True))
    return both.where(keep).select("id", F.when(F.col("seen"), confidence_of(F.col("adjusted"))).otherwise(F.col("stated")).alias("confidence"))
