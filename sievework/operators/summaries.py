"""Counts and totals of findings, progress, tokens and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import KINDS, confidence_of, kind_of
from ..functions.text import strip


def count_if(c: Column, name: str) -> Column:
    return F.count_if(c).alias(name)


def by_kind(findings: DataFrame, kind: Column) -> DataFrame:
    """One row: the total and a count for each of the five kinds, zeros kept."""
    return findings.agg(F.count(F.lit(1)).alias("total"), *[count_if(kind == k, k) for k in KINDS])


def confidence_mix(findings: DataFrame) -> DataFrame:
    """(run_id, findings, high, medium, low, sure_percent)."""
    c = confidence_of(F.col("confidence"))
    mixed = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"), count_if(c == "high", "high"), count_if(c == "medium", "medium"), count_if(c == "low", "low"))
    return mixed.withColumn("sure_percent", F.round((F.col("high") + F.col("medium")) * 100 / F.col("findings"), 2))


def files_per_run(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id").agg(F.countDistinct("location.file_path").alias("files"))


def token_totals(usage: DataFrame) -> DataFrame:
    """(role, five sums, runs): detector, validator, and both together as grand."""
    kinds = ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens")
    side = lambda r: usage.select(F.lit(r).alias("role"), F.col(r).isNotNull().cast("int").alias("there"), *[F.col(f"{r}.{k}").alias(k) for k in kinds])
    both = side("detector").unionByName(side("validator"))
    total = both.rollup("role").agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in kinds], F.sum("there").cast("bigint").alias("runs"))
    return total.withColumn("role", F.coalesce("role", F.lit("grand")))


def progress_counters(progress: DataFrame) -> DataFrame:
    s = F.lower(strip(F.col("status")))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return progress.groupBy("run_id").agg(count_if(s == "completed", "completed"), count_if(s == "failed", "failed"), count_if(s == "skipped", "skipped"), zero("invariants_found"), zero("tokens_used"))


def coverage(chunks: DataFrame, completed: DataFrame, prefixes: list[str]) -> DataFrame:
    """One row: chunks that were and were not analysed, those on a priority path apart."""
    hit = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.coalesce(F.col("module_path"), F.lit("")).contains(p))
    done = completed.select("crate_name", "chunk_id", F.lit(True).alias("done"))
    both = chunks.select("crate_name", "chunk_id", hit.alias("hit")).join(done, ["crate_name", "chunk_id"], "left")
    d = F.coalesce("done", F.lit(False))
    return both.agg(count_if(F.col("hit") & d, "priority_done"), count_if(F.col("hit"), "priority_total"), count_if(~F.col("hit") & d, "other_done"), count_if(~F.col("hit"), "other_total"))


def consolidated(findings: DataFrame, programs: DataFrame) -> DataFrame:
    """(program, findings, one count a kind): every program, those without findings as zeros."""
    k = kind_of(F.col("invariant_type"))
    f = findings.groupBy("program").agg(F.count(F.lit(1)).alias("findings"), *[count_if(k == x, x) for x in KINDS])
    out = programs.select("program").distinct().join(f, "program", "left")
    return out.select("program", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("findings", *KINDS)])


def entity_overlap(findings: DataFrame, side: Column) -> DataFrame:
    """(shared, only_a, only_b): entities that findings of side 'a', of 'b', or of both name; one pass, no join."""
    e = findings.where("trim(coalesce(entity, '')) <> ''").select(F.lower(strip(F.col("entity"))).alias("e"), side.alias("side"))
    per = e.groupBy("e").agg(F.max((F.col("side") == "a").cast("int")).alias("a"), F.max((F.col("side") == "b").cast("int")).alias("b"))
    return per.agg(count_if((F.col("a") == 1) & (F.col("b") == 1), "shared"), count_if((F.col("a") == 1) & (F.col("b") == 0), "only_a"), count_if((F.col("a") == 0) & (F.col("b") == 1), "only_b"))
