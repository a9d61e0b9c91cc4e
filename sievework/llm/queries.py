"""Queries of the training-text problems (1, 2, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leaks, mixture, pieces, sentences, survivors

#: Where the ranks of the public tokenizer lie on the machines that run these queries.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "invariants"))


def p1_built(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, its fields taken from the rows that offer the best."""
    return survivors.built(table(spark, d, "invariants"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(table(spark, d, "chunks")).select("crate_name", "chunk_id", F.explode("item_lines").alias("line_no"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "chunks"))


def _leaks(spark: SparkSession, d: str, **more) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), **more)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents that it leaked into."""
    n = _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return table(spark, d, "eval_items").select("item_id", "lang", "suite").join(n, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0).cast("long")))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """As p6_found, but one word or character of a passage may be missing, added or changed."""
    return _leaks(spark, d, edits=1, recall=0.95, shifts=True)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY)[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY)[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, d, "documents"))


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_built, p2_found, p2_pieces, p6_found, p6_items, p6_near, p7_shares, p7_mix, p8_found, p8_sentences)}
ORACLE: dict[str, str] = {}
