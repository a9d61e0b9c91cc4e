"""A mix of sources by target weights, fitted to the token."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letters_digits
from ..session import cut, spread

#: The pattern that byte-level BPE vocabularies of 50k ranks cut words by.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one source and length are chosen bucket by bucket of their seeded hash.
BUCKETS = 64
#: Targets up to this number are sent to all tasks; more are joined by shuffle.
SENT = 10_000


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            out = b.drop(columns="text")
            out["tokens"] = [len(own.encode_ordinary(t)) for t in b["text"]]
            yield out

    return run


def token_lengths(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens) of each document with a text; source is lower case without separators."""
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), letters_digits(F.coalesce("source", F.lit(""))).alias("source"), "text")
    return spread(docs, "doc_id").mapInPandas(_count(vocabulary), "doc_id long, source string, tokens long").where("tokens > 0")


#: Tokens of slack beyond the longest document that the knapsack gets at first, and bits that its table may take.
SLACK, TABLE = 1000, 1 << 31


def even_share(counts: np.ndarray, part: float) -> np.ndarray:
    """``part`` of the documents, spread evenly over the lengths: of the documents in order of length, those where part * place passes a whole number."""
    upto = np.floor(np.cumsum(counts) * part + 1e-9).astype(np.int64)
    return np.diff(upto, prepend=0)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (ascending) make up ``budget`` tokens, or the most below it.

    Whatever the size, every length first gives its even share of the budget. A few documents,
    spread evenly again, are then given back, so that some tokens are open, and a bounded knapsack
    fills those from all documents left: bit i of an integer says whether i tokens can be made,
    and each length joins in by halves of its remaining count. The way back reads the choice off
    the stored integers. If the open tokens cannot be made up exactly, twice as many are given
    back, until all are or the table would take more than ``TABLE`` bits.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = even_share(counts, budget / total)
    mean = total / int(counts.sum())
    want, best, best_sum = int(lengths.max()) + SLACK, None, -1
    while True:
        held = int(share.sum())
        over = int((share * lengths).sum()) - budget
        back = min(held, max(1, math.ceil((want + over) / mean)))
        took = share - even_share(share, back / held) if held else share.copy()
        while (room := budget - int((took * lengths).sum())) < 0:  # the share of few documents may be over the budget
            took[np.flatnonzero(took)[-1]] -= 1
        took = _filled(lengths, counts, took, room)
        if (reached := int((took * lengths).sum())) > best_sum:
            best, best_sum = took, reached
        want *= 2
        if best_sum == budget or back == held or want * len(lengths) > TABLE:
            return best


def _filled(lengths: np.ndarray, counts: np.ndarray, took: np.ndarray, room: int) -> np.ndarray:
    """``took`` with documents added that make up ``room`` tokens, or the most below."""
    took, items = took.copy(), []
    # lengths join in mixed order, so that what is added leans to none
    for i in np.random.default_rng(len(lengths)).permutation(len(lengths)):
        left, k = min(int(counts[i] - took[i]), room // int(lengths[i])), 1
        while left > 0:
            k_ = min(k, left)
            items.append((i, k_, k_ * int(lengths[i])))
            left -= k_
            k *= 2
    full = (1 << (room + 1)) - 1
    reach, kept = 1, [1]
    for _, _, size in items:
        reach |= (reach << size) & full
        kept.append(reach)
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for j in range(len(kept) - 1, 0, -1):
        if not kept[j - 1] >> at & 1:
            i, k, size = items[j - 1]
            took[i] += k
            at -= size
    return took


def _fit_source(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(source, tokens, rounds, extra): each document ``rounds`` times, and ``extra`` documents of the length once more."""
    rows = rows.sort_values("tokens")
    lengths, counts = rows["tokens"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    budget, most = int(rows["budget"].iloc[0]), int(rows["max_repeats"].iloc[0])
    total = int((lengths * counts).sum())
    rounds = min(most, budget // total)
    extra = fit(lengths, counts, budget - rounds * total) if rounds < most else np.zeros_like(counts)
    return pd.DataFrame({"source": rows["source"], "tokens": lengths, "rounds": rounds, "extra": extra})


def _goals(targets: DataFrame) -> DataFrame:
    """Targets by the source's bare spelling; targets that differ in spelling only are one, with their shares added."""
    usable = targets.where("source IS NOT NULL AND target_share > 0")
    return usable.groupBy(letters_digits(F.col("source")).alias("source")).agg(F.min("source").alias("name"), F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str, total_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): the documents to take with how often, and what each source reached.

    A source's budget is its share of ``total_tokens``, by default all tokens of the documents
    whose source has a target. Tokens are those of the byte-level BPE whose ranks lie at
    ``vocabulary``, a path that every executor can read. Documents are counted by exact token length; a source is taken
    whole as often as its budget holds it, up to max_repeats, and what remains of the budget is
    given evenly over the lengths and then fitted to the token by a bounded knapsack. Which documents of a length are
    taken is decided by a seeded hash of doc_id. So no document is used more than max_repeats
    times, a source misses its budget only where it is too scarce (or no sum of its lengths fits),
    and a run can be repeated exactly.

    mix: (doc_id, source, tokens, copies). shares: (source, target_share, max_repeats, documents,
    available_tokens, budget_tokens, used_tokens, documents_used, budget_share, actual_share), a
    row per target, absent sources too; actual_share is of the tokens in the mix, budget_share of
    ``total_tokens``. Null and empty texts, null sources and sources without a target are not
    used. max_repeats null counts as 1. Other columns are not read.

    Only counts by (source, length) meet in one task. Documents are chosen in hash buckets of
    (source, length): whole buckets by their counts, and a window within the one where the choice
    ends, so neither a source nor a length that holds a third of all rows is ordered in one place.
    """
    spark = documents.sparkSession
    goals = _goals(targets)
    sized = token_lengths(documents, vocabulary)
    # the pass through the tokenizer is written once and read by all that follows
    small = F.broadcast if goals.count() <= SENT else lambda df: df
    sized = cut(sized.join(small(goals.select("source")), "source"))
    by_length = sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"))
    have = by_length.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("tokens")).alias("available_tokens"))
    if total_tokens is None:
        total_tokens = have.agg(F.sum("available_tokens")).first()[0] or 0
    goals = goals.withColumn("budget", F.floor(F.col("target_share") * F.lit(total_tokens) + F.lit(1e-6)))
    fitted = cut(by_length.join(goals.select("source", "budget", "max_repeats"), "source").groupBy("source").applyInPandas(_fit_source, "source string, tokens long, rounds long, extra long"))
    place = F.xxhash64(F.lit(seed), "doc_id")
    lean = sized.withColumn("place", place).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)).cast("int"))
    group = ["source", "tokens"]
    over = Window.partitionBy(*group).orderBy("bucket")
    buckets = lean.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    plan = buckets.join(fitted, group).withColumn("quota", F.greatest(F.lit(0), F.least(F.col("k"), F.col("extra") - (F.col("upto") - F.col("k"))))).where("rounds > 0 OR quota > 0").select(*group, "bucket", "rounds", "k", "quota")
    marked = lean.join(plan, [*group, "bucket"])
    clear = (F.col("quota") == 0) | (F.col("quota") == F.col("k"))
    whole = marked.where(clear).withColumn("copies", F.col("rounds") + (F.col("quota") > 0).cast("long"))
    within = Window.partitionBy(*group, "bucket").orderBy("place", "doc_id")
    edge = marked.where(~clear).withColumn("copies", F.col("rounds") + (F.row_number().over(within) <= F.col("quota")).cast("long"))
    shape = lambda df: df.where("copies > 0").join(small(goals.select("source", "name")), "source").select("doc_id", F.col("name").alias("source"), "tokens", "copies")
    mix = shape(whole).unionByName(shape(edge))
    used = mix.groupBy(F.col("source").alias("name")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("documents_used"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    shares = goals.join(have, "source", "left").join(used, "name", "left").select(F.col("name").alias("source"), "target_share", "max_repeats", none(F.col("documents")).alias("documents"), none(F.col("available_tokens")).alias("available_tokens"), F.col("budget").cast("long").alias("budget_tokens"), none(F.col("used_tokens")).alias("used_tokens"), none(F.col("documents_used")).alias("documents_used"))
    grand = shares.agg(F.sum("used_tokens").alias("all_used"))
    share = lambda part, of: F.when(of > 0, part / of).otherwise(F.lit(0.0))
    shares = shares.join(F.broadcast(grand)).withColumn("budget_share", share(F.col("used_tokens"), F.lit(total_tokens))).withColumn("actual_share", share(F.col("used_tokens"), F.col("all_used"))).drop("all_used")
    return mix, shares

