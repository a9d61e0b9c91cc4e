"""Duplicate findings: exact by key, fuzzy by title."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import confidence_of, confidence_rank, kind_of, plain_words
from ..functions.text import strip
from ..session import cut
from .similarity import HOT, meetings


def weighed(findings: DataFrame) -> DataFrame:
    """(id, entity, kind, title, rank, bytes): what deduplication goes by."""
    return findings.where("id IS NOT NULL").select("id", F.coalesce("entity", F.lit("")).alias("entity"), kind_of(F.col("invariant_type")).alias("kind"), F.coalesce("title", F.lit("")).alias("title"), confidence_rank(confidence_of(F.col("confidence"))).alias("rank"), F.coalesce(F.octet_length("evidence.code_snippet"), F.lit(0)).alias("bytes"))


def _best():
    return F.col("rank").desc(), F.col("bytes").desc(), F.col("id")


def exact(findings: DataFrame) -> DataFrame:
    """The best finding of each (entity, title, kind), where case and runs of white space do not count.

    Best is the higher confidence, then the longer snippet, then the smaller id. The window keeps
    one row a key and task before the shuffle, so repeated findings cannot skew it. Null fields
    count as empty, a null kind as protocol; findings without an id are left out.
    """
    level = lambda c: strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    w = Window.partitionBy(level(F.col("entity")), level(F.col("title")), "kind").orderBy(*_best())
    return weighed(findings).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def fuzzy(weighed_findings: DataFrame, hot: int = HOT) -> DataFrame:
    """Findings that remain when, best first, each is dropped that shares over 3/5 of its title's words with one kept.

    Compared are findings of one (lower-case entity, kind). Equal word sets keep their best at
    once; the others meet in pairs or, where a template crowds them, in groups
    (:mod:`.similarity`). What the greedy rule keeps is then found in rounds: who has no better
    rival left is kept, its rivals are dropped. Titles without words are all kept. Rounds end
    after as many as the longest chain of better rivals, and each writes one table to the shared
    folder.
    """
    rows = weighed_findings.withColumn("block", F.md5(F.concat_ws("\0", F.lower("entity"), "kind"))).withColumn("w", F.array_sort(plain_words(F.col("title"))))
    same = Window.partitionBy("block", "w").orderBy(*_best())
    reps = cut(rows.where("size(w) > 0").withColumn("place", F.row_number().over(same)).where("place = 1").drop("place"))
    state = cut(_rivals(reps, hot).withColumn("status", F.lit("open")))
    while not (left := state.where("status = 'open'")).isEmpty():
        top = left.groupBy("group").agg(F.max(F.when(F.col("low"), F.col("p"))).alias("low_top"), F.max(F.when(F.col("high"), F.col("p"))).alias("high_top"))
        beaten = F.coalesce((F.col("low") & (F.col("high_top") > F.col("p"))) | (F.col("high") & (F.col("low_top") > F.col("p"))), F.lit(False))
        won = left.join(top, "group").groupBy("id").agg(F.bool_or(beaten).alias("beaten"))
        judged = left.join(won, "id")
        winners = judged.where("NOT beaten").groupBy("group").agg(F.max("low").alias("low_kept"), F.max("high").alias("high_kept"))
        hit = F.coalesce(F.col("beaten") & ((F.col("low") & F.col("high_kept")) | (F.col("high") & F.col("low_kept"))), F.lit(False))
        out = judged.join(winners, "group", "left").groupBy("id").agg(F.when(~F.bool_or("beaten"), "kept").when(F.bool_or(hit), "out").otherwise("open").alias("now"))
        now = left.drop("status").join(out, "id").withColumnRenamed("now", "status")
        state = cut(now.unionByName(state.where("status = 'out'")).where("status <> 'kept'"))
    dropped = state.select(F.col("id").alias("out_id")).distinct()
    return reps.join(dropped, F.col("id") == F.col("out_id"), "left_anti").unionByName(rows.where("size(w) = 0")).drop("block", "w")


def _rivals(reps: DataFrame, hot: int) -> DataFrame:
    """(group, low, high, id, p): in a group each low member is similar to each high one; p orders by quality."""
    two, many = meetings(reps.select(F.col("id").alias("cid"), "block", "w"), hot)
    two = two.select(F.concat_ws(" ", "a", "b").alias("group"), F.lit(True).alias("low"), F.lit(True).alias("high"), F.explode(F.array("a", "b")).alias("id"))
    weight = reps.select("id", F.struct("rank", "bytes", (-F.col("id")).alias("early")).alias("p"))
    return two.unionByName(many).join(weight, "id")
