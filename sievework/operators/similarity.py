"""Word sets of which more than three fifths of the union is common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Keys that more than HOT sets share are made longer.
HOT = 200

_KEY = ["block", "lo", "hi", "key"]


def least_common(n: Column, m: Column) -> Column:
    """Common words that sets of n and m words need for more than three fifths of their union."""
    return F.floor((n + m) * 3 / 8).cast("int") + 1


def _ranked(sets: DataFrame) -> DataFrame:
    """(cid, block, r, n, lengths): hashes of the words of each set that is not alone in its block, rarest in the block first, with the block's set sizes."""
    sized = sets.select("cid", "block", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).withColumn("n", F.size("h")).where("n > 0")
    at = sized.select("cid", "block", "n", F.explode("h").alias("word"))
    rare = at.groupBy("block", "word").agg(F.count(F.lit(1)).alias("df"))
    shape = sized.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_set("n")).alias("lengths")).where("k > 1").drop("k")
    ranked = at.join(rare, ["block", "word"]).groupBy("block", "cid").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"))
    return ranked.select("cid", "block", F.col("r.word").alias("r"), F.size("r").alias("n")).join(shape, "block")


def _paired(rows: DataFrame, key: list[str]) -> DataFrame:
    """(a, b): similar sets that share a key; a is the shorter or, of one size, the one with the smaller id."""
    x = rows.select(*key, F.col("cid").alias("a"), F.col("r").alias("ra"), F.col("n").alias("na"))
    y = rows.select(*key, F.col("cid").alias("b"), F.col("r").alias("rb"), F.col("n").alias("nb"))
    met = x.join(y, key).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    need = least_common(F.col("na"), F.col("nb"))
    return met.where((need <= F.col("na")) & (F.size(F.array_intersect("ra", "rb")) >= need)).select("a", "b")


def meetings(sets: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs, groups) that hold every similar pair of a block, and nothing else.

    sets: (cid, block, w), distinct words w. pairs: (a, b). groups: (group, low, high, id); in a
    group each low member is similar to each high one.

    Sets of n and m words need o common ones. With words ordered by rarity within the block, the
    first l of their common words are among the first n-o+l and m-o+l. Sets meet on the first of
    these, so that rare words carry the join and those of a template do not. Where more than
    ``hot`` sets share such a key it is made a word longer, level by level, for each pair of sizes
    apart: whoever is similar shares the longer key too. A key of o words that is still crowded is
    a group. So no key joins more than ``hot`` sets by pairs, whatever the titles' length, and a
    template that holds a third of all rows costs a number of rows linear in its sets. Each level
    is written to the shared folder.
    """
    rows = _ranked(sets)
    fits = lambda n, m: least_common(n, m) <= F.least(n, m)
    least = F.array_min(F.transform(F.filter("lengths", lambda m: fits(F.col("n"), m)), lambda m: least_common(F.col("n"), m)))
    first = F.slice("r", F.lit(1), F.col("n") - least + 1)
    keyed = cut(rows.select("cid", "block", "r", "n", "lengths", F.posexplode(first).alias("pos", "key")).where("pos IS NOT NULL"))
    crowded = cut(keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("block", "key"))
    spark = sets.sparkSession
    groups = [spark.createDataFrame([], "group string, low boolean, high boolean, id long")]
    if crowded.isEmpty():
        return _paired(keyed, ["block", "key"]).distinct(), groups[0]
    pairs = [_paired(keyed.join(crowded, ["block", "key"], "left_anti"), ["block", "key"])]
    front = keyed.join(crowded, ["block", "key"], "left_semi").withColumn("m", F.explode("lengths")).where(fits(F.col("n"), F.col("m")))
    front = front.withColumn("o", least_common(F.col("n"), F.col("m"))).where(F.col("pos") <= F.col("n") - F.col("o"))
    front = cut(front.select("cid", "block", "r", "n", "o", F.least("n", "m").alias("lo"), F.greatest("n", "m").alias("hi"), "key", "pos"))
    level = 1
    while True:
        met = front.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") == F.col("lo")).alias("lows"), F.count_if(F.col("n") == F.col("hi")).alias("highs"))
        met = met.where("k > 1 AND lows > 0 AND highs > 0").select(*_KEY, (F.col("k") > hot).alias("crowded"))
        live = cut(front.join(met, _KEY))
        pairs.append(_paired(live.where("NOT crowded"), _KEY))
        full = live.where(F.col("crowded") & (F.col("o") == level))
        groups.append(full.select(F.concat_ws(" ", *_KEY).alias("group"), (F.col("n") == F.col("lo")).alias("low"), (F.col("n") == F.col("hi")).alias("high"), F.col("cid").alias("id")))
        longer = live.where(F.col("crowded") & (F.col("o") > level))
        if longer.isEmpty():
            break
        nexts = F.sequence(F.col("pos") + 1, F.col("n") - F.col("o") + level)
        front = longer.withColumn("at", F.explode(nexts)).select("cid", "block", "r", "n", "o", "lo", "hi", F.xxhash64("key", F.get("r", F.col("at"))).alias("key"), F.col("at").alias("pos"))
        level += 1
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(pairs).distinct(), union(groups)
