"""Places, running totals and the last value before a row, without one task holding a whole group."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the whole table that fall into one block of the order, about; and the most blocks there are.
SPAN, BLOCKS = 100_000, 4096

_EARLIEST = -9.3e18


def _micros(time: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(time).cast("timestamp")).cast("double"), F.lit(_EARLIEST))


def blocked(df: DataFrame, time: str, tie: str, span: int = SPAN) -> tuple[DataFrame, bool]:
    """df with ``_block``, and whether there is more than one: blocks follow each other in the order of (time, tie), each with about ``span`` rows of the table.

    Their edges are quantiles of time over all rows. A time that many rows share, null among them,
    is split by quantiles of ``tie``, a whole number; null times come first. So a group that holds
    a third of all rows is shared out however its times lie.
    """
    steps = [i / BLOCKS for i in range(1, BLOCKS)]
    wanted = min(BLOCKS, -(-df.count() // span))
    if wanted < 2:
        return df.withColumn("_block", F.lit(0).cast("long")), False
    times, ties = df.agg(F.percentile_approx(_micros(time), steps, 50_000), F.percentile_approx(F.col(tie).cast("double"), steps, 50_000)).first()
    pick = [round(i * BLOCKS / wanted) - 1 for i in range(1, wanted)]
    edges, lines = [times[i] for i in pick], [ties[i] for i in pick]
    heavy = sorted({a for a, b in zip([min(times), *edges], edges) if a == b})
    inf = float("inf")
    cutter = lambda at, col, out: Bucketizer(splits=[-inf, *sorted(set(at)), inf], inputCol=col, outputCol=out)
    df = cutter(edges + heavy, "_t", "_tb").transform(df.withColumn("_t", _micros(time)))
    if not heavy:
        return df.withColumn("_block", F.col("_tb").cast("long")).drop("_t", "_tb"), True
    df = cutter(lines, "_i", "_ib").transform(df.withColumn("_i", F.coalesce(F.col(tie).cast("double"), F.lit(_EARLIEST))))
    within = F.when(F.col("_t").isin(heavy), F.col("_ib")).otherwise(F.lit(wanted))
    return df.withColumn("_block", (F.col("_tb") * (wanted + 1) + within).cast("long")).drop("_t", "_tb", "_i", "_ib"), True


def _back(inner: DataFrame, blocks: DataFrame, group: list[str]) -> DataFrame:
    """What was found for the blocks, joined to their rows; null groups agree."""
    named = blocks.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_block").alias("_b"), *[c for c in blocks.columns if c not in (*group, "_block")])
    on = F.col("_block") == F.col("_b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return inner.join(named, on).drop("_b", *[f"_g{i}" for i in range(len(group))])


def numbered(df: DataFrame, group: list[str], time: str, tie: str, span: int = SPAN) -> DataFrame:
    """Adds ``seq``, the row's place in its group by (time, tie).

    Places are found within blocks, then the blocks' counts are added up. Null times come first,
    null groups are groups like any other.
    """
    df, many = blocked(df, time, tie, span)
    inner = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_block").orderBy(F.col(time).asc_nulls_first(), tie)))
    if not many:
        return inner.drop("_block").withColumnRenamed("_rn", "seq")
    past = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0))).drop("_n")
    return _back(inner, blocks, group).withColumn("seq", F.col("_before") + F.col("_rn")).drop("_block", "_rn", "_before")


def last_before(df: DataFrame, group: list[str], time: str, tie: str, value: Column, name: str, many: bool) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not null of the rows before this one in its group, by (time, tie).

    df and ``many`` come from :func:`blocked`. The value is found within the block, else it is the
    last of the blocks before.
    """
    df = df.withColumn("_value", value)
    here = Window.partitionBy(*group, "_block").orderBy(F.col(time).asc_nulls_first(), tie)
    inner = df.withColumn("_here", F.last("_value", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))).drop("_value")
    if not many:
        return inner.withColumnRenamed("_here", name)
    ends = df.groupBy(*group, "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(_micros(time), tie))).alias("_end"))
    past = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(past)).drop("_end")
    return _back(inner, blocks, group).withColumn(name, F.coalesce("_here", "_carried")).drop("_here", "_carried")


def running_total(df: DataFrame, group: list[str], order: str, value: str, span: int = 65_536) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over the rows of the group that come earlier by ``order``.

    ``order`` is a unique whole number. Totals are found within blocks of ``span`` of its values and
    the blocks' totals added up, so that no task holds more of a group than a block. Null values
    count as 0; null groups are groups like any other.
    """
    v = F.coalesce(F.col(value), F.lit(0))
    df = df.withColumn("_block", F.floor(F.col(order) / span))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_block").agg(F.sum(v).alias("_sum"))
    sums = sums.withColumn("_past", F.coalesce(F.sum("_sum").over(past(Window.partitionBy(*group).orderBy("_block"))), F.lit(0))).drop("_sum")
    inner = df.withColumn("_here", F.coalesce(F.sum(v).over(past(Window.partitionBy(*group, "_block").orderBy(order))), F.lit(0)))
    return _back(inner, sums, group).withColumn("before", F.col("_past") + F.col("_here")).drop("_block", "_past", "_here")
