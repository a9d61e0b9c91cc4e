"""Line ranges of findings: merged with context, and cut from the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rust_lines


def merged(ranges: DataFrame, context: int = 5) -> DataFrame:
    """(path, line_start, line_end, weight): ranges of a file padded by ``context`` and joined where they touch.

    ranges: (path, line_start, line_end, weight). Ranges that begin on one line are first reduced to
    the longest, in a partial aggregate, so a file's group is at most its number of lines. Ranges
    with a null are left out.
    """
    ok = ranges.where("path IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL")
    padded = ok.groupBy("path", F.greatest(F.col("line_start") - context, F.lit(0)).alias("s")).agg((F.max("line_end") + context).alias("e"), F.max("weight").alias("weight"))
    w = Window.partitionBy("path").orderBy("s")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("s") > F.max("e").over(before) + 1).cast("int"), F.lit(1))
    island = padded.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("path", "island").agg(F.greatest(F.min("s"), F.lit(1)).alias("line_start"), F.max("e").alias("line_end"), F.max("weight").alias("weight")).drop("island")


def sliced(findings: DataFrame, chunks: DataFrame, least: int = 20) -> DataFrame:
    """(id, region_lines, region): the source lines a finding points at, from files that are one chunk.

    Regions of fewer than ``least`` bytes, those past the file's end among them, are dropped.
    """
    files = chunks.where("raw_source IS NOT NULL AND chunk_id = module_path").select("file_path", "raw_source")
    f = findings.select("id", F.col("location.file_path").alias("file_path"), F.col("location.line_start").alias("s"), F.col("location.line_end").alias("e")).where("s >= 1 AND e >= s")
    lines = rust_lines(F.col("raw_source"))
    cut = F.slice(lines, F.col("s").cast("int"), (F.col("e") - F.col("s") + 1).cast("int"))
    out = f.join(files, "file_path").select("id", "file_path", cut.alias("c")).select("id", "file_path", F.size("c").cast("bigint").alias("region_lines"), F.array_join("c", "\n").alias("region"))
    return out.where(F.octet_length("region") >= least)
