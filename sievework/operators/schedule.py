"""What is still to be analysed, in which order, within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .order import running_total


def completed(progress: DataFrame) -> DataFrame:
    """(crate_name, chunk_id) of what a log calls completed; failed and skipped ones are tried again."""
    done = F.lower(strip(F.col("status"))) == "completed"
    return progress.where(done & F.col("module_path").isNotNull()).select("crate_name", F.col("module_path").alias("chunk_id")).distinct()


def pending(chunks: DataFrame, progress: DataFrame) -> DataFrame:
    return chunks.join(completed(progress), ["crate_name", "chunk_id"], "left_anti")


def within_budget(rows: DataFrame, group: list[str], order: str, tokens: str, budget: int, priority: Column) -> DataFrame:
    """Adds ``taken``: priority rows always, others while the tokens before them are below ``budget`` (0: no limit)."""
    out = running_total(rows, group, order, tokens)
    return out.withColumn("taken", priority | (F.col("before") < budget) if budget else F.lit(True))
