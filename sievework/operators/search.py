"""The nearest vectors of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block.
BLOCK = 2048

_PACK = "dim int, ids array<long>, rows binary"


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of vectors of one length, scaled to length one, as one row each."""
    for b in batches:
        dims = b["embedding"].str.len().to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for i in range(0, len(at), BLOCK):
                part = b.iloc[at[i : i + BLOCK]]
                v = np.stack(part["embedding"]).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"dim": [d], "ids": [part["vec_id"].to_numpy()], "rows": [v.tobytes()]}).astype({"dim": "int32"})


def _nearest(k: int, threshold: float):
    """The k best of one block of vectors for each query of one block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, ids, rows, asked, asked_rows in zip(b["dim"], b["ids"], b["rows"], b["asked"], b["asked_rows"]):
                q, v = np.frombuffer(asked_rows).reshape(-1, dim), np.frombuffer(rows).reshape(-1, dim)
                sims = q @ v.T
                keep = sims >= threshold - 1e-9
                if len(ids) > k + 1:  # ties at the edge all stay, the window decides
                    keep &= sims >= np.partition(sims, -(k + 1), axis=1)[:, -(k + 1), None] - 1e-9
                i, j = np.nonzero(keep)
                yield pd.DataFrame({"query_id": asked[i], "vec_id": ids[j], "similarity": sims[i, j]})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, threshold: float = 0.1) -> DataFrame:
    """(query_id, vec_id, similarity, place): each query's ``k`` most similar vectors by cosine, itself aside, at or over ``threshold``.

    Exact: vectors and queries are packed into blocks within their own tasks, the blocks of vectors
    are spread over slices, every slice gets all blocks of queries, and each pair of blocks is one
    matrix product that passes on the best ``k``; a window merges these. Nothing passes through
    the driver. Null and empty vectors are left out, and vectors of another length than the
    query's; ties go to the smaller vec_id; similarities are rounded to six places first.
    """
    slices = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usable = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0"
    packed = lambda df: df.where(usable).select("vec_id", "embedding").mapInPandas(_packed, _PACK)
    own = packed(vectors).withColumn("slice", F.pmod(F.hash("ids"), F.lit(slices)))
    asked = packed(queries).select("dim", F.col("ids").alias("asked"), F.col("rows").alias("asked_rows"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    found = own.join(asked, ["dim", "slice"]).select("dim", "ids", "rows", "asked", "asked_rows").mapInPandas(_nearest(k, threshold), "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    near = found.where("query_id <> vec_id").withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") >= threshold)
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
