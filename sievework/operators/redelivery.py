"""One copy of each message that was delivered at least once."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import files_at, work_path


def instant(ts: Column) -> Column:
    """An RFC 3339 text as whole microseconds and the digits below them: equal for equal instants, whatever the offset.

    What cannot be read as a time stands for itself, trimmed.
    """
    t = F.upper(strip(ts))
    digits = F.rpad(F.regexp_extract(t, r"\.(\d+)", 1), 12, "0")
    whole = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"\.\d+", ""), r"^(\S+)\s(\d)", "$1T$2"))
    return F.coalesce(F.concat(F.unix_seconds(whole).cast("string"), F.lit("."), digits), t)


def message_key() -> Column:
    """run_id and message_seq; without message_seq, run_id, crate_name, module_path, status and the instant of timestamp.

    Null agrees with null; outer white space of the names and the case of status do not count.
    """
    numbered = F.to_json(F.struct(F.lit("seq").alias("by"), F.col("run_id"), F.col("message_seq").cast("string").alias("seq")))
    named = [strip(F.col(c)).alias(c) for c in ("crate_name", "module_path")]
    described = F.to_json(F.struct(F.lit("row").alias("by"), F.col("run_id"), *named, F.lower(strip(F.col("status"))).alias("status"), instant(F.col("timestamp")).alias("at")))
    return F.when(F.col("message_seq").isNotNull(), numbered).otherwise(described)


ARRAYS = "prefix int, h1s array<long>, h2s array<long>, ats array<long>"
_LONG = ("h1s", "h2s", "ats")


def _opened(folder: str) -> list[np.ndarray] | None:
    """The sorted arrays of one prefix of a run, read by the task that needs them."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if folder.startswith("file:"):
        at, name = fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    else:
        at, name = fs.FileSystem.from_uri(folder)
    found = [x.path for x in at.get_file_info(fs.FileSelector(name, allow_not_found=True)) if x.path.endswith(".parquet")]
    tables = [pq.read_table(at.open_input_file(x), columns=list(_LONG)) for x in found]
    if not any(t.num_rows for t in tables):
        return None
    return [np.concatenate([t.column(c).combine_chunks().values.to_numpy(zero_copy_only=False) for t in tables]) for c in _LONG]


def _arrays(prefix: int, h1: np.ndarray, h2: np.ndarray, at: np.ndarray) -> dict:
    order = np.lexsort((h2, h1))
    return {"prefix": prefix, "h1s": h1[order], "h2s": h2[order], "ats": at[order]}


def _looked_up(path: str, runs: list[tuple[str, int]], bits: int):
    """Of the identifiers of one prefix: the arrays of those that no run holds, and the ``at`` of those that a run holds from the same row."""

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        h1, h2, at = (batch[c].to_numpy(np.int64) for c in ("h1", "h2", "at"))
        fresh, again = np.ones(len(batch), bool), np.zeros(len(batch), bool)
        for name, own in runs:
            if (held := _opened(f"{path}/{name}/prefix={key[0] >> (bits - own)}")) is None:
                continue
            a, b, c = held
            low, high = np.searchsorted(a, h1, "left"), np.searchsorted(a, h1, "right")
            for step in range(int((high - low).max(initial=0))):
                i = low + step
                inside = np.flatnonzero(i < high)
                same = inside[b[i[inside]] == h2[inside]]
                fresh[same] = False
                again[same] |= c[i[same]] == at[same]
        return pd.DataFrame([_arrays(key[0], h1[fresh], h2[fresh], at[fresh]) | {"again": at[again]}])

    return run


def _merged(bits: int):
    """The arrays of one prefix of several runs as one, split by the prefixes of ``bits`` bits."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        h1, h2, at = (np.concatenate([np.asarray(x, np.int64) for x in batch[c]]) for c in _LONG)
        prefix = (h1.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        return pd.DataFrame([_arrays(int(p), h1[prefix == p], h2[prefix == p], at[prefix == p]) for p in np.unique(prefix)], columns=["prefix", *_LONG])

    return run


class SeenIndex:
    """The identifiers seen so far, as sorted arrays by hash prefix in immutable runs under the shared folder.

    An identifier is a 128-bit hash; its leading bits are the prefix, and a run holds one folder a
    prefix with one sorted array of identifiers, each with the ``order`` value of the row it was
    first seen in. Incoming batches are deduplicated among themselves by a partial aggregate, then
    grouped by prefix, and each task opens its prefix's arrays in every run and binary-searches
    them: the index itself is never shuffled. What is novel becomes a run. Once ``merge_every``
    runs of one size stand at the end they are merged into one, so an identifier is rewritten a
    logarithmic number of times. Arrays hold about ``per_array`` identifiers: the number of bits
    follows from ``expected`` at first, is kept in the index's manifest, and grows as merged
    runs do.

    A row counts as the first of its message if the index holds its message from that very row.
    So a batch that is added again, after a crash or with a new stream checkpoint, gives what it
    gave before, and nothing else is taken for it. An index opened on a ``path`` that holds one
    goes on where it was, whatever ``expected`` says.
    """

    def __init__(self, spark: SparkSession, expected: int, per_array: int = 500_000, merge_every: int = 4, path: str | None = None):
        self.spark, self.merge_every, self.per_array = spark, max(2, merge_every), per_array
        self.files = files_at(spark, path or work_path(spark, "seen-index"))
        self.path = self.files.path
        if (manifest := self.files.read("manifest.json")) is None:
            self.bits = min(20, max(4, math.ceil(math.log2(max(1, expected) / per_array)))) if expected > 0 else 4
            self.files.write("manifest.json", json.dumps({"bits": self.bits}))
        else:
            self.bits = json.loads(manifest)["bits"]
        whole = sorted(n for n in self.files.names() if n.startswith("run-") and self.files.exists(f"{n}/_SUCCESS"))
        span = {n: self._span(n) for n in whole}
        self.runs = [n for n in whole if not any(m != n and span[m][0] <= span[n][0] and span[n][1] <= span[m][1] for m in whole)]
        self.old = [n for n in whole if n not in self.runs]
        self.count = max((z + 1 for _, z in span.values()), default=0)
        self.bits = max([self.bits, *(int(n.split("-")[3]) for n in self.runs)])

    @staticmethod
    def _span(name: str) -> tuple[int, int]:
        return int(name.split("-")[1]), int(name.split("-")[2])

    def _read(self, name: str) -> DataFrame:
        schema = ARRAYS if self._span(name)[0] < self._span(name)[1] else ARRAYS + ", again array<long>"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def add(self, batch: DataFrame, key: Column, order: str) -> DataFrame:
        """Index the batch; return the ``order`` value of each row that is the first of a message."""
        self.merge()
        ids = batch.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), F.col(order).cast("long").alias("at"))
        local = ids.groupBy("h1", "h2").agg(F.min("at").alias("at")).withColumn("prefix", F.shiftrightunsigned("h1", 64 - self.bits).cast("int"))
        known = [(n, int(n.split("-")[3])) for n in self.runs]
        found = local.groupBy("prefix").applyInPandas(_looked_up(self.path, known, self.bits), ARRAYS + ", again array<long>")
        name = f"run-{self.count:09d}-{self.count:09d}-{self.bits}"
        found.write.partitionBy("prefix").mode("overwrite").parquet(f"{self.path}/{name}")
        self.runs.append(name)
        self.count += 1
        return self._read(name).select(F.explode(F.concat("ats", "again")).alias(order))

    def merge(self) -> None:
        """While the last ``merge_every`` runs are of one size, one run in their place; :meth:`sweep` removes the old files."""
        size = lambda n: self._span(n)[1] - self._span(n)[0]
        while len(last := self.runs[-self.merge_every :]) == self.merge_every and len({size(n) for n in last}) == 1:
            parts = self._read(last[0]).select("prefix", *_LONG)
            for n in last[1:]:
                parts = parts.unionByName(self._read(n).select("prefix", *_LONG))
            wide = max(int(n.split("-")[3]) for n in last)
            held = parts.agg(F.sum(F.size("ats"))).first()[0] or 0
            bits = max(wide, self.bits, min(30, math.ceil(math.log2(max(1, held) / self.per_array))))
            narrow = min(int(n.split("-")[3]) for n in last)
            group = F.shiftrightunsigned(F.element_at("h1s", 1), 64 - narrow).cast("int")
            whole = parts.where("size(h1s) > 0").groupBy(group.alias("at_prefix")).applyInPandas(_merged(bits), ARRAYS)
            name = f"run-{self._span(last[0])[0]:09d}-{self._span(last[-1])[1]:09d}-{bits}"
            whole.write.partitionBy("prefix").mode("overwrite").parquet(f"{self.path}/{name}")
            self.bits, self.runs, self.old = bits, [*self.runs[: -len(last)], name], [*self.old, *last]

    def sweep(self) -> None:
        """Remove the files of runs that were merged; what :meth:`add` returned must have been used."""
        for n in self.old:
            self.files.remove(n)
        self.old = []


def repeated(messages: DataFrame, key: Column | None = None, order: str = "delivery_no", batches: int = 4) -> DataFrame:
    """The ``order`` value of every row that repeats an earlier message.

    The rows are taken as ``batches`` consecutive batches by ``order``, as they arrived, each
    against the index of those before, whose runs are merged two by two; of a message the row with
    the smallest ``order`` is kept. ``order`` must be a unique whole number; rows where it is null
    cannot be placed and are left out. Null parts of a key agree with null. Hot messages shrink to
    one row per task before the shuffle; what repeats is found by an anti-join on ``order``, which
    no message can skew. An empty table gives no rows; other columns are not read.
    """
    spark, key = messages.sparkSession, message_key() if key is None else key
    placed = messages.where(F.col(order).isNotNull())
    cuts = [i / batches for i in range(1, batches)]
    n, marks = placed.agg(F.count(order), F.percentile_approx(order, cuts, 10_000)).first()
    if not n:
        return placed.select(order)
    index = SeenIndex(spark, n, merge_every=2)
    edges = [None, *sorted(set(marks or [])), None]
    kept = None
    for low, high in zip(edges, edges[1:]):
        batch = placed
        batch = batch if low is None else batch.where(F.col(order) > low)
        batch = batch if high is None else batch.where(F.col(order) <= high)
        firsts = index.add(batch, key, order)
        kept = firsts if kept is None else kept.unionByName(firsts)
    return placed.select(order).join(kept, order, "left_anti")


def once(messages: DataFrame, key: Column | None = None, order: str = "delivery_no", batches: int = 4) -> DataFrame:
    """The messages, one copy each, with all their columns."""
    return messages.join(repeated(messages, key, order, batches), order, "left_anti")
