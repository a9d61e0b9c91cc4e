"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for one machine: UTC, adaptive plans, as many shuffle partitions as cores."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    It is the one in ``spark.checkpoint.dir``. Only a ``local[...]`` session without that
    setting gets a temporary folder; on a cluster its absence is an error, since executors
    could not read each other's machine-local files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sievework-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
        Files(spark, sc.getCheckpointDir()).forget_at_end()  # a folder of this session's own below the named one
    return named


class Files:
    """Names, small texts and removal below one folder of the file system that it lies on."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._fs.makeQualified(at).toString().rstrip("/")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        at = self._jvm.org.apache.hadoop.fs.Path(self.path)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def forget_at_end(self) -> None:
        """Remove the folder when the driver ends."""
        self._fs.deleteOnExit(self._jvm.org.apache.hadoop.fs.Path(self.path))


def files_at(spark: SparkSession, path: str) -> Files:
    return Files(spark, path)


def work_path(spark: SparkSession, name: str) -> str:
    """A path for a table of one run, under the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    Files(spark, path).forget_at_end()
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores, for work that costs far more than a shuffle: as it is if its scan has that many tasks, else by hash of ``keys``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
