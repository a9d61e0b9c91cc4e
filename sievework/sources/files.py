"""Readers of source trees, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRESS = "run_id string, crate_name string, message_seq long, module_path string, status string, invariants_found long, tokens_used long, timestamp string, error string"
FINDING = "id long, invariant_type string, title string, description string, location struct<file_path string, line_start long, line_end long>, evidence struct<code_snippet string, explanation string>, suggested_pattern string, confidence string, entity string"


def rust_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, error): every *.rs below root, build output aside; what is not UTF-8 has an error instead of a text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.where(~F.col("path").contains("/target/")).select("path", text.alias("text"), F.when(text.isNull(), "read error: not valid UTF-8").alias("error"))


def crate_roots(files: DataFrame, base: str) -> DataFrame:
    """(crate, root, error), by crate: for each directory below base its src/lib.rs, src/main.rs, lib.rs or main.rs, in that order.

    A crate with none of them has an error instead; hidden directories and target are no crates.
    """
    crate = F.regexp_extract("path", base.strip("/") + r"/([^/]+)/", 1)
    rest = F.regexp_extract("path", base.strip("/") + r"/[^/]+/(.*)$", 1)
    place = F.array_position(F.array(*map(F.lit, ("src/lib.rs", "src/main.rs", "lib.rs", "main.rs"))), rest)
    ok = files.select("path", crate.alias("crate"), F.when(place > 0, place).alias("place")).where("crate NOT IN ('', 'target') AND NOT crate LIKE '.%'")
    found = ok.groupBy("crate").agg(F.min_by("path", "place").alias("root"))
    return found.withColumn("error", F.when(F.col("root").isNull(), "no crate root")).orderBy("crate")


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of progress logs; blank and malformed lines are passed over."""
    return spark.read.schema(PROGRESS).option("mode", "DROPMALFORMED").json(path)


def findings_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDING).option("mode", "DROPMALFORMED").json(path)


def report_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(file, payload, error): whole report files, as the drift operator takes them; what is no valid JSON has an error."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("payload"))
    return whole.withColumn("error", F.when(F.try_parse_json("payload").isNull(), "no valid JSON"))


def vectors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Test vectors, keyed by file; fields that a file leaves out are null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())


def settings(path: str) -> dict:
    import tomllib

    with open(path, "rb") as f:
        return tomllib.load(f)

