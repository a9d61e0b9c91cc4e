"""Queries of the general training-data problems (3, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, redelivery, twins
from ..session import table

COMPARED = {"location.file_path": twins.same_path, "entity": twins.same_text, "invariant_type": twins.same_label}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "report_files")).select("file_id", "field_path", "change_kind")


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "report_files"))


def p3_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Every name and type under which a field was found, in how many reports and since when."""
    return drift.alternatives(table(spark, d, "report_files"))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per report in the layout, with the branches that its drifting fields came in and the fields outside of it."""
    t = drift.one_table(table(spark, d, "report_files"))
    return t.select("file_id", "crate_name", "run_id", "written_at", *[F.col(f"summary.{f}.value").alias(f) for f in drift.SUMMARY], F.col("summary.temporal_ordering_count.branch").alias("temporal_ordering_branch"), F.col("summary.state_machine_count.branch").alias("state_machine_branch"), F.to_json("summary.extra").alias("extra"), F.to_json("invariants").alias("invariants"), F.to_json("parse_failures").alias("parse_failures"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of every report, whatever name, level and type they came in."""
    t = drift.one_table(table(spark, d, "report_files"))
    return t.select("file_id", *[F.col(f"summary.{f}.value").alias(f) for f in drift.SUMMARY])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.repeated(table(spark, d, "progress"))


def p4_once(spark: SparkSession, d: str) -> DataFrame:
    """Progress by status once every message counts once."""
    kept = redelivery.once(table(spark, d, "progress"))
    return kept.groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count(F.lit(1)).alias("messages"), F.sum("tokens_used").alias("tokens_used"))


def _twins(spark: SparkSession, d: str) -> DataFrame:
    return twins.differences(table(spark, d, "invariants"), table(spark, d, "invariants_mirror"), "id", COMPARED, "invariants", "mirror")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _twins(spark, d).select("id", "difference")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """How many ids differ in which way."""
    return _twins(spark, d).groupBy("difference").agg(F.count(F.lit(1)).alias("ids"))


QUERIES = {f.__name__: f for f in (p3_found, p3_changes, p3_alternatives, p3_table, p3_counts, p4_found, p4_once, p5_found, p5_report)}

_KEYED = r"""
WITH m AS (
  SELECT *, lower(regexp_replace(coalesce(status, ''), '^\s+|\s+$', '', 'g')) AS st,
    regexp_replace(module_path, '^\s+|\s+$', '', 'g') AS mp, regexp_replace(crate_name, '^\s+|\s+$', '', 'g') AS cn,
    epoch(CAST(regexp_replace(timestamp, '\.\d+', '') AS TIMESTAMPTZ)) AS sec,
    rpad(regexp_extract(timestamp, '\.(\d+)', 1), 12, '0') AS frac
  FROM progress),
k AS (
  SELECT *, row_number() OVER (
    PARTITION BY run_id, message_seq, CASE WHEN message_seq IS NULL THEN concat_ws('|', coalesce(cn, '~'), coalesce(mp, '~'), st, sec, frac) END
    ORDER BY delivery_no) AS copy FROM m)
"""

_SIDES = r"""
WITH a AS (SELECT id, replace(coalesce(regexp_replace(location.file_path, '^\s+|\s+$', '', 'g'), ''), '\', '/') AS p,
    coalesce(regexp_replace(entity, '^\s+|\s+$', '', 'g'), '') AS e, regexp_replace(lower(coalesce(regexp_replace(invariant_type, '^\s+|\s+$', '', 'g'), '')), '[\s_\-]+', '', 'g') AS t FROM invariants),
b AS (SELECT DISTINCT id, replace(coalesce(regexp_replace(location.file_path, '^\s+|\s+$', '', 'g'), ''), '\', '/') AS p,
    coalesce(regexp_replace(entity, '^\s+|\s+$', '', 'g'), '') AS e, regexp_replace(lower(coalesce(regexp_replace(invariant_type, '^\s+|\s+$', '', 'g'), '')), '[\s_\-]+', '', 'g') AS t FROM invariants_mirror),
an AS (SELECT id, regexp_replace(regexp_replace(p, '/+', '/', 'g'), '^(\./)+', '') AS p, e, t FROM a),
bn AS (SELECT DISTINCT id, regexp_replace(regexp_replace(p, '/+', '/', 'g'), '^(\./)+', '') AS p, e, t FROM b),
found AS (
  SELECT id, 'missing_in_mirror' AS difference FROM an WHERE id NOT IN (SELECT id FROM bn)
  UNION ALL SELECT id, 'missing_in_invariants' FROM bn WHERE id NOT IN (SELECT id FROM an)
  UNION ALL SELECT an.id, 'location.file_path' FROM an JOIN bn ON an.id = bn.id AND an.p <> bn.p
  UNION ALL SELECT an.id, 'entity' FROM an JOIN bn ON an.id = bn.id AND an.e <> bn.e
  UNION ALL SELECT an.id, 'invariant_type' FROM an JOIN bn ON an.id = bn.id AND an.t <> bn.t)
"""

# the names under which the two drifting counts are found in the test tables
_NAMES = {
    "temporal_ordering_count": ("temporal_ordering_count", "temporalOrderingCount", "temporal_count", "n_temporal_ordering", "TemporalOrdering", "by_type.temporal_ordering"),
    "state_machine_count": ("state_machine_count", "stateMachineCount", "fsm_count", "n_state_machine", "StateMachine", "by_type.state_machine"),
}


def _count(f: str) -> str:
    found = "coalesce(" + ", ".join(f"nullif(json_extract(j, '$.summary.{n}'), 'null')" for n in (*_NAMES.get(f, (f,)), f)) + ")"
    return f"CASE json_type({found}) WHEN 'ARRAY' THEN json_array_length({found}) WHEN 'VARCHAR' THEN TRY_CAST(trim(json_extract_string({found}, '$')) AS BIGINT) ELSE CAST(trunc(CAST({found} AS DOUBLE)) AS BIGINT) END AS {f}"


ORACLE = {
    "p3_counts": f"WITH r AS (SELECT file_id, CAST(payload AS JSON) AS j FROM report_files WHERE json_valid(payload)) SELECT file_id, {', '.join(map(_count, drift.SUMMARY))} FROM r",
    "p4_found": _KEYED + "SELECT delivery_no FROM k WHERE copy > 1",
    "p4_once": _KEYED + "SELECT lower(trim(status)) AS status, count(*) AS messages, CAST(sum(tokens_used) AS BIGINT) AS tokens_used FROM k WHERE copy = 1 GROUP BY 1",
    "p5_found": _SIDES + "SELECT id, difference FROM found",
    "p5_report": _SIDES + "SELECT difference, count(*) AS ids FROM found GROUP BY 1",
}
