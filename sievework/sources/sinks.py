"""Writers of logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import KINDS, confidence_of, kind_of


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object a line, added to what is there."""
    rows.write.mode("append").json(path)


def run_directory(model: Column, at: Column, mode: Column) -> Column:
    """runs/<model>_<yyyymmdd>_<hhmmss>_<mode>, with the model's separators as underscores."""
    return F.concat(F.lit("runs/"), F.translate(model, "/.:", "___"), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), mode)


#: Headings of a report's sections in the order of the kinds, and the lines of its summary.
HEADINGS = ("Temporal Ordering Invariants", "Resource Lifecycle Invariants", "State Machine Invariants", "Precondition Invariants", "Protocol Invariants")
BULLETS = ("Total invariants discovered", "Temporal ordering", "Resource lifecycle", "State machine", "Precondition", "Protocol", "Modules analyzed")
COUNTS = ("total_invariants", "temporal_ordering_count", "resource_lifecycle_count", "state_machine_count", "precondition_count", "protocol_count", "modules_analyzed")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def report_summary(findings: DataFrame, failures: DataFrame, group: str) -> DataFrame:
    """(group, seven counts, failures): one row for each group that has findings or unreadable files; modules are distinct files."""
    k = kind_of(F.col("invariant_type"))
    f = findings.groupBy(group).agg(F.count(F.lit(1)).alias(COUNTS[0]), *[F.count_if(k == x).alias(n) for x, n in zip(KINDS, COUNTS[1:])], F.count_distinct("location.file_path").alias(COUNTS[6]), F.max("id").alias("last_id"))
    both = f.join(failures.groupBy(group).agg(F.count(F.lit(1)).alias("failures"), F.max("file").alias("last_file")), group, "full")
    return both.select(group, *[F.coalesce(c, F.lit(0)).alias(c) for c in (*COUNTS, "failures")], "last_id", "last_file")


def report_json(findings: DataFrame, failures: DataFrame, group: str) -> DataFrame:
    """(group, section, place, line): the lines of each group's JSON report; in the order of section and place they are one document.

    The summary comes first, then an entry a finding by id, then the files that could not be read.
    failures: (group, file, error). A report is never gathered: commas come from each group's last
    id, which an aggregate finds. Ids are unique; findings without one are left out.
    """
    entry = F.struct("id", kind_of(F.col("invariant_type")).alias("invariant_type"), "title", "description", "location", "evidence", "suggested_pattern", confidence_of(F.col("confidence")).alias("confidence"), "entity")
    known = findings.where("id IS NOT NULL")
    s = report_summary(known, failures, group)
    head = s.select(group, F.lit(0).alias("section"), F.lit("").alias("place"), F.concat(F.lit('{"summary": '), F.to_json(F.struct(*COUNTS)), F.lit(', "invariants": [')).alias("line"))
    ends = s.select(F.col(group).alias("_g"), "last_id", "last_file")
    placed = lambda df: df.join(ends, F.col(group).eqNullSafe(F.col("_g")))
    body = placed(known).select(group, F.lit(1), F.lpad(F.col("id").cast("string"), 20, "0"), F.concat(F.to_json(entry, {"ignoreNullFields": "false"}), F.when(F.col("id") < F.col("last_id"), ",").otherwise("")))
    middle = s.select(group, F.lit(2), F.lit(""), F.lit('], "parse_failures": ['))
    lost = placed(failures).select(group, F.lit(3), "file", F.concat(F.to_json(F.array("file", "error")), F.when(F.col("file") < F.col("last_file"), ",").otherwise("")))
    tail = s.select(group, F.lit(4), F.lit(""), F.lit("]}"))
    return head.union(body).union(middle).union(lost).union(tail)


def report_markdown(findings: DataFrame, failures: DataFrame, group: str) -> DataFrame:
    """(group, section, place, block): the blocks of each group's Markdown report; in the order of section and place they are one document.

    Section 0 is the title with the summary's seven lines, 1 to 5 are the kinds that have findings,
    each led by its heading, 6 lists the files that could not be read. failures: (group, file, error).
    """
    s = report_summary(findings, failures, group)
    lines = F.concat(*[F.concat(F.lit(f"- **{b}**: "), F.col(c), F.lit("\n")) for b, c in zip(BULLETS, COUNTS)])
    title = s.select(group, F.lit(0).alias("section"), F.lit("").alias("place"), F.concat(F.lit("# Latent Invariant Analysis Report\n\n## Summary\n\n"), lines, F.lit("\n")).alias("block"))
    section = F.array_position(F.array(*map(F.lit, KINDS)), kind_of(F.col("invariant_type"))).cast("int")
    named = F.array(*[F.struct(F.lit(i + 1).alias("section"), F.lit(h).alias("heading"), F.col(c).alias("n")) for i, (h, c) in enumerate(zip(HEADINGS, COUNTS[1:6]))])
    heads = s.select(group, F.inline(F.filter(named, lambda x: x["n"] > 0))).select(group, "section", F.lit(""), F.concat(F.lit("## "), "heading", F.lit("\n\n")))
    explained = _text("evidence.explanation")
    block = F.concat(
        F.lit("### "), _text("id"), F.lit(". "), _text("title"), F.lit("\n\n**Location**: `"), _text("location.file_path"), F.lit(":"), _text("location.line_start"), F.lit("-"), _text("location.line_end"),
        F.lit("`\n\n**Confidence**: "), F.initcap(confidence_of(F.col("confidence"))), F.lit("\n\n**Suggested Pattern**: "), _text("suggested_pattern"), F.lit("\n\n**Description**: "), _text("description"),
        F.lit("\n\n**Evidence**:\n\n```rust\n"), _text("evidence.code_snippet"), F.lit("\n```\n\n"), F.when(explained != "", F.concat(explained, F.lit("\n\n"))).otherwise(""), F.lit("---\n\n"),
    )
    body = findings.select(group, section, F.lpad(_text("id"), 20, "0"), block)
    skipped = s.where("failures > 0").select(group, F.lit(6), F.lit(""), F.concat(F.lit("## Skipped Files\n\n"), F.col("failures"), F.lit(" file(s) could not be parsed:\n\n")))
    lost = failures.select(group, F.lit(6), "file", F.concat(F.lit("- `"), "file", F.lit("`: "), "error", F.lit("\n")))
    return title.union(heads).union(body).union(skipped).union(lost)


def write_report(lines: DataFrame, group: str, path: str) -> None:
    """One folder a group; its part files, in the order of their names, are the document.

    Rows are spread by ranges of (group, section, place), so a group that holds a third of all
    rows is written by many tasks.
    """
    keys = [F.col(group), F.col("section"), F.col("place")]
    text = lines.columns[-1]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(group, F.col(text).alias("value")).write.partitionBy(group).mode("overwrite").text(path)


def usage_json(usage: DataFrame) -> DataFrame:
    """(run_id, usage): the JSON of each run's token counts, detector, validator and their sum; runs without any have none. Null counts are 0."""
    kinds = ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens")
    side = lambda r: F.struct(*[F.coalesce(F.col(f"{r}.{k}"), F.lit(0)).cast("long").alias(k) for k in kinds])
    both = usage.select("run_id", side("detector").alias("detector"), side("validator").alias("validator")).withColumn("grand_total_tokens", F.col("detector.total_tokens") + F.col("validator.total_tokens"))
    return both.where("grand_total_tokens > 0").select("run_id", F.to_json(F.struct("detector", "validator", "grand_total_tokens")).alias("usage"))


def consolidated_markdown(reports: DataFrame) -> DataFrame:
    """(section, place, line): one document over all programs, each by its latest report.

    reports: (program, written_at, file_id, payload). Section 0 are the totals, 1 the programs with
    findings, 2 those without, 3 those whose latest report cannot be read; within a section by
    program. Only one report a program and task is kept before the shuffle.
    """
    last = reports.where("program IS NOT NULL").groupBy("program").agg(F.max_by("payload", F.struct("written_at", "file_id")).alias("payload"))
    read = last.select("program", F.try_parse_json("payload").isNotNull().alias("readable"), F.coalesce(F.json_array_length(F.get_json_object("payload", "$.invariants")), F.lit(0)).alias("n"))
    with_, without, failed = F.col("readable") & (F.col("n") > 0), F.col("readable") & (F.col("n") <= 0), ~F.col("readable")
    t = read.agg(F.count(F.lit(1)).alias("programs"), F.count_if(with_).alias("with"), F.count_if(without).alias("without"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(F.when(F.col("readable"), F.col("n"))), F.lit(0)).alias("found"))
    rows = F.array(*[F.struct(F.lit(str(i)).alias("place"), F.concat(F.lit(f"| {name} | "), F.col(c), F.lit(" |")).alias("line")) for i, (name, c) in enumerate((("Total programs analyzed", "programs"), ("Programs with invariants", "with"), ("Programs without invariants", "without"), ("Programs that failed", "failed"), ("**Total invariants found**", "found")))])
    totals = t.select(F.inline(rows)).select(F.lit(0).alias("section"), "place", "line")
    line = F.when(with_, F.concat(F.lit("- ["), "program", F.lit("](#"), F.lower(F.regexp_replace("program", "[_ ]", "-")), F.lit(") ("), F.col("n"), F.lit(" invariants)"))).when(without, F.concat(F.lit("- "), "program")).otherwise(F.concat(F.lit("- "), "program", F.lit(" (error: no valid JSON)")))
    return totals.union(read.select(F.when(with_, 1).when(without, 2).otherwise(3), "program", line))
