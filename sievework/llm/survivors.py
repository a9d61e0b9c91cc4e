"""The best representative of each group of duplicate findings, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_filled, letters_digits, strip, words
from ..operators.similarity import HOT, meetings
from ..session import cut
from .components import components

#: Spellings of a stated confidence, stages by trust, sections of an explanation.
STATED = ("high", "medium", "low", "med")
TRUST = {"validator": 3, "detector": 2, "imported": 1}
SECTIONS = "entity|states|transitions|evidence|implementation"


def filled_sections(explanation: Column) -> Column:
    """How many of the five sections hold more than nothing or a stand-in."""
    label = rf"(?im)^[ \t*_#>•-]*({SECTIONS})[*_ \t]*(?::|—|–|-)[*_]*"
    parts = F.slice(F.split(F.regexp_replace(F.coalesce(explanation, F.lit("")), label, "\u0001$1\u0002"), "\u0001"), 2, 2**30)
    named = F.transform(parts, lambda p: F.struct(F.lower(F.substring_index(p, "\u0002", 1)).alias("name"), is_filled(F.substring_index(p, "\u0002", -1)).alias("ok")))
    return F.size(F.array_distinct(F.transform(F.filter(named, lambda x: x["ok"]), lambda x: x["name"])))


def _classes(findings: DataFrame) -> DataFrame:
    """Findings that may have duplicates, with the block they can have them in and the class of equal word sets."""
    block = F.md5(F.concat_ws("\0", "run_id", letters_digits(F.col("entity")), letters_digits(F.coalesce("invariant_type", F.lit("")))))
    may = F.col("id").isNotNull() & F.col("run_id").isNotNull() & (strip(F.coalesce("entity", F.lit(""))) != "")
    base = findings.where(may).withColumn("block", block).withColumn("w", F.array_sort(words(F.col("title")))).where("size(w) > 0")
    return base.withColumn("cls", F.md5(F.concat_ws("\0", F.col("block"), F.col("w"))))


def links(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): word sets of one block of which more than three fifths is common, enough of them to chain all that are.

    classes: (cid, block, w). Where a template crowds sets into groups, each is linked to the
    group's smallest low member, so that links grow with the sets and not with their pairs.
    """
    pairs, groups = meetings(classes, hot)
    centre = groups.where("low").groupBy("group").agg(F.min("id").alias("b"))
    stars = groups.join(centre, "group").where("id <> b").select(F.col("id").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def duplicate_groups(findings: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(findings with their class, (cls, group_id) of the classes in groups of two or more findings)."""
    rows = _classes(findings)
    classes = cut(rows.groupBy("cls").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n"), F.first("block").alias("block"), F.first("w").alias("w")))
    rooted = components(links(classes.select("cid", "block", "w"), hot))
    grouped = classes.select("cls", "cid", "n").join(rooted.withColumnRenamed("node", "cid"), "cid", "left").select("cls", "n", F.coalesce("root", "cid").alias("group_id"))
    total = grouped.groupBy("group_id").agg(F.sum("n").alias("n")).where("n > 1").select("group_id")
    return rows, grouped.join(total, "group_id").select("cls", "group_id")


def survivors(findings: DataFrame, hot: int = HOT) -> DataFrame:
    """(group_id, confidence_id, explanation_id, pattern_id): for each group of two or more duplicates, whose row supplies each field.

    Each row stands as a candidate for each field that it can supply: a stated confidence by
    recorded_at, null oldest; an explanation by its filled sections, none of them included; a
    pattern that is no stand-in by the trust in its stage. Windows over (class, field), then over
    (group, field), keep the top candidate, ties by the smallest id; Spark limits each task to one
    candidate a window before it shuffles, so a group that holds a third of all rows costs little.
    A field that no row can supply is null. Findings with a null id or run, a blank entity or a
    title without words are in no group; a null invariant_type agrees with null. Other columns
    are not read. An empty table gives no rows.
    """
    lean = findings.select("id", "run_id", "entity", "invariant_type", "title", "confidence", "stage", "recorded_at", "suggested_pattern", F.col("evidence.explanation").alias("explanation"))
    rows, members = duplicate_groups(lean, hot)
    trust = F.coalesce(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])[letters_digits(F.col("stage"))], F.lit(0))
    offer = lambda field, ok, score: F.when(ok, F.struct(F.lit(field).alias("field"), score.cast("long").alias("score")))
    offers = F.array(
        offer("confidence", letters_digits(F.col("confidence")).isin(*STATED), F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(-(2**63)))),
        offer("explanation", F.lit(True), filled_sections(F.col("explanation"))),
        offer("pattern", is_filled(F.col("suggested_pattern")), trust),
    )
    candidates = rows.select("cls", "id", F.explode(F.filter(offers, lambda x: x.isNotNull())).alias("f")).select("cls", "id", "f.field", "f.score")
    best = F.col("score").desc(), F.col("id")
    top = candidates.withColumn("place", F.row_number().over(Window.partitionBy("cls", "field").orderBy(*best))).where("place = 1")
    top = top.drop("place").join(members, "cls").withColumn("place", F.row_number().over(Window.partitionBy("group_id", "field").orderBy(*best))).where("place = 1")
    pick = lambda field: F.max(F.when(F.col("field") == field, F.col("id"))).alias(f"{field}_id")
    return top.groupBy("group_id").agg(pick("confidence"), pick("explanation"), pick("pattern"))


def built(findings: DataFrame, hot: int = HOT) -> DataFrame:
    """One surviving record a group: the smallest id's row with the best confidence, explanation and pattern on offer."""
    s = survivors(findings, hot)
    other = lambda c, v, name: s.select("group_id", F.col(c).alias("id")).join(findings.select("id", v.alias(name)), "id").select("group_id", name)
    first = s.select(F.col("group_id").alias("id")).join(findings.select("id", "run_id", "invariant_type", "title", "entity"), "id").withColumnRenamed("id", "group_id")
    for c, v, name in (("confidence_id", letters_digits(F.col("confidence")), "confidence"), ("explanation_id", F.col("evidence.explanation"), "explanation"), ("pattern_id", F.col("suggested_pattern"), "suggested_pattern")):
        first = first.join(other(c, v, name), "group_id", "left")
    return first
