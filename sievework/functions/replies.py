"""Model replies in free text: the JSON in them, labelled fields, search listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import confidence_of
from .text import strip

LABELS = ("Entity", "States", "Transitions", "Evidence", "Implementation")


def fenced(c: Column) -> Column:
    """What the first fence tagged json holds, else the first fence, else the text."""
    tagged = F.regexp_extract(c, r"(?s)```json[ \t]*\n?(.*?)```", 1)
    plain = F.regexp_extract(c, r"(?s)```[^\n`]*\n?(.*?)```", 1)
    return F.when(tagged != "", tagged).when(plain != "", plain).otherwise(c)


def json_part(c: Column, opening: str = "[", closing: str = "]") -> Column:
    """From the first opening to the last closing mark, or null if they are not both there in that order."""
    t = fenced(c)
    first = F.locate(opening, t)
    last = F.length(t) - F.locate(closing, F.reverse(t)) + 1
    there = (first > 0) & (F.locate(closing, t) > 0) & (last > first)
    return F.when(there, F.substring(t, first, last - first + 1))


def field(c: Column, label: str, labels: tuple[str, ...] = LABELS) -> Column:
    """What stands after a label up to the next one, trimmed; null if there is nothing."""
    others = "|".join(x for x in labels)
    rx = rf"(?is)(?:^|\n)[*\s]*{label}\b[*\s]*(?::|—)\**(.*?)(?=\n[*\s]*(?:{others})\b[*\s]*(?::|—)|\z)"
    return F.nullif(strip(F.regexp_replace(F.regexp_extract(c, rx, 1), r"^[*\s]+|[*\s]+$", "")), F.lit(""))


#: The fields that each entry of a detector's reply must have, with their types.
REQUIRED = {"name": "text", "kind": "text", "description": "text", "evidence": "texts", "suggested_pattern": "text", "implementation_sketch": "text", "confidence": "text"}
OPTIONAL = {"entity": "text", "states": "texts", "state": "text", "transitions": "texts"}


def decoded(c: Column, required: dict[str, str] = REQUIRED, optional: dict[str, str] = OPTIONAL) -> Column:
    """The number of entries in a reply's JSON array, all or nothing: null unless each entry has every required field, and each field its type.

    Types: text, whole, texts (a list of texts). A field of ``optional`` may be absent, not of another type.
    """
    items = F.try_parse_json(json_part(c)).try_cast("array<variant>")

    def typed(x: Column, name: str, kind: str) -> Column:
        v = F.try_variant_get(x, f"$.{name}", "variant")
        is_ = F.schema_of_variant(v)
        if kind == "texts":
            return is_.isin("ARRAY<STRING>", "ARRAY<VOID>")
        return is_ == {"text": "STRING", "whole": "BIGINT"}[kind]

    def fits(x: Column) -> Column:
        must = [F.coalesce(typed(x, n, k), F.lit(False)) for n, k in required.items()]
        may = [F.coalesce(typed(x, n, k), F.lit(True)) for n, k in optional.items()]
        return F.forall(F.array(*must, *may), lambda ok: ok)

    return F.when(F.forall(items, fits), F.size(items))


def explanation(entity: Column, states: Column, state: Column, transitions: Column, evidence: Column, implementation: Column) -> Column:
    """An explanation in labelled blocks; states, or else the one state, entity and transitions only where there are any."""
    none = F.array().cast("array<string>")
    states = F.when(F.size(F.coalesce(states, none)) > 0, states).when(F.coalesce(state, F.lit("")) != "", F.array(state)).otherwise(none)
    steps = F.transform(F.coalesce(transitions, none), lambda t: F.concat(F.lit("- "), t, F.lit("\n")))
    return F.concat(
        F.when(F.coalesce(entity, F.lit("")) != "", F.concat(F.lit("**Entity:** "), entity, F.lit("\n\n"))).otherwise(""),
        F.when(F.size(states) > 0, F.concat(F.lit("**States:** "), F.array_join(states, ", "), F.lit("\n\n"))).otherwise(""),
        F.when(F.size(steps) > 0, F.concat(F.lit("**Transitions:**\n"), F.array_join(steps, ""), F.lit("\n"))).otherwise(""),
        F.lit("**Evidence:** "), F.array_join(F.coalesce(evidence, none), "; "), F.lit("\n\n**Implementation:** "), F.coalesce(implementation, F.lit("")),
    )


def verdict(c: Column) -> Column:
    """(valid, adjusted_confidence) that a validator's reply states; a reply that is no JSON counts as valid with medium confidence.

    What the JSON leaves out is false and medium.
    """
    body = F.coalesce(json_part(c, "{", "}"), c)
    v = F.try_parse_json(body)
    said = F.from_json(F.when(v.isNotNull(), body), "struct<valid boolean, adjusted_confidence string>")
    return F.struct(F.when(v.isNull(), True).otherwise(F.coalesce(said["valid"], F.lit(False))).alias("valid"), confidence_of(said["adjusted_confidence"]).alias("adjusted_confidence"))


def prompt(template: str, **parts: Column) -> Column:
    """A template with each {name} replaced by the part of that name; null counts as empty. What parts hold is not read again."""
    import re

    out = [F.coalesce(parts[x[1:-1]], F.lit("")) if x[:1] == "{" and x[1:-1] in parts else F.lit(x) for x in re.split(r"(\{\w+\})", template)]
    return F.concat(*out)


def sections(c: Column, word: str = "INVARIANT") -> Column:
    """The parts of a reply in plain text that each describe one finding; none for an empty reply."""
    t = strip(F.coalesce(c, F.lit("")))
    none = (t == "") | (t == "[]") | t.contains(f"NO {word}S")
    parts = F.filter(F.slice(F.split(t, word), 2, 2**30), lambda p: ~p.startswith("S FOUND"))
    return F.when(none, F.array().cast("array<string>")).otherwise(parts)


def described(c: Column, labels: tuple[str, ...] = ("Name", "Description", "Kind", "Confidence", *LABELS)) -> Column:
    """The findings of a reply in plain text, a struct of their labelled fields each; parts without a Name or a Description are dropped."""
    one = lambda p: F.struct(*[field(p, x, labels).alias(x.lower()) for x in labels])
    return F.filter(F.transform(sections(c), lambda p: one(F.concat(F.lit("\n"), p))), lambda x: x["name"].isNotNull() & x["description"].isNotNull())


def hits(c: Column) -> Column:
    """The numbered entries of a search listing, as (path, similarity, line_start, line_end); entries without a line number are dropped."""

    def one(e: Column) -> Column:
        lines = F.transform(F.regexp_extract_all(e, F.lit(r"(?m)^\s*(\d+):"), F.lit(1)), lambda x: x.cast("int"))
        return F.struct(F.regexp_extract(e, r"(?m)^\s*\d+\.\s+(\S+\.rs)", 1).alias("path"), F.regexp_extract(e, r"Similarity:?\s*([0-9.]+)", 1).try_cast("double").alias("similarity"), F.array_min(lines).alias("line_start"), F.array_max(lines).alias("line_end"))

    found = F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), one)
    return F.filter(found, lambda x: (x["path"] != "") & x["line_start"].isNotNull())
