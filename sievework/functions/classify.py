"""Cascades that sort free text into the few classes that reports use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Classes in report order, and word lists that decide.
KINDS = ("temporal_ordering", "resource_lifecycle", "state_machine", "precondition", "protocol")
KIND_WORDS = (("temporal_ordering", "temporal|order|sequence"), ("resource_lifecycle", "resource|lifecycle|cleanup"), ("state_machine", "state|machine"), ("precondition", "precondition|require"))
COMPILE_TIME = "cfg_select|cfg_if|cfg_attr|feature gate|conditional compilation|variant correctness|enum exhaustiveness|documentation policy|doc comment|api stability|compile-time"
VARIANT_TALK = "represents the state where|this variant|enum variant|represents a|represents the|simply wraps|just describes"
RETRYABLE = "429|rate limit|rate_limit|too many requests|500|502|503|529|overloaded|capacity|timeout|timed out|connection reset|connection refused|connection closed|broken pipe|eof|dns error|network|temporarily unavailable|server error"


def kind_of(c: Column) -> Column:
    """A stated kind brought to one of the five, protocol where nothing else fits."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(low.isin(*KINDS), low)
    for kind, rx in KIND_WORDS:
        out = out.when(low.rlike(rx), F.lit(kind))
    return out.otherwise(F.lit("protocol"))


def kind_of_text(pattern: Column, description: Column) -> Column:
    """The kind that a suggested pattern and a description speak of."""
    p, d = F.lower(F.coalesce(pattern, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(p.rlike("typestate|session") | d.rlike("order|sequence|before"), "temporal_ordering")
        .when(p.rlike("raii|drop") | d.rlike("cleanup|free|release|close"), "resource_lifecycle")
        .when(d.rlike("state|transition"), "state_machine")
        .when(d.rlike("must|precondition|require"), "precondition")
        .otherwise("protocol")
    )


def confidence_of(c: Column) -> Column:
    """high, low, or medium for everything else."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("high", "low"), low).otherwise("medium")


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def downgraded(c: Column) -> Column:
    return F.when(c == "high", "medium").otherwise("low")


def is_compile_time(entity: Column, name: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(entity, F.lit("")), F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")))).rlike(COMPILE_TIME)


def is_variant_talk(entity: Column, name: Column, description: Column, bare: Column) -> Column:
    """A finding that only describes an enum variant; ``bare``: it has no transitions and at most one state."""
    e, n, d = (F.lower(F.coalesce(x, F.lit(""))) for x in (entity, name, description))
    return (e.rlike("error|result") & d.rlike(VARIANT_TALK)) | (n.contains("::") & n.rlike("( state| variant)$") & bare)


def is_retryable(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike(RETRYABLE)


def retry_after(message: Column) -> Column:
    """Seconds that a message asks to wait, or null."""
    found = [F.nullif(F.regexp_extract(F.lower(message), rx + r"(\d+)", 1), F.lit("")) for rx in ("retry after ", "retry-after: ", "try again in ")]
    return F.coalesce(*found).cast("bigint")


def backoff_ms(attempt: Column, consecutive: Column, asked: Column, base: int = 1000) -> Column:
    """Milliseconds before the next try: what was asked for and a second, else exponential with a fixed jitter, at most five minutes."""
    d = F.lit(base) * F.pow(F.lit(2), attempt).cast("bigint") * (F.least(consecutive, F.lit(5)) + 1)
    j = F.floor(d / 4).cast("bigint")
    jitter = F.when(j > 0, F.pmod(attempt * 7 + consecutive * 13, 2 * F.greatest(j, F.lit(1)))).otherwise(0)
    return F.when(asked.isNotNull(), (asked + 1) * 1000).otherwise(F.least(d - j + jitter, F.lit(300_000))).cast("bigint")


def short_count(c: Column) -> Column:
    """1.2M, 34K or the number itself."""
    return F.when(c >= 1_000_000, F.format_string("%.1fM", c / 1e6)).when(c >= 1000, F.format_string("%.0fK", c / 1e3)).otherwise(c.cast("string"))


def overlap(a: Column, b: Column) -> Column:
    """Common part of two word sets' union; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def plain_words(c: Column) -> Column:
    """Distinct white-space words in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def cut_bytes(c: Column, limit: int, marker: str) -> Column:
    """At most ``limit`` bytes of UTF-8 at a character's end, with a marker if anything is gone."""
    heads = [F.try_validate_utf8(F.substring(F.encode(c, "UTF-8"), 1, k).cast("string")) for k in range(limit, limit - 4, -1)]
    return F.when(F.octet_length(c) > limit, F.concat(F.coalesce(*heads), F.lit(marker))).otherwise(c)
