"""JSON reports whose schema drifts from file to file: one table, every change, and every alternative."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from . import order

#: The layout that reports are brought to.
SUMMARY = ("total_invariants", "temporal_ordering_count", "resource_lifecycle_count", "state_machine_count", "precondition_count", "protocol_count", "modules_analyzed")
ENTRY = ("id", "invariant_type", "title", "location", "confidence", "entity")
PLACE = ("file_path", "line_start", "line_end")
LAYOUT = {"summary": SUMMARY, "invariants": tuple(f for f in ENTRY if f != "location"), "location": PLACE}
#: Scopes whose changes count, and those beside them that only the table and the alternatives tell of.
COUNTED, BESIDE = ("summary", "invariants"), ("location", "beside")
#: Paths of a summary and of entries that are neither object nor list; they stand for no field.
BARE = ("../summary", "../invariants")
#: A name stands for a field of the layout only if at most this part of its reports holds the field as well ...
TOGETHER = 0.05
#: ... and at least this part of the field's moves, or of the reports without it, speaks for the name. So at most a thousand names a field are fused.
SUPPORT = 0.001

#: Reports of the whole table in one block of the order, about.
SPAN = order.SPAN

PATH = "struct<path string, type string>"


_TYPES = {type(None): None, bool: "true/false", int: "whole", float: "decimal", str: "text", dict: "object"}


def _type(v: object) -> str | None:
    return _TYPES.get(type(v), "list")


def _leaves(value: object, path: str | None = None) -> Iterator[tuple[str, object]]:
    rest = [(path, value)]  # a stack of its own, since reports may be nested deeper than calls can be
    while rest:
        path, value = rest.pop()
        if isinstance(value, dict):
            rest += [(k if path is None else f"{path}.{k}", v) for k, v in reversed(value.items())]
        elif path is not None:
            yield path, value


def _never(text: str) -> None:
    raise ValueError(text)


def loaded(payload: str | None) -> dict | None:
    """The report, or None for what is null, no valid JSON or no object."""
    sys.set_int_max_str_digits(0)  # long numbers are valid JSON
    try:
        report = json.loads(payload or "", parse_constant=_never)
        if "\\ud" in payload.lower():  # halves of surrogate pairs are no text; they become question marks
            report = json.loads(json.dumps(report, ensure_ascii=False).encode("utf-8", "replace"))
    except (ValueError, RecursionError):
        return None
    return report if isinstance(report, dict) else None


def _parts(report: dict) -> tuple[list[tuple[str, object]], list]:
    """(leaves of the summary, those outside of it as ../name; entries).

    An object in place of the list of entries is one entry. What else stands for summary or
    entries, null aside, is a leaf outside of it.
    """
    summary, entries = report.get("summary"), report.get("invariants")
    inside = {"parse_failures"}
    if summary is None or isinstance(summary, dict):
        inside.add("summary")
    if entries is None or isinstance(entries, (dict, list)):
        inside.add("invariants")
    held = list(_leaves(summary)) if isinstance(summary, dict) else []
    held += [(f"../{p}", v) for k, x in report.items() if k not in inside for p, v in _leaves({k: x})]
    if isinstance(entries, dict) and entries:
        return held, [entries]
    return held, entries if isinstance(entries, list) else []


def _signature(report: dict, whole: bool) -> tuple:
    """What a report's shape follows from: names and Python types of the summary's leaves, and of those of the entries, None if it has no entries.

    ``whole`` adds those of the entries' locations, and what stands beside all of these: parse
    failures, and locations and entries that are no objects.
    """
    held, entries = _parts(report)
    seen: set[tuple[str, type]] = set()
    for e in entries:
        if type(e) is not dict:
            continue
        types = [*map(type, e.values())]
        if types.count(dict) > (type(e.get("location")) is dict):
            seen.update((p, type(x)) for k, v in e.items() if k != "location" for p, x in (_leaves(v, k) if isinstance(v, dict) else [(k, v)]))
        else:
            seen.update(zip(e, types))
    fields = frozenset((p, type(v)) for p, v in held), frozenset(x for x in seen if x[0] != "location") if entries else None
    if not whole:
        return fields
    places = [e["location"] for e in entries if type(e) is dict and "location" in e]
    beside = {("../invariants.location", type(x)) for x in places if type(x) is not dict} | {("../invariants", type(e)) for e in entries if type(e) is not dict}
    if "parse_failures" in report:
        beside.update((p, type(x)) for p, x in _leaves(report["parse_failures"], "../parse_failures"))
    return *fields, frozenset((p, type(v)) for x in places if type(x) is dict for p, v in _leaves(x)) or None, frozenset(beside) or None


def _shape(signature: tuple) -> list[dict]:
    """The scopes of a report with path and type of their leaves; a path of the entries has the types it has in any of them."""
    shape = []
    for scope, pairs in zip((*COUNTED, *BESIDE), signature):
        if pairs is not None:
            out: dict[str, set] = {}
            for p, t in pairs:
                out.setdefault(p, set()).add(_TYPES.get(t, "list"))
            shape.append({"scope": scope, "paths": [{"path": p, "type": "|".join(sorted(t - {None})) or None} for p, t in sorted(out.items(), key=lambda x: x[0])]})
    return shape


def _shapes(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = pa.list_(pa.struct([("path", pa.string()), ("type", pa.string())]))
        scopes = pa.list_(pa.struct([("scope", pa.string()), ("paths", paths)]))
        for b in batches:
            place: dict[tuple, int] = {}  # reports of one shape share it
            at = [None if (r := loaded(p)) is None else place.setdefault(_signature(r, whole), len(place)) for p in b.column("payload").to_pylist()]
            found = pa.array([_shape(x) for x in place], scopes).take(pa.array(at, pa.int32()))
            kept = [c for c in b.schema.names if c != "payload"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), found], [*kept, "scopes"])

    return run


def shapes(reports: DataFrame, whole: bool = False) -> DataFrame:
    """(file_id, crate, written_at, _block, scope, paths): each readable report's paths with their types, summary and entries apart; with ``whole``, also what stands beside these.

    Reports without entries have no row for these; entries without a field have one without paths.
    """
    read = spread(reports, "file_id").mapInArrow(_shapes(whole), f"file_id long, crate string, written_at timestamp, _block long, scopes array<struct<scope string, paths array<{PATH}>>>")
    return read.select("file_id", "crate", "written_at", "_block", F.explode("scopes").alias("s")).select("file_id", "crate", "written_at", "_block", "s.scope", "s.paths")


def _before(reports: DataFrame, whole: bool = False) -> tuple[DataFrame, bool]:
    """Each report's shape with that of the last report before it, written to the shared folder once."""
    lean = reports.select("file_id", F.coalesce("crate_name", F.lit("\0")).alias("crate"), "written_at", "payload")
    placed, many = order.blocked(lean, "written_at", "file_id", SPAN)
    return cut(order.last_before(shapes(placed, whole), ["crate", "scope"], "written_at", "file_id", F.struct("paths"), "was", many)), many


def _words(name: str) -> set[str]:
    return {w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()) if w}


def _table(fused: dict[tuple[str, str], str]) -> Column:
    """A map from scope.path to scope.field."""
    return F.from_json(F.lit(json.dumps({f"{s}.{p}": f"{s}.{f}" for (s, p), f in fused.items()})), "map<string,string>")


def _steps(shaped: DataFrame) -> DataFrame:
    """(scope, now, then, n): the paths of a report and of the one before it (null for the first), and how many reports have just these; far fewer than reports."""
    names = lambda c: F.transform(c, lambda x: x["path"])
    return cut(shaped.groupBy("scope", names(F.col("paths")).alias("now"), names(F.col("was.paths")).alias("then")).agg(F.count(F.lit(1)).alias("n")))


def _speaking(fused: dict[tuple[str, str], str], steps: DataFrame, by_moves: bool, scopes: tuple[str, ...]) -> dict[tuple[str, str], str]:
    """(scope, path) -> field for the paths that stand for a field of the layout, what is fused already counting as that field."""
    fields, none = [(s, f) for s in scopes for f in LAYOUT[s]], F.array().cast("array<string>")
    full = [f"{s}.{f}" for s, f in fields]
    table, layout = _table(fused), F.array(*map(F.lit, full))

    def names(c: Column) -> Column:
        whole = F.transform(c, lambda x: F.concat("scope", F.lit("."), x))
        return F.array_distinct(F.transform(F.coalesce(whole, none), lambda p: F.coalesce(F.try_element_at(table, p), p)))

    here = steps.select("scope", "n", names(F.col("now")).alias("now"), names(F.col("then")).alias("then"), F.col("then").isNotNull().alias("after"))
    moved = lambda a, b: F.when(F.col("after"), F.array_except(a, b)).otherwise(none)
    known = here.select("scope", "n", "now", F.array_intersect(layout, "now").alias("held"), moved("now", "then").alias("new"), moved("then", "now").alias("lost"))
    others = F.array_except(F.array_union("now", "lost"), F.array(*map(F.lit, [*full, *(f"summary.{p}" for p in BARE)])))

    def one(p: Column) -> Column:
        gone = F.array_contains("lost", p)
        swapped = F.when(F.array_contains("new", p), F.array_intersect(layout, "lost")).when(gone, F.array_intersect(layout, "new")).otherwise(none)
        return F.struct(p.alias("name"), F.when(gone, 0).otherwise(F.col("n")).alias("n"), F.col("n").alias("of"), F.when(gone, none).otherwise(F.col("held")).alias("held"), swapped.alias("swapped"))

    # the row without a name counts for all reports of the scope
    all_ = F.struct(F.lit(None).cast("string").alias("name"), F.col("n"), F.col("n").alias("of"), F.col("held"), F.array_intersect(layout, F.concat("new", "lost")).alias("swapped"))
    per = known.select("scope", F.explode(F.concat(F.transform(others, one), F.array(all_))).alias("f")).select("scope", "f.*")
    has = lambda c, f: F.sum(F.when(F.array_contains(c, f), F.col("of")).otherwise(0))
    seen = cut(per.groupBy("scope", "name").agg(F.sum("n").alias("n"), *[has("held", f).alias(f"with{i}") for i, f in enumerate(full)], *[has("swapped", f).alias(f"swap{i}") for i, f in enumerate(full)]))
    total = {r["scope"]: r for r in seen.where("name IS NULL").collect()}
    options = []
    for i, (scope, f) in enumerate(fields):
        if scope in total:
            every = total[scope]
            own = _words(f) - set().union(*(_words(g) for g in LAYOUT[scope] if g != f))
            spoken = F.size(F.array_intersect(F.split(F.lower(F.regexp_replace(F.substring("name", len(scope) + 2, 1 << 30), r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+"), F.array(*map(F.lit, sorted(own))).cast("array<string>"))).cast("long")
            speaks = (spoken > 0) & (F.col("n") >= (every["n"] - every[f"with{i}"]) * SUPPORT)
            if by_moves:
                speaks = speaks | (F.col(f"swap{i}") > 0) & (F.col(f"swap{i}") >= every[f"swap{i}"] * SUPPORT)
            apart = (F.col("scope") == scope) & (F.col(f"with{i}") <= F.col("n") * TOGETHER)
            options.append(F.when(apart & speaks, F.struct(spoken.alias("words"), F.col(f"swap{i}").alias("swaps"), F.lit(-i).alias("place"))))
    if not options:
        return {}
    best = seen.where("name IS NOT NULL AND n > 0").select("scope", "name", F.array_max(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("best")).where("best IS NOT NULL")
    return {(r[0], r[1][len(r[0]) + 1 :]): fields[-r[2]["place"]][1] for r in best.collect()}


def _fused(shaped: DataFrame, scopes: tuple[str, ...] = COUNTED) -> dict[tuple[str, str], str]:
    """(scope, path) -> field: the drifted names and levels under which fields of the layout live on, as the reports show it.

    A path stands for a field if the two are not found together and either its words include one
    that no other field of the layout has, or it comes where the field goes, or goes where it
    comes, from one report to the next. Words decide first, so that the moves are then counted
    between all names of a field. One aggregate a path counts all of that; only what is fused
    reaches the driver, and ``SUPPORT`` bounds it.
    """
    steps = _steps(shaped.where(F.col("scope").isin(*scopes)))
    worded = _speaking({}, steps, False, scopes)
    return worded | _speaking(worded, steps, True, scopes)


def _placed(paths: Column, fused: dict[tuple[str, str], str], scope: Column) -> Column:
    """(field, path, type) of each path: a name of the layout holds its own place, the first that stands for it takes a free one, others keep their name."""
    table, whole = _table(fused), lambda x: F.concat(scope, F.lit("."), x["path"])
    stands = F.transform(paths, lambda x: F.coalesce(F.substring(F.try_element_at(table, whole(x)), F.length(scope) + 2, F.lit(1 << 30)), x["path"]))
    own = F.transform(paths, lambda x: x["path"])

    def one(x: Column, i: Column) -> Column:
        f = F.get(stands, i)
        free = ~F.array_contains(own, f) & (F.array_position(stands, f) == i + 1)
        return F.struct(F.when((f == x["path"]) | free, f).otherwise(x["path"]).alias("field"), x["path"], x["type"])

    return F.transform(paths, one)


def _field_path(scope: Column, field: Column) -> Column:
    at = F.when(scope == "location", "invariants.location").otherwise(scope)
    return F.when(field.startswith("../"), F.substring(field, 4, 1 << 30)).otherwise(F.concat(at, F.lit("."), field))


def changes(reports: DataFrame) -> DataFrame:
    """(file_id, field_path, change_kind, old_path, new_path, old_type, new_type): each change of a report against the last readable one of its crate.

    Each report's paths carry their typed alternatives; which drifted name or level stands for a
    field of the layout is inferred from all reports (:func:`_fused`). A report is compared with
    the last before it that is readable, for the entries' fields the last that has entries, be they
    without a field. Location and parse failures do not count. Added and removed compare presence, renamed the path, retyped the type, where null has none and the
    last known one of an unbroken presence stands. A path outside of summary and entries is named
    as found. Payloads that are null, cut off, or no JSON object are passed over. Reports of one
    instant go by file_id, null times come first, a null crate_name is a crate of its own.
    Histories are cut into blocks (:mod:`.order`), so a crate that holds a third of all files is
    shared out; only reports whose shape differs go on to the second step. An empty table gives
    no rows.
    """
    shaped, many = _before(reports)
    fused = _fused(shaped)
    scope, key = F.col("scope"), ["crate", "scope", "field"]
    moved = shaped.where(F.col("was").isNull() | (F.col("was.paths") != F.col("paths")))
    both = moved.select("file_id", "crate", "written_at", "scope", "_block", F.col("was").isNull().alias("first"), _placed(F.col("paths"), fused, scope).alias("now"), F.when(F.col("was").isNotNull(), _placed(F.col("was.paths"), fused, scope)).alias("then"))
    then = F.coalesce("then", F.array().cast("array<struct<field string, path string, type string>>"))
    old = lambda x: F.get(F.filter(then, lambda y: y["field"] == x["field"]), F.lit(0))
    is_now = F.transform("now", lambda x: F.struct(x["field"].alias("field"), x.alias("now"), old(x).alias("then")))
    lost = F.filter(then, lambda y: ~F.exists("now", lambda x: x["field"] == y["field"]))
    is_lost = F.transform(lost, lambda y: F.struct(y["field"].alias("field"), F.lit(None).cast("struct<field string, path string, type string>").alias("now"), y.alias("then")))
    # of a crate's first report only null types are of use later
    steps = F.filter(F.concat(is_now, is_lost), lambda x: ~x["now"].eqNullSafe(x["then"]) & (~F.col("first") | x["now"]["type"].isNull()))
    rows = both.select("file_id", "crate", "written_at", "scope", "_block", "first", F.explode(steps).alias("s")).select("file_id", "crate", "written_at", "scope", "_block", "first", "s.field", "s.now", "s.then")
    # where a type becomes null, the last known one is carried on, or none if the field comes without
    told = F.when(F.col("now").isNotNull() & F.col("now.type").isNull() & (F.col("then").isNull() | F.col("then.type").isNotNull()), F.struct(F.col("then.type").alias("type")))
    rows = order.last_before(rows, key, "written_at", "file_id", told, "known", many)
    known, kind = F.coalesce("then.type", "known.type"), F.col("now.type")

    def event(cond: Column, name: str, **more: Column) -> Column:
        text = lambda k: more.get(k, F.lit(None)).cast("string").alias(k)
        return F.when(cond, F.struct(F.lit(name).alias("change_kind"), *map(text, ("old_path", "new_path", "old_type", "new_type"))))

    stays = F.col("now").isNotNull() & F.col("then").isNotNull()
    events = F.array(
        event(F.col("then").isNull() & ~F.col("first"), "added", new_path=F.col("now.path"), new_type=kind),
        event(F.col("now").isNull(), "removed", old_path=F.col("then.path"), old_type=known),
        event(stays & (F.col("now.path") != F.col("then.path")), "renamed", old_path=F.col("then.path"), new_path=F.col("now.path")),
        event(stays & (known != kind), "retyped", old_type=known, new_type=kind),
    )
    found = rows.select("file_id", _field_path(F.col("scope"), F.col("field")).alias("field_path"), F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return found.select("file_id", "field_path", "e.change_kind", "e.old_path", "e.new_path", "e.old_type", "e.new_type")


def alternatives(reports: DataFrame) -> DataFrame:
    """(field_path, found_as, type, reports, first_seen): every name and type under which a field was found, in how many reports and since when.

    The union of all shapes, locations and parse failures included: paths that stand for a field of
    the layout are its alternatives. A null has no type; the entries of one report count once, with
    all the types they have.
    """
    shaped, _ = _before(reports, True)
    each = shaped.select("scope", "written_at", F.explode(_placed(F.col("paths"), _fused(shaped, tuple(LAYOUT)), F.col("scope"))).alias("p"))
    found_as = F.when(F.col("scope") == "location", F.concat(F.lit("location."), "p.path")).otherwise(F.col("p.path"))
    return each.groupBy(_field_path(F.col("scope"), F.col("p.field")).alias("field_path"), found_as.alias("found_as"), F.col("p.type").alias("type")).agg(F.count(F.lit(1)).alias("reports"), F.min("written_at").alias("first_seen"))


def _branch(v: object, number: bool) -> dict | None:
    """A value with its typed branch and what the layout makes of it: a whole number or a text."""
    if v is None:
        return None
    kind, value = _type(v), None
    if number:
        if kind == "list":
            value = len(v)
        elif kind in ("whole", "decimal") and abs(v) < 2**63:
            value = int(v)
        elif kind == "text" and re.fullmatch(r"\s*[-+]?\d{1,18}\s*", v):
            value = int(v)
    elif kind == "text":
        value = v
    elif kind == "list":
        value = next((x for x in v if isinstance(x, str)), None)
    return {"value": value, "branch": kind, "raw": json.dumps(v, ensure_ascii=False)}


def _outside(v: object) -> dict:
    return _branch(v, False) or {"value": None, "branch": None, "raw": "null"}


def _in_layout(pairs: list[tuple[str, object]], fused: dict[str, str], layout: tuple[str, ...], numbers: tuple[str, ...]) -> dict:
    own, out, extra = {p for p, _ in pairs}, {}, {}
    for p, v in sorted(pairs, key=lambda x: x[0]):
        f = p if p in layout else fused.get(p, p)
        if f not in layout or f != p and (f in own or f in out):
            extra[p] = _outside(v)
        else:
            out[f] = _branch(v, f in numbers)
    return {f: out.get(f) for f in layout} | {"extra": extra}


def _canonical(fused: dict[tuple[str, str], str]):
    of = {s: {p: f for (t, p), f in fused.items() if t == s} for s in LAYOUT}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.drop(columns="payload")
            made = []
            for p in b["payload"]:
                if (report := loaded(p)) is None:
                    made.append(None)
                    continue
                held, entries = _parts(report)
                rows = []
                for e in entries:
                    if not isinstance(e, dict):
                        rows.append({"extra": {"": _outside(e)}})
                        continue
                    at = e.get("location")
                    row = _in_layout(list(_leaves({k: v for k, v in e.items() if k != "location"})), of["invariants"], LAYOUT["invariants"], ("id",))
                    place = _in_layout(list(_leaves(at)) if isinstance(at, dict) else [], of["location"], PLACE, PLACE[1:])
                    row["extra"] |= {f"location.{p}": x for p, x in place.pop("extra").items()}
                    if at is not None and not isinstance(at, dict):
                        row["extra"]["location"] = _outside(at)
                    rows.append(row | place)
                summary = _in_layout(held, of["summary"], SUMMARY, SUMMARY)
                made.append(json.dumps({"summary": summary, "invariants": rows, "parse_failures": _branch(report.get("parse_failures"), True)}, ensure_ascii=False))
            out["canonical"] = made
            yield out

    return run


def one_table(reports: DataFrame) -> DataFrame:
    """Every readable report in one layout: (file_id, crate_name, run_id, written_at, summary, invariants, parse_failures).

    Each field is a struct of ``value``, the typed ``branch`` it was found in and the ``raw`` JSON.
    Counts and ids become whole numbers: texts of digits are read, decimals cut, a list counts its
    items; what does not fit (1e400) has no value. Texts stay, of a list the first text is taken;
    what has neither has no value and stays in raw. Fields outside the layout, those of the
    report's top level as ../name among them, are in ``extra``, a map of the same structs. Names
    drift within locations as well. An entry that is no object is a row with itself as ``extra``
    without a name. Of parse failures the value is their number.
    """
    fused = _fused(_before(reports, True)[0], tuple(LAYOUT))
    struct = lambda v: f"struct<value {v}, branch string, raw string>"
    extra = f"extra map<string, {struct('string')}>"
    entry = ", ".join(f"{f} {struct('bigint' if f in ('id', *PLACE[1:]) else 'string')}" for f in (*LAYOUT["invariants"], *PLACE))
    layout = f"summary struct<{', '.join(f'{f} {struct("bigint")}' for f in SUMMARY)}, {extra}>, invariants array<struct<{entry}, {extra}>>, parse_failures {struct("bigint")}"
    lean = reports.select("file_id", "crate_name", "run_id", "written_at", "payload")
    read = spread(lean, "file_id").mapInPandas(_canonical(fused), "file_id long, crate_name string, run_id string, written_at timestamp, canonical string").where("canonical IS NOT NULL")
    return read.select("file_id", "crate_name", "run_id", "written_at", F.from_json("canonical", layout).alias("r")).select("file_id", "crate_name", "run_id", "written_at", "r.summary", "r.invariants", "r.parse_failures")
