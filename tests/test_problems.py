"""Schema drift, redelivery and twin differences, on small cases."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.operators import drift, order, redelivery, twins
from sievework.plans import problems
from sievework.plans.problems import COMPARED

REPORT = "file_id long, crate_name string, run_id string, written_at timestamp, payload string, scope string, seq int"
PROGRESS = "delivery_no long, run_id string, crate_name string, message_seq long, module_path string, status string, timestamp string, tokens_used long, h1 string, prefix string"


def reports(spark, *payloads, crate="c"):
    t = datetime(2025, 1, 1)
    rows = [(i + 1, crate, "r", t + timedelta(hours=9 * i), p if isinstance(p, str) or p is None else json.dumps(p), "x", 0) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, REPORT)


def changed(df):
    return sorted((r.file_id, r.field_path, r.change_kind) for r in drift.changes(df).collect())


def rep(summary=None, *entries):
    return {"summary": {"total_invariants": 1, **(summary or {})}, "invariants": list(entries), "parse_failures": []}


def test_each_kind_of_change(spark):
    a = {"state_machine_count": 1}
    out = changed(reports(spark, rep(a), rep({"fsm_count": "1"}), rep({"by_type": {"state_machine": None}}), rep({"by_type": {"state_machine": 2}}), rep(), rep({"stateMachineCount": [1]}), rep({"state_machine_count": 1.0, "chunks_seen": 3})))
    assert out == [
        (2, "summary.state_machine_count", "renamed"), (2, "summary.state_machine_count", "retyped"),
        (3, "summary.state_machine_count", "renamed"),
        (4, "summary.state_machine_count", "retyped"),
        (5, "summary.state_machine_count", "removed"),
        (6, "summary.state_machine_count", "added"),
        (7, "summary.chunks_seen", "added"), (7, "summary.state_machine_count", "renamed"), (7, "summary.state_machine_count", "retyped"),
    ]


def test_entries_skip_reports_without_entries_and_bad_payloads(spark):
    e = {"id": 1, "title": "t", "location": {"line_start": 1}}
    out = changed(reports(spark, rep({}, e | {"invariant_type": "x"}), rep(), "{", None, "", "[1]", rep({}, e | {"kind": 3}, e | {"kind": None}), rep({}, {**e, "location": None, "kind": 4})))
    assert out == [(7, "invariants.invariant_type", "renamed"), (7, "invariants.invariant_type", "retyped")]


def test_crates_are_apart_and_empty_tables_give_nothing(spark):
    both = reports(spark, rep()).unionByName(reports(spark, rep({"x": 1}), crate=None))
    assert changed(both) == []
    assert changed(reports(spark, rep()).limit(0)) == []


def test_blocks_and_days_make_no_difference(spark, monkeypatch):
    series = [rep({k: v for k, v in (("state_machine_count", (1, None, "1")[i % 3]), ("protocol_count", 1)) if (i * 7) % 5 or k == "protocol_count"}) for i in range(40)]
    whole = changed(reports(spark, *series))
    monkeypatch.setattr(drift, "SPAN", 3)
    assert changed(reports(spark, *series)) == whole and len(whole) > 20


def test_a_name_is_fused_where_the_field_moves_to_it(spark):
    a, b = rep({"state_machine_count": 1, "chunks_seen": 2}, {"id": 1, "invariant_type": "x"}), rep({"automata": 1, "chunks_seen": 2}, {"id": 1, "label": "x", "severity": "s"})
    out = changed(reports(spark, a, b, a, b))
    assert {x[1:] for x in out if x[1].startswith("summary")} == {("summary.state_machine_count", "renamed")}


def test_what_comes_and_goes_apart_is_not_fused(spark):
    a, b = rep({"state_machine_count": 1}), rep({"state_machine_count": 1, "build": "z"})
    assert changed(reports(spark, a, b, rep({"build": "z"}), a)) == [(2, "summary.build", "added"), (3, "summary.state_machine_count", "removed"), (4, "summary.build", "removed"), (4, "summary.state_machine_count", "added")]


def test_one_table_keeps_branches_and_extras(spark):
    odd = '{"summary": {"total_invariants": 1, "state_machine_count": 1e400, "n_protocol": [1, 2], "runtime_ms": 5}, "tool": {"build": "x"}, "invariants": [{"id": "12", "invariant_type": ["protocol"], "location": {"file_path": "f", "line_start": "4", "col": 2}, "score": 0.5}, {"id": 1.0, "invariant_type": 3, "location": "f:3", "title": null}], "parse_failures": []}'
    t = drift.one_table(reports(spark, odd, "{", rep({"state_machine_count": "12", "protocol_count": 1}))).orderBy("file_id").collect()
    s = t[0].summary
    assert (s.state_machine_count.value, s.state_machine_count.branch) == (None, "decimal")
    assert (s.protocol_count.value, s.protocol_count.branch, s.protocol_count.raw) == (2, "list", "[1, 2]")
    assert {k: v.raw for k, v in s.extra.items()} == {"runtime_ms": "5", "../tool.build": '"x"'}
    one, two = t[0].invariants
    assert (one.id.value, one.id.branch, one.line_start.value, one.line_start.branch, one.file_path.value, one.invariant_type.value) == (12, "text", 4, "text", "f", "protocol")
    assert {k: v.raw for k, v in one.extra.items()} == {"location.col": "2", "score": "0.5"}
    assert (two.id.value, two.id.branch, two.invariant_type.value, two.invariant_type.raw, two.title, two.extra["location"].value) == (1, "decimal", None, "3", None, "f:3")
    assert len(t) == 2 and (t[1].summary.state_machine_count.value, t[1].summary.total_invariants.value) == (12, 1)


def test_deep_reports_and_halves_of_surrogate_pairs(spark):
    deep = '{"summary": {"total_invariants": 2, "a": ' + '{"b": ' * 1500 + "1" + "}" * 1500 + '}, "invariants": []}'
    half = '{"summary": {"total_invariants": 2, "x\\ud800": "\\udc00"}, "invariants": []}'
    df = reports(spark, rep({"total_invariants": 2}), deep, half)
    assert [(i, k) for i, _, k in changed(df)] == [(2, "added"), (3, "removed"), (3, "added")]
    assert drift.one_table(df).where("file_id = 3").first().summary.extra["x?"].value == "?"


def test_entries_without_a_field_are_entries(spark):
    e, at = {"id": 1, "title": "t"}, {"location": {"line_start": 1}}
    gone, back = [("invariants.id", k) for k in ("removed", "added")], [("invariants.title", k) for k in ("removed", "added")]
    for bare in (at, {}, {"location": None}, "t"):
        out = changed(reports(spark, rep({}, e | at), rep(), rep({}, bare), rep(), rep({}, bare), rep({}, e)))
        assert out == [(3, *gone[0]), (3, *back[0]), (6, *gone[1]), (6, *back[1])], bare


def test_all_parts_of_a_report_are_kept(spark):
    e, long = {"id": 1, "title": "t"}, "7" * 5000
    some = [
        rep({}, e | {"location": {"file_path": "f", "line_start": 3}}),
        rep({}, e | {"location": {"file_path": "f", "start": "4", "": 0}}, "lost", None),
        {"summary": "none", "invariants": e | {"location": "f:5"}, "parse_failures": [["f", "x"], ["g", "y"]]},
        {"summary": {"total_invariants": 1}, "invariants": "none", "parse_failures": {"f": 1}},
        '{"summary": {"total_invariants": 1, "state_machine_count": ' + long + ', "": 2}, "invariants": []}',
    ]
    df = reports(spark, *some)
    found = {(r.field_path, r.found_as, r.type): r.reports for r in drift.alternatives(df).collect()}
    assert {k: n for k, n in found.items() if "location" in k[0] or k[1].startswith("../")} == {
        ("invariants.location.file_path", "location.file_path", "text"): 2,
        ("invariants.location.line_start", "location.line_start", "whole"): 1, ("invariants.location.line_start", "location.start", "text"): 1, ("invariants.location.", "location.", "whole"): 1,
        ("invariants.location", "../invariants.location", "text"): 1, ("invariants", "../invariants", "text"): 2, ("summary", "../summary", "text"): 1,
        ("parse_failures", "../parse_failures", "list"): 3, ("parse_failures.f", "../parse_failures.f", "whole"): 1,
    }
    assert found["invariants.title", "title", "text"] == 3 and found["summary.", "", "whole"] == 1
    t = drift.one_table(df).orderBy("file_id").collect()
    assert [[x.title and x.title.value for x in r.invariants] for r in t] == [["t"], ["t", None, None], ["t"], [], []]
    assert (t[1].invariants[0].line_start.value, t[1].invariants[0].extra["location."].raw, [x.extra[""].raw for x in t[1].invariants[1:]]) == (4, "0", ['"lost"', "null"])
    assert t[2].summary.extra["../summary"].value == "none" and t[2].invariants[0].extra["location"].value == "f:5" and t[3].summary.extra["../invariants"].value == "none"
    assert [r.parse_failures and (r.parse_failures.value, r.parse_failures.branch) for r in t] == [(0, "list"), (0, "list"), (2, "list"), (None, "object"), None]
    assert (t[4].summary.state_machine_count.value, t[4].summary.state_machine_count.raw, t[4].summary.extra[""].raw) == (None, long, "2")
    assert [x for x in changed(df) if "invariants.i" in x[1] or "invariants.t" in x[1]] == []


def test_alternatives(spark):
    rows = drift.alternatives(reports(spark, rep({"state_machine_count": 1}), rep({"state_machine_count": 2}), rep({"stateMachineCount": "3"}), "[")).where("field_path = 'summary.state_machine_count'").collect()
    assert sorted((r.found_as, r.type, r.reports) for r in rows) == [("stateMachineCount", "text", 1), ("state_machine_count", "whole", 2)]


@pytest.mark.parametrize("span", [3, 10_000])
def test_places_and_last_values_in_blocks(spark, span):
    t = datetime(2025, 1, 1)
    rows = [(i, None if i % 3 == 0 else "g", None if i % 5 == 0 else t if i % 2 else t + timedelta(seconds=i * 37 % 11), None if i % 4 else str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, at timestamp, v string")
    places = {r.id: r.seq for r in order.numbered(df, ["g"], "at", "id", span).collect()}
    placed, many = order.blocked(df, "at", "id", span)
    lasts = {r.id: r.was for r in order.last_before(placed, ["g"], "at", "id", F.col("v"), "was", many).collect()}
    assert many == (span == 3)
    for g in (None, "g"):
        v = None
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] or datetime(1, 1, 1), r[0])), 1):
            assert (places[r[0]], lasts[r[0]]) == (n, v), (r, n, v)
            v = r[3] or v


def history(con):
    """The changes of the given reports by the definition, crate by crate; the drifting names are those of the test tables."""
    known = {("summary", n): f for f, names in problems._NAMES.items() for n in names} | {("invariants", n): "invariant_type" for n in ("invariantType", "type", "kind", "category")}
    kind = lambda v: None if v is None else {bool: "b", int: "i", float: "f", str: "s", list: "l"}[type(v)]
    out, last = set(), {}

    def leaves(x, at=""):
        for k, v in x.items():
            if isinstance(v, dict):
                yield from leaves(v, f"{at}{k}.")
            else:
                yield at + k, v

    for crate, file, payload in con.sql("SELECT crate_name, file_id, payload FROM report_files ORDER BY crate_name, written_at, file_id").fetchall():
        try:
            r = json.loads(payload or "")
        except ValueError:
            continue
        for scope, fields in (("summary", list(leaves(r["summary"]))), ("invariants", [x for e in r["invariants"] for x in leaves({k: v for k, v in e.items() if k != "location"})])):
            if scope == "invariants" and not r["invariants"]:
                continue
            now = {}
            for p, v in fields:
                f = known.get((scope, p), p)
                now[f] = (p, kind(v) or now.get(f, (0, None))[1])
            if (then := last.get((crate, scope))) is not None:
                for f in {*now, *then}:
                    a, b = then.get(f), now.get(f)
                    if a is None or b is None:
                        out.add((file, f"{scope}.{f}", "added" if a is None else "removed"))
                        continue
                    if a[0] != b[0]:
                        out.add((file, f"{scope}.{f}", "renamed"))
                    if a[1] and b[1] and a[1] != b[1]:
                        out.add((file, f"{scope}.{f}", "retyped"))
                    now[f] = (b[0], b[1] or a[1])
            last[crate, scope] = now
    return out


def test_changes_of_the_given_reports(spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW report_files AS SELECT * FROM '{data}/report_files.parquet'")
    want = history(con)
    rows = problems.p3_changes(spark, data).collect()
    assert {(r.file_id, r.field_path, r.change_kind) for r in rows} == want and len(rows) == len(want) > 100
    assert all((r.old_path != r.new_path) == (r.change_kind in ("renamed", "added", "removed")) for r in rows if r.change_kind != "retyped")
    tables = {r.file_id: r for r in problems.p3_table(spark, data).collect()}
    assert len(tables) == con.sql("SELECT count(*) FROM report_files WHERE json_valid(payload)").fetchall()[0][0]
    first = con.sql("SELECT file_id, payload FROM report_files WHERE json_valid(payload)").fetchall()
    assert all(len(json.loads(tables[i].invariants)) == len(json.loads(p)["invariants"]) for i, p in first)
    extras = sum(len(json.loads(t.extra)) for t in tables.values())
    assert extras == sum(1 for _, p in first for k in json.loads(p)["summary"] if k in ("runtime_ms", "schema_version", "dropped_low", "chunks_seen", "tool_build", "duplicates_merged", "validated_count"))
    found = problems.p3_alternatives(spark, data).where("field_path = 'summary.total_invariants'").collect()
    assert sum(r.reports for r in found) == len(first)


def progress(spark, *rows):
    return spark.createDataFrame([(i + 1, *r, 1, "x", "y") for i, r in enumerate(rows)], PROGRESS)


ROWS = [
    ("r", "c", 1, "m", "completed", "2025-02-03T06:00:00.123456789+00:00"),
    ("r", "c", 1, "other", "failed", None),  # same sequence number
    ("r", "c", None, "m", "Completed ", "2025-02-03T05:00:00.123456789-01:00"),
    ("r", "c", None, " m\t", "completed", "2025-02-03 06:00:00.123456789Z"),  # the same instant
    ("r", "c", None, "m", "completed", "2025-02-03T06:00:00.123456788Z"),  # a nanosecond earlier
    ("q", "c", 1, "m", "completed", None),
    (None, None, None, None, None, None),
    (None, None, None, None, None, None),
    ("r", "c", None, "m", "completed", "not a time"),
    ("r", "c", None, "m", "completed", " NOT A TIME"),
]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_repeated_messages(spark, batches):
    out = sorted(r[0] for r in redelivery.repeated(progress(spark, *ROWS), batches=batches).collect())
    assert out == [2, 4, 8, 10]
    kept = redelivery.once(progress(spark, *ROWS), batches=batches)
    assert kept.count() == 6 and "h1" in kept.columns


def test_a_hot_message_and_many_runs(spark):
    rows = spark.range(1, 3001).select(F.col("id").alias("delivery_no"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string")).alias("k"))
    out = {r[0] for r in redelivery.repeated(rows, F.col("k"), batches=9).collect()}
    seen, want = set(), set()
    for i in range(1, 3001):
        k = "hot" if i % 3 == 0 else str(i % 500)
        if k in seen:
            want.add(i)
        seen.add(k)
    assert out == want


def test_no_messages(spark):
    assert redelivery.repeated(progress(spark, *ROWS).limit(0)).count() == 0


def added(spark, index, *ks):
    return sorted(r[0] for r in index.add(spark.createDataFrame(list(ks), "delivery_no long, k string"), F.col("k"), "delivery_no").collect())


def test_an_index_goes_on_where_it_was(spark, tmp_path):
    at = str(tmp_path / "i")
    first = redelivery.SeenIndex(spark, 8_000_000, merge_every=2, path=at)
    assert added(spark, first, (1, "a"), (2, "a"), (3, "b")) == [1, 3]
    assert added(spark, first, (4, "b"), (5, "c")) == [5]
    again = redelivery.SeenIndex(spark, 100_000_000, merge_every=2, path=at)  # another expectation does not move what is there
    assert again.bits == first.bits
    assert added(spark, again, (4, "b"), (5, "c")) == [5]  # a batch that comes again gives what it gave
    assert added(spark, again, (6, "c"), (7, "a"), (8, "d")) == [8]
    again.sweep()
    assert len(again.runs) < 4 and set(again.files.names()) == {"manifest.json", *again.runs}
    assert added(spark, redelivery.SeenIndex(spark, 1, path=at), (9, "new"), (10, "d")) == [9]  # whatever number it has


def test_an_index_splits_its_arrays_as_it_grows(spark, tmp_path):
    index, seen = redelivery.SeenIndex(spark, 10, per_array=8, merge_every=2, path=str(tmp_path / "i")), set()
    for i in range(5):
        keys = [(1000 * i + j, str((i * 53 + j * 7) % 700)) for j in range(200)]
        want = []
        for n, k in keys:
            if k not in seen:
                seen.add(k)
                want.append(n)
        assert added(spark, index, *keys) == want
    assert index.bits > 4 and len(index.runs) < 5


FINDING = "id long, location struct<file_path string, line_start long>, entity string, invariant_type string, f0 string, side string"


def test_twin_differences(spark):
    left = spark.createDataFrame([(1, ("./a//b.rs", 1), " E\n", "state_machine", "", ""), (2, None, None, None, "", ""), (3, ("a", 1), "e", "t", "", ""), (4, ("a", 1), "e", "t", "", ""), (None, ("a", 1), "e", "t", "", "")], FINDING)
    right = spark.createDataFrame([(1, ("a\\b.rs", 9), "E", "State-Machine", "", ""), (1, ("a/b.rs", 9), "E", "StateMachine", "", ""), (2, ("", 1), " ", "\t", "", ""), (3, ("A", 1), "E", "T2", "", ""), (5, ("a", 1), "e", "t", "", "")], FINDING)
    out = sorted((r.id if r.id is not None else -1, r.difference) for r in twins.differences(left, right, "id", COMPARED, "invariants", "mirror").collect())
    assert out == [(-1, "missing_in_mirror"), (3, "entity"), (3, "invariant_type"), (3, "location.file_path"), (4, "missing_in_mirror"), (5, "missing_in_invariants")]
    assert twins.differences(left.limit(0), right, "id", COMPARED, "invariants", "mirror").where("difference = 'missing_in_invariants'").count() == 4
    assert twins.differences(left.limit(0), right.limit(0), "id", COMPARED, "invariants", "mirror").count() == 0


def test_runs_are_merged_in_the_registered_query(spark, monkeypatch):
    made, init = [], redelivery.SeenIndex.__init__
    monkeypatch.setattr(redelivery.SeenIndex, "__init__", lambda self, *a, **k: (init(self, *a, **k), made.append(self))[0])
    rows = spark.range(400).select(F.col("id").alias("delivery_no"), (F.col("id") % 150).alias("m"))
    out = redelivery.repeated(rows, key=F.col("m").cast("string"))
    assert sorted(r.delivery_no for r in out.collect()) == list(range(150, 400))
    assert [i._span(n) for i in made for n in i.runs] == [(0, 1), (2, 2), (3, 3)]
