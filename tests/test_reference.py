"""Every registered query runs; those with SQL give what it gives; and the small rules one by one."""

import glob
import json
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievework.functions import classify as C
from sievework.functions import replies as R
from sievework.operators import dedup, detect, modules, order, regions, search, verify
from sievework.sources import files, sinks
from sievework.streaming import logs


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_agrees(spark, data, con, name):
    df, want = entry.queries()[name](spark, data), con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


# --- queries without SQL, against plain Python


def rows_of(con, sql):
    return con.sql(sql).fetchall()


def test_prompt_text(spark, data, con):
    want = {}
    for crate, chunk, module, file, note, source in rows_of(con, "SELECT crate_name, chunk_id, module_path, file_path, sibling_summary, raw_source FROM chunks"):
        raw = ((f"// Note: {note}\n" if note is not None else "") + (source or "")).encode()
        text = raw.decode() if len(raw) <= 50_000 else raw[:50_000].decode(errors="ignore") + "\n// ... (truncated) ..."
        want[crate, chunk] = f"Module: {module or ''}\nFile: {file}\n\n```rust\n{text}\n```\n"
    assert {(r.crate_name, r.chunk_id): r.prompt for r in entry.queries()["prompt_text"](spark, data).collect()} == want


def test_detect_signals(spark, data, con):
    want = set()
    for crate, chunk, source in rows_of(con, "SELECT crate_name, chunk_id, coalesce(raw_source, '') FROM chunks"):
        for kind, rx in detect.SIGNALS:
            if n := sum(1 for _ in re.finditer(rx, source, re.A)):
                want.add((crate, chunk, kind, n))
    assert {tuple(r) for r in entry.queries()["detect_signals"](spark, data).collect()} == want and len(want) > 100


def test_reply_fields_and_explanations(spark, data, con):
    label = re.compile(r"[*\s]*\b(entity|states|transitions|evidence|implementation)\b[*\s]*(?::|—)[*\s]*", re.I)
    want = {}
    for i, text in rows_of(con, "SELECT id, coalesce(evidence.explanation, '') FROM invariants"):
        own, last = {}, None
        for line in text.split("\n"):
            if m := label.match(line):
                last = m[1].lower()
                last = None if last in own else last
                if last:
                    own[last] = line[m.end() :]
            elif last:
                own[last] += "\n" + line
        want[i] = {k: re.sub(r"^[*\s]+|[*\s]+$", "", v) or None for k, v in own.items()}
    got = {r.id: r for r in entry.queries()["reply_fields"](spark, data).collect()}
    wrong = [(i, k, got[i][k.lower()], w.get(k.lower())) for i, w in want.items() for k in R.LABELS if got[i][k.lower()] != w.get(k.lower())]
    assert len(got) == len(want) and wrong == []
    built = entry.queries()["explanation_build"](spark, data)
    again = built.select("id", *[R.field(F.col("explanation"), x).alias(x.lower()) for x in ("Entity", "Implementation")])
    assert all(r.entity == got[r.id].entity and r.implementation == got[r.id].implementation for r in again.collect())


def included(source, starts, names):
    """Which lines a cluster's source has, told line by line."""
    lines = source.replace("\r\n", "\n").split("\n")
    lines = lines[:-1] if lines[-1] == "" and len(lines) > 1 else lines
    keep = set()
    for n in (n for n in starts if 1 < n <= len(lines)):
        end = next((i for i in range(n + 1, len(lines) + 1) if sum(x.count("{") - x.count("}") for x in lines[n - 1 : i]) <= 0), len(lines))
        keep |= set(range(max(1, n - 3), end + 1))
    if not any(1 < n <= len(lines) for n in starts):
        keep = {j for i, x in enumerate(lines, 1) if any(y in x for y in names) for j in range(i - 5, i + 6) if 1 <= j <= len(lines)}
    out = ""
    for i in sorted(keep):
        out += (modules.GAP if out and i - 1 not in keep else "") + lines[i - 1] + "\n"
    return out


def test_cluster_sources(spark, data, con):
    chunks = {(c, k): t for c, k, t in rows_of(con, "SELECT crate_name, chunk_id, raw_source FROM chunks WHERE length(raw_source) < 8000")}
    parts = {(r.crate_name, r.chunk_id, r.cluster): r for r in modules.clusters(spark.read.parquet(f"{data}/chunks.parquet")).collect()}
    seen = 0
    for r in modules.cluster_sources(spark.read.parquet(f"{data}/chunks.parquet")).collect():
        if (r.crate_name, r.chunk_id) in chunks:
            p, text = parts[r.crate_name, r.chunk_id, r.cluster], chunks[r.crate_name, r.chunk_id]
            assert r.source == (included(text, p.lines, [p.anchor]) if p.anchor else text)
            seen += 1
    assert seen > 20
    assert modules.extract("a\nFoo\nb", [1], ["Foo"]) == "a\nFoo\nb\n" and modules.extract("x\n" * 30 + "fn\n", [], ["fn"]) == "x\n" * 5 + "fn\n"


def test_reports_are_documents(spark, data, con):
    by = {}
    for r in sorted(entry.queries()["report_entries"](spark, data).collect(), key=lambda r: (r.section, r.place)):
        by[r.run_id] = by.get(r.run_id, "") + r.line + "\n"
    read = {k: json.loads(v) for k, v in by.items()}
    assert sum(len(x["invariants"]) for x in read.values()) == rows_of(con, "SELECT count(*) FROM invariants")[0][0]
    assert all(x["summary"]["total_invariants"] == len(x["invariants"]) == sum(v for k, v in x["summary"].items() if k.endswith("_count")) for x in read.values())


def test_entry(spark, data):
    assert entry.entry(spark).count() == 1


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_region_merge(spark):
    rows = spark.createDataFrame([("a", 10, 15, 0.8), ("a", 12, 20, 0.7), ("a", 50, 55, 0.6), (None, 1, 2, 0.5), ("b", 2, 3, None)], "path string, line_start long, line_end long, weight double")
    assert sorted((r.path, r.line_start, r.line_end, r.weight) for r in regions.merged(rows).collect()) == [("a", 5, 25, 0.8), ("a", 45, 60, 0.6), ("b", 1, 8, None)]


def test_report_names_of_over_a_thousand_reports(spark, tmp_path):
    spark.range(1, 1013).select(F.col("id").alias("file_id"), F.lit("c").alias("crate_name"), F.timestamp_seconds("id").alias("written_at")).write.parquet(f"{tmp_path}/report_files.parquet")
    names = {r.file_id: r.file_name for r in entry.queries()["report_names"](spark, str(tmp_path)).collect()}
    assert len(set(names.values())) == 1012
    assert [names[i] for i in (7, 100, 999, 1000, 1012)] == ["report007.json", "report100.json", "report999.json", "report1000.json", "report1012.json"]


FOUND = "id long, entity string, invariant_type string, title string, confidence string, evidence struct<code_snippet string, explanation string>, rank string"


def findings(spark, *rows):
    return spark.createDataFrame([(i + 1, e, k, t, c, (s, None), "x") for i, (e, k, t, c, s) in enumerate(rows)], FOUND)


def test_exact_and_fuzzy_duplicates(spark):
    f = findings(spark, ("A", "protocol", "one two", "medium", "x"), ("a ", "protocol", "One  two", "high", "x"), ("a", "protocol", "one two", "high", "xx"), ("a", "state_machine", "one two", "low", ""), (None, None, None, None, None))
    assert sorted(r.id for r in dedup.exact(f).collect()) == [3, 4, 5]
    g = findings(spark, ("w", "protocol", "waker empty state", "high", "xx"), ("w", "protocol", "waker empty idle state", "high", "x"), ("w", "protocol", "waker full other", "low", ""), ("v", "protocol", "waker empty state", "low", ""))
    assert sorted(r.id for r in dedup.fuzzy(dedup.exact(g)).collect()) == [1, 3, 4]
    assert dedup.fuzzy(dedup.exact(g.limit(0))).count() == 0


def test_fuzzy_is_greedy_best_first(spark):
    import random

    rng, names = random.Random(3), "abcdefg"
    rows = [("e", "protocol", " ".join(rng.sample(names, rng.randint(0, 6))), rng.choice(["high", "low", "medium"]), "x" * rng.randint(0, 5)) for _ in range(150)]
    weighed = dedup.weighed(findings(spark, *rows)).cache()
    got = {r.id for r in dedup.fuzzy(weighed).collect()}
    assert got == {r.id for r in dedup.fuzzy(weighed, hot=1).collect()}  # by common subsets
    rank = {"high": 3, "medium": 2, "low": 1}
    kept = []
    for i, r in sorted(enumerate(rows, 1), key=lambda x: (-rank[x[1][3]], -len(x[1][4]), x[0])):
        w = set(r[2].split())
        if all(not (w | k) or len(w & k) / len(w | k) <= 0.6 for _, k in kept):
            kept.append((i, w))
    assert got == {i for i, _ in kept}


def test_classes(spark):
    r = one(spark, C.kind_of(F.lit("Temporal thing")), C.kind_of(F.lit(None).cast("string")), C.kind_of(F.lit("State Machine")), C.confidence_of(F.lit(" HIGH ")), C.confidence_of(F.lit("?")), C.kind_of_text(F.lit("RAII guard"), F.lit("x")), C.retry_after(F.lit("Rate limit, retry after 12s")), C.is_retryable(F.lit("HTTP 503")), C.backoff_ms(F.lit(0), F.lit(0), F.lit(3)), C.backoff_ms(F.lit(12), F.lit(9), F.lit(None).cast("int")), C.short_count(F.lit(1_234_567)), C.cut_bytes(F.lit("aéé"), 2, "..."))
    assert tuple(r) == ("temporal_ordering", "protocol", "state_machine", "high", "medium", "resource_lifecycle", 12, True, 4000, 300_000, "1.2M", "a...")


def test_replies(spark):
    text = F.lit('Sure:\n```json\n[{"a": [1]}]\n```\n[x]')
    listing = F.lit("1. src/a.rs\n Similarity 0.82\n42: x\n45: y\n\n2. src/b.rs\n Similarity 0.7\nno line\n\n3. src/c.rs\n10: z")
    r = one(spark, R.json_part(text), R.json_part(F.lit("] [")), R.json_part(F.lit(None).cast("string")), R.field(F.lit("**Entity:** A\n**States:** x\ny\n**Evidence:**"), "States"), R.field(F.lit("Entity: A\nEvidence:"), "Evidence"), F.size(R.sections(F.lit("INVARIANTS FOUND\nINVARIANT 1 a INVARIANT 2 b"))), F.size(R.sections(F.lit("NO INVARIANTS"))), R.hits(listing))
    assert tuple(r)[:7] == ('[{"a": [1]}]', None, None, "x\ny", None, 2, 0)
    assert [tuple(x) for x in r[7]] == [("src/a.rs", 0.82, 42, 45), ("src/c.rs", None, 10, 10)]


def test_described_findings(spark):
    text = "INVARIANTS FOUND\nINVARIANT 1\nName: A\nDescription: x\ny\nConfidence: high\nINVARIANT 2\nName: B\nINVARIANT 3\n**Name:** C\n**Description:** z"
    got = one(spark, R.described(F.lit(text)).alias("f"), R.described(F.lit("[]")), R.described(F.lit(None).cast("string")))
    assert [(x["name"], x["description"], x["confidence"]) for x in got[0]] == [("A", "x\ny", "high"), ("C", "z", None)] and got[1] == got[2] == []


def test_citations(spark):
    rows = [(1, "high", ("a\nlet x = 1;\nb", "Evidence: line 2: let x = 1;; line 90: LET X")), (2, "high", ("a", "line 1: zzz; line 2: yyy")), (3, "low", (None, None))]
    f = spark.createDataFrame(rows, "id long, confidence string, evidence struct<code_snippet string, explanation string>")
    assert sorted(tuple(r) for r in verify.citations(f).collect()) == [(1, 2, 2, 1.0, "high"), (2, 2, 0, 0.0, "medium"), (3, 0, 0, 0.5, "low")]


def test_expected_values(spark):
    a = spark.createDataFrame([(1, "x", 2), (2, None, 2), (3, "x", 3)], "id long, a string, b int")
    e = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, None, 3)], "id long, a string, b int")
    assert sorted(tuple(r) for r in verify.compared(a, e, "id", ["a", "b"]).collect()) == [(1, True), (2, False), (3, True)]


def test_module_tree(spark):
    rows = [("c", "crate", "mod a;\npub mod b { }\n// mod x;\nmod tests;"), ("c", "a", "pub(crate) mod b;\nmod gone;"), ("c", "a::b", "mod c;"), ("c", "a::b::c", "mod c;"), ("c", "z::y", ""), ("d", "a", "mod b;"), ("d", "a::b", None)]
    chunks = spark.createDataFrame([(c, f"{m}#0", m, t) for c, m, t in rows], "crate_name string, chunk_id string, module_path string, raw_source string")
    assert sorted((r.crate_name, r.parent, r.module) for r in modules.children(chunks).collect()) == [("c", "a", "a::b"), ("c", "a::b", "a::b::c"), ("c", "crate", "a"), ("d", "a", "a::b")]
    assert sorted((r.module, r.depth) for r in modules.reached(modules.workspace(chunks)).collect()) == [("c", 1), ("c::a", 2), ("c::a::b", 3), ("c::a::b::c", 4), ("workspace", 0)]
    assert modules.reached(modules.workspace(chunks), depth=2).count() == 3
    assert modules.children(chunks, by_path=True).count() == 4 and modules.reached(modules.workspace(chunks.limit(0))).count() == 1
    ring = spark.createDataFrame([("workspace", "a"), ("a", "b"), ("b", "a"), (None, "x")], "parent string, module string")
    assert sorted((r.module, r.depth) for r in modules.reached(ring).collect()) == [("a", 1), ("b", 2), ("workspace", 0)]


TYPESTATE = """use std::marker::PhantomData;

/// Not open.
pub struct Closed;
pub struct Open;

pub struct FileHandle<S> {
    path: String,
    _state: PhantomData<S>,
}

impl FileHandle<Closed> {
    pub fn new(path: &str) -> Self {
        todo!()
    }
    pub fn open(self) -> FileHandle<Open> {
        todo!()
    }
}

impl FileHandle<Open> {
    pub unsafe fn read(&self) -> u8 { 0 }
}

impl Drop for FileHandle<Open> {
    fn drop(&mut self) {}
}

impl Clone for Closed { fn clone(&self) -> Self { Closed } }

enum Kind { A }

pub fn reopen(h: FileHandle<Closed>) -> FileHandle<Open> { h.open() }
unsafe fn stray() {}
trait Named { fn name(&self); }
"""


def test_clusters_by_type(spark):
    chunks = spark.createDataFrame([("c", "file_handle", "io::file_handle", TYPESTATE), ("c", "none", "m", None), ("c", "blank", "m", ""), ("c", "uses", "m", "use a::b;\n")], "crate_name string, chunk_id string, module_path string, raw_source string")
    got = {r.cluster: r for r in modules.clusters(chunks).collect()}
    assert {k: r.summary for k, r in got.items()} == {
        0: "struct Closed, 1 free function(s), impl FileHandle<Closed> (2 methods)",
        1: "struct Open, impl FileHandle<Open> (1 methods), impl Drop for FileHandle<Open> (1 methods)",
        2: "struct FileHandle",
        3: "enum Kind",
        4: "trait Named, 1 free function(s)",
    }
    assert [got[i].anchor for i in range(5)] == ["Closed", "Open", "FileHandle", "Kind", None]
    parts = {r.cluster: r for r in modules.siblings(modules.clusters(chunks)).collect()}
    assert parts[3].part == "file_handle#3" and parts[4].siblings.endswith("; struct FileHandle; enum Kind")
    assert {r.chunk_id: r.score for r in modules.scores(chunks, ["io"]).collect()} == {"file_handle": 1000 + 50 + 40 + 30 + 20 + 20, "none": 0, "blank": 0, "uses": 0}
    named = {r.name: r.chars for r in modules.items(chunks).where("kind <> 'impl'").collect()}
    assert named["Closed"] == len("Closed") + 20 + len("Not open.") and named["FileHandle"] == 10 + 20 + (4 + 6 + 4) + (6 + 14 + 4) and named["Named"] == 5 + 20
    assert modules.clusters(chunks.limit(0)).count() == 0


def test_spans_of_nested_and_open_headers(spark):
    text = "fn a() {\nfn b() {\n}\n}\nmod m {\nfn c();\nstruct D {\n"
    chunks = spark.createDataFrame([("c", "x", text)], "crate_name string, chunk_id string, raw_source string")
    assert sorted((r.line_no, r.end_line) for r in modules.spans(chunks).collect()) == [(1, 4), (2, 3), (5, 7), (6, 7), (7, 7)]


def test_titles_of_a_template_stay_linear(spark):
    from sievework.operators.similarity import meetings

    words = [f"t{i}" for i in range(16)]
    sets = [(i, "b", sorted([*words, f"x{i}", f"y{i}", f"z{i}", f"u{i % 3}"])) for i in range(1200)]
    pairs, groups = meetings(spark.createDataFrame(sets, "cid long, block string, w array<string>"))
    assert pairs.count() + groups.count() < 1200 * 40  # all pairs would be 719,400
    assert {r.id for r in groups.select("id").distinct().collect()} == set(range(1200))


def test_programs_without_report(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "crate_name string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("a",), (None,)], "crate_name string").write.parquet(f"{tmp_path}/report_files.parquet")
    assert [r.program for r in entry.queries()["programs_without_report"](spark, str(tmp_path)).collect()] == ["b"]


def test_strict_replies(spark):
    good = '[{"name": "n", "kind": "k", "description": "d", "evidence": ["e"], "suggested_pattern": "p", "implementation_sketch": "s", "confidence": "high"}]'
    cases = [(good, 1), ("[]", 0), (good.replace('"d"', "3"), None), (good.replace('["e"]', '"e"'), None), (good.replace('"confidence": "high"', '"entity": 1, "confidence": "high"'), None), ("[1]", None), ("no", None), (None, None)]
    df = spark.createDataFrame(cases, "r string, n int").select("r", "n", R.decoded(F.col("r")).alias("got"), R.verdict(F.col("r")).alias("v"))
    assert [r.got for r in df.collect()] == [n for _, n in cases]
    v = spark.createDataFrame([('x {"valid": true, "adjusted_confidence": "LOW"} y',), ('{"valid": false}',), ("{}",), ("nothing",)], "r string").select(R.verdict(F.col("r")).alias("v")).collect()
    assert [tuple(r.v) for r in v] == [(True, "low"), (False, "medium"), (False, "medium"), (True, "medium")]


def test_running_total_and_places(spark):
    rows = spark.range(1, 2001).select("id", (F.col("id") % 3 == 0).cast("string").alias("g"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    got = {r.id: r.before for r in order.running_total(rows, ["g"], "id", "v", span=64).collect()}
    sums = {}
    for i in range(1, 2001):
        g = i % 3 == 0
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (i if i % 5 else 0)


def test_nearest(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, None)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.place) for r in search.nearest(v, v.where("vec_id = 0"), k=2).orderBy("place").collect()] == [(1, 1), (3, 2)]
    assert search.nearest(v, v.limit(0)).count() == 0


def test_detector_retries_and_replay(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def complete(self, prompt):
            self.calls += 1
            if prompt == "bad":
                raise ValueError("no such model")
            if self.calls % 2:
                raise RuntimeError("rate limit")
            return prompt.upper(), len(prompt)

    p = spark.createDataFrame([("1", "abc"), ("2", "bad")], "prompt_id string, prompt string")
    out = {r.prompt_id: (r.reply, r.tokens, r.error) for r in detect.answered(p, Flaky, 1, pause=lambda s: None).collect()}
    assert out == {"1": ("ABC", 3, None), "2": (None, 0, "no such model")}
    replies = p.select(F.sha2("prompt", 256).alias("prompt_hash"), F.lit("[]").alias("reply"), F.lit(1).alias("tokens")).limit(1)
    assert {r.error for r in detect.replayed(p, replies).collect()} == {None, "no such reply"}


def test_sources_and_sinks(spark, tmp_path):
    for name, text in (("a/src/lib.rs", b"fn a() {}"), ("a/src/main.rs", b"x"), ("b/main.rs", b"\xff\xfe"), ("a/target/x.rs", b"no"), (".c/lib.rs", b"x"), ("d/src/other.rs", b"x")):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(text)
    f = files.rust_files(spark, str(tmp_path / "src"))
    assert {r.path.split("/src/", 1)[1]: r.error for r in f.collect()}["b/main.rs"] == "read error: not valid UTF-8"
    roots = files.crate_roots(f, str(tmp_path / "src")).collect()
    assert [(r.crate, r.root and r.root.split(str(tmp_path))[1], r.error) for r in roots] == [("a", "/src/a/src/lib.rs", None), ("b", "/src/b/main.rs", None), ("d", None, "no crate root")]
    for name, text in (("x.json", '{"a": 1}'), ("y.json", "{")):
        (tmp_path / name).write_text(text)
    assert sorted((r.file[-6:], r.error) for r in files.report_payloads(spark, str(tmp_path / "*.json")).collect()) == [("x.json", None), ("y.json", "no valid JSON")]
    rows = spark.createDataFrame([("c", "a#0", "completed")], "crate_name string, module_path string, status string")
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    (tmp_path / "log" / "broken.json").write_text("{not json\n\n")
    assert files.progress_log(spark, str(tmp_path / "log")).where("status = 'completed'").count() == 2
    (tmp_path / "t.toml").write_text("[a]\nb = 1\n")
    assert files.settings(str(tmp_path / "t.toml")) == {"a": {"b": 1}}
    found = spark.createDataFrame([(i, "r", "protocol", "T", "D", ("f", 1, 2), ("s", "e"), "p", "high", "E") for i in (2, 1)], "id long, run_id string, invariant_type string, title string, description string, location struct<file_path string, line_start long, line_end long>, evidence struct<code_snippet string, explanation string>, suggested_pattern string, confidence string, entity string")
    lost = spark.createDataFrame([("r", "x.rs", "read error"), ("q", "y.rs", "read error")], "run_id string, file string, error string")
    sinks.write_report(sinks.report_markdown(found, lost, "run_id"), "run_id", str(tmp_path / "md"))
    text = lambda d, run: "".join(p.read_text() for p in sorted((tmp_path / d / f"run_id={run}").glob("part-*")))
    assert re.findall(r"^#+ .*", text("md", "r"), re.M) == ["# Latent Invariant Analysis Report", "## Summary", "## Protocol Invariants", "### 1. T", "### 2. T", "## Skipped Files"]
    sinks.write_report(sinks.report_json(found, lost, "run_id"), "run_id", str(tmp_path / "json"))
    assert [x["id"] for x in json.loads(text("json", "r"))["invariants"]] == [1, 2] and json.loads(text("json", "q")) == {"summary": dict.fromkeys(sinks.COUNTS, 0), "invariants": [], "parse_failures": [["y.rs", "read error"]]}


def test_resumed_stream(spark, tmp_path):
    chunks = spark.createDataFrame([("c", f"m#{i}") for i in range(4)], "crate_name string, chunk_id string")
    chunks.write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("crate_name string, chunk_id string").json(str(tmp_path / "in"))
    work = lambda rows: rows.select("crate_name", F.col("chunk_id").alias("module_path"), F.lit("completed").alias("status"))
    log = str(tmp_path / "log")
    logs.analyse_stream(spark, stream(), log, str(tmp_path / "k1"), work).awaitTermination()
    assert files.progress_log(spark, log).count() == 4
    logs.analyse_stream(spark, stream(), log, str(tmp_path / "k2"), work).awaitTermination()  # all over again, with another checkpoint
    assert files.progress_log(spark, log).count() == 4


def test_messages_once_in_a_stream(spark, tmp_path):
    from sievework.operators.redelivery import SeenIndex

    rows = lambda a, b: spark.createDataFrame([(i, str(i % 5)) for i in range(a, b)], "delivery_no long, k string")
    index = SeenIndex(spark, 100, path=str(tmp_path / "index"))
    stream = lambda: spark.readStream.schema("delivery_no long, k string").json(str(tmp_path / "in"))
    for a in (0, 6):
        rows(a, a + 6).write.mode("append").json(str(tmp_path / "in"))
        logs.once_stream(stream(), index, str(tmp_path / "out"), str(tmp_path / "k"), F.col("k")).awaitTermination()
    kept = lambda: sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert kept() == ["0", "1", "2", "3", "4"]
    rows(100, 102).select(F.col("delivery_no"), F.concat(F.lit("new"), "k").alias("k")).write.json(str(tmp_path / "in2"))
    other = spark.readStream.schema("delivery_no long, k string").json(str(tmp_path / "in2"))
    logs.once_stream(other, index, str(tmp_path / "out"), str(tmp_path / "k2"), F.col("k")).awaitTermination()  # its batch 0 is another
    assert kept() == ["0", "1", "2", "3", "4", "new0", "new1"]
