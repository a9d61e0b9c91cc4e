"""The registered training-text queries over a whole small input, against plain Python."""

import os
import random
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from sievework.llm import leaks, pieces, queries
from sievework.llm.rust_items import item_starts, line_starts

EMPTY = {"", "na", "none", "null", "nil", "todo", "tbd", "unknown", "notavailable", "notapplicable"}


@pytest.fixture(scope="module")
def rows(data):
    con = duckdb.connect()
    return lambda table, cols: con.sql(f"SELECT {cols} FROM '{data}/{table}.parquet'").fetchall()


def bare(x):
    return re.sub(r"[\W_]", "", (x or "").lower())


def filled(text):
    found, last = defaultdict(str), None
    for line in (text or "").split("\n"):
        if m := re.match(r"[ \t*_#>•-]*(entity|states|transitions|evidence|implementation)[*_ \t]*(?::|—|–|-)[*_]*(.*)", line, re.I):
            last = (m[1].lower(), len(found))
            found[last] = m[2]
        elif last:
            found[last] += "\n" + line
    return len({k[0] for k, v in found.items() if bare(v) not in EMPTY})


def test_survivors_of_the_given_findings(spark, data, rows):
    f = {r[0]: r for r in rows("invariants", "id, run_id, entity, invariant_type, title, confidence, recorded_at, evidence.explanation, suggested_pattern, stage")}
    blocks = defaultdict(list)
    for i, r in f.items():
        words = set(re.findall(r"[^\W_]+", (r[4] or "").lower()))
        if r[1] is not None and (r[2] or "").strip() and words:
            blocks[r[1], bare(r[2]), bare(r[3])].append((i, words))
    root = {i: i for i in f}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in blocks.values():
        for k, (i, v) in enumerate(b):
            for j, w in b[:k]:
                if 5 * len(v & w) > 3 * len(v | w):
                    x, y = sorted((top(i), top(j)))
                    root[y] = x
    groups = defaultdict(list)
    for i in f:
        groups[top(i)].append(f[i])
    trust, want = {"validator": 3, "detector": 2, "imported": 1}, set()
    for g, members in groups.items():
        if len(members) > 1:
            first = lambda ok, key: min((r for r in members if ok(r)), key=lambda r: (*key(r), r[0]), default=[None])[0]
            stated = first(lambda r: bare(r[5]) in ("high", "medium", "med", "low"), lambda r: (-(r[6].timestamp() if r[6] else -1e18),))
            want.add((g, stated, first(lambda r: True, lambda r: (-filled(r[7]),)), first(lambda r: bare(r[8]) not in EMPTY, lambda r: (-trust.get(bare(r[9]), 0),))))
    got = {tuple(r) for r in queries.p1_found(spark, data).collect()}
    assert got == want and len(want) > 50
    built = {r.group_id: r for r in queries.p1_built(spark, data).collect()}
    assert {g: (f[p][8] if p else None) for g, _, _, p in want} == {g: r.suggested_pattern for g, r in built.items()}


def test_pieces_of_the_given_chunks(spark, data, rows):
    big = {(c, k): t for c, k, t in rows("chunks", "crate_name, chunk_id, raw_source") if t and len(t.encode()) > 6000}
    made = defaultdict(list)
    for r in queries.p2_pieces(spark, data).collect():
        made[r.crate_name, r.chunk_id].append(r)
    assert made.keys() == big.keys()
    lines = defaultdict(set)
    for r in queries.p2_found(spark, data).collect():
        lines[r.crate_name, r.chunk_id].add(r.line_no)
    at_items = inner = 0
    for key, parts in made.items():
        parts.sort(key=lambda r: r.piece_no)
        assert b"".join(r.text.encode()[r.overlap_bytes :] for r in parts).decode() == big[key]
        assert all(len(r.text.encode()) <= 6000 and 0 < r.overlap_bytes <= 300 for r in parts[1:]) and len(parts) > 1
        starts = {x for x in line_starts(big[key].encode())}
        for r in parts[1:]:
            inner += 1
            at_items += (r.start_byte + r.overlap_bytes) in starts and big[key].encode()[: r.start_byte + r.overlap_bytes].count(b"\n") + 1 in lines[key]
    assert at_items > 0.5 * inner


@pytest.mark.parametrize("seed", range(8))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    buf = "".join(rng.choice(["fn a() {\n  let b = 1;\n}\n", "// x y\n", "struct S;\n", "use a::b;\n", "é é\n\n"]) for _ in range(rng.randint(8, 14))).encode()
    limit, overlap, items = 64, 8, item_starts(buf)
    at, cost = pieces._boundaries(buf, items, line_starts(buf), (limit - overlap) // 4)
    at, cost = ([int(x) for x in at], list(cost)) if at[0] == 0 else ([0, *map(int, at)], [0.0, *cost])
    n = len(buf)
    even = n / max(1, -(-(n - overlap) // (limit - overlap)))
    back = {x: pieces._overlap_start(buf, line_starts(buf), x, overlap) if x else 0 for x in at}
    memo = {}

    def least(k):
        """The least cost of what follows the cut at ``at[k]``."""
        if k not in memo:
            ways = []
            for m in range(k + 1, len(at) + 1):
                end = n if m == len(at) else at[m]
                if end - back[at[k]] <= limit and (m == len(at) or end - at[k] >= overlap):
                    here = pieces.PER_PIECE + pieces.UNEVEN * ((end - at[k]) / even - 1) ** 2
                    ways.append(here + (0 if m == len(at) else cost[m] + least(m)))
            memo[k] = min(ways, default=float("inf"))
        return memo[k]

    cuts = [c for _, c in pieces.cut_positions(buf, items, limit, overlap)]
    of = dict(zip(at, cost))
    total = sum(pieces.PER_PIECE + pieces.UNEVEN * ((e - c) / even - 1) ** 2 + (of[c] if c else 0) for c, e in zip(cuts, [*cuts[1:], n]))
    assert abs(total - least(0)) < 1e-6


def test_leaks_of_the_given_items(spark, data, rows):
    def grams(text, lang):
        u = leaks.units(text or "")
        u, n = ("".join(u), 30) if lang in ("zh", "ja") else (u, 13)
        return {tuple(u[i : i + n]) for i in range(len(u) - n + 1)}

    by = {True: defaultdict(set), False: defaultdict(set)}
    for i, t, lang in rows("eval_items", "item_id, text, lang"):
        for g in grams(t, lang):
            by[lang in ("zh", "ja")][g].add(i)
    want = set()
    for d, t in rows("documents", "doc_id, text"):
        for chars, known in by.items():
            for g in grams(t, "zh" if chars else "en") & known.keys():
                want |= {(d, i) for i in known[g]}
    got = {(r.doc_id, r.item_id) for r in queries.p6_found(spark, data).collect()}
    assert got == want and len(want) > 50
    assert {r.item_id: r.documents for r in queries.p6_items(spark, data).collect()} == {i: sum(x == i for _, x in want) for (i,) in rows("eval_items", "item_id")}
    assert got <= {(r.doc_id, r.item_id) for r in queries.p6_near(spark, data).collect()}


def test_the_mix_of_the_given_sources(spark, data, rows):
    shares = {r.source: r for r in queries.p7_shares(spark, data).collect()}
    assert {k: (r.target_share, r.max_repeats) for k, r in shares.items()} == {s: (w, m) for s, w, m in rows("mix_targets", "source, target_share, max_repeats")}
    goal = {s: min(r.budget_tokens, r.available_tokens * r.max_repeats) for s, r in shares.items()}
    assert all(r.used_tokens == goal[s] for s, r in shares.items() if r.documents > 30 or r.documents == 0)
    assert all(goal[s] - r.available_tokens / max(1, r.documents) <= r.used_tokens <= goal[s] for s, r in shares.items())  # few documents may have no such sum
    mix = queries.p7_mix(spark, data).collect()
    assert len({r.doc_id for r in mix}) == len(mix) and all(0 < r.copies <= shares[r.source].max_repeats for r in mix)
    named = {bare(s): s for s in shares}
    texts = {i: named.get(bare(s)) for i, s, t in rows("documents", "doc_id, source, text") if t}
    used = defaultdict(list)
    for r in mix:
        assert texts[r.doc_id] == r.source
        used[r.source] += [r.tokens] * r.copies
    assert {s: sum(x) for s, x in used.items()} == {s: r.used_tokens for s, r in shares.items() if r.used_tokens}
    for s, x in used.items():  # documents of all lengths, not the short ones
        if len(x) > 60:
            r = shares[s]
            assert abs(sum(x) / len(x) / (r.available_tokens / r.documents) - 1) < 0.08, s


def test_sentences_of_the_given_documents(spark, data, rows):
    texts = dict(rows("documents", "doc_id, text"))
    made = defaultdict(list)
    for r in queries.p8_sentences(spark, data).collect():
        made[r.doc_id].append(r)
    ends = defaultdict(set)
    for r in queries.p8_found(spark, data).collect():
        ends[r.doc_id].add(r.end_pos)
    assert made.keys() == ends.keys() and all(texts[d].strip() for d in made)
    for d, parts in made.items():
        parts.sort(key=lambda r: r.sentence_no)
        assert {r.end_pos for r in parts} == ends[d] and [r.sentence_no for r in parts] == list(range(len(parts)))
        assert all(r.sentence == texts[d][r.start_pos : r.end_pos] and r.sentence == r.sentence.strip() != "" for r in parts)
        assert all(a.end_pos <= b.start_pos for a, b in zip(parts, parts[1:]))
        assert not any(re.search(r"\n[ \t]*\n", r.sentence) for r in parts)


def test_executors_need_not_have_the_package(tmp_path):
    """Tasks of every query run where only the driver can import the package."""
    small = "/root/testdata/sf0.001"
    if not Path(small).exists():
        pytest.skip("no test data here")
    script = tmp_path / "driver.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from sievework.session import local_session
import __spark_entry__ as entry
spark = local_session(4)
for name in ("p2_found", "p3_found", "p4_found", "p6_found", "p6_near", "p7_shares", "p8_found"):
    assert entry.queries()[name](spark, {small!r}).count() > 0, name
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
