"""The training-text operators against brute force, round trips and small cases."""

import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import components, leaks, lexicon, mixture, pieces, sentences, survivors
from sievework.llm.queries import VOCABULARY
from sievework.llm.rust_items import item_starts

# --- components


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (1, 2), (2, 1)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(40)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: survivors

FINDING = "id long, run_id string, invariant_type string, title string, evidence struct<code_snippet string, explanation string>, suggested_pattern string, confidence string, entity string, stage string, recorded_at timestamp, block string, cls string, n int"


def found(spark, *rows):
    full = [(i, run, kind, title, ("", ex), pat, conf, ent, stage, at, "b", "c", 1) for i, run, kind, title, ex, pat, conf, ent, stage, at in rows]
    return spark.createDataFrame(full, FINDING)


T = datetime(2025, 1, 1)


def test_each_field_from_its_best_row(spark):
    f = found(
        spark,
        (5, "r", "protocol", "a b c d", "Entity: x\nStates: n/a", "none", "HIGH ", "E", None, None),
        (6, "r", "Protocol", "A, b. c d", "**Entity:** x\n**States:** y", "p", "?", " e ", "imported", T),
        (7, "r", "PROTOCOL", "a b c d", "Entity:\nx\n\nStates:\ny", "q", "low", "e", "validator", None),
        (8, "r", "protocol", "a b c d e", None, " ", None, "E", "validator", None),
        (9, "q", "protocol", "a b c d", None, "p", "high", "E", None, None),  # another run
        (10, "r", "protocol", "a b c d", None, "p", "high", " ", None, None),  # no entity
        (11, None, "protocol", "a b c d", None, "p", "high", "E", None, None),
        (12, "r", "protocol", None, None, "p", "high", "E", None, None),
        (13, "r", "protocol", "...", None, "p", "high", "E", None, None),
    )
    assert [tuple(r) for r in survivors.survivors(f).collect()] == [(5, 5, 6, 7)]
    b = survivors.built(f).first()
    assert (b.group_id, b.confidence, b.suggested_pattern) == (5, "high", "q")


def test_fields_nobody_offers(spark):
    f = found(spark, (1, "r", None, "a b", None, "TODO", "?", "E", None, None), (2, "r", None, "a b", "", None, None, "E", None, None))
    assert [tuple(r) for r in survivors.survivors(f).collect()] == [(1, None, 1, None)]
    assert survivors.survivors(f.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_groups_against_brute_force(spark, hot):
    rng = random.Random(hot)
    words = [f"w{i}" for i in range(14)]
    rows = [(i, "r", "protocol", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), None, "p", "high", "hot" if i % 3 else f"e{i % 4}", None, None) for i in range(1, 241)]
    rows += [(1000 + i, "r", "protocol", "one title that many share " + str(i % 2), None, "p", "high", "hot", None, None) for i in range(100)]
    got = {r.group_id for r in survivors.survivors(found(spark, *rows), hot).collect()}
    root = {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {r[0]: (r[7], set(r[3].split())) for r in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) * 5 > 3 * len(sets[a][1] | sets[b][1]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    tops = [top(x) for x in root]
    assert got == {t for t in tops if tops.count(t) > 1}


def test_sections(spark):
    cases = {"": 0, "Entity:": 0, "Entity: N/A\nStates: a": 1, "*Entity* — x\n*States* — -\n*Evidence* — line 1: y": 2, "IMPLEMENTATION:\nz\n\nEntity:\nTODO\n": 1, "Entity: a\nEntity: b": 1}
    df = spark.createDataFrame(list(cases.items()), "e string, n int")
    assert all(r.got == r.n for r in df.select("n", survivors.filled_sections(F.col("e")).alias("got")).collect())


# --- 2: pieces

SOURCE = """//! File.
use a::b;

/// Doc
#[derive(Debug)]
pub struct S<'a> { x: &'a str }

// stands alone

fn f() { let c = '{'; let s = "}"; } // not above
const X: [u8; 2] = [1, 2];
/* fn no() {} */
macro_rules! m { () => { fn g() {} } }
unsafe impl Send for S<'_> {}
static R: &str = r#"
fn hidden() { " {
"#;
pub(crate) const unsafe fn k() {}
extern "C" { fn z(); }
thread_local! { static A: u8 = 1; }
#[test]

fn last() {}
"""


def test_item_lines():
    b = SOURCE.encode()
    assert [b[:x].count(b"\n") + 1 for x in item_starts(b)] == [4, 10, 11, 12, 14, 15, 18, 20, 21]
    assert item_starts(b"") == item_starts(b"}}}") == []
    assert item_starts("﻿\r\nfn é() {}\r\n".encode()) == [5]


@pytest.mark.parametrize("seed", range(6))
def test_pieces_round_trip(seed):
    rng = random.Random(seed)
    parts = [SOURCE, "é" * rng.randint(1, 900) + "\n", "x" * rng.randint(1, 5000), "\n" * rng.randint(1, 500), "fn a() {\n    // b\n}\n", "字 " * 300, "\r\n", '"' * rng.randint(0, 3), "/*"]
    text = "".join(rng.choice(parts) for _ in range(rng.randint(5, 60)))
    buf = text.encode()
    for limit, overlap in ((6000, 300), (1200, 300), (400, 4)):
        cuts = pieces.cut_positions(buf, item_starts(buf), limit, overlap)
        ends = [c for _, c in cuts[1:]] + [len(buf)]
        assert b"".join(buf[c:e] for (_, c), e in zip(cuts, ends)) == buf
        for k, ((s, c), e) in enumerate(zip(cuts, ends)):
            assert e - s <= limit and c - s <= overlap and (k == 0 or c > s)
            assert k == 0 or s >= cuts[k - 1][0]
            buf[s:e].decode()


def test_pieces_table(spark):
    rows = [("c", "big", "m", SOURCE * 40, "x"), ("c", "big", "m", SOURCE * 40, "x"), ("c", "small", "m", SOURCE, "x"), ("c", "null", None, None, "x"), ("c", "empty", "m", "", "x"), (None, "wide", "m", "漢" * 9000, "x")]
    df = spark.createDataFrame(rows, "crate_name string, chunk_id string, module_path string, raw_source string, text string")
    out = pieces.pieces(df).collect()
    assert {r.chunk_id for r in out} == {"big", "wide"}
    wide = sorted((r for r in out if r.chunk_id == "wide"), key=lambda r: r.piece_no)
    assert "".join(r.text.encode()[r.overlap_bytes :].decode() for r in wide) == "漢" * 9000
    assert pieces.pieces(df.limit(0)).count() == 0


def test_a_long_text_of_short_lines():
    buf = b"\n" * 200_000
    assert len(pieces.cut_positions(buf, [], 6000, 300)) >= 200_000 // 6000


# --- 6: leaks

ITEM = "item_id long, text string, lang string, doc_id string"
DOC = "doc_id long, text string, sig string, tab string"
LONG = "Which call on the guard has to precede the release so that the queue ends up empty? Name the step."
HAN = "创建守卫之后必须先调用释放函数然后才能读取队列中的剩余内容否则会出现竞争条件"


def docs(spark, *texts):
    return spark.createDataFrame([(i + 1, t, "x", "y") for i, t in enumerate(texts)], DOC)


def items(spark, *rows):
    return spark.createDataFrame([(i + 1, t, lang, "x") for i, (t, lang) in enumerate(rows)], ITEM)


def pairs(df):
    return sorted((r.doc_id, r.item_id) for r in df.collect())


@pytest.mark.parametrize("most", [0, 10**6])
def test_leaks_whatever_the_dress(spark, most):
    w = LONG.split()
    d = docs(
        spark,
        "> before " + " ".join(w[2:15]).upper() + " after",
        "// " + "\n// ".join(w[:13]),
        "no " + " ".join(w[:12]) + " zebra " + " ".join(w[12:]),
        LONG.replace("guard", "gu​ar\xadd").replace(" ", " ").replace("fi", "ﬁ"),
        None,
        "  ",
        "\n".join(HAN[i : i + 7] for i in range(0, 31, 7))[:40],
        HAN[:29],
        LONG,
        LONG,
    )
    t = items(spark, (LONG, "en"), (HAN, "zh"), ("too short", "en"), (None, "en"), (HAN + LONG, None))
    out = [x for x in pairs(leaks.leaks(d, t, most_sent=most)) if x[1] < 5]
    assert out == [(1, 1), (2, 1), (4, 1), (7, 2), (9, 1), (10, 1)]
    assert pairs(leaks.leaks(d.limit(0), t)) == pairs(leaks.leaks(d, t.limit(0))) == []


def test_a_passage_within_a_very_long_text(spark):
    rng = random.Random(1)
    noise = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(200_000))
    assert pairs(leaks.leaks(docs(spark, noise + " " + LONG + " " + noise, noise), items(spark, (LONG, "en")))) == [(1, 1)]


def test_recall_of_passages_with_an_edit(spark):
    rng = random.Random(5)
    texts, tests, want = [], [], set()
    for i in range(120):
        w = [f"v{rng.randint(0, 10**6)}" for _ in range(13)]
        tests.append((" ".join(w), "en"))
        k = rng.randrange(13)
        edited = {0: w[:k] + w[k + 1 :] + ["tail"], 1: w[:k] + ["new"] + w[k + 1 :], 2: w[:k] + ["new"] + w[k:]}[i % 3]
        texts.append("lead in " + " ".join(edited) + " and out")
        want.add((i + 1, i + 1))
    got = set(pairs(leaks.leaks(docs(spark, *texts), items(spark, *tests), edits=1, recall=0.95)))
    a = [leaks.units(t) for t, _ in tests]

    def near(i, j):
        u = leaks.units(texts[i])
        return any(leaks.within_edits(np.array([[hash(x) for x in u[s : s + 13]]]), np.array([[hash(x) for x in a[j]]]), 1)[0] for s in range(len(u) - 12))

    true = {(i + 1, i + 1) for i in range(120) if near(i, i)}
    assert got <= true and len(got) >= 0.9 * len(true) and len(true) > 30


@pytest.mark.parametrize("most", [0, 10**6])
def test_recall_of_passages_with_a_word_or_character_missing_added_or_changed(spark, most):
    rng = random.Random(6)
    kinds = {"missing": lambda w, k, new: w[:k] + w[k + 1 :], "changed": lambda w, k, new: w[:k] + [new] + w[k + 1 :], "added": lambda w, k, new: w[:k] + [new] + w[k:]}
    texts, tests, kind_of = [], [], []
    for i in range(180):
        lang, n = ("zh", 30) if i % 6 > 2 else ("en", 13)
        w = [chr(rng.randint(0x4E00, 0x9000)) for _ in range(n)] if lang == "zh" else [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
        kind, join = list(kinds)[i % 3], "" if lang == "zh" else " "
        tests.append((join.join(w), lang))
        edited = join.join(kinds[kind](w, rng.randrange(1, n - 1), "新" if lang == "zh" else "new"))
        texts.append(edited if i < 36 else f"lead in {edited} and out")
        kind_of.append((lang, kind))
    got = pairs(leaks.leaks(docs(spark, *texts), items(spark, *tests), edits=1, recall=0.95, most_sent=most, shifts=True))
    assert all(a == b for a, b in got)
    for x in set(kind_of):
        assert sum(kind_of[a - 1] == x for a, _ in got) >= 0.9 * kind_of.count(x), x


@pytest.mark.parametrize("edits", [1, 2])
def test_passages_that_hold(edits):
    rng = np.random.default_rng(3)
    n, p = 7, leaks.Plan(7, 1, 4, edits, edits)
    a, b, length = rng.integers(0, 2, (600, n + edits)), rng.integers(0, 2, (600, n)), rng.integers(n - edits, n + edits + 1, 600)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    want = [any(distance(x[:m], y) <= edits for m in range(n - edits, z + 1)) for x, y, z in zip(a.tolist(), b.tolist(), length)]
    assert leaks.holds(a, length, b, p).tolist() == want and 20 < sum(want) < 580


# --- 7: mixture


@pytest.mark.parametrize("seed", range(40))
def test_fit_reaches_the_best_sum(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 400, rng.integers(1, 20)))
    counts = rng.integers(1, 40, len(lengths))
    budget = int(rng.integers(0, (lengths * counts).sum() + 5))
    took = mixture.fit(lengths, counts, budget)
    reach = 1
    for n, c in zip(lengths, counts):
        for _ in range(c):
            reach |= reach << int(n)
    assert (took >= 0).all() and (took <= counts).all()
    assert (took * lengths).sum() == (reach & ((1 << budget + 1) - 1)).bit_length() - 1


@pytest.mark.parametrize("times", [1, 1000])
@pytest.mark.parametrize("part", [0.07, 0.3, 0.8])
def test_fit_takes_every_third_of_the_lengths_alike(times, part):
    rng = np.random.default_rng(9)
    lengths, counts = np.unique(rng.lognormal(6, 0.5, 2500).astype(int), return_counts=True)
    counts = counts * times
    budget = int((lengths * counts).sum() * part)
    took = mixture.fit(lengths, counts, budget)
    assert (took * lengths).sum() == budget and (took >= 0).all() and (took <= counts).all()
    third = np.cumsum(counts) * 3 // (counts.sum() + 1)
    for t in range(3):
        assert abs(took[third == t].sum() / counts[third == t].sum() - part) < 0.03, t


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("word" for _ in range(rng.randint(1, 40))), rng.choice(["Big-Source", "big source", "big_source"]), "x") for i in range(400)]
    rows += [(1000 + i, "same text here", "hot", "x") for i in range(300)] + [(2000, "one two", "rare", "x"), (2001, None, "rare", "x"), (2002, "", "rare", "x"), (2003, "a", None, "x"), (2004, "a", "other", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    t = spark.createDataFrame([("big_source", 0.5, 2), ("hot", 0.2, 1), ("rare", 0.2, 3), ("absent", 0.1, None)], "source string, target_share double, max_repeats int")
    mix, shares = mixture.mixture(d, t, VOCABULARY, total_tokens=2000)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"big_source", "hot", "rare", "absent"}
    assert s["big_source"].used_tokens == 1000 and 400 - 3 < s["hot"].used_tokens <= 400 and s["rare"].used_tokens == 3 * s["rare"].available_tokens and s["absent"].used_tokens == 0
    assert abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    m = mix.collect()
    assert len({r.doc_id for r in m}) == len(m) and all(r.copies <= {"big_source": 2, "hot": 1, "rare": 3}[r.source] for r in m)
    assert sum(r.copies * r.tokens for r in m) == sum(r.used_tokens for r in s.values())
    assert sorted(tuple(r) for r in mixture.mixture(d, t, VOCABULARY, total_tokens=2000)[0].collect()) == sorted(tuple(r) for r in m)
    assert mixture.mixture(d.limit(0), t, VOCABULARY)[0].count() == 0 and mixture.mixture(d, t.limit(0), VOCABULARY)[1].count() == 0


# --- 8: sentences


def cut(text):
    return [text[s:e] for s, e in sentences.sentence_spans(text)]


CASES = [
    ("One. Two! Three? Four… Five", ["One.", "Two!", "Three?", "Four…", "Five"]),
    ("It took 3.14 ms in v. 2.5.1, i.e. fast. See Fig. 4. Then Sect. 2 ff. for more.", ["It took 3.14 ms in v. 2.5.1, i.e. fast.", "See Fig. 4.", "Then Sect. 2 ff. for more."]),
    ("Rings, maps, etc. The rest. The U.S. copy at 9 a.m. on day\n8. For this, e.g. in `a. B`.", ["Rings, maps, etc.", "The rest.", "The U.S. copy at 9 a.m. on day\n8.", "For this, e.g. in `a. B`."]),
    ("It ends.Then more.Dept. B of io::fs. in a.b.c and src/x.rs.", ["It ends.", "Then more.", "Dept. B of io::fs.", "in a.b.c and src/x.rs."]),
    ("He said “Stop! Now.” and left. She asked, “Why?” Then it went (it did!) on. (All fine.) ok then.", ["He said “Stop! Now.” and left.", "She asked, “Why?”", "Then it went (it did!) on.", "(All fine.)", "ok then."]),
    ("so it seems ... or not. The rest is noise... Done.", ["so it seems ... or not.", "The rest is noise...", "Done."]),
    ("# Head. Line\nText\n\n- a. B\n- c\n1) x\n2) y\n\n```rust\nlet a. B\n```\nz", ["# Head.", "Line", "Text", "a.", "B", "c", "x", "y", "z"]),
    ("// One line\n// goes on. Next?\n// Last", ["One line\n// goes on.", "Next?", "Last"]),
    ("Am 14. Mai, z. B. hier, bis zum 9. Versuch. Siehe Abb. 9 und Abschn. 3. Seit ca. 2 Tagen usw. gilt das.", ["Am 14. Mai, z. B. hier, bis zum 9. Versuch.", "Siehe Abb. 9 und Abschn. 3.", "Seit ca. 2 Tagen usw. gilt das."]),
    ("Списки и т. д. Ок. 3 МБ, т. е. 5. «Нет! Ждите.» сказал он.", ["Списки и т. д.", "Ок. 3 МБ, т. е. 5.", "«Нет! Ждите.» сказал он."]),
    ("¡No llames! El valor aprox. 3, p. ej. aquí. ¿Sí?", ["¡No llames!", "El valor aprox. 3, p. ej. aquí.", "¿Sí?"]),
    ("日志写着“没有空位！请等待。”然后退出。（见第一行。）在模块中……对吗？", ["日志写着“没有空位！请等待。”然后退出。", "（见第一行。）", "在模块中……", "对吗？"]),
    ("ログには「空きがない！待て。」と出た。\nガードが残る……バッファは", ["ログには「空きがない！待て。」と出た。", "ガードが残る……", "バッファは"]),
    ("ค่าของ `X` ยังอยู่ 3 ครั้ง ไม่มีการตรวจสอบ ผู้เรียก", ["ค่าของ `X` ยังอยู่ 3 ครั้ง", "ไม่มีการตรวจสอบ", "ผู้เรียก"]),
    ("दर 3.5 हो गई। लॉग में “जगह नहीं! रुकें।” लिखा था।", ["दर 3.5 हो गई।", "लॉग में “जगह नहीं! रुकें।” लिखा था।"]),
    ("هل ما زالت؟ نعم. كتب «لا! انتظر.» ثم توقف.", ["هل ما زالت؟", "نعم.", "كتب «لا! انتظر.» ثم توقف."]),
    ("  \n\t", []), ("", []), ("...", []), ("***", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_sentences(text, want):
    assert [re.sub(r"^(?:// |[-#] )", "", x) if not x.startswith("# ") else x for x in cut(text)] == want


@pytest.mark.parametrize("marks", ["! ! ! ! ! ! ! !", "? ! ? ! ? ! ? ! ? !"])
def test_many_marks_in_a_row_keep_the_sentences_before(marks):
    assert [x.split()[0] for x in cut(f"One here. Two there. Three {marks} Four it is.")] == ["One", "Two", "Three", "Four"]
    assert [x.split()[0] for x in cut(f"One here. Two there. Three {marks}")] == ["One", "Two", "Three"]


def test_sentences_cover_each_text():
    rng = random.Random(7)
    alphabet = "aB1 .!?…\n\"“”()（）「」。`*-#>/:,;éЖ中ก​"
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        spans = sentences.sentence_spans(t)
        assert all(s < e for s, e in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all(t[e - 1].strip() for _, e in spans)


def test_sentence_table(spark):
    d = spark.createDataFrame([(1, "A b. C d.", "x"), (2, None, "x"), (3, " ", "x"), (4, "A b. C d.", "x"), (5, "w. " * 50_000, "x")], "doc_id long, text string, spans string")
    ends = sentences.sentence_ends(d)
    assert sorted(tuple(r) for r in ends.where("doc_id < 5").collect()) == [(1, 4), (1, 9), (4, 4), (4, 9)]
    assert [r.sentence for r in sentences.sentences(d).where("doc_id = 1").orderBy("sentence_no").collect()] == ["A b.", "C d."]
    assert sentences.sentence_ends(d.limit(0)).count() == 0


# --- the lexicon of spaceless scripts


def test_lexicon_learns_words_that_open_and_close(spark):
    rng = random.Random(8)
    nouns, verbs = ["守卫", "队列", "缓冲区", "模块", "句柄"], ["释放", "读取", "关闭", "等待"]
    texts = []
    for _ in range(400):
        parts = [f"但是{rng.choice(nouns)}{rng.choice(verbs)}{rng.choice(nouns)}的{rng.choice(nouns)}了" for _ in range(3)]
        texts.append("。".join(parts) + "。")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, "plain text")], "doc_id long, text string")
    x = lexicon.lexicon(d)
    assert x.segments("但是守卫释放队列")[0] == "但是" and x.segments("队列关闭缓冲区了")[-1] == "了"
    assert x.leaning("守卫关闭队列了", "但是队列") > 1 > -1 > x.leaning("守卫的", "的队列")
    word = x.words["但是"]
    assert word.total == word.opens == 1200 and x.words["了"].closes == 1200
    one = "守卫释放了……但是队列等待句柄了……的模块"
    assert [one[s:e] for s, e in sentences.sentence_spans(one, x)] == ["守卫释放了……", "但是队列等待句柄了……的模块"]
    assert lexicon.lexicon(d.where("doc_id > 8999")).words == {} == lexicon.lexicon(d.limit(0)).words


def test_segments_are_the_best_way():
    rng = random.Random(3)
    words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 4))): lexicon.Word(rng.random() * 3) for _ in range(12)}
    x = lexicon.Lexicon(words)
    gain = lambda parts: sum(len(p) * words[p].weight for p in parts if p in words)

    def every(t):
        return [[]] if not t else [[t[:k], *rest] for k in range(1, len(t) + 1) if t[:k] in words or k == 1 for rest in every(t[k:])]

    for _ in range(60):
        t = "".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 9)))
        got = x.segments(t)
        assert "".join(got) == t and abs(gain(got) - max(map(gain, every(t)))) < 1e-9
