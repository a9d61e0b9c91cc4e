"""Sentences of every document, in whatever script."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import boundaries as B
from .lexicon import Lexicon, first_run, last_run, lexicon

_CLOSERS = {v: k for k, v in {**B.BRACKETS, **B.QUOTES}.items()}
_OPENERS = {**B.BRACKETS, **B.QUOTES}
_SPACE = " \t\r\n\f\v ​⁠﻿　  \u0085"
_TERM = set(B.FULL + B.PLAIN)
_FULL = set(B.FULL)
_SHUT = B.CLOSING | set(_SPACE)

_LINE = regex.compile(r"[^\n]*(?:\n|\Z)")
_PREFIX = regex.compile(r"[ \t﻿]*(?:(?:>[ \t]?)+|//[/!]?(?=[\s])|//[/!]?$)")
_FENCE = regex.compile(r"[ \t﻿]*(```+|~~~+)")
_HEADING = regex.compile(r"[ \t﻿]*#{1,6}[ \t]")
_ITEM = regex.compile(r"[ \t﻿]*(?:[-*+•‣·][ \t]+|\(?\d{1,4}(?:[)][ \t]+|）[ \t]*)|(\d{1,4})[.．][ \t]+|(\p{Latin})[)][ \t]+)")
_EVENT = regex.compile(
    r"`+|[" + regex.escape("".join(_TERM)) + r"]+|[" + regex.escape("".join({*_OPENERS, *_CLOSERS})) + r"]|(?<=[\p{Thai}--\p{N}--\p{S}--\p{P}])[ \t\r\n ]+(?=[\p{Thai}--\p{N}--\p{S}--\p{P}])", regex.V1
)
_MARK = regex.compile(r"\p{M}")
_BEFORE = regex.compile(r"(\p{L}{1,2})\.\s+\Z")
_PREVIOUS = regex.compile(r"([\p{L}\p{M}\d.,]+)\s+\Z")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_GERMAN = regex.compile(B.GERMAN)
_SHORT_NEXT = regex.compile(r"\s+\p{L}{1,3}\.")
_ORDINAL = regex.compile(r"(?:([\p{L}]+)\s+)?(\d+)\Z")
_AFTER_NUMBER = regex.compile(r"\d\s*\Z")
_VOWEL = regex.compile(r"[aeiouyáéíóúàèùâêîôûäöüаеёиоуыэюя]", regex.I)
_NEXT_WORD = regex.compile(r"[\p{L}\p{M}]+")
_NO_WORDS = Lexicon({})


def _caseless(c: str) -> bool:
    return c.isalpha() and not c.islower() and not c.isupper()


def _opens(c: str) -> bool:
    """Whether a sentence after a gap plainly begins with c."""
    return c.isupper() or c.isdigit() or c in "`¿¡#@" or c in _OPENERS or c.istitle()


def blocks(text: str) -> tuple[str, list[tuple[int, int]]]:
    """(text with line marks blanked, spans of paragraphs, headings and list items); fenced code is in none."""
    clean, spans = list(text) if "//" in text or ">" in text else None, []
    start, end, number, fence = -1, 0, None, ""

    def flush() -> None:
        nonlocal start
        if start >= 0:
            spans.append((start, end))
        start = -1

    for m in _LINE.finditer(text):
        a, z = m.span()
        if a == z:
            continue
        line = m[0]
        if fence:
            if (f := _FENCE.match(line)) and f[1].startswith(fence) and not line[f.end() :].strip():
                fence = ""
            continue
        body = 0
        if p := _PREFIX.match(line):
            body = p.end()
            clean[a : a + body] = " " * body
            line = " " * body + line[body:]
        if f := _FENCE.match(line, body):
            flush()
            fence, number = f[1], None
        elif not line.strip(_SPACE):
            flush()
            number = None
        elif _HEADING.match(line, body):
            flush()
            spans.append((a, z))
            number = None
        else:
            item = _ITEM.match(line, body)
            if item and item[1] and start >= 0 and not (number is not None and int(item[1]) == number + 1):
                item = None  # a number that a line break left at a line's start
            if item and item[2] and start >= 0:
                item = None
            if item:
                flush()
                number = int(item[1]) if item[1] else None
                start = a + item.end() if a + item.end() < z and line[item.end() :].strip() else a
            elif start < 0:
                start = a
            end = z
    flush()
    return "".join(clean) if clean else text, spans


def _word_before(text: str, a: int, i: int) -> str:
    """The letters, marks and inner full stops right before i; none if there is no letter right before it."""
    j = i
    while j > a and ((c := text[j - 1]).isalpha() or c == "." and j < i and text[j] != "." or ord(c) > 0x2FF and _MARK.match(c)):
        j -= 1
    return text[j + 1 : i] if j < i and text[j] == "." else text[j:i]


def _pairs(text: str, events: list[tuple[int, int, str]], a: int, z: int) -> dict[int, int]:
    """Opening position -> end of each outermost quotation, bracket or code span of a block; what has no counterpart counts for nothing."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    code = -1
    for i, end, c in events:
        if c[0] == "`":
            if code < 0:
                if text.find(c, end, z) >= 0:
                    code, tick = i, c
            elif c == tick:
                found.append((code, end))
                code = -1
            continue
        if code >= 0 or c[0] in _TERM or c[0] in _SPACE:
            continue
        close = _CLOSERS.get(c)
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == close or c == "”" and stack[k][0] == "„"), None) if close else None
        if at is not None:
            found.append((stack[at][1], i + 1))
            del stack[at:]
        elif c in _OPENERS:
            stack.append((c, i))
    out: dict[int, int] = {}
    last = a
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= last:
            out[s] = e
            last = e
    return out


def _dot(text: str, a: int, i: int, end: int, nxt: str, at: int, gap: bool, german: list) -> bool:
    """Whether the single full stop at i, followed by ``nxt`` at ``at``, ends a sentence."""
    word = _word_before(text, max(a, i - 40), i)
    low = word.lower()
    if "." in word and low not in B.NEVER | B.EITHER:
        word = word.rpartition(".")[2]  # what a missing space glued together
        low = word.lower()
    if word:
        k = i - len(word)
        if k > a + 2 and text[k - 1].isspace() and (b := _BEFORE.search(text, max(a, k - 8), k)):
            low = f"{b[1].lower()}.{low}" if f"{b[1].lower()}.{low}" in B.NEVER | B.EITHER else low
        elif len(word) <= 2 and gap and _SHORT_NEXT.match(text, i + 1, i + 12) and f"{low}.{text[at : at + 3].split('.')[0].lower()}" in B.NEVER | B.EITHER:
            return False
        if low in B.NEVER or low in B.NUMBERED and nxt.isdigit():
            return False
    if not gap:
        before = text[i - 1]
        if len(word) == 1 or before in "./_:":
            return False
        if nxt.isupper() and not before.isupper():
            w = _NEXT_WORD.match(text, at)[0]
            tail = text[at + len(w) : at + len(w) + 1]
            short = tail == "." and (w.lower() in B.NEVER | B.EITHER or len(w) == 1 and text[at + 2 : at + 3].isupper())
            return short or (len(w) == 1 or w[1:].islower()) and tail in (" ", "\n", ",", "’", "")
        return _caseless(nxt) and _caseless(before) and end == i + 1
    if low in B.EITHER:
        return _opens(nxt) or _caseless(nxt)
    if text[i - 1].isdigit():
        p = _ORDINAL.search(text[max(a, i - 24) : i])
        if p and nxt.isupper() and len(p[2]) <= 3:
            if _NEXT_WORD.match(text, at)[0] in B.MONTHS:
                return False
            if p[1] and p[1].lower() in B.ORDINAL_BEFORE:
                if not german:
                    german.append(bool(_GERMAN.search(text)))
                return not german[0]
        return True
    if len(word) == 1 and word.isupper() and nxt.isupper():
        p = _PREVIOUS.search(text, max(a, i - 30), i - 1)
        return not (p is None or p[1][0].isupper())
    if nxt.islower() and word:
        unit = _AFTER_NUMBER.search(text[max(a, i - len(word) - 3) : i - len(word)])
        return bool(unit or _VOWEL.search(word)) and len(word) > 1 or text[i - len(word) - 1] in ":/_"
    return True


def block_ends(text: str, a: int, z: int, words: Lexicon = _NO_WORDS) -> list[int]:
    """Where the sentences of one block end.

    The candidates, terminators outside of quotations and brackets and those that close one, form a
    lattice; each is scored by what stands around it, and of the ways through the block that
    give every sentence a letter or digit the one with the highest sum is taken. Gaps of spaceless
    scripts that no rule decides go by the words on either side of them in the lexicon's lattice.
    """
    stop = z
    while stop > a and text[stop - 1] in _SPACE:
        stop -= 1
    if not _ALNUM.search(text, a, stop):
        return []
    events = [(m.start(), m.end(), m[0]) for m in _EVENT.finditer(text, a, stop)]
    spans = _pairs(text, events, a, stop)
    german: list[bool] = []
    nodes: list[tuple[int, float]] = []
    begin, skip = a, a

    def add(end: int, score: float) -> None:
        nonlocal begin
        nodes.append((end, score))
        if score > 0:
            begin = end

    for i, end, c in events:
        if i < skip:
            continue
        if c[0] in _SPACE:
            # a gap between Thai letters: a space parts sentences, a line break needs words that lean to an end
            add(i, 2.0 if c.strip("\r\n") else words.leaning(last_run(text, i, a), first_run(text, end, stop)) - 0.5)
            continue
        if i in spans:
            end = skip = spans[i]
            if c[0] == "`":
                continue
            k = end - 1
            while k > i and text[k - 1] in _SHUT:
                k -= 1
            at = end
            while at < stop and text[at] in _SPACE:
                at += 1
            if k <= i or text[k - 1] not in _TERM or at >= stop or text[at] in _TERM:
                continue
            nxt, gap = text[at], at > end
            first = not text[begin:i].strip(_SPACE)
            if nxt in ",;:，、；：" or nxt in _CLOSERS and nxt not in _OPENERS:
                continue
            if c in B.BRACKETS:
                ends = first or gap and _opens(nxt) and not nxt.isdigit() or nxt.isupper()
            else:
                led = text[a:i].rstrip(_SPACE)[-1:] in (":", ",", "：")
                ends = nxt.isupper() or gap and (_opens(nxt) and not nxt.isdigit() or led and (nxt.isdigit() or nxt.islower() and not first))
            if ends:
                add(end, 1.0)
            continue
        if c[0] not in _TERM:
            continue
        while end < stop and text[end] in B.CLOSING and end not in spans:
            end += 1
        at = end
        while at < stop and text[at] in _SPACE:
            at += 1
        if at >= stop or text[at] in ",;:，、；：":
            continue
        nxt, gap = text[at], at > end
        if _FULL & set(c):
            ends = True
        elif "…" in c or c.count(".") > 1 and not set(c) & set("!?"):
            wide = _caseless(nxt) or nxt == "`" or nxt in _OPENERS
            if not gap and (c.count("…") > 1 or _caseless(text[i - 1])):
                ends = wide and words.leaning(last_run(text, i, a), first_run(text, at, stop)) > -1
            else:
                ends = gap and (_opens(nxt) or _caseless(nxt)) or nxt.isupper() and text[i - 1].islower()
        elif c[0] == "." and len(c) == 1:
            ends = i > a and _dot(text, a, i, end, nxt, at, gap, german)
        else:
            ends = gap or nxt.isupper() or _caseless(nxt) and nxt not in "ー"
        if ends:
            add(end, 1.0)
    # the way through the lattice: of the nodes up to the last letter or digit before an end, the best, or else the latest, comes before it
    nodes.append((stop, 0.0))
    best: list[tuple[float, int]] = []
    top, seen, last, looked = -1, 0, -1, a
    for k, (end, score) in enumerate(nodes):
        for i in range(end - 1, looked - 1, -1):
            if text[i].isalnum():
                last = i
                break
        looked = max(looked, end)
        while seen < k and nodes[seen][0] <= last:
            if top < 0 or best[seen][0] + 1e-9 >= best[top][0]:
                top = seen
            seen += 1
        value, via = (0.0, -1) if last >= 0 else (float("-inf"), -1)
        if top >= 0 and best[top][0] > value:
            value, via = best[top][0], top
        best.append((value + score, via))
    out, k = [], len(nodes) - 1
    if best[k][1] >= 0 and not _ALNUM.search(text, nodes[best[k][1]][0], stop):
        k = best[k][1]
    while k >= 0:
        out.append(nodes[k][0])
        k = best[k][1]
    return out[::-1]


def sentence_spans(text: str, words: Lexicon = _NO_WORDS) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text, in characters."""
    clean, spans = blocks(text)
    out = []
    for a, z in spans:
        for end in block_ends(clean, a, z, words):
            while clean[end - 1] in _SPACE:
                end -= 1
            while a < end and clean[a] in _SPACE:
                a += 1
            out.append((a, end))
            a = end
    return out


def _sentences(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Lexicon.of(sent.value)
        for b in batches:
            found = [sentence_spans(t, words) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "spans": [[{"sentence_no": i, "start_pos": s, "end_pos": e} for i, (s, e) in enumerate(f)] for f in found]})

    return run


def _ends(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Lexicon.of(sent.value)
        for b in batches:
            found = [[e for _, e in sentence_spans(t, words)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].repeat([len(f) for f in found]).to_numpy(), "end_pos": [e for f in found for e in f]}).astype({"end_pos": "int32"})

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.where("text IS NOT NULL AND trim(text) <> ''").select("doc_id", "text"), "doc_id")


def _sent(documents: DataFrame, words: Lexicon | None):
    return documents.sparkSession.sparkContext.broadcast((lexicon(documents) if words is None else words).plain())


def sentences(documents: DataFrame, words: Lexicon | None = None) -> DataFrame:
    """(doc_id, sentence_no, start_pos, end_pos, sentence): the sentences of each text, in order.

    Positions count characters; end_pos is that of the last one, closing marks included. A blank
    line, a heading or a list item always ends a sentence, a line break within a paragraph and the
    comment or quote marks at line starts do not; fenced code is left out; what stands within
    quotation marks or brackets is not split. Spaced scripts go by a lattice of terminators with
    abbreviations, numbers and what follows. In Thai, Chinese and Japanese text the full marks,
    and a space between Thai letters, part sentences by rule; other gaps are decided by the final
    and opening words that a lattice of the lexicon's words finds on either side. ``words`` is the
    lexicon; without one it is made from all of the documents. Null and blank texts have no rows;
    repeated rows repeat theirs; other columns are not read. Rows are independent: no sentence is
    shuffled.
    """
    cut = _texts(documents).mapInPandas(_sentences(_sent(documents, words)), "doc_id long, text string, spans array<struct<sentence_no int, start_pos int, end_pos int>>")
    return cut.select("doc_id", "text", F.inline("spans")).select("doc_id", "sentence_no", "start_pos", "end_pos", F.expr("substring(text, start_pos + 1, end_pos - start_pos)").alias("sentence"))


def sentence_ends(documents: DataFrame, words: Lexicon | None = None) -> DataFrame:
    """(doc_id, end_pos) of :func:`sentences`, without the texts."""
    return _texts(documents).mapInPandas(_ends(_sent(documents, words)), "doc_id long, end_pos int")
