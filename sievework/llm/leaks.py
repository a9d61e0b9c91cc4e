"""Evaluation items that leaked into documents."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

WORD = regex.compile(r"[\p{L}\p{N}]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")
UNSEEN = regex.compile(r"[\p{Cf}\p{M}]")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
#: The same for Spark, with what compatibility forms become such characters.
CJK_RANGES = r"[\x{2E80}-\x{2FDF}\x{3005}-\x{30FF}\x{3190}-\x{319F}\x{31F0}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{1F200}-\x{1F2FF}\x{20000}-\x{3FFFF}]"
#: Languages whose items are matched by characters, not words.
BY_CHARACTER = ("zh", "ja")
WORDS, CHARACTERS = 13, 30
#: Item windows up to this number (some 120 to 260 bytes each) are sent to every task; more are joined by shuffle.
SENT = 200_000
#: Bits of the filter that keeps document windows from the shuffle where items are joined so: 32 MB, whatever the number of items.
FILTER = 1 << 28
#: Windows that are walked at once, for the memory they take.
BLOCK = 1 << 17

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Plan(NamedTuple):
    """How windows of one unit are embedded: length, repetitions, sampled places a repetition; symbols by which a document's passage may be shorter or longer."""

    window: int
    tables: int
    samples: int
    edits: int
    spare: int = 0


def plan(window: int, edits: int, recall: float, shifts: bool = False) -> Plan:
    """Repetitions for the target recall.

    Equal windows walk alike, so one repetition finds them all. With k edits about 5k of the 3n
    places of the embedding are taken to differ (the random walks meet again after a few steps);
    the chance that no sampled place does then fixes the number of repetitions. With ``shifts``,
    where a symbol may be missing, 8.5k are taken: what the worst quarter of a window showed.
    """
    if edits == 0:
        return Plan(window, 1, min(16, window), 0)
    samples = max(4, window // 2)
    hit = (1 - min(0.75, (8.5 if shifts else 5) * edits / (3 * window))) ** samples
    return Plan(window, math.ceil(math.log(1 - recall) / math.log(1 - hit)), samples, edits, edits if shifts else 0)


def _scramble(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signatures(ids: np.ndarray, starts: np.ndarray, p: Plan, ends: np.ndarray | None = None) -> np.ndarray:
    """(windows, tables): hashes of sampled places of each window's CGK embedding; windows end at ``ends``, else after n symbols.

    The embedding of n symbols has 3n places: a walk writes its symbol at each and steps on by a
    random bit of (place, symbol), so that windows a few edits apart agree at most places.
    """
    n, places = p.window, 3 * p.window
    out = np.empty((len(starts), p.tables), np.int64)
    if len(starts) == 0:
        return out
    ends = starts + n if ends is None else ends
    low, always = starts.min(), int((ends - starts).min())
    # only the symbols of these windows are walked over
    ids, starts, ends = ids[low : ends.max()], starts - low, ends - low
    rng = np.random.default_rng(20_250)
    with np.errstate(over="ignore"):
        for t in range(p.tables):
            sampled = set(rng.choice(2 * n, p.samples, replace=False).tolist())
            seed = np.uint64(t * 1_000_003 + 17)
            bits = [_scramble(ids + (seed + np.uint64(w) * np.uint64(7919)) * _MIX) for w in range(-(-places // 64))]
            at, acc = starts.copy(), np.zeros(len(starts), np.uint64)
            for j in range(max(sampled) + 1):
                step = (bits[j // 64] >> np.uint64(j % 64)) & np.uint64(1)
                if j < always:  # no walk can have left its window yet
                    if j in sampled:
                        acc ^= ids[at]
                    at += step[at].view(np.int64)
                else:
                    inside = at < ends
                    i = np.where(inside, at, starts)
                    if j in sampled:
                        acc ^= np.where(inside, ids[i], np.uint64(j))
                    at += step[i].view(np.int64) & inside
                if j in sampled:
                    acc *= _MIX
                    acc ^= acc >> np.uint64(29)
            out[:, t] = acc.view(np.int64)
    return out


def within_edits(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether each row of a is at most ``edits`` insertions, deletions or changes from that of b."""
    if edits == 0:
        return (a == b).all(axis=1)
    # of rows of one length, one edit can only be a change; more may also be shifts, which the table finds
    out = (a != b).sum(axis=1) <= edits
    if edits == 1:
        return out
    rest = np.flatnonzero(~out)
    x, y, n = a[rest], b[rest], a.shape[1]
    row = np.tile(np.arange(n + 1, dtype=np.int16), (len(rest), 1))
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, n + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (x[:, i - 1] != y[:, j - 1]))
        live = new.min(axis=1) <= edits
        rest, x, y, row = rest[live], x[live], y[live], new[live]
    out[rest] = row[:, n] <= edits
    return out


def holds(a: np.ndarray, length: np.ndarray, b: np.ndarray, p: Plan) -> np.ndarray:
    """Whether each row of a begins with a passage of b's row, within the edits; only ``length`` symbols of a's row count.

    The passage may be up to ``spare`` symbols shorter or longer than b's row.
    """
    if p.spare == 0:
        return within_edits(a, b, p.edits)
    n = p.window
    if p.edits == 1:
        here = a[:, :n] == b
        lead = here.cumprod(axis=1).sum(axis=1)
        trail = lambda same: same[:, ::-1].cumprod(axis=1).sum(axis=1)
        changed = (length >= n) & (here.sum(axis=1) >= n - 1)
        missing = (length >= n - 1) & (lead + trail(a[:, : n - 1] == b[:, 1:]) >= n - 1)
        added = (length >= n + 1) & (lead + trail(a[:, 1 : n + 1] == b) >= n)
        return changed | missing | added
    out, rest, x, y, wide = np.zeros(len(a), bool), np.arange(len(a)), a, b, a.shape[1]
    row = np.tile(np.arange(wide + 1, dtype=np.int16), (len(a), 1))
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, wide + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (y[:, i - 1] != x[:, j - 1]))
        live = new.min(axis=1) <= p.edits
        rest, x, y, row = rest[live], x[live], y[live], new[live]
    out[rest] = ((row <= p.edits) & (np.arange(wide + 1) <= length[rest, None])).any(axis=1)
    return out


def units(text: str) -> list[str]:
    """The words that count: compatibility forms, case, marks and what cannot be seen are levelled."""
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return WORD.findall(UNSEEN.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())))


class _Symbols(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = v = xxhash.xxh3_64_intdigest(word)
        return v


def symbols(texts: list[str], by_character: bool, cache: _Symbols) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, where each text begins, and the end)."""
    parts = []
    for t in texts:
        w = units(t)
        if by_character:
            parts.append(_scramble(np.frombuffer("".join(w).encode("utf-32-le"), np.uint32).astype(np.uint64) + _MIX))
        else:
            parts.append(np.array([*map(cache.__getitem__, w)], np.uint64))
    ends = np.cumsum([0, *map(len, parts)])
    return np.concatenate([*parts, np.empty(0, np.uint64)]), ends


def _starts(ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, start) of every window of at least this length."""
    counts = np.maximum(np.diff(ends) - window + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(ends[:-1] - np.cumsum(counts) + counts, counts)
    return owner, first + np.arange(counts.sum())


def _passages(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray, wide: int) -> np.ndarray:
    """(windows, wide): the symbols from each start on; behind a text's end its last one again."""
    return ids[np.minimum(starts[:, None] + np.arange(wide), stops[:, None] - 1)]


def _blocks(texts: list[str], p: Plan, by_character: bool, cache: _Symbols, spare: int, block: int):
    """(text number of each window, a function that gives the passages of some, its length, its signatures), a block of windows at a time."""
    ids, ends = symbols(texts, by_character, cache)
    owner, starts = _starts(ends, p.window - spare)
    for k in range(0, len(starts), block):
        s, o = starts[k : k + block], owner[k : k + block]
        stops = np.minimum(s + p.window + spare, ends[o + 1])
        yield o, lambda x, s=s, stops=stops: _passages(ids, s[x], stops[x], p.window + spare).view(np.int64), stops - s, signatures(ids, s, p, np.minimum(s + p.window, stops))


def _item_windows(p: Plan, by_character: bool):
    """(item_id, own, sigs): the symbols and the signatures of every window of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Symbols()
        for b in batches:
            keys = b["item_id"].to_numpy()
            for o, own, _, sig in _blocks(b["text"].tolist(), p, by_character, cache, 0, BLOCK // 4):
                yield pd.DataFrame({"item_id": keys[o], "own": list(own(slice(None))), "sigs": list(sig)})

    return run


def _places(sig: np.ndarray, tab: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each signature."""
    with np.errstate(over="ignore"):
        x = _scramble(sig.view(np.uint64) + np.uint64(tab + 1) * _MIX)
    return x & np.uint64(FILTER - 1), (x >> np.uint64(32)) & np.uint64(FILTER - 1)


def _filter_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, mask): the filter's bits that the items' signatures set."""
    for b in batches:
        sigs = np.stack(b["sigs"]) if len(b) else np.empty((0, 0), np.int64)
        bits = np.unique(np.concatenate([np.concatenate(_places(np.ascontiguousarray(sigs[:, t]), t)) for t in range(sigs.shape[1])] + [np.empty(0, np.uint64)]))
        yield pd.DataFrame({"word": (bits >> np.uint64(6)).astype(np.int64), "mask": (np.uint64(1) << (bits & np.uint64(63))).view(np.int64)})


def _likely_windows(p: Plan, by_character: bool, sent):
    """(doc_id, tab, sig, own) of the document windows whose signature may be an item's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, bits = _Symbols(), sent.value
        has = lambda at: (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        for b in batches:
            keys = b["doc_id"].to_numpy()
            for o, own, length, sig in _blocks(b["text"].tolist(), p, by_character, cache, p.spare, BLOCK // 4):
                for t in range(p.tables):
                    one, two = _places(np.ascontiguousarray(sig[:, t]), t)
                    hit = np.flatnonzero(has(one) & has(two))
                    if len(hit):
                        yield pd.DataFrame({"doc_id": keys[o[hit]], "tab": np.int32(t), "sig": sig[hit, t], "own": [w[:n] for w, n in zip(own(hit), length[hit])]})

    return run


def _scarcest(window: int):
    """The least number of CJK characters in any window of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            least = []
            for t in b["text"]:
                held = np.cumsum([0, *(CJK.match(c) is not None for c in "".join(units(t)))])
                if len(held) > window:
                    least.append(int((held[window:] - held[:-window]).min()))
            yield pd.DataFrame({"least": np.asarray(least, np.int64)})

    return run


def _matches(p: Plan, by_character: bool, sent):
    """(doc_id, win) found by looking signatures up in the index that every task holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Symbols()
        wins, tables, known = sent.value
        for b in batches:
            found: set[tuple] = set()
            docs = b["doc_id"].to_numpy()
            for o, own, length, sig in _blocks(b["text"].tolist(), p, by_character, cache, p.spare, BLOCK):
                for t, (sorted_sig, row) in enumerate(tables):
                    low = np.searchsorted(sorted_sig, sig[:, t], "left")
                    near = np.flatnonzero(sorted_sig[np.minimum(low, len(sorted_sig) - 1)] == sig[:, t])
                    high = np.searchsorted(sorted_sig, sig[near, t], "right")
                    low, step = low[near], 0
                    while len(near):
                        live = low + step < high
                        near, low, high = near[live], low[live], high[live]
                        at = row[low + step]
                        for c in range(0, len(near), BLOCK):
                            x = near[c : c + BLOCK]
                            ok = holds(own(x), length[x], known[at[c : c + BLOCK]], p)
                            found.update(zip(docs[o[x[ok]]].tolist(), wins[at[c : c + BLOCK][ok]].tolist()))
                        step += 1
            yield pd.DataFrame(sorted(found), columns=["doc_id", "win"], dtype="int64")

    return run


def _held(p: Plan):
    """(doc_id, win) of the proposed pairs of windows that hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                length = b["own"].str.len().to_numpy()
                flat, starts = np.concatenate(b["own"].tolist()), np.cumsum(length) - length
                yield b.loc[holds(_passages(flat, starts, starts + length, p.window + p.spare), length, np.stack(b["other"]), p), ["doc_id", "win"]]

    return run


def _unit(docs: DataFrame, items: DataFrame, p: Plan, by_character: bool, most_sent: int) -> DataFrame | None:
    spark = docs.sparkSession
    windows = cut(items.mapInPandas(_item_windows(p, by_character), "item_id long, own array<long>, sigs array<long>").withColumn("win", F.xxhash64("own")))
    # equal windows, of one item or of many, are one row of the index
    index = cut(windows.groupBy("win").agg(F.first("own").alias("own"), F.first("sigs").alias("sigs")))
    n = index.count()
    if n == 0:
        return None
    if n <= most_sent:
        rows = index.toPandas()
        known, sigs = np.stack(rows["own"]), np.stack(rows["sigs"])
        order = [np.argsort(sigs[:, t], kind="stable") for t in range(p.tables)]
        sent = spark.sparkContext.broadcast((rows["win"].to_numpy(np.int64), [(sigs[x, t], x) for t, x in enumerate(order)], known))
        found = spread(docs, "doc_id").mapInPandas(_matches(p, by_character, sent), "doc_id long, win long")
    else:
        bits = np.zeros(FILTER >> 6, np.uint64)
        for w in index.select("sigs").mapInPandas(_filter_words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
            bits[w[0]] = np.int64(w[1]).view(np.uint64)
        mine = spread(docs, "doc_id").mapInPandas(_likely_windows(p, by_character, spark.sparkContext.broadcast(bits)), "doc_id long, tab int, sig long, own array<long>")
        theirs = index.select("win", F.col("own").alias("other"), F.posexplode("sigs").alias("tab", "sig"))
        pairs = mine.join(theirs, ["tab", "sig"]).select("doc_id", "win", "own", "other")
        found = pairs.mapInPandas(_held(p), "doc_id long, win long")
    return found.distinct().join(windows.select("win", "item_id").distinct(), "win").select("doc_id", "item_id").distinct()


def leaks(documents: DataFrame, items: DataFrame, edits: int = 0, recall: float = 0.99, words: int = WORDS, characters: int = CHARACTERS, most_sent: int = SENT, shifts: bool = False) -> DataFrame:
    """(doc_id, item_id): the text holds a passage of the item, of ``words`` words or, for zh and ja, ``characters`` characters.

    Every window of that size, of items and of documents alike, goes through a CGK embedding, whose
    random walk turns edit distance into Hamming distance; hashes of sampled places propose pairs
    of windows, and an exact edit distance of at most ``edits`` symbols decides. With no edits one
    repetition proposes all equal windows, so nothing is missed; with more, repetitions are added
    for the target ``recall``. A document's passage is as long as the item's, unless ``shifts``: then
    it may be up to ``edits`` symbols shorter or longer, so that a symbol can be missing or added. Case, punctuation, markup signs, line breaks, invisible characters,
    marks and compatibility forms do not count. Whole texts are walked, in blocks.

    Equal item windows are one row of the index, with its items aside. The index is counted
    first: up to ``most_sent`` windows are sent to all tasks and no document is shuffled. More are
    joined on (repetition, hash), and only those document windows are shuffled whose hash passes a
    filter of fixed size of the items' hashes. Null and blank texts, and items shorter than a
    window, have no rows; repeated rows repeat nothing; other columns are not read.
    """
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tests = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text", F.coalesce("lang", F.lit("")).isin(*BY_CHARACTER).alias("chars"))
    found = []
    by_word = plan(words, edits, recall, shifts)
    if (u := _unit(docs, tests.where("NOT chars").select("item_id", "text"), by_word, False, most_sent)) is not None:
        found.append(u)
    scripted = tests.where("chars").select("item_id", "text")
    # a document without any such character holds no window of an item with more of them than edits
    least = scripted.mapInPandas(_scarcest(characters), "least long").agg(F.min("least")).first()[0]
    hosts = docs.where(F.col("text").rlike(CJK_RANGES)) if least is not None and least > edits else docs
    if (u := _unit(hosts, scripted, plan(characters, edits, recall, shifts), True, most_sent)) is not None:
        found.append(u)
    if not found:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
