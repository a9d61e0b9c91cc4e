"""Words of scripts without spaces, found in the documents themselves, and how they stand at sentence ends."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

#: Letters of the scripts that are written without spaces; for Spark's expressions and for Python's.
SPACELESS = r"[\x{3005}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}\x{0E01}-\x{0E4E}]"
_RUN = regex.compile(r"(?:[\p{Han}\p{Hiragana}\p{Katakana}ー]+|[\p{Thai}--\p{N}--\p{S}--\p{P}]+)", regex.V1)
#: What stands between two runs ends a sentence for certain: a full mark, a blank line, or a space between Thai letters.
_END = regex.compile(r"[。！？｡]|\n[ \t]*\n|(?<=\p{Thai})[ \t]+(?=\p{Thai})")
#: Longest word, and the least share of all characters that a word's occurrences make up, which bounds the dictionary to a million words.
LONGEST, LEAST = 8, 1e-6
#: Different characters that a word is met with on either side at least, and as how many of these the edges of runs count at most.
VARIETY, EDGES = 2, 8


class Word(NamedTuple):
    """Logarithm of the different neighbours, occurrences in the segmented text, and how many of these open and close a sentence."""

    weight: float
    total: int = 0
    opens: int = 0
    closes: int = 0


class Lexicon(NamedTuple):
    words: dict[str, Word]
    opening: float = 0.0
    closing: float = 0.0

    def plain(self) -> tuple:
        """The lexicon as tuples: a broadcast is read without this package, which executors need not have."""
        return {k: tuple(w) for k, w in self.words.items()}, self.opening, self.closing

    @classmethod
    def of(cls, plain: tuple) -> Lexicon:
        words, opening, closing = plain
        return cls({k: Word(*w) for k, w in words.items()}, opening, closing)

    def segments(self, run: str) -> list[str]:
        """The best way through the word lattice of a run: a word gains its length times the logarithm of its variety, a character outside of one nothing."""
        words, n = self.words, len(run)
        gain, back = [0.0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            best, via = gain[i - 1], i - 1
            for j in range(max(0, i - LONGEST), i):
                if (w := words.get(run[j:i])) is not None and (g := gain[j] + (i - j) * w.weight) > best:
                    best, via = g, j
            gain[i], back[i] = best, via
        out, i = [], n
        while i:
            out.append(run[back[i] : i])
            i = back[i]
        return out[::-1]

    def leaning(self, before: str, after: str) -> float:
        """How much a gap between two runs looks like a sentence's end, by its last word before (final particles) and first word after (opening words): log odds, 0 for unknown words."""
        score = 0.0
        for run, at, count, base in ((before, -1, "closes", self.closing), (after, 0, "opens", self.opening)):
            if run and base and (w := self.words.get(self.segments(run)[at])) is not None and w.total >= 5:
                score += math.log((getattr(w, count) + 0.5) / (w.total + 1) / base)
        return score


def last_run(text: str, end: int, low: int) -> str:
    """The run of spaceless letters that ends before ``end``, white space aside."""
    k = end
    while k > low and text[k - 1].isspace():
        k -= 1
    j = k
    while j > low and _RUN.match(text, j - 1, j):
        j -= 1
    return text[j:k]


def first_run(text: str, at: int, high: int) -> str:
    while at < high and text[at].isspace():
        at += 1
    m = _RUN.match(text, at, high)
    return m[0] if m else ""


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, before, after, n): every stretch of up to LONGEST letters with the letters around it, counted within the batch over different runs."""
    for b in batches:
        runs: Counter = Counter()
        for t in b["text"]:
            runs.update(_RUN.findall(t))
        counts: Counter = Counter()
        for run, c in runs.items():
            n = len(run)
            for i in range(n):
                before = run[i - 1] if i else "^"
                for j in range(i + 1, min(n, i + LONGEST) + 1):
                    counts[run[i:j], before, run[j] if j < n else "$"] += c
        keys = list(counts)
        yield pd.DataFrame({"gram": [k[0] for k in keys], "before": [k[1] for k in keys], "after": [k[2] for k in keys], "n": [counts[k] for k in keys]}).astype({"n": "int64"})


def _standing(sent):
    """(word, total, opens, closes): the words of the segmented runs, and where runs stand at a sure sentence end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon.of(sent.value)
        for b in batches:
            seen: Counter = Counter()  # (run, opens, closes), so that equal runs are segmented once
            for t in b["text"]:
                at, opens, runs = 0, True, []
                for m in _RUN.finditer(t):
                    ended = bool(_END.search(t, max(0, at - 1), m.end())) if runs else True
                    if runs:
                        runs[-1][2] = ended
                    runs.append([m[0], ended, False])
                    at = m.end()
                if runs:
                    runs[-1][2] = True
                seen.update(map(tuple, runs))
            total, first, last = Counter(), Counter(), Counter()
            for (text, opens, closes), c in seen.items():
                found = lexicon.segments(text)
                for w in found:
                    total[w] += c
                first[found[0]] += c * opens
                last[found[-1]] += c * closes
            words = [w for w in total if w in lexicon.words]
            yield pd.DataFrame({"word": words, "total": [total[w] for w in words], "opens": [first[w] for w in words], "closes": [last[w] for w in words]}).astype({"total": "int64", "opens": "int64", "closes": "int64"})

    return run


def lexicon(documents: DataFrame) -> Lexicon:
    """The dictionary of the documents' spaceless scripts.

    Every stretch of letters of all documents is counted; those met often enough, between enough
    different neighbours, are words. All runs are then segmented by their lattice, and for each
    word it is counted how often it stands right after and right before a sure sentence end. Only
    words are sent to the driver, at most a million (``LEAST``). Documents without such letters
    are not read by Python; without any the dictionary is empty.
    """
    spark = documents.sparkSession
    texts = spread(documents.where("text IS NOT NULL").where(F.col("text").rlike(SPACELESS)).select("text"), "text")
    grams = texts.mapInPandas(_grams, "gram string, before string, after string, n long")
    near = grams.groupBy("gram", "before", "after").agg(F.sum("n").alias("n"))
    edge = lambda c, mark: F.sum(F.when(F.col(c) == mark, F.col("n")).otherwise(0))
    kinds = lambda c, mark: F.count_distinct(F.when(F.col(c) != mark, F.col(c))) + F.least(F.lit(EDGES), edge(c, mark))
    per = cut(near.groupBy("gram").agg(F.sum("n").alias("n"), F.least(kinds("before", "^"), kinds("after", "$")).alias("variety")))
    letters = per.where(F.length("gram") == 1).agg(F.sum("n")).first()[0] or 0
    known = per.where((F.col("n") >= max(2.0, letters * LEAST)) & (F.col("variety") >= VARIETY))
    words = {r.gram: Word(math.log(r.variety)) for r in known.select("gram", "variety").toLocalIterator()}
    if not words:
        return Lexicon({})
    stand = texts.mapInPandas(_standing(spark.sparkContext.broadcast(Lexicon(words).plain())), "word string, total long, opens long, closes long")
    for r in stand.groupBy("word").agg(F.sum("total").alias("total"), F.sum("opens").alias("opens"), F.sum("closes").alias("closes")).toLocalIterator():
        words[r.word] = Word(words[r.word].weight, r.total, r.opens, r.closes)
    every = sum(w.total for w in words.values()) or 1
    return Lexicon(words, sum(w.opens for w in words.values()) / every, sum(w.closes for w in words.values()) / every)
