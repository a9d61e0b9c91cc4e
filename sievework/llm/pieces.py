"""Oversized source chunks cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .rust_items import depths, item_starts, line_starts

#: Penalties of a cut: before an item, at another top-level line, within brackets (and a level more each), within a comment or literal, within a line at white space, anywhere else.
AT_ITEM, AT_TOP, NESTED, LEVEL, WITHIN, AT_SPACE, ANYWHERE = 0.0, 2.0, 4.0, 1.0, 14.0, 20.0, 30.0
PER_PIECE, UNEVEN = 3.0, 6.0
#: Boundaries closer than this many bytes compete for one place.
GRAIN = 16

PIECE = "struct<piece_no int, start_byte int, end_byte int, overlap_bytes int, text string>"


def _boundaries(buf: bytes, items: list[int], lines: list[int], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets where the text may be cut, with penalties; no gap between them is over ``longest``."""
    starts = set(items)
    at, cost = [], []
    for x, d in zip(lines, depths(buf, lines)):
        at.append(x)
        cost.append(AT_ITEM if x in starts else WITHIN if d == 99 else AT_TOP if d == 0 else NESTED + LEVEL * min(d, 8))
    for x in starts - set(lines):
        at.append(x)
        cost.append(AT_ITEM)
    order = np.argsort(np.asarray(at, np.int64), kind="stable")
    a, c = np.asarray(at, np.int64)[order], np.asarray(cost)[order]
    # of boundaries in one cell the best is kept
    cell = a // GRAIN
    keep = np.lexsort((a, c, cell))
    keep = np.sort(keep[np.unique(cell[keep], return_index=True)[1]])
    a, c = a[keep], c[keep]
    more_at, more_cost = [], []
    ends = np.append(a[1:], len(buf))
    for i in np.flatnonzero(ends - a > longest):
        low, high = int(a[i]), int(ends[i])
        for x in range(low + longest // 4, high, longest // 4):
            m = max((y.end() for y in re.compile(rb"[ \t,;]").finditer(buf, x, min(high, x + longest // 4))), default=0)
            y = m or x
            while y < high and buf[y] & 0xC0 == 0x80:
                y += 1
            if low < y < high:
                more_at.append(y)
                more_cost.append(AT_SPACE if m else ANYWHERE)
    if more_at:
        a, c = np.append(a, more_at), np.append(c, more_cost)
        order = np.argsort(a, kind="stable")
        a, c = a[order], c[order]
        first = np.append(True, a[1:] != a[:-1])
        a, c = a[first], c[first]
    return a, c


def _overlap_start(buf: bytes, lines: list[int], cut: int, overlap: int) -> int:
    """Where the piece that begins at ``cut`` starts to repeat: the first line within the last ``overlap`` bytes, else a character."""
    low = max(0, cut - overlap)
    i = bisect_left(lines, low)
    if i < len(lines) and lines[i] < cut:
        return lines[i]
    while low < cut and buf[low] & 0xC0 == 0x80:
        low += 1
    return low


def cut_positions(buf: bytes, items: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start of the repeated part, cut) of each piece, by dynamic programming over the boundaries.

    The sum of cut penalties and of squared departures from an even size is least, where no piece,
    its repeated part included, is over ``limit`` bytes and each holds at least ``overlap`` new ones
    unless it is the last.
    """
    n = len(buf)
    if n <= limit:
        return [(0, 0)]
    lines = line_starts(buf)
    a, c = _boundaries(buf, items, lines, (limit - overlap) // 4)
    if a[0] != 0:
        a, c = np.append(0, a), np.append(0.0, c)
    a = np.append(a, n)
    c = np.append(c, 0.0)
    back = np.array([_overlap_start(buf, lines, int(x), overlap) if x else 0 for x in a[:-1]] + [n], np.int64)
    even = n / max(1, -(-(n - overlap) // (limit - overlap)))
    total = np.full(len(a), np.inf)
    total[0], via = 0.0, np.zeros(len(a), np.int64)
    for i in range(1, len(a)):
        last = i == len(a) - 1
        low = bisect_left(back, int(a[i]) - limit, 0, i)
        high = i if last else bisect_right(a, int(a[i]) - overlap, 0, i)
        if low < high:
            sizes = (a[i] - a[low:high]) / even - 1
            t = total[low:high] + UNEVEN * sizes * sizes
            k = int(t.argmin())
            total[i], via[i] = t[k] + c[i] + PER_PIECE, low + k
    out, i = [], int(via[-1])
    while True:
        out.append((int(back[i]), int(a[i])))
        if i == 0:
            return out[::-1]
        i = int(via[i])


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, pieces = [], []
            for source in b["raw_source"]:
                buf = source.encode("utf-8")
                items = item_starts(buf)
                lines = line_starts(buf)
                found.append(sorted({bisect_right(lines, x) for x in items}))
                cuts = cut_positions(buf, items, limit, overlap)
                ends = [c for _, c in cuts[1:]] + [len(buf)]
                pieces.append([{"piece_no": i, "start_byte": s, "end_byte": e, "overlap_bytes": c - s, "text": buf[s:e].decode("utf-8")} for i, ((s, c), e) in enumerate(zip(cuts, ends))])
            out = b.drop(columns="raw_source")
            out["item_lines"], out["pieces"] = found, pieces
            yield out

    return run


def oversized(chunks: DataFrame, limit: int = 6000, overlap: int = 300) -> DataFrame:
    """(crate_name, chunk_id, module_path, item_lines, pieces) of each chunk with more than ``limit`` bytes.

    item_lines are the lines, from 1, at which top-level items start, with what belongs to them;
    pieces are ordered, each at most ``limit`` bytes of UTF-8 with the last ``overlap`` bytes or
    less of the one before repeated at its head, so that the texts without ``overlap_bytes`` make
    up raw_source again. A cut falls between items where one fits, else at a line outside or
    little within brackets, else, in a line over the limit, at white space or between characters.
    Lines end at a line feed. Null, empty and small sources give no row; equal rows give equal
    rows; other columns are not read. Rows are independent, so nothing is shuffled.
    """
    if not 0 < overlap * 4 <= limit:
        raise ValueError("the overlap must be at most a quarter of the limit")
    over = chunks.where(F.octet_length("raw_source") > limit).select("crate_name", "chunk_id", "module_path", "raw_source")
    return spread(over, "crate_name", "chunk_id").mapInPandas(_split(limit, overlap), f"crate_name string, chunk_id string, module_path string, item_lines array<int>, pieces array<{PIECE}>")


def pieces(chunks: DataFrame, limit: int = 6000, overlap: int = 300) -> DataFrame:
    """One row per piece, traceable to its chunk."""
    return oversized(chunks, limit, overlap).select("crate_name", "chunk_id", "module_path", F.inline("pieces"))
