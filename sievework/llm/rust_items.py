"""Where top-level items of Rust source start: the small scanner behind the piece splitter."""

from __future__ import annotations

import re
from bisect import bisect_right

#: A stretch that may hold brackets which do not count, or a bracket that does.
_MARK = re.compile(
    rb"""//[^\n]*|/\*|(?<![A-Za-z0-9_])[bc]?r(?P<raw>\#*)"|"[^"\\]*(?:\\.[^"\\]*)*"|'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}\n]*\}|[^\n])|[\x00-\x09\x0b-\x26\x28-\x5b\x5d-\x7f]|[\xc0-\xff][\x80-\xbf]{1,3})'|[{}()\[\];]""",
    re.S | re.X,
)
_COMMENT = re.compile(rb"/\*|\*/")
_HEAD = re.compile(
    rb"""(?:pub\b\s*(?:\([^()]*\)\s*)?)?(?:(?:default|async|unsafe|safe|auto)\s+|const\s+(?=(?:async|unsafe|extern|fn)\b)|extern\s*(?:r?"[^"]*"\s*)?(?=(?:unsafe\s+)?fn\b))*
        (?:(?P<word>fn|struct|enum|trait|impl|mod|const|static|type|macro|use|extern|union)\b|(?P<macro>(?:::)?[A-Za-z_]\w*(?:\s*::\s*[A-Za-z_]\w*)*\s*!))""",
    re.X,
)
#: Items that end at a semicolon only, and what is no item of its own.
_TO_SEMICOLON = {b"const", b"static", b"type", b"use"}
_NO_ITEM = {b"use", b"extern", b"union"}


def _comment_end(buf: bytes, at: int) -> int:
    """End of the (nested) block comment that begins at ``at``."""
    depth = 0
    for m in _COMMENT.finditer(buf, at):
        depth += 1 if m[0] == b"/*" else -1
        if not depth:
            return m.end()
    return len(buf)


def marks(buf: bytes, at: int = 0):
    """(start, end, token) of each bracket or semicolon, and of each comment and literal with token b''."""
    while m := _MARK.search(buf, at):
        token, end = m[0], m.end()
        if token == b"/*":
            token, end = b"", _comment_end(buf, m.start())
        elif m["raw"] is not None:
            close = buf.find(b'"' + m["raw"], end)
            token, end = b"", len(buf) if close < 0 else close + 1 + len(m["raw"])
        elif len(token) > 1:
            token = b""
        yield m.start(), end, token
        at = end


def _consume(buf: bytes, at: int, brace_ends: bool) -> int:
    """End of the item whose head begins at ``at``."""
    depth = 0
    for _, end, token in marks(buf, at):
        if token in (b"{", b"(", b"["):
            depth += 1
        elif token in (b"}", b")", b"]"):
            depth -= 1
            if depth < 0 or depth == 0 and token == b"}" and brace_ends:
                return end
        elif token == b";" and depth == 0:
            return end
    return len(buf)


def _bracket_end(buf: bytes, at: int) -> int:
    depth = 0
    for _, end, token in marks(buf, at):
        depth += (token in (b"{", b"(", b"[") and 1) - (token in (b"}", b")", b"]") and 1)
        if token and depth <= 0:
            return end
    return len(buf)


def item_starts(buf: bytes) -> list[int]:
    """Offsets at which top-level items begin, with the comments and attributes directly above them.

    Inner doc comments and inner attributes belong to the file; comments followed by a blank line
    stand alone, attributes hold on to their item across one.
    """
    out: list[int] = []
    at, n = 3 if buf.startswith(b"\xef\xbb\xbf") else 0, len(buf)
    above, held, fresh = -1, False, True
    while at < n:
        c = buf[at]
        if c == 10:
            if fresh and not held:
                above = -1
            fresh = True
            at += 1
        elif c in b" \t\r\f\v":
            at += 1
        elif buf.startswith((b"//", b"/*"), at):
            inner = buf[at + 2 : at + 3] == b"!"
            if inner:
                above, held = -1, False
            elif fresh and above < 0:
                above = at
            fresh = False
            if buf[at + 1] == 42:
                at = _comment_end(buf, at)
            else:
                end = buf.find(b"\n", at)
                at = n if end < 0 else end
        elif buf.startswith(b"#![", at):
            above, held, fresh = -1, False, False
            at = _bracket_end(buf, at)
        elif c == 35 and (m := re.compile(rb"#\s*\[").match(buf, at)):
            above, held, fresh = at if above < 0 else above, True, False
            at = _bracket_end(buf, at)
        else:
            head = _HEAD.match(buf, at)
            if not head:
                at = max(_consume(buf, at, True), at + 1)
            else:
                word = head["word"]
                if word not in _NO_ITEM:
                    out.append(at if above < 0 else above)
                at = _consume(buf, head.end(), word not in _TO_SEMICOLON)
                if word is None and buf[at - 1 : at] != b"}" and buf[at - 1 : at] != b";":
                    at = n
            above, held, fresh = -1, False, False
    return out


def line_starts(buf: bytes) -> list[int]:
    out, at = [0], buf.find(b"\n")
    while at >= 0:
        out.append(at + 1)
        at = buf.find(b"\n", at + 1)
    if out[-1] == len(buf) and len(out) > 1:
        out.pop()
    return out


def depths(buf: bytes, lines: list[int]) -> list[int]:
    """How deep each line begins in brackets; 99 within a comment or literal."""
    edges, deep, depth = [0], [0], 0
    for start, end, token in marks(buf):
        if not token:
            edges += [start + 1, end]
            deep += [99, depth]
        elif token != b";":
            depth = depth + 1 if token in b"{([" else max(0, depth - 1)
            edges.append(end)
            deep.append(depth)
    return [deep[bisect_right(edges, x) - 1] for x in lines]
