"""Lines of log files and their assembly to events, by byte offsets."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

# What the first line of an event looks like.
STARTS = (
    r"\d{4}-\d{2}-\d{2}[ T]\d{2}\s*:\s*\d{2}\s*:\s*\d{2}(?:\.\d+)?",
    r"[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b",
    r"\s*\{",
    r"\s*[tT][iI][mM][eE][sS][tT][aA][mM][pP]=",
)
START = "^(?:" + "|".join(STARTS) + ")"
_START = re.compile(START)
BUFFER = 1 << 20


def decode_line(raw: bytes) -> str:
    """UTF-8 without one carriage return at the end and without a byte order mark at the beginning."""
    return raw.removesuffix(b"\r").decode("utf-8", "replace").removeprefix("﻿")


def starts_event(line: str) -> bool:
    return _START.match(line) is not None


def lines(path: str, start: int = 0) -> Iterator[tuple[str, int, int]]:
    """(line, its offset, the next line's offset) from ``start``, which must be the beginning of a line."""
    at = start
    with open(path, "rb", buffering=BUFFER) as f:
        f.seek(start)
        for raw in f:
            end = at + len(raw)
            yield decode_line(raw.removesuffix(b"\n")), at, end
            at = end


def _line_from(path: str, at: int) -> int:
    """The first beginning of a line at or after ``at``."""
    if at <= 0:
        return 0
    with open(path, "rb", buffering=BUFFER) as f:
        f.seek(at - 1)
        return at - 1 + len(f.readline())


def clamp(offset: int, size: int) -> int:
    """A saved offset; 0 if it is negative or beyond the end, as after a rotation."""
    return offset if 0 <= offset <= size else 0


def events(path: str, begin: int = 0, end: int | None = None, first: bool = True, size: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of the events that begin in bytes ``begin`` to ``end`` of a file, read to ``size`` at most.

    Blank lines are skipped; a line that starts an event closes the one before; others are appended with a line feed.
    With ``first`` the first line that isn't blank opens an event whatever it looks like. Ranges that follow each
    other give every event once: one that begins in a range is read to its end.
    """
    size = os.path.getsize(path) if size is None else size
    end = size if end is None else end
    text: list[str] = []
    start = 0
    for line, at, after in lines(path, begin if first else _line_from(path, begin)):
        if at >= size:
            break
        if not line.strip():
            continue
        new = starts_event(line)
        if at >= end and (new or not (text or first)):
            break
        if new or (first and not text):
            if text:
                yield "\n".join(text), start, at
            text, start = [line], at
            first = False
        elif text:
            text.append(line)
    else:
        at = size
    if text:
        yield "\n".join(text), start, min(at, size)
