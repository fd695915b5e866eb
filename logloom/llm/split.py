"""Problem 6: texts over a size limit are cut into overlapping pieces at natural boundaries.

For each text the byte offsets of its characters are a prefix sum, and its boundaries a sorted array of offsets.
A piece ends at the last boundary within the limit, found by binary search; a strong one (end of paragraph, line
or sentence) is taken if it lies in the second half of the piece. The next piece begins the overlap earlier, moved to
a whole character. Where there is no boundary within the limit the cut is hard, after the last whole character and, where there is
such a place, not between a letter and its marks or the parts of a joined sign.

The overlap shrinks only where a full one would leave the next boundary out of reach of the next piece.

Defined results: null texts and texts within the limit have no pieces; blank ones over it are cut like any other
(white space is a boundary). Items without id or kind, and kinds without a row in the limits, aren't cut. A limit below four bytes still makes
pieces of one character at least. Very long texts are cut whole. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Marks that are boundaries besides white space, and marks that end a sentence.
MARKS = ",;。！？；，"
FULL_STOPS = ".!?。！？"

_SPACE = np.zeros(0x3001, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
_STOPS = np.array([ord(c) for c in FULL_STOPS], np.uint32)
_MARKS = np.array([ord(c) for c in MARKS], np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in FULL_STOPS if ord(c) > 127], np.uint32)


class Offsets:
    """Byte offsets of a text's characters and of its boundaries."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        widths = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        self.chars = np.concatenate([[0], np.cumsum(widths)])
        space = _SPACE[np.minimum(codes, 0x3000)] & (codes <= 0x3000)
        mark = np.isin(codes, _MARKS)
        open_ = space | mark
        #: Where text without white space and marks begins or ends: after each such character and before it.
        edges = np.zeros(len(codes) + 1, bool)
        edges[1:] |= open_
        edges[:-1] |= open_
        edges[[0, -1]] = True
        self.weak = self.chars[edges]
        newline = codes == 10
        ended = np.zeros(len(codes), bool)
        if len(codes) > 1:
            ended[1:] = space[1:] & np.isin(codes[:-1], _STOPS)
        self.strong = self.chars[1:][newline | ended | np.isin(codes, _WIDE_STOPS)]
        self.size = int(self.chars[-1])
        self._codes = codes

    @functools.cached_property
    def whole(self) -> np.ndarray:
        """Where characters begin that belong together with none before: not marks on a letter, nor what a joiner joins."""
        distinct, back = np.unique(self._codes, return_inverse=True)
        joined = np.array([_joins(int(c)) for c in distinct], bool)[back] if len(distinct) else np.zeros(0, bool)
        begins = ~joined
        begins[1:] &= self._codes[:-1] != _JOINER
        return np.concatenate([self.chars[:-1][begins], [self.size]])


_JOINER = 0x200D


def _joins(code: int) -> bool:
    """Whether a character belongs to the one before it: marks, the joiner, shades of skin."""
    return code == _JOINER or 0x1F3FB <= code <= 0x1F3FF or unicodedata.category(chr(code)) in ("Mn", "Mc", "Me")


def _last(sorted_offsets: np.ndarray, low: int, high: int) -> int | None:
    """The last offset in (low, high]."""
    k = int(np.searchsorted(sorted_offsets, high, side="right")) - 1
    return int(sorted_offsets[k]) if k >= 0 and sorted_offsets[k] > low else None


def cut(offsets: Offsets, limit: int, overlap: int) -> tuple[list[tuple[int, int]], bool]:
    """Byte spans of the pieces, and whether a cut had to be hard."""
    overlap = max(0, min(overlap, limit - 1))
    spans: list[tuple[int, int]] = []
    start, done, hard = 0, 0, False  # done: the text before is in a piece
    while True:
        if offsets.size - start <= limit:
            spans.append((start, offsets.size))
            return spans, hard
        end = _last(offsets.strong, max(done, start + limit // 2), start + limit)
        if end is None:
            end = _last(offsets.weak, done, start + limit)
        if end is None:
            hard = True
            end = _last(offsets.whole, done, start + limit) or _last(offsets.chars, done, start + limit)
            if end is None:  # a limit below the width of one character
                end = int(offsets.chars[np.searchsorted(offsets.chars, done, side="right")])
        spans.append((start, end))
        done = end
        following = int(offsets.weak[np.searchsorted(offsets.weak, end, side="right")])
        back = end - overlap
        if following - end <= limit:  # within reach from the cut: not farther back than that
            back = max(back, following - limit)
        start = max(int(offsets.chars[np.searchsorted(offsets.chars, back)]), start + 1)
        start = int(offsets.chars[np.searchsorted(offsets.chars, start)])
        start = min(start, end)


_PIECES = "item_kind string, item_id bigint, piece_no int, start_byte bigint, end_byte bigint, text string, forced int"


def _cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, item, text, limit, overlap in batch.itertuples(index=False):
            offsets = Offsets(text)
            spans, hard = cut(offsets, limit, overlap)
            raw = text.encode("utf-8", "surrogatepass")
            rows += [(kind, item, k, a, b, raw[a:b].decode("utf-8", "surrogatepass"), int(hard)) for k, (a, b) in enumerate(spans)]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PIECES.split(", ")])


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every text over its limit. ``items``: item_kind, item_id, text; ``limits`` as split_limits.

    Only texts over the limit reach Python; the rest is dropped by their length in the scan's stage.
    """
    own = items.select("item_kind", "item_id", "text").filter(F.col("item_id").isNotNull())
    over = own.join(limits.select("item_kind", "max_bytes", "overlap_bytes"), "item_kind").filter(F.octet_length("text") > F.col("max_bytes"))
    return over.select("item_kind", "item_id", "text", "max_bytes", "overlap_bytes").mapInPandas(_cut_batches, _PIECES)


def _items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks = spark.read.parquet(f"{sf}/log_chunks.parquet").select(F.lit("chunk").alias("item_kind"), F.col("chunk_no").alias("item_id"), "text")
    messages = spark.read.parquet(f"{sf}/log_entries.parquet").select(F.lit("message").alias("item_kind"), F.col("log_id").alias("item_id"), F.col("message").alias("text"))
    return chunks.unionByName(messages), spark.read.parquet(f"{sf}/split_limits.parquet")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each text over its limit, and whether it had to be cut hard."""
    pieces = split_items(*_items(spark, sf))
    return pieces.filter(F.col("piece_no") == 0).select("item_kind", "item_id", F.col("forced").cast("bigint").alias("forced"))


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces."""
    return split_items(*_items(spark, sf)).drop("forced")
