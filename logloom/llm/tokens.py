"""Problem 8: the whole corpus as token ids of a public byte-level BPE tokenizer.

Pre-tokenisation needs no regex. The characters of a batch become one array of codepoints and one of classes
(letter, number, white space, other). Read as an automaton, every class but the apostrophe's maps all states to one
and the same state: its transition function is constant. Composing functions is associative and a constant absorbs all
that came before, so the prefix scan over the functions is a shift by one, for all characters at once; only an apostrophe
depends on the state before it, which the shifted array holds, and acts on the two characters after it. The slices
between the boundaries feed a cache of merged pairs, and their places are kept for decoding.

Defined results: null, and empty texts have an empty list. Blank texts are encoded like any other, names of special
tokens are ordinary text. Very long texts are encoded whole. Lone surrogates, which UTF-8 can't hold, count as the
replacement character. Repeated rows are encoded alike. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.storage import spread

#: Where the vocabulary is on every executor; a parameter of all functions.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts are concatenated up to so many characters, which bounds the arrays.
CHARS_AT_ONCE = 1 << 22
CACHE_AT_MOST = 1 << 20

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
# Characters with the property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe in a token of its own.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@functools.cache
def class_table() -> np.ndarray:
    """The class of each codepoint."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. codes: the characters of all texts; starts: the place of each text's first one."""
    n = len(codes)
    kind = class_table()[codes]
    before = np.empty(n, np.uint8)
    before[0:1], before[1:] = EDGE, kind[:-1]
    before[starts[starts < n]] = EDGE
    after = np.empty(n, np.uint8)
    after[-1:], after[:-1] = EDGE, kind[1:]
    inner = starts[(starts > 0) & (starts <= n)]
    after[inner - 1] = EDGE
    space = kind == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = codes[:-1] == 0x20
    blank_before &= before != EDGE
    # A run begins where the class changes; one blank before a run belongs to it, so that white space gives away its
    # last character to what follows.
    begins = np.where(space, (before != SPACE) | (after < SPACE) | (after == OTHER), (before != kind) & ~blank_before)
    quote = np.flatnonzero((codes == 0x27) & (before != OTHER) & ~blank_before & (after == LETTER))
    if len(quote):
        one = codes[quote + 1]
        far = np.minimum(quote + 2, n - 1)
        two = np.where(after[quote + 1] == LETTER, codes[far], 0)
        length = np.isin(one, [ord(c) for c in SHORT]).astype(np.int64)
        for pair in LONG:
            length[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        quote, length = quote[length > 0], length[length > 0]
        begins[quote + 1] = False
        last = quote + length
        begins[last[after[last] == LETTER] + 1] = True
    return np.flatnonzero(begins)


class Encoder:
    """Merges pairs by rank, each distinct slice once."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, list[int]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Always joins the pair of the lowest rank, the leftmost of equals; n log n for long slices."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        ranks, n = self.ranks, len(raw)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that begins here; 0: joined to one before
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(raw[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            j = nxt[k] if end[k] else n
            if not end[k] or j >= n or end[j] != stop:
                continue
            end[k], end[j] = stop, 0
            nxt[k] = nxt[j]
            if nxt[k] < n:
                prv[nxt[k]] = k
                if (r := ranks.get(raw[k : end[nxt[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[nxt[k]]))
            if prv[k] >= 0 and (r := ranks.get(raw[prv[k] : stop])) is not None:
                heapq.heappush(heap, (r, prv[k], stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[raw[k : end[k]]])
            k = nxt[k]
        return out

    def slice_ids(self, piece: str) -> list[int]:
        found = self.merge(piece.encode("utf-8", "replace"))
        if len(self.cache) >= CACHE_AT_MOST:
            self.cache.clear()
        self.cache[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        out: list[list[int]] = []
        k = 0
        while k < len(texts):
            group, size = [], 0
            while k < len(texts) and (not group or size + len(texts[k]) <= CHARS_AT_ONCE):
                group.append(texts[k])
                size += len(texts[k])
                k += 1
            out += self._encode(group)
        return out

    def _encode(self, texts: list[str]) -> list[list[int]]:
        whole = "".join(texts)
        try:
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        except UnicodeEncodeError:
            texts = [t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for t in texts]
            whole = "".join(texts)
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        at = boundaries(codes, starts) if len(codes) else np.zeros(0, np.int64)
        bounds = at.tolist() + [len(codes)]
        pieces = [whole[a:b] for a, b in zip(bounds, bounds[1:])]
        cache, miss = self.cache, self.slice_ids
        ids = [cache[p] if p in cache else miss(p) for p in pieces]
        firsts = np.searchsorted(at, starts).tolist() + [len(pieces)]
        return [[i for part in ids[a:b] for i in part] for a, b in zip(firsts, firsts[1:])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)

    def starts(self, ids: list[int]) -> list[int]:
        """The byte at which each token begins in its text."""
        return np.concatenate([[0], np.cumsum([len(self.tokens[i]) for i in ids[:-1]])]).astype(np.int64).tolist() if ids else []


@functools.lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder in each worker process; its cache serves all its tasks."""
    return Encoder(path)


def _encode_batches(path: str, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            keys, texts = batch.columns[:-1], [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            ids = own.encode(texts)
            if what == "count":
                columns = [pa.array([len(x) for x in ids], pa.int64())]
            else:
                columns = [pa.array(ids, pa.list_(pa.int32()))]
                if what == "places":
                    columns.append(pa.array([own.starts(x) for x in ids], pa.list_(pa.int64())))
            names = batch.schema.names[:-1] + {"count": ["n_tokens"], "ids": ["ids"], "places": ["ids", "starts"]}[what]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names)

    return run


def _with(docs: DataFrame, text: str | Column, what: str, added: str, path: str) -> DataFrame:
    made = [x.split()[0] for x in added.split(", ")]
    keys = [c for c in docs.columns if c != text and c.lower() not in made]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema) + ", " + added
    return docs.select(*keys, text).mapInArrow(_encode_batches(path, what), schema)


def encode(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with the ids of column ``text`` in its place. A column ``ids`` is replaced, as are those added below."""
    return _with(docs, text, "ids", "ids array<int>", path)


def encode_with_places(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Also the byte at which each token begins."""
    return _with(docs, text, "places", "ids array<int>, starts array<bigint>", path)


def count_tokens(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with the number of tokens of column ``text`` in its place."""
    return _with(docs, text, "count", "n_tokens bigint", path)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every document."""
    return encode(spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")))


def p8_places(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every document and where each begins."""
    return encode_with_places(spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")))
