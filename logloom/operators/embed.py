"""Texts to vectors. The embedder is pluggable; the default one hashes words and needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom import schemas
from logloom.functions.text import point_id

#: Batches of texts to vectors, in order. Made once in each worker by a factory.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

_WORD = re.compile(r"\w+")


class HashingEmbedder:
    """Signed feature hashing of lower-case words, at unit length; all zero for texts without words."""

    def __init__(self, dims: int = 768):
        self.dims = dims
        self._cache: dict[str, tuple[int, int]] = {}

    def _place(self, word: str) -> tuple[int, int]:
        if (found := self._cache.get(word)) is None:
            h = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8])
            found = (h >> 1) % self.dims, 1 if h & 1 else -1
            if len(self._cache) < 1 << 20:
                self._cache[word] = found
        return found

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            places = [self._place(word) for word in _WORD.findall((text or "").lower())]
            k, signs = zip(*places) if places else ((), ())
            v = np.bincount(np.array(k, np.int64), np.array(signs, np.float64), self.dims)
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).astype(np.float32))
        return out


def embed(df: DataFrame, text: str = "text", factory: Callable[[], Embedder] | None = None, batch_size: int = 16, dims: int = 768, in_flight: int = 1, at_once: int = 256) -> DataFrame:
    """``df`` with ``vector``. Batches of ``batch_size`` go to the embedder, ``in_flight`` at a time in each partition, in order.
    More than one helps an embedder that waits for a server; the default one is called directly. At most ``at_once`` texts, a batch
    for each call at least, are under way in a partition.

    Null texts count as empty. An embedder that returns another number of vectors, or none for a text, raises.
    """
    make = factory or (lambda: HashingEmbedder(dims))

    waits = in_flight if factory else 1

    def vectors_of(own: Embedder, group: list[str]) -> list:
        vectors = list(own(group))
        if len(vectors) != len(group) or any(v is None for v in vectors):
            raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(group)} texts")
        return vectors

    @F.pandas_udf(T.ArrayType(T.FloatType(), False))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for part in parts:
            texts = ["" if t is None else t for t in part]
            groups = [texts[k : k + batch_size] for k in range(0, len(texts), batch_size)]
            if waits > 1:
                step, found = max(waits, at_once // batch_size), []
                with ThreadPoolExecutor(waits) as pool:
                    for k in range(0, len(groups), step):
                        found += pool.map(lambda g: vectors_of(own, g), groups[k : k + step])
            else:
                found = [vectors_of(own, g) for g in groups]
            yield pd.Series([v for group in found for v in group], dtype=object)

    return df.withColumn("vector", run(F.col(text)))


def embed_one(question: str, factory: Callable[[], Embedder] | None = None, dims: int = 768) -> list[float]:
    """The vector of one text."""
    return [float(x) for x in (factory or (lambda: HashingEmbedder(dims)))()([question])[0]]


def to_points(chunks: DataFrame, factory: Callable[[], Embedder] | None = None, batch_size: int = 16, dims: int = 768, in_flight: int = 1, at_once: int = 256) -> DataFrame:
    """Chunks with their point ids and vectors."""
    return embed(chunks.withColumn("point_id", point_id(F.col("chunk_id"))), "text", factory, batch_size, dims, in_flight, at_once).select(*schemas.names(schemas.POINT))
