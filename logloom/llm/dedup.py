"""Problem 2: records that differ in form only are collapsed, with the number of their copies.

Every message is rewritten as its words in order and its set of named fields. Each distinct word and field value is
canonicalised once (a dictionary in each worker) and stands for an integer from then on; the integer is 128 bits of a hash
of the canonical text, so that all workers assign the same one without a shared dictionary, which would grow with the
corpus. A record is the identifier of its words and the sorted identifiers of its field values; the tuples are packed to 16 bytes.
A second digest, of the record's canonical text itself and not of its identifiers, goes with the tuple, and only rows
with both alike are one group, so that two texts that should ever get one identifier stay apart. Groups are summed before they
are shuffled. Rows find their group again by a join that a group of a third of all rows doesn't slow down.

Defined results: null messages are no records and copies of nothing. Blank messages and messages of punctuation alone
are one record (no words, no fields). Of repeated names in one message each distinct value counts once. In JSON blanks of
any kind may stand between the tokens, as white space doesn't count; a message that looks like JSON but isn't is plain text. Very long messages are read whole. Repeated rows are copies. Empty tables
give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.skew import join_by_size, total_rows
from logloom.functions.storage import materialize, spread

#: The name that holds the words of a message in JSON.
WORDS_FIELD = "msg"

_FIELD = re.compile(r"""(?<!\w)["'“„«]?([^\W\d]\w*)["'”“»]?\s*[=:]\s*(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|<([^<>]*)>|([^\s,;|()\[\]{}"'<>]+))""")
_CODE = re.compile(r"(?<!\w)[+-](?=\d)\w+(?:[.+-]\w+)*|\w+(?:[.+-]\w+)*")  # signs, points and hyphens are inside
_IDEOGRAPH = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]|[^\W぀-ヿ㐀-䶿一-鿿豈-﫿]+")
_EDGES = " \t\r\n\xa0.,;:!?…*\"'“”„«»()[]{}<>|"
_JSON = json.JSONDecoder(strict=False, parse_float=str, parse_int=str, parse_constant=str)
#: A string of JSON, or blanks between its tokens that JSON itself doesn't know.
_ODD_BLANK = re.compile(r'("(?:[^"\\]|\\.)*")|[^\S \t\r\n]+|[\u200b\u2060\ufeff]+', re.S)


@functools.lru_cache(maxsize=1 << 18)
def canonical_words(token: str) -> tuple[str, ...]:
    """The words of a run between blanks and marks: a number or code whole, else each run of letters."""
    if any(c.isdigit() for c in token) and token.isascii():
        return (token,)
    return tuple(_IDEOGRAPH.findall(token))


def canonical_field(name: str, value: str) -> str:
    """A field with a value, without what is form only."""
    return f"{name.lower()}\0{' '.join(value.strip(_EDGES).lower().split())}"


def identifier(text: str) -> int:
    """The integer that stands for a canonical text."""
    return xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))


@functools.lru_cache(maxsize=1 << 18)
def field_code(name: str, value: str) -> tuple[int, str]:
    """The identifier of a field with a value in any form, and its canonical text."""
    text = canonical_field(name, value)
    return identifier(text), text


def _plain(text: str, words: list[str], fields: set[tuple[int, str]]) -> None:
    end = 0
    rest = []
    for m in _FIELD.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] if m[4] is not None else m[5]
        if not value.strip(_EDGES):
            continue
        fields.add(field_code(m[1], value))
        rest.append(text[end : m.start()])
        end = m.end()
    rest.append(text[end:])
    for token in _CODE.findall(" ".join(rest).lower()):
        words.extend(canonical_words(token))


def _object(text: str) -> dict | None:
    """A message that is one JSON object, with blanks of any kind between its tokens."""
    for form in (lambda t: t, lambda t: _ODD_BLANK.sub(lambda m: m[1] or " ", t)):
        try:
            found, end = _JSON.raw_decode(tried := form(text))
        except (ValueError, RecursionError):
            continue
        return found if isinstance(found, dict) and not tried[end:].strip(_EDGES) else None
    return None


def record_tuple(message: str) -> tuple[int, tuple[int, ...], str]:
    """The identifier of the words, the sorted identifiers of the field values, and the canonical text of both."""
    words: list[str] = []
    fields: set[tuple[int, str]] = set()
    text = message.strip()
    found = _object(text) if text.startswith("{") else None
    if found is None:
        _plain(text, words, fields)
    else:
        for name, value in found.items():
            if name.lower() == WORDS_FIELD and isinstance(value, str):
                _plain(value, words, fields)
            else:
                fields.add(field_code(name, value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)))
    joined = "\x1f".join(words)
    texts = sorted(text for _, text in fields)
    return identifier(joined), tuple(sorted(code for code, _ in fields)), "\x1e".join([joined, *texts])


def _pack(record: tuple[int, tuple[int, ...], str]) -> bytes:
    """16 bytes of the tuple of identifiers, then 16 of the canonical text."""
    words, ids, text = record
    proof = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return xxhash.xxh3_128_digest(words.to_bytes(16) + b"".join(i.to_bytes(16) for i in ids)) + proof


_KEYS = "log_id bigint, record binary"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).dictionary_encode()  # equal messages of a batch are read once
        packed = [_pack(record_tuple(t)) for t in texts.dictionary.to_pylist()]
        keys = pa.array(packed, pa.binary()).take(texts.indices)
        yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["log_id", "record"])


def record_keys(entries: DataFrame) -> DataFrame:
    """log_id and the packed tuple of every message that isn't null."""
    return entries.select("log_id", "message").filter(F.col("message").isNotNull()).mapInArrow(_keys, _KEYS)


def records(keys: DataFrame) -> DataFrame:
    """record, first_id, n_copies: one row a record."""
    return keys.groupBy("record").agg(F.min("log_id").alias("first_id"), F.count("*").alias("n_copies"))


def copies(keys: DataFrame) -> DataFrame:
    """first_id, log_id of every row that is a copy of an earlier one. ``keys`` is read twice."""
    groups = records(keys)
    several = groups.filter(F.col("n_copies") > 1)
    joined = join_by_size(keys, several, ["record"], "n_copies", total_rows(keys.withColumn("n", F.lit(1)), "n"))
    return joined.filter(F.col("log_id") != F.col("first_id")).select("first_id", "log_id")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/log_entries.parquet").select("log_id", "message"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies(materialize(record_keys(_entries(spark, sf)), "records"))


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each record: the row it first stands in and how many copies it has."""
    return records(record_keys(_entries(spark, sf))).select("first_id", "n_copies")
