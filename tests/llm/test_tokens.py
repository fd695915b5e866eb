import os
import random

import pytest

from logloom.llm import tokens as t

pytestmark = pytest.mark.skipif(not os.path.exists(t.VOCABULARY), reason="no vocabulary")
JSON = t.VOCABULARY.replace(".tiktoken", ".json")
ODD = ["'s's 'll don't I'lly 's\n's  'd　'm !'s <|endoftext|>  a  \n\n b\t\tc   ", "   ", "\n", "x" * 3000, "ab" * 500 + "'" * 50, "½²³ 12½ ٣٤", "😀é ́​ z\x1c\x1dq", "'", "a'", "'re", "'r", "' s", "﻿a\x00b"]


def texts():
    random.seed(3)
    letters = "ab'slretvmd 1½\n\t  .,!é中　\xa0\x85😀\x1c"
    return ODD + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)] + [""]


def test_against_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    own = t.Encoder(t.VOCABULARY)
    got = own.encode(texts())
    assert got == [e.ids for e in library.encode_batch(texts(), add_special_tokens=False)]
    assert all(own.decode(i).decode() == x for i, x in zip(got, texts()))
    for ids, text in zip(got, texts()):
        starts = own.starts(ids)
        assert [own.tokens[i] for i in ids] == [text.encode()[a:b] for a, b in zip(starts, starts[1:] + [len(text.encode())])]


def test_groups_of_texts(monkeypatch):
    own = t.Encoder(t.VOCABULARY)
    want = own.encode(texts())
    monkeypatch.setattr(t, "CHARS_AT_ONCE", 50)
    monkeypatch.setattr(t, "CACHE_AT_MOST", 7)
    assert own.encode(texts()) == want


def test_operator(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (4, "long " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in t.encode(df).collect()}
    assert got[1] == [31373, 995] and got[2] == [] and got[3] == [] and len(got[4]) > 300_000
    assert {r["doc_id"]: r["n_tokens"] for r in t.count_tokens(df).collect()}[1] == 2
    assert t.encode_with_places(df.filter("doc_id = 1")).first()["starts"] == [0, 5]
    clash = df.withColumn("ids", df.doc_id).withColumn("extra", df.doc_id)
    assert t.encode(clash).columns == ["doc_id", "extra", "ids"]
    assert t.encode(df.limit(0)).count() == 0
    assert t.Encoder(t.VOCABULARY).encode(["\ud800"]) == t.Encoder(t.VOCABULARY).encode(["�"])
