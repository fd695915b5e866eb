import re

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import split
from pyspark.sql import functions as F

TEXTS = st.text(alphabet="ab cé\n.,;。，😀　!?x", max_size=400)


def check(text, limit, overlap):
    raw = text.encode()
    offsets = split.Offsets(text)
    spans, hard = split.cut(offsets, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(raw)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d, "every piece goes on and joins the one before"
        assert b - c <= overlap
    for a, b in spans:
        raw[a:b].decode()
        assert b - a <= max(limit, 4)
    return spans, hard


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(8, 60), st.integers(0, 30))
def test_pieces(text, limit, overlap):
    spans, hard = check(text, limit, min(overlap, limit // 2))
    runs = [len(r.encode()) for r in re.split(r"[\s,;。！？；，]", text)]
    assert hard == (max(runs) > limit and len(text.encode()) > limit)


def test_boundaries_and_overlap():
    text = "One two three. Four five six seven eight nine ten. " * 20
    spans, hard = check(text, 100, 10)
    assert not hard
    assert all(text[b - 1].isspace() or text[b - 1 : b] in ".,;" or text[b : b + 1].isspace() for _, b in spans)
    assert sum(b - c == 10 for (_, b), (c, _) in zip(spans, spans[1:])) > len(spans) // 2
    spans, hard = check("x" * 1000, 100, 10)
    assert hard and spans[1] == (90, 190)
    assert check("é" * 100, 33, 5)[0][0] == (0, 32)
    assert check("ab cd", 1, 0)[0][0] == (0, 1)
    check("word " * 400_000, 2000, 200)


def test_operator(spark):
    rows = [("a", 1, "x" * 50), ("a", 1, "x" * 50), ("a", 2, None), ("a", 3, ""), ("a", 4, "y z " * 20), ("b", 5, "x" * 5000), ("a", 6, " " * 50), (None, 7, "x" * 50), ("a", None, "x" * 50)]
    items = spark.createDataFrame(rows, "item_kind string, item_id bigint, text string").withColumn("max_bytes", F.lit(1))
    limits = spark.createDataFrame([("a", 40, 4)], "item_kind string, max_bytes int, overlap_bytes int")
    got = split.split_items(items, limits).collect()
    assert {r["item_id"] for r in got} == {1, 4, 6} and {r["item_id"] for r in got if r["forced"]} == {1}
    assert sum(r["item_id"] == 1 and r["piece_no"] == 0 for r in got) == 2
    assert split.split_items(items.limit(0), limits).count() == 0
    assert split.split_items(items, limits.limit(0)).count() == 0


def test_hard_cuts_leave_letters_with_their_marks():
    text = "e\u0301" * 40  # three bytes each
    spans, hard = split.cut(split.Offsets(text), 16, 0)
    assert hard and all(b % 3 == 0 and b - a <= 16 for a, b in spans)
    family = "\U0001f469\u200d\U0001f467" * 6  # eleven bytes each
    spans, hard = split.cut(split.Offsets(family), 25, 0)
    assert hard and all(b % 11 == 0 for _, b in spans)
    spans, hard = split.cut(split.Offsets("\u0301" * 50), 16, 0)  # marks alone: cut anywhere
    assert hard and spans[-1][1] == 100 and all(b - a <= 16 for a, b in spans)
