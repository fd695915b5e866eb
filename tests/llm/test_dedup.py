import random

from logloom.llm import dedup
from pyspark.sql import functions as F

SAME = [
    "hold release delayed after 45.9 seconds attempt=16 code=E887 delta=-40.7",
    'HOLD RELEASE, DELAYED AFTER 45.9 SECONDS! (CODE:"E887" | DELTA:<-40.7> | ATTEMPT: 16)',
    "attempt='16'\tdelta='-40.7', code='e887' “hold\xa0release – delayed after 45.9 seconds…”",
    '{"code":"E887", "MSG" : "Hold release delayed after 45.9 seconds", "attempt":16, "delta":"-40.7"},',
    "  hold\r\nrelease delayed after 45.9 seconds. attempt = 16 - code = E887 - delta = -40.7 ;",
]
OTHER = [
    "release hold delayed after 45.9 seconds attempt=16 code=E887 delta=-40.7",
    "hold release delayed after 45.9 seconds attempt=16 code=E887 delta=40.7",
    "hold release delayed after 459 seconds attempt=16 code=E887 delta=-40.7",
    "hold release delayed after 45.9 seconds attempt=16 code=E887 delta=-407",
    "hold release delayed after 45.9 seconds attempt=16 code=E887",
    "hold release delayed after 45.9 seconds attempt=1-6 code=E887 delta=-40.7",
    "hold release delayed after 45.9 seconds attempt=16 code=E887 delta=-40.7 delta=3",
]


def test_forms():
    key = dedup.record_tuple(SAME[0])
    assert len(key[1]) == 3
    for text in SAME[1:]:
        assert dedup.record_tuple(text) == key, text
    assert len({dedup.record_tuple(t) for t in [SAME[0], *OTHER]}) == len(OTHER) + 1


def test_odd_messages():
    assert dedup.record_tuple("") == dedup.record_tuple(" .,! ")
    assert dedup.record_tuple("{broken") == dedup.record_tuple("broken")
    assert dedup.record_tuple("重支，统") == dedup.record_tuple("重支 统")
    assert dedup.record_tuple("after 9.5,seconds") == dedup.record_tuple("After 9.5 seconds")
    assert dedup.record_tuple("a=1 a=1 x") == dedup.record_tuple("x a=1")
    assert dedup.record_tuple("word " * 200_000 + "k=v") == dedup.record_tuple("k: v " + "Word, " * 200_000)
    assert dedup.record_tuple('{"msg": null, "a": {"y": 1, "x": 2}}') == dedup.record_tuple('{"a": {"x": 2, "y": 1}, "msg": null}')


def test_json_with_blanks_of_any_kind():
    key = dedup.record_tuple(SAME[0])
    for blank in ("\xa0", "\u2009", "\u3000", "\u200b", "\ufeff", "\x0b"):
        text = f'{{"code"{blank}:{blank}"E887",{blank}"msg":"Hold release delayed after 45.9 seconds"{blank}, "attempt":16,{blank}"delta":"-40.7"}}'
        assert dedup.record_tuple(text) == key, repr(blank)
    inside = dedup.record_tuple('{"a":\xa0"x\xa0y \\" z"}')
    assert inside == dedup.record_tuple('{"a":"x y \\" z"}') and len(inside[1]) == 1
    assert dedup.record_tuple('{"a"\xa0"b"}')[2].startswith("a\x1fb")  # no JSON in any reading


def test_colliding_identifiers_stay_apart(monkeypatch):
    monkeypatch.setattr(dedup, "identifier", lambda text: 7)
    dedup.field_code.cache_clear()
    packed = [dedup._pack(dedup.record_tuple(t)) for t in [SAME[0], *OTHER]]
    assert len({p[:16] for p in packed}) < len(packed) == len(set(packed))
    assert {dedup._pack(dedup.record_tuple(t)) for t in SAME} == {packed[0]}
    monkeypatch.undo()
    dedup.field_code.cache_clear()


def brute(rows):
    first, out = {}, []
    for i, m in sorted(rows):
        if m is not None:
            key = dedup.record_tuple(m)
            if key in first:
                out.append((first[key], i))
            first.setdefault(key, i)
    return sorted(out)


def test_copies_against_brute_force(spark):
    random.seed(1)
    rows = [(k, random.choice(SAME + OTHER + [None, "", "x"])) for k in range(400)]
    rows += [(1000 + k, f"only {k}") for k in range(3000)]  # so that some groups are hot and others aren't
    df = spark.createDataFrame(rows, "log_id bigint, message string").withColumn("record", F.lit("clash"))
    keys = dedup.record_keys(df)
    assert sorted(tuple(r) for r in dedup.copies(keys).collect()) == brute(rows)
    counts = dedup.records(keys)
    assert counts.agg(F.sum("n_copies")).first()[0] == sum(m is not None for _, m in rows)
    empty = dedup.record_keys(df.limit(0))
    assert dedup.copies(empty).count() == 0 and dedup.records(empty).count() == 0
