import threading
from datetime import datetime, timedelta, timezone

import pytest

from logloom import schemas
from logloom.config import IngestOptions, LogSource, Options
from logloom.sources import events as ev
from logloom.sources.checkpoints import Checkpoints
from logloom.sources.files import check_sources, read_files, read_text
from logloom.sources.store import PointStore
from logloom.streaming.ingest import Scheduler, point_store, respond, run_ingest, stream_ingest
from logloom.config import SchedulerOptions

AT = datetime(2026, 6, 1, tzinfo=timezone.utc)
FILE = "﻿2026-05-19 18: 13: 07.823 {\"a\":1}\r\n\r\n  at Foo()\r\ncont é\n{\"x\":2}\ntimestamp=1 k=v\nMay  9 18:13:07 h s: INFO m\ntail".encode()
WANT = [(0, 60, '2026-05-19 18: 13: 07.823 {"a":1}\n  at Foo()\ncont é'), (60, 68, '{"x":2}'), (68, 84, "timestamp=1 k=v"), (84, 116, "May  9 18:13:07 h s: INFO m\ntail")]


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(FILE)
    return str(path)


def found(df):
    return sorted((int(r["attributes"]["start_offset"]), int(r["attributes"]["end_offset"]), r["raw_text"]) for r in df.collect())


def test_assembly(log):
    assert len(FILE) == 116
    assert [(a, b, t) for t, a, b in ev.events(log)] == WANT
    assert [a for _, a, _ in ev.events(log, 60)] == [60, 68, 84]
    assert [t for t, _, _ in ev.events(log, 112)] == ["tail"]
    assert ev.clamp(500, 116) == 0 and ev.clamp(-1, 116) == 0 and ev.clamp(60, 116) == 60


@pytest.mark.parametrize("step", [1, 7, 33, 61, 1000])
def test_ranges_give_every_event_once(log, step):
    got = []
    for a in range(0, 116, step):
        got += [(s, e, t) for t, s, e in ev.events(log, a, min(a + step, 116), a == 0)]
    assert got == WANT


def test_readers_agree(spark, log, tmp_path):
    source = LogSource("s", log)
    assert found(read_files(spark, [source], AT)) == WANT
    assert found(read_files(spark, [source], AT, range_bytes=20)) == WANT
    assert found(read_text(spark, source, AT)) == WANT
    missing = LogSource("m", str(tmp_path / "none.log"))
    (tmp_path / "empty.log").write_bytes(b"")
    assert read_files(spark, [missing, LogSource("e", str(tmp_path / "empty.log"))], AT).count() == 0
    with pytest.raises(ValueError):
        check_sources([LogSource("x", "y", type="kafka")])


def test_checkpoints(tmp_path):
    path = str(tmp_path / "c" / "o.json")
    c = Checkpoints(path)
    c.save({"a": 5, "b": -3})
    assert Checkpoints(path).get("a") == 5 and Checkpoints(path).get("b") == 0 and Checkpoints(path).get("z") == 0
    (tmp_path / "c" / "o.json").write_text("{broken")
    assert Checkpoints(path).get("a") == 0


STORE = "point_id string, timestamp_utc timestamp, v int"


def rows(spark, *values):
    return spark.createDataFrame([(k, t, v) for k, t, v in values], STORE)


def test_store(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "t"), STORE)
    read = lambda: sorted((r["point_id"], r["v"]) for r in store.read().collect())
    store.ensure()
    store.ensure()
    assert read() == []
    store.upsert(rows(spark))
    store.upsert(rows(spark, ("a", AT, 1), ("b", AT, 1), ("a", AT - timedelta(days=1), 0)))
    store.upsert(rows(spark, ("b", AT - timedelta(days=40), 2), ("c", None, 1)))
    assert read() == [("a", 1), ("b", 2), ("c", 1)]
    store.delete_before(AT)
    # The older version of b doesn't come back; the bound itself stays.
    assert read() == [("a", 1), ("c", 1)]
    store.upsert(rows(spark, ("d", AT - timedelta(days=50), 1)))
    assert read() == [("a", 1), ("c", 1), ("d", 1)]
    store.compact()
    assert read() == [("a", 1), ("c", 1), ("d", 1)] and len(store._segments()) == 1
    store.GRACE = 0.0
    for k in range(3):
        store.upsert(rows(spark, ("a", AT, 10 + k)))
    assert ("a", 12) in read() and store.maintain() == 1 and ("a", 12) in read() and len(store._segments()) <= 3
    assert len([d for d in (tmp_path / "t").iterdir() if d.is_dir()]) == len(store._segments()) and len(store._numbers()) == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    stores = [PointStore(spark, str(tmp_path / "t"), STORE) for _ in range(2)]
    stores[0].ensure()
    errors = []

    def write(which):
        try:
            for k in range(4):
                stores[which].upsert(rows(spark, (f"w{which}-{k}", AT, k), ("both", AT, 10 * which + k)))
                if k == 2:
                    stores[which].maintain()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    got = {r["point_id"] for r in stores[0].read().collect()}
    assert got == {"both", *(f"w{w}-{k}" for w in range(2) for k in range(4))} and stores[1].read().count() == 9


def test_no_points_change_nothing(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "t"), STORE)
    store.upsert(rows(spark).limit(0))
    assert not store._segments() and store._numbers() == [0] and store.read().count() == 0


def test_merging_a_tier_brings_nothing_back(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "t"), STORE)
    store.upsert(rows(spark, ("a", AT, 1), *((f"x{k}", AT, k) for k in range(2000))))
    store.upsert(rows(spark, ("a", AT - timedelta(days=40), 2)))
    for k in range(3):
        store.upsert(rows(spark, (f"y{k}", AT, k)))
    store.delete_before(AT - timedelta(days=1))
    store.GROWTH = 1.5  # the first segment is too large to be merged
    assert store.maintain() == 1 and len(store._segments()) == 2
    assert store.read().filter("point_id = 'a'").count() == 0 and store.read().count() == 2003
    assert store.compact() and store.read().count() == 2003 and len(store._segments()) == 1


def test_filters_reach_every_segment(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "t"), STORE)
    for k in range(3):
        store.upsert(rows(spark, (f"a{k}", AT, k)))
    plan = store.read().filter("v = 2")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    points = [line for line in scans if "v#" in line]
    assert len(points) == 3 and all("EqualTo(v,2)" in line for line in points), plan
    assert all("ReadSchema: struct<point_id:string>" in line for line in scans if line not in points)


def test_equal_texts_are_embedded_once(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text("2026-05-19 18:13:07 same\n" * 5 + "2026-05-19 18:13:08 other\n")
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def embed(texts):
            seen.add(len(texts))
            return [[1.0, 2.0]] * len(texts)

        return embed

    store = point_store(spark, str(tmp_path / "t"))
    got = run_ingest(spark, store, options(tmp_path, log), AT, factory).first()
    assert (got["raw_logs_read"], got["chunks_created"], got["vectors_upserted"]) == (6, 6, 6)
    assert store.read().count() == 2 and seen.value == 2


def options(tmp_path, log):
    return Options(sources=(LogSource("pay", log),), ingest=IngestOptions(checkpoint_file=str(tmp_path / "o.json")))


def test_ingest_resumes_and_is_idempotent(spark, tmp_path, log):
    store, o = point_store(spark, str(tmp_path / "t")), options(tmp_path, log)
    first = run_ingest(spark, store, o, AT).first()
    assert (first["raw_logs_read"], first["chunks_created"], first["vectors_upserted"]) == (4, 4, 4) and first["completed_at_utc"] == AT.replace(tzinfo=None)
    n = store.read().count()
    assert run_ingest(spark, store, o, AT).first()["raw_logs_read"] == 0
    with open(log, "ab") as f:
        f.write(b'\n{"message":"new","timestamp":"2026-05-30"}\n')
    assert run_ingest(spark, store, o, AT).first()["raw_logs_read"] == 1
    assert store.read().count() == n + 1
    Checkpoints(o.ingest.checkpoint_file).save({Checkpoints.key("pay", log): 0})
    run_ingest(spark, store, o, AT)
    assert store.read().filter("text like '%new%'").count() == 1
    # A run without chunks removes nothing, even if old points exist; one with chunks does.
    run_ingest(spark, store, o, AT + timedelta(days=400))
    assert store.read().count() > 0
    with open(log, "ab") as f:
        f.write(b'{"message":"late","timestamp":"2027-07-01"}\n')
    run_ingest(spark, store, o, AT + timedelta(days=400))
    assert [r["text"].split()[-1] for r in store.read().collect()] == ["late"]


def test_stream(spark, tmp_path, log):
    store, o = point_store(spark, str(tmp_path / "t")), options(tmp_path, log)
    def run():
        q = stream_ingest(spark, store, o, str(tmp_path / "ck"), clock=lambda: AT)
        q.awaitTermination(120)
        return store.read().count()
    n = run()
    assert n >= 3 and run() == n
    with open(log, "ab") as f:
        f.write(b'\n{"message":"more","timestamp":"2026-05-30"}\n')
    assert run() == n + 1


def test_responses_and_schedule(spark):
    assert respond(lambda: spark.createDataFrame([(1,)], "n int")) == (200, {"n": 1})
    def broken():
        raise RuntimeError("x") from ConnectionError("refused")
    assert respond(broken)[0] == 503 and respond(broken)[1]["inner"] == "refused"
    assert respond(lambda: 1 / 0)[0] == 500
    calls = []
    s = Scheduler(lambda: calls.append(s.tick()), Options(scheduler=SchedulerOptions(daily_batch=False, run_on_start=True)))
    s.start()
    assert calls == [False]
    Scheduler(broken, Options()).tick()


def test_schema_names():
    assert schemas.names(schemas.RAW) == ["source_id", "source_type", "raw_text", "ingested_at_utc", "attributes"]
    assert len(schemas.names(schemas.NORMALIZED)) == 20
