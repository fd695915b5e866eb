from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logloom.config import ChatOptions, SearchOptions
from logloom.operators import chat, embed, search
from logloom.operators.search import QueryFilter
from logloom.plans import retrieval

AT = datetime(2026, 5, 19, 18, tzinfo=timezone.utc)


def candidates(spark):
    rows = [(1, "h1", 0.90, "login ok"), (2, "h1", 0.95, "payment ok"), (3, "h2", 0.93, "payment timeout"), (4, "h3", 0.94, "idle")]
    return spark.createDataFrame(rows, "point_id int, log_hash string, score double, text string")


def test_dedup_and_rerank(spark):
    best = search.best_per_event(candidates(spark))
    assert sorted(r["point_id"] for r in best.collect()) == [2, 3, 4]
    got = {r["point_id"]: round(r["rank_score"], 4) for r in search.rerank(best, "payment timeout").collect()}
    assert got == {2: 0.8825, 3: 0.9405, 4: 0.7990}
    off = search.rerank(best, "payment timeout", SearchOptions(rerank=False)).orderBy(F.desc("rank_score")).collect()
    assert [r["point_id"] for r in off][:2] == [2, 4]
    part = search.rerank(spark.createDataFrame([(1, "h", 0.0, "repayment")], "point_id int, log_hash string, score double, text string"), "pay")
    assert part.first()["rank_score"] == pytest.approx(0.15)


def test_search_skips_unusable_vectors_and_breaks_ties_by_id(spark):
    rows = [(3, [1.0, 0.0]), (2, [2.0, 0.0]), (1, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "point_id int, vector array<float>")
    assert [r["point_id"] for r in search.search(df, [1.0, 0.0], 9).collect()] == [2, 3, 7]
    assert search.search(df, [1.0, 0.0], 0).count() == 1
    assert search.search(df.limit(0), [1.0, 0.0], 5).count() == 0


def test_filters(spark):
    rows = [(1, "WARNING", "a", AT), (2, "ERROR", "b", AT + timedelta(hours=1)), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id int, severity string, module string, timestamp_utc timestamp")
    ids = lambda f: [r["id"] for r in f.apply(df).orderBy("id").collect()]
    assert ids(QueryFilter(severity="warn")) == [] and ids(QueryFilter(severity="warning")) == [1] and ids(QueryFilter(severity="warn", fold_severity=True)) == [1]
    assert ids(QueryFilter(module=" ")) == [1, 2, 3] and ids(QueryFilter(module="b", severity="error")) == [2]
    assert ids(QueryFilter(from_utc=AT, to_utc=AT)) == [1] and ids(QueryFilter(from_utc=AT)) == [1, 2]


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "INFO", [1.0])], "point_id int, severity string, vector array<float>").write.parquet(str(tmp_path / "p"))
    df = search.search(spark.read.parquet(str(tmp_path / "p")), [1.0], 3, QueryFilter(severity="info"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(severity,INFO)" in plan and "TakeOrderedAndProject" in plan


def found(spark, n=2):
    rows = [(k + 1, AT, "INFO", "svc", f"t{k}", "src", "app", f"text {k}") for k in range(n)]
    return spark.createDataFrame(rows, "rank int, timestamp_utc timestamp, severity string, service_name string, trace_id string, source_id string, source_type string, text string")


def test_context_and_answer(spark):
    assert chat.context(found(spark, 0)).first()["context"] == "No matching logs found."
    want = "[1] ts=2026-05-19T18:00:00.0000000+00:00 severity=INFO service=svc trace=t0 source=src/app\ntext 0\n\n[2] ts=2026-05-19T18:00:00.0000000+00:00 severity=INFO service=svc trace=t1 source=src/app\ntext 1\n"
    assert chat.context(found(spark)).first()["context"] == want
    cited = [r.asDict() for r in chat.citations(found(spark, 1)).collect()]
    assert chat.shape(" yes ", cited) == "yes\n\n### Cited log chunks\n- [1] `2026-05-19T18:00:00.0000000+00:00` `INFO` `svc` trace `t0`"
    assert chat.shape(" yes ", []) == "yes"


def test_chat_cases(spark):
    sessions = chat.Sessions()
    with pytest.raises(ValueError):
        chat.chat("  ", lambda q: found(spark), sessions)
    ok = list(chat.chat("q", lambda q: found(spark), sessions, " s "))
    assert [e.type for e in ok] == ["meta", "token", "token", "final"] and ok[0].metadata["chunk_count"] == 2 and ok[-1].metadata["citations"][0]["id"] == 1
    assert [m[0] for m in sessions.history("s")] == ["user", "assistant"] and "### Cited" in sessions.history("s")[1][1]
    none = list(chat.chat("q", lambda q: found(spark, 0), sessions, "t"))
    assert [e.type for e in none] == ["meta", "final"] and len(sessions.history("t")) == 2
    def broken(*_):
        raise RuntimeError("down")
    store = list(chat.chat("q", broken, sessions, "u"))
    assert [e.metadata["error"] for e in store] == ["vector_store_unavailable"] * 2 and not sessions.history("u")
    model = list(chat.chat("q", lambda q: found(spark), sessions, "v", generate=broken))
    assert model[-1].metadata["error"] == "llm_unavailable" and not sessions.history("v")
    text = "".join(chat.frames(ok))
    assert [e["type"] for e in chat.read_frames([text[:30], text[30:]])] == ["meta", "token", "token", "final"]


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "s.json")
    s = chat.Sessions(path=path)
    for k in range(40):
        s.append("a", "user", str(k))
    again = chat.Sessions(path=path).history("a")
    assert len(again) == 32 and again[-1][1] == "39"
    assert chat.history_text(again, 2) == "[USER] 38\n[USER] 39" and chat.history_text(again, 0) == ""
    rows = [("a", k, "user", str(k), AT) for k in range(40)]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, role string, content string, ts timestamp")
    assert chat.kept_messages(df).count() == 32
    assert chat.prompt_history(df, 2).first()["history"] == "[USER] 38\n[USER] 39"
    prompt = chat.build_prompt("q?", "ctx", "[USER] x", ChatOptions())
    assert prompt.index("history") < prompt.index("ctx") < prompt.index("q?")
    assert "history:" not in chat.build_prompt("q?", "ctx", " ")


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b a a"), (4, "")], "id int, text string")
    got = {r["id"]: r["vector"] for r in embed.embed(df, dims=64).collect()}
    assert got[1] == got[3] and len(got[2]) == 64 and not any(got[2]) and not any(got[4])
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)
    with pytest.raises(Exception, match="vectors for"):
        embed.embed(df, factory=lambda: lambda texts: []).collect()
    assert embed.embed(df.limit(0)).count() == 0


def test_defaults(spark):
    df = spark.createDataFrame([(None, None, None)], "severity string, service_name string, timestamp_utc timestamp")
    assert search.with_defaults(df, F.lit(AT)).first()[:2] == ("INFO", "unknown")


def test_whole_messages_in_the_history(spark, sf):
    queries = retrieval.queries()
    threads = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").filter("thread_key is not null").select("thread_key", "doc_id", "source", "text").collect():
        threads.setdefault(r["thread_key"], []).append((r["doc_id"], f"[{(r['source'] or 'user').upper()}] {r['text'] or ''}"))
    want = {t: "\n".join(x for _, x in sorted(lines)[-8:]).strip(" ") for t, lines in threads.items()}
    got = {r["session_id"]: r["history"] for r in queries["prompt_history"](spark, sf).collect()}
    assert got == want and max(map(len, got.values())) > 8 * 60
