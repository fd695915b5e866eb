
import uuid
import hashlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logloom import schemas
from logloom.config import RegexRule
from logloom.functions import jsontext, text as tx
from logloom.operators import chunk, normalize, parse

AT = datetime(2026, 6, 1, tzinfo=timezone.utc)
LINES = {
    "L1": '{"timestamp":"2026-05-19T18:13:07.823Z","level":"warn","service":"billing","traceId":"t-1","message":"slow call","region":"eu"}',
    "L2": '2026-05-19 18: 13: 07.823 {"LogLevel":"ERR","LogDate":"2026-05-19","LogTime":"18:13:08.001","CorrelationId":"c-9","Module":"Pay","Method":"Post","Source":"gw","Destination":"core","BRN":null,"MessageBody":{"StatusCode":502,"Reason":"timeout"},"ExtraData":[{"Key":"AccountId","Value":"77"}],"Entity":"X"}',
    "L3": '2026-05-19 18:13:07 ERROR user="bob" amount=12.5, ctx={"k":"v"}',
    "L4": "2026-05-19T10:00:00Z,error,cart,tr-5,checkout failed, retry=2",
    "L5": "foo, bar, baz, qux, quux",
    "L6": "May  9 18:13:07 host1 authd[4242]: WARN login slow",
    "L7": 'timestamp=2026-05-19T10:00:00Z level=crit app=ledger msg="disk full" disk=sda',
    "L8": "2026-05-19 18:13:07.5 WARN: cache miss Correlation_ID: abc-1",
    "L9": "plain text no shape",
    "L11": "{}",
    "L12": '{"message":null,"level":"info"}',
    "L13": '{"message":"pwd=abc;Bearer aaaaaaaaaaaaaaaaaaaaaaaa api_key=ABCDEFGHIJKLMNOP1"}',
}
HASHES = {
    "L1": ("3367eb6cde2de87557a79fc47754d5a19841f36de300a4c2af65743c57ba6236", "1a72c56f-3a2f-7f03-e572-8d6defb29f66"),
    "L6": ("f06c6aafb7f02c819380acc523d1cc0010ba0398985f93470185096a36e35b36", "883eec7b-37ea-f2b7-26cc-fd4d54a5bd2e"),
    "L13": ("c63ae450eac8e25d97c879df0a9556886da1f310c46a049fa358d478995ead77", "e9c8460a-85d3-6d7f-1f70-8532ccd852e4"),
}


def raw_frame(spark, texts):
    return spark.createDataFrame([(k, "app", v, AT, {}) for k, v in texts.items()], schemas.RAW)


@pytest.fixture(scope="module")
def entries(spark):
    raw = raw_frame(spark, LINES)
    tiers = {r["source_id"]: r["tier"] for r in parse.parse(raw).select("source_id", "tier").collect()}
    # The source is "pay" in the expected values; the key of the line is carried beside it.
    keyed = parse.parse(raw).withColumn("attributes", F.create_map(F.lit("k"), "source_id")).withColumn("source_id", F.lit("pay"))
    rows = {}
    for k, v in LINES.items():
        rows[k] = normalize.normalize(keyed.filter(F.col("attributes")["k"] == k)).first()
    return tiers, rows


def utc(*a):
    return datetime(*a)


def test_tiers(entries):
    assert entries[0] == {"L1": "json", "L2": "stamped_json", "L3": "stamped_pairs", "L4": "commas", "L5": "commas", "L6": "rule:syslog-like", "L7": "pairs", "L8": "stamped_text", "L9": "text", "L11": "text", "L12": "json", "L13": "json"}


def test_fields(entries):
    r = entries[1]
    x = r["L1"]
    assert (x["timestamp_utc"], x["severity"], x["service_name"], x["trace_id"], x["correlation_id"], x["message"], x["payload"]) == (utc(2026, 5, 19, 18, 13, 7, 823000), "WARNING", "billing", "t-1", "t-1", "slow call", {"region": "eu"})
    x = r["L2"]
    assert (x["timestamp_utc"], x["severity"], x["service_name"], x["trace_id"], x["module"], x["method"], x["log_source"], x["destination"], x["brn"], x["account_id"], x["status_code"]) == (utc(2026, 5, 19, 18, 13, 8, 1000), "ERROR", "pay", "c-9", "Pay", "Post", "gw", "core", None, "77", 502)
    assert x["message"] == '{"StatusCode":502,"Reason":"timeout"}' and x["payload"] == {"Reason": "timeout"}
    x = r["L3"]
    assert (x["severity"], x["message"], x["payload"]) == ("INFO", LINES["L3"], {"user": "bob", "amount": "12.5", "ctx": '{"k":"v"}', "k": "v"})
    x = r["L4"]
    assert (x["severity"], x["service_name"], x["trace_id"], x["message"], x["payload"]) == ("ERROR", "cart", "tr-5", "checkout failed, retry=2", {})
    x = r["L5"]
    assert (x["timestamp_utc"], x["severity"], x["service_name"], x["trace_id"], x["message"]) == (utc(2026, 6, 1), "BAR", "baz", "qux", "quux")
    x = r["L6"]
    assert (x["timestamp_utc"], x["severity"], x["service_name"], x["trace_id"], x["message"], x["payload"]) == (utc(2026, 5, 9, 18, 13, 7), "WARNING", "authd", "4242", "login slow", {})
    x = r["L7"]
    assert (x["timestamp_utc"], x["severity"], x["service_name"], x["message"], x["payload"]) == (utc(2026, 5, 19, 10), "CRITICAL", "ledger", LINES["L7"], {"disk": "sda"})
    x = r["L8"]
    assert (x["timestamp_utc"], x["severity"], x["trace_id"], x["message"], x["payload"]) == (utc(2026, 5, 19, 18, 13, 7, 500000), "WARNING", "abc-1", "cache miss Correlation_ID: abc-1", {})
    x = r["L9"]
    assert (x["timestamp_utc"], x["severity"], x["service_name"], x["trace_id"], x["correlation_id"], x["message"]) == (utc(2026, 6, 1), "INFO", "pay", "n/a", "n/a", "plain text no shape")
    assert r["L11"]["message"] == "{}" and r["L11"]["status_code"] is None
    assert (r["L12"]["severity"], r["L12"]["message"]) == ("INFO", "null")


def test_hashes_and_ids(spark, entries):
    for k, (h, p) in HASHES.items():
        assert entries[1][k]["log_hash"] == h
        got = spark.range(1).select(tx.point_id(F.lit(f"{h}-0000")).alias("p")).first()["p"]
        assert got == p == str(uuid.UUID(bytes_le=hashlib.md5(f"{h}-0000".encode()).digest()))


def test_chunk_text(spark):
    one = normalize.normalize(parse.parse(raw_frame(spark, {"pay": LINES["L1"]})))
    assert chunk.chunk(one).first()["text"] == '2026-05-19T18:13:07.8230000+00:00 [WARNING] billing trace=t-1 slow call payload={"region":"eu"}'
    secret = chunk.chunk(normalize.normalize(parse.parse(raw_frame(spark, {"pay": LINES["L13"]})))).first()
    assert secret["text"] == "2026-06-01T00:00:00.0000000+00:00 [INFO] pay trace=n/a pwd=[REDACTED];Bearer [REDACTED_TOKEN] api_key=[REDACTED_KEY]"


def test_noise(spark):
    raw = raw_frame(spark, {"a": "2026-05-19 18:13:07 start retry! Thread: 5", "b": "other"})
    assert [r["source_id"] for r in parse.drop_noise(raw).collect()] == ["b"]
    assert parse.drop_noise(raw, (" ", "")).count() == 2
    nulls = spark.createDataFrame([("a", "app", None, AT, {})], schemas.RAW)
    assert parse.drop_noise(nulls).count() == 1
    row = normalize.normalize(parse.parse(nulls)).first()
    assert row["message"] is None and row["severity"] == "INFO"
    assert normalize.normalize(parse.parse(spark.createDataFrame([], schemas.RAW))).count() == 0


def cut(spark, text, size, overlap):
    rows = spark.range(1).select(F.explode(chunk.windows(tx.tokens(F.lit(text)), size, overlap)).alias("w")).select("w.chunk_index", F.array_join("w.words", " ").alias("t")).collect()
    return [r["t"] for r in rows]


def test_windows(spark):
    letters = " ".join("abcdefghijklmnopqrst")
    assert cut(spark, letters, 8, 2) == ["a b c d e f g h", "g h i j k l m n", "m n o p q r s t"]
    assert len(cut(spark, " ".join("x" * 8), 8, 2)) == 1 and len(cut(spark, " ".join("x" * 9), 8, 2)) == 2
    assert cut(spark, "a  b", 8, 2) == ["a b"] and cut(spark, "   ", 8, 2) == []
    assert cut(spark, letters, 3, 99) == cut(spark, letters, 8, 7)
    assert spark.range(1).select(chunk.chunk_id(F.lit("h"), F.lit(12345)).alias("c")).first()["c"] == "h-12345"


def test_redaction_is_idempotent(spark):
    text = "X-Api-Key: ABCDEFGHIJKLMNOP1 pwd = a;b Bearer eyJaaaaaaaaaaaa.eyJbbbbbbbbbbbb.c"
    once, twice = spark.range(1).select(tx.redact(F.lit(text)).alias("a"), tx.redact(tx.redact(F.lit(text))).alias("b")).first()
    assert once == twice == "X-Api-Key=[REDACTED_KEY] pwd=[REDACTED];b Bearer [REDACTED_JWT]"


def test_strict_json():
    assert jsontext.object_items('{"a": 1.50, "b" : [1, {"c":2}] }') == [("a", 1.5, "1.50"), ("b", [1, {"c": 2}], '[1, {"c":2}]')]
    for bad in ('{"a":1} x', '{"a":1,}', "{a:1}", '{"a":NaN}', "[1]", '{"a":01}', ""):
        with pytest.raises(ValueError):
            jsontext.object_items(bad)
    f = jsontext.Fields()
    f["Ab"] = "1"
    f["aB"] = "2"
    assert dict(f) == {"Ab": "2"} and f.find("AB") == "2"


def test_json_null_and_nesting():
    assert dict(parse.parse_json('{"a":null,"message":"{\\"x\\":{\\"y\\":1},\\"a\\":5}"}')) == {"a": "5", "message": '{"x":{"y":1},"a":5}', "x": '{"y":1}', "y": "1"}
    assert parse.parse_stamped_json("2026-05-19 {}") is None
    assert dict(parse.parse_stamped_pairs('2026-05-19 10:00:00 a="x \\" y" b=[1,{"c":2}] d=')) == {"timestamp": "2026-05-19 10:00:00", "a": 'x \\" y', "b": '[1,{"c":2}]', "c": "2"}


def test_account_and_status():
    text = '[1, {"x":{"Key":"AccountId","Value": 7.50}}]'
    assert normalize.find_account(jsontext.parse(text), text) == "7.50"
    plain = '{"AccountId":"1"}'
    assert normalize.find_account(jsontext.parse(plain), plain) is None
    assert normalize.status_of('{"StatusCode":"200"}') is None and normalize.status_of('{"StatusCode":200}') == 200 and normalize.status_of("{") is None


def test_rules(spark):
    pattern, names = parse.translate(r"^(?<a_b>\w+)(x)?\(?(?:y)(?<c>[(<]+)$")
    assert names == [("a_b", 1), ("c", 3)]
    rules = (RegexRule("none", "^(?<a>zzz)"), RegexRule("one", r"^(?<x_y>\w+) -> (?<z>.*)$"))
    got = parse.parse(raw_frame(spark, {"s": 'left -> "right\nmore"'}), rules).first()
    assert got["tier"] == "rule:one" and got["fields"] == {"x_y": "left", "z": "right\nmore"}


@pytest.mark.parametrize("text,want", [("05/19/2026 18:13:07", datetime(2026, 5, 19, 18, 13, 7)), ("Tue, 19 May 2026 18:13:07 GMT", datetime(2026, 5, 19, 18, 13, 7)), ("2026-05-19", datetime(2026, 5, 19)), ("2026-05-19T20:13:07+02:00", datetime(2026, 5, 19, 18, 13, 7)), ("18:13", datetime(2026, 6, 1)), ("2026", datetime(2026, 6, 1)), ('" 2026-05-19 18 : 13:07 "', datetime(2026, 5, 19, 18, 13, 7)), (None, datetime(2026, 6, 1))])
def test_timestamps(spark, text, want):
    got = spark.createDataFrame([(text, AT)], "t string, at timestamp").select(normalize.parse_timestamp(F.col("t"), F.col("at")).alias("x")).first()["x"]
    assert got == want
