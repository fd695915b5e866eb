"""Queries of sources, parser tiers, normaliser, store, ingest runs and service on the driver's tables, with their SQL.

Files are written from raw_logs first, each of a bounded number of rows, into the folder that all executors share.
"""

from __future__ import annotations

import json
import os
import threading
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.config import IngestOptions, LogSource, Options, SchedulerOptions
from logloom.functions.storage import materialize, shared_dir, spread
from logloom.operators import chat, chunk, normalize, parse
from logloom.plans import retrieval
from logloom.service import ChatRequest, Service, load_options
from logloom.sources.checkpoints import Checkpoints
from logloom.sources.files import read_files, read_text
from logloom.sources.store import PointStore
from logloom.streaming.ingest import Scheduler, point_store, run_ingest, stream_ingest

NOW = retrieval.NOW
#: Rows of raw_logs in one file.
FILE_ROWS = 2000


# ---- sources


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors can open."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}").removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


def _sources(spark: SparkSession, sf: str) -> list[LogSource]:
    """raw_logs as text files of FILE_ROWS rows, in order of raw_id; the id of a source is k and the file's number."""
    raw = spark.read.parquet(f"{sf}/raw_logs.parquet").filter("raw_text is not null and raw_id is not null")
    numbered = raw.select(F.floor(F.col("raw_id") / FILE_ROWS).alias("k"), "raw_id", F.col("raw_text").alias("value"))
    path = os.path.join(_folder(spark, "logs"), "files")
    numbered.repartition("k").sortWithinPartitions("k", "raw_id").select("value", "k").write.partitionBy("k").text("file://" + path)
    found = sorted((int(d.removeprefix("k=")), os.path.join(path, d, f)) for d in os.listdir(path) if d.startswith("k=") for f in os.listdir(os.path.join(path, d)) if f.endswith(".txt"))
    return [LogSource(f"k{k}", file) for k, file in found]


def _placed(events: DataFrame) -> DataFrame:
    at = (F.col("attributes")[c].cast("bigint").alias(c) for c in ("start_offset", "end_offset"))
    return events.select("source_id", "source_type", *at, F.col("attributes")["path"].isNotNull().alias("has_path"), "ingested_at_utc", "raw_text")


def read_log_files(spark, sf):
    """All events of the files, by byte ranges that are far smaller than the files."""
    return _placed(read_files(spark, _sources(spark, sf), NOW, range_bytes=4096))


def read_text_files(spark, sf):
    """The same events by built-in operators, all files as one source."""
    sources = _sources(spark, sf)
    if not sources:
        return _placed(read_files(spark, [], NOW)).select("source_id", "start_offset", "end_offset", "raw_text")
    root = os.path.dirname(os.path.dirname(sources[0].path))
    events = read_text(spark, LogSource("all", "file://" + root), NOW)
    at = (F.col("attributes")[c].cast("bigint").alias(c) for c in ("start_offset", "end_offset"))
    file = F.concat(F.lit("k"), F.regexp_extract(F.col("attributes")["path"], "/k=([0-9]+)/", 1))
    return events.select(file.alias("source_id"), *at, "raw_text")


def resume_log_files(spark, sf):
    """The events from saved offsets: none of files k % 3 = 0, behind the third event of k % 3 = 1, beyond the end of k % 3 = 2; one
    source's file is missing, and the file of offsets is read again as after a restart."""
    sources = _sources(spark, sf)
    events = materialize(_placed(read_files(spark, sources, NOW)).select("source_id", "start_offset"), "offsets")
    order = F.array_sort(F.collect_list("start_offset"))
    fourth = {r["source_id"]: r["at"] for r in events.groupBy("source_id").agg(F.try_element_at(order, F.lit(4)).alias("at")).collect()}  # a row a file
    offsets = {}
    for s in sources:
        kind = int(s.id[1:]) % 3
        if kind:
            offsets[Checkpoints.key(s.id, s.path)] = (fourth.get(s.id) or 0) if kind == 1 else os.path.getsize(s.path) + 1
    file = os.path.join(_folder(spark, "checkpoints"), "offsets.json")
    Checkpoints(file).save(offsets)
    again = Checkpoints(file)
    sources.append(LogSource("gone", os.path.join(os.path.dirname(file), "missing.log")))
    keys = [Checkpoints.key(s.id, s.path) for s in sources]
    return _placed(read_files(spark, sources, NOW, {k: again.get(k) for k in keys})).select("source_id", "start_offset", "end_offset", "raw_text")


_EVENTS = rf"""
    WITH raw AS (SELECT raw_id, raw_id // {FILE_ROWS} AS k, string_split(raw_text, chr(10)) AS l FROM raw_logs WHERE raw_text IS NOT NULL AND raw_id IS NOT NULL),
    lines AS (SELECT k, raw_id, unnest(l) AS line, generate_subscripts(l, 1) AS j FROM raw),
    placed AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY k ORDER BY raw_id, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
      sum(strlen(line) + 1) OVER (PARTITION BY k) AS size, regexp_replace(regexp_replace(line, '\r$', ''), '^\x{{FEFF}}', '') AS shown FROM lines),
    kept AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) = 1 OR
      regexp_matches(shown, '^(?:\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}\s*:\s*\d{{2}}\s*:\s*\d{{2}}|[A-Za-z]{{3}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\b|\s*\{{|\s*(?i:timestamp)=)') AS begins
      FROM placed WHERE regexp_matches(shown, '[^\t\n\x0B\f\r\x1C-\x1F\x{{85}}\p{{Z}}]')),
    numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY k ORDER BY pos) AS e FROM kept),
    made AS (SELECT k, e, min(pos) AS a, max(size) AS size, string_agg(shown, chr(10) ORDER BY pos) AS raw_text FROM numbered GROUP BY k, e),
    events AS (SELECT 'k' || k AS source_id, 'app' AS source_type, k, e, CAST(a AS BIGINT) AS start_offset, CAST(coalesce(lead(a) OVER (PARTITION BY k ORDER BY a), size) AS BIGINT) AS end_offset, raw_text FROM made)"""


# ---- parser tiers and normaliser


def parse_raw_tiers(spark, sf):
    """The tier of every real line and what can be told of it without a parser."""
    parsed = parse.parse(retrieval._raw_entries(spark, sf))
    whole = F.when(F.col("tier").isin("stamped_pairs", "text"), F.col("parsed_message"))
    stamp = F.when(F.col("tier").isin("stamped_text", "stamped_pairs"), F.try_element_at("fields", F.lit("timestamp")))
    return parsed.select("raw_id", "tier", whole.alias("whole"), stamp.alias("stamp"))


def _blank(c):
    return F.when(c.rlike(r"(?U)\S"), c)


def _mixed_lines(spark, sf):
    """A line of one of nine layouts for each log entry, of its own values."""
    e = spread(spark.read.parquet(f"{sf}/log_entries.parquet").drop("source_type", "payload", "log_hash", "timestamp_utc").filter("log_id is not null"))
    plain = F.coalesce(F.regexp_replace(F.regexp_replace("message", r"[^A-Za-z0-9]+", " "), "^ +| +$", ""), F.lit(""))
    day = F.date_format(F.coalesce("load_day", F.lit("2026-01-01").cast("date")), "yyyy-MM-dd")
    clock = F.format_string("%02d:%02d:07.5", F.col("log_id") % 24, F.col("log_id") % 60)
    e = e.withColumn("plain", F.concat(F.lit("m "), plain)).withColumn("day", day).withColumn("clock", clock)
    spaced, iso = F.concat("day", F.lit(" "), "clock"), F.concat("day", F.lit("T"), "clock", F.lit("Z"))
    c = F.col

    def named(**values):
        return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())))

    def pair(key, value, quote=""):
        return F.concat(F.lit(f"{key}={quote}"), value, F.lit(quote))

    word = F.regexp_replace("service_name", r"[^A-Za-z0-9-]", "")
    lines = [
        named(**{"@timestamp": iso}, level=c("severity"), service=c("service_name"), traceId=c("trace_id"), msg=c("plain"), Module=c("module"), METHOD=c("method"), BRN=c("brn"), IP=c("ip"), region=c("destination"), Entity=F.lit("E"), AccountId=c("account_id")),
        F.concat(spaced, F.lit(" "), named(
            LogLevel=c("severity"), CorrelationId=c("trace_id"), Module=c("module"), Method=c("method"), Source=c("log_source"), Destination=c("destination"), BRN=c("brn"), BillingAccount=c("billing_account"), DenominationId=c("denomination_id"), IP=c("ip"),
            MessageBody=F.struct(c("status_code").alias("StatusCode"), c("plain").alias("Reason")), ExtraData=F.array(F.struct(F.lit("Other").alias("Key"), F.lit("0").alias("Value")), F.struct(F.lit("AccountId").alias("Key"), F.coalesce("account_id", F.lit("none")).alias("Value"))),
            LogDate=F.when(c("log_id") % 2 == 1, c("day")), LogTime=F.lit("11:22:33"),
        )),
        F.concat_ws(" ", spaced, F.lit("ERROR"), pair("user", c("plain"), '"'), pair("ip", c("ip")), pair("n", c("status_code").cast("string")), pair("region", c("destination"), '"'), F.lit('ctx={"deep":{"k":1}}')),
        F.concat_ws(",", iso, F.coalesce("severity", F.lit("")), F.concat(F.lit(" "), F.coalesce("service_name", F.lit("")), F.lit(" ")), F.coalesce("trace_id", F.lit("")), F.concat(c("plain"), F.lit(", twice, thrice"))),
        F.concat(F.lit("May  9 18:13:07 host1 svc"), word, F.lit("["), c("log_id").cast("string"), F.lit("]: WARN "), c("plain")),
        F.concat_ws(" ", pair("level", F.coalesce(_blank(F.regexp_replace("severity", r"\s", "")), F.lit("x"))), pair("app", F.concat(F.lit("a"), word)), pair("msg", c("plain"), '"'), pair("region", F.concat(F.lit("r"), F.regexp_replace(F.coalesce("destination", F.lit("")), r"\s", ""))), F.lit("level=err")),
        F.concat(spaced, F.lit(" crit: "), c("plain"), F.when(c("log_id") % 2 == 1, F.concat(F.lit(" Correlation_ID: c-"), c("log_id").cast("string"))).otherwise(F.concat(F.lit(" requestId: r-"), c("log_id").cast("string")))),
        F.concat(F.lit("  "), c("plain"), F.lit(" ")),
        F.concat(F.lit('{"broken": "'), c("plain")),
    ]
    text = lines[-1]
    for k, line in enumerate(lines[:-1]):
        text = F.when(c("log_id") % 9 == k, line).otherwise(text)
    return e.select("log_id", F.concat(F.lit("s"), c("log_id").cast("string")).alias("source_id"), F.lit("app").alias("source_type"), text.alias("raw_text"), F.lit(NOW).alias("ingested_at_utc"))


_COLUMNS = ("severity", "service_name", "trace_id", "correlation_id", "module", "method", "log_source", "destination", "brn", "billing_account", "denomination_id", "account_id", "ip", "status_code")


def _normalized(spark, sf):
    return normalize.normalize(parse.parse(_mixed_lines(spark, sf)), keep=("log_id", "tier"))


def normalize_mixed_lines(spark, sf):
    out = _normalized(spark, sf)
    made = F.when(F.col("tier").isin("stamped_pairs", "pairs", "text"), F.lit("whole text")).otherwise(F.col("message"))
    keys = F.array_join(F.array_sort(F.map_keys("payload")), ",")
    values = F.array_join(F.array_sort(F.map_values("payload")), ",")
    return out.select("log_id", "tier", "timestamp_utc", *_COLUMNS, made.alias("message"), keys.alias("payload_keys"), values.alias("payload_values"))


def chunk_mixed_lines(spark, sf):
    """The chunks of windows of 12 words, 3 of them shared, of those lines whose text SQL can render."""
    kept = _normalized(spark, sf).filter(F.col("tier").isin("commas", "rule:syslog-like", "stamped_text"))
    cut = chunk.chunk(kept, 12, 3, keep=("log_id",))
    return cut.select("log_id", "chunk_index", "text")


def _clean(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[^\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]') THEN {x} END"


def _fold(x: str) -> str:
    up = f"upper({retrieval._trim(x)})"
    return f"CASE {up} WHEN 'WARN' THEN 'WARNING' WHEN 'ERR' THEN 'ERROR' WHEN 'CRIT' THEN 'CRITICAL' ELSE {up} END"


def _mixed_sql() -> str:
    given = {c: f"nullif({_clean(c)}, 'null')" for c in ("module", "method", "log_source", "destination", "brn", "billing_account", "denomination_id", "ip")}
    sev = f"coalesce({_clean('severity')}, 'INFO')"
    word = "regexp_replace(service_name, '[^A-Za-z0-9-]', '', 'g')"
    tight = "regexp_replace(severity, '\\s', '', 'g')"
    trace = {
        0: f"coalesce({_clean('trace_id')}, 'n/a')", 1: f"coalesce({_clean('trace_id')}, 'n/a')", 3: f"coalesce({_clean(retrieval._trim('trace_id'))}, 'n/a')",
        4: "CASE WHEN service_name IS NULL THEN 'n/a' ELSE CAST(log_id AS VARCHAR) END", 6: "CASE WHEN log_id % 2 = 1 THEN 'c-' ELSE 'r-' END || log_id",
    }
    correlation = {**trace, 1: f"coalesce(nullif({_clean('trace_id')}, 'null'), {trace[1]})"}
    wide = {0: ("module", "method", "brn", "ip"), 1: tuple(given), 2: ("ip",)}

    def by(column: str, cases: dict[int, str], other: str) -> str:
        return "CASE log_id % 9 " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {other} END AS {column}"

    columns = [
        by("tier", {0: "'json'", 1: "'stamped_json'", 2: "'stamped_pairs'", 3: "'commas'", 4: "CASE WHEN service_name IS NULL THEN NULL ELSE 'rule:syslog-like' END", 5: "'pairs'", 6: "'stamped_text'"}, "'text'"),
        by("timestamp_utc", {0: "stamp", 1: "CASE WHEN log_id % 2 = 1 THEN day::TIMESTAMP + INTERVAL 11 HOUR + INTERVAL 22 MINUTE + INTERVAL 33 SECOND ELSE stamp END", 2: "stamp", 3: "stamp", 4: "CASE WHEN service_name IS NULL THEN TIMESTAMP '2026-05-01' ELSE TIMESTAMP '2026-05-09 18:13:07' END", 6: "stamp"}, "TIMESTAMP '2026-05-01'"),
        by("severity", {0: _fold(sev), 1: _fold(sev), 3: _fold(sev), 4: "CASE WHEN service_name IS NULL THEN 'INFO' ELSE 'WARNING' END", 5: "'ERROR'", 6: "'CRIT'"}, "'INFO'").replace("THEN 'CRIT'", "THEN 'INFO'"),
        by("service_name", {0: f"coalesce({_clean('service_name')}, 's' || log_id)", 3: f"coalesce({_clean(retrieval._trim('service_name'))}, 's' || log_id)", 4: f"coalesce('svc' || {word}, 's' || log_id)", 5: f"coalesce('a' || {word}, 's' || log_id)"}, "'s' || log_id"),
        by("trace_id", trace, "'n/a'"), by("correlation_id", correlation, "'n/a'"),
        *(by(c, {k: f"coalesce({given[c]}, '')" for k in (0, 1) if c in wide[k]}, "''") for c in ("module", "method", "log_source", "destination")),
        *(by(c, {k: given[c] for k in (0, 1, 2) if c in wide[k]}, "NULL") for c in ("brn", "billing_account", "denomination_id", "ip")),
        by("account_id", {1: "coalesce(account_id, 'none')"}, "NULL"), by("status_code", {1: "status_code"}, "NULL"),
        by("message", {0: "plain", 1: """'{' || coalesce('"StatusCode":' || status_code || ',', '') || '"Reason":"' || plain || '"}'""", 3: "plain || ', twice, thrice'", 4: "CASE WHEN service_name IS NULL THEN NULL ELSE plain END", 6: "'crit: ' || plain || CASE WHEN log_id % 2 = 1 THEN ' Correlation_ID: c-' ELSE ' requestId: r-' END || log_id"}, "'whole text'"),
        by("payload_keys", {0: "CASE WHEN destination IS NULL THEN '' ELSE 'region' END", 1: "'Reason'", 2: "concat_ws(',', 'ctx', 'deep', 'k', CASE WHEN status_code IS NOT NULL THEN 'n' END, CASE WHEN destination IS NOT NULL THEN 'region' END, 'user')", 4: "''", 5: "'region'"}, "''"),
        by("payload_values", {0: "coalesce(destination, '')", 1: "plain", 2: """array_to_string(list_sort(list_filter(['{"deep":{"k":1}}', '{"k":1}', '1', CAST(status_code AS VARCHAR), destination, plain], lambda x: x IS NOT NULL)), ',')""", 5: "'r' || regexp_replace(coalesce(destination, ''), '\\s', '', 'g')"}, "''"),
    ]
    return rf"""
        WITH e AS (SELECT *, 'm ' || coalesce(regexp_replace(regexp_replace(message, '[^A-Za-z0-9]+', ' ', 'g'), '^ +| +$', '', 'g'), '') AS plain, strftime(coalesce(load_day, DATE '2026-01-01'), '%Y-%m-%d') AS day FROM log_entries WHERE log_id IS NOT NULL),
        t AS (SELECT * REPLACE (trim(plain) AS plain), plain AS whole, day::TIMESTAMP + to_hours(log_id % 24) + to_minutes(log_id % 60) + to_milliseconds(7500) AS stamp FROM e),
        n AS (SELECT log_id, whole, {", ".join(columns)} FROM t)"""


# ---- store and ingest runs


def _events_store(spark, sf) -> PointStore:
    """The latest batch's event of each user: three upserts, merged in part."""
    store = PointStore(spark, _folder(spark, "store"), "user_id bigint, ts timestamp, event_id bigint, batch int", "user_id", "ts")
    events = spark.read.parquet(f"{sf}/events.parquet").filter("user_id is not null")
    for batch in range(3):
        rows = events.filter(F.col("event_id") % 3 == batch).select("user_id", "ts", "event_id", F.lit(batch).alias("batch"))
        if batch < 2:  # so that users differ between batches
            rows = rows.filter(F.col("user_id") % (batch + 2) == 0)
        else:
            rows = rows.filter(F.col("user_id") % 5 != 0)
        store.upsert(rows, F.struct(F.col("ts"), F.col("event_id")).desc())
        if batch == 1:
            store.compact()
    return store


def store_upserts(spark, sf):
    return _events_store(spark, sf).read()


def store_retained(spark, sf):
    """After retention, and an upsert of an older event that it doesn't touch."""
    store = _events_store(spark, sf)
    store.delete_before(retrieval.TO)
    old = spark.range(1).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(retrieval.FROM).alias("ts"), F.lit(-1).cast("bigint").alias("event_id"), F.lit(9).alias("batch"))
    store.upsert(old)
    store.maintain()
    return store.read()


_STORE = """
    WITH b AS (SELECT *, CAST(event_id % 3 AS INTEGER) AS batch FROM events WHERE user_id IS NOT NULL),
    k AS (SELECT * FROM b WHERE (batch = 0 AND user_id % 2 = 0) OR (batch = 1 AND user_id % 3 = 0) OR (batch = 2 AND user_id % 5 <> 0)),
    s AS (SELECT user_id, ts, event_id, batch FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch DESC, ts DESC, event_id DESC) = 1)"""


def _options(sources, spark, **ingest) -> Options:
    # Windows of so many words that an entry is one chunk, and retention beyond all times in the lines.
    made = IngestOptions(checkpoint_file=os.path.join(_folder(spark, "checkpoints"), "offsets.json"), chunk_tokens=1 << 20, retention_days=20_000, noise_patterns=("callback was throttled", " "), **ingest)
    return Options(sources=tuple(sources), ingest=made)


def ingest_runs(spark, sf):
    """Two runs over the files; the second finds nothing new. Counts of each and what is stored then."""
    store, options = point_store(spark, _folder(spark, "points")), _options(_sources(spark, sf), spark)
    out = None
    for run in (1, 2):
        result = run_ingest(spark, store, options, NOW)
        row = result.select(F.lit(run).alias("run"), "raw_logs_read", "chunks_created", "vectors_upserted", "completed_at_utc").withColumn("stored", F.lit(store.read().count()))
        out = row if out is None else out.unionByName(row)
    return out


def stream_points(spark, sf):
    """The same by the stream, in two starts from one checkpoint: first the even files, then all."""
    sources, folder = _sources(spark, sf), _folder(spark, "stream")
    store = point_store(spark, _folder(spark, "points"))
    for part in ([s for s in sources if int(s.id[1:]) % 2 == 0], sources):
        query = stream_ingest(spark, store, _options(part, spark), folder, clock=lambda: NOW)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    store.maintain()
    return store.read().groupBy("source_id").agg(F.count("*").alias("n_points"), F.count_distinct("log_hash").alias("n_events"), F.min(F.size("vector")).alias("dims"))


def stored_points(spark, sf):
    """Ids and hashes of all points of one run."""
    store = point_store(spark, _folder(spark, "points"))
    run_ingest(spark, store, _options(_sources(spark, sf), spark), NOW)
    return store.read().select("source_id", "source_type", "log_hash", "chunk_index", "chunk_id", "point_id")


_POINT_ID = "m[7:8] || m[5:6] || m[3:4] || m[1:2] || '-' || m[11:12] || m[9:10] || '-' || m[15:16] || m[13:14] || '-' || m[17:20] || '-' || m[21:32]"
_KEPT = "NOT regexp_matches(raw_text, '(?i)callback was throttled')"


def scheduled_runs(spark, sf):
    """Which ticks of a schedule run: not while another is at work, and again after an error."""
    entries = spark.read.parquet(f"{sf}/log_entries.parquet")
    state = {"count": 0}
    scheduler: Scheduler

    def run():
        state["count"] += 1
        if state["count"] == 2:
            raise ValueError("fails once")
        ran.append(("within", scheduler.tick()))
        ran.append(("counted", entries.count() >= 0))

    ran: list[tuple[str, bool]] = []
    scheduler = Scheduler(run, Options(scheduler=SchedulerOptions(daily_batch=False, polling=False, run_on_start=True)))
    scheduler.start()
    for name in ("fails", "after"):
        ran.append((name, scheduler.tick()))
    scheduler.stop()
    return spark.createDataFrame([(k, n, r) for k, (n, r) in enumerate(ran)], "step int, name string, ran boolean")


# ---- service


def _chat_service(spark, sf) -> Service:
    """A service whose retrieval is that of retrieve_chunks."""
    offsets = os.path.join(_folder(spark, "checkpoints"), "offsets.json")
    service = Service(spark, load_options(json.dumps({"ingest": {"checkpoint_file": offsets}})), _folder(spark, "points"), clock=lambda: NOW)
    found = materialize(retrieval._retrieved(spark, sf), "retrieved")
    service.retrieve = lambda request: found if request.filter.service_name is None else found.limit(0)
    return service


def _events(service: Service, body: dict) -> list[dict]:
    return list(chat.read_frames(chat.frames(service.chat(ChatRequest.from_json(json.dumps(body))))))


def chat_events(spark, sf):
    """The events of a question with matches and of one without, through frames and back."""
    service, rows = _chat_service(spark, sf), []
    for turn, body in enumerate(({"question": retrieval.QUESTION, "session_id": " s "}, {"question": "anything", "session_id": "s", "filter": {"service_name": "none"}})):
        for k, e in enumerate(_events(service, body)):
            meta = e["metadata"] or {}
            rows.append((turn, k, e["type"], e["content"], meta.get("session_id"), meta.get("chunk_count"), len(meta["citations"]) if "citations" in meta else None))
    return spark.createDataFrame(rows, "turn int, k int, type string, content string, session_id string, chunk_count int, n_citations int")


def chat_sessions(spark, sf):
    """What a session keeps after 20 questions: 32 messages, of which the last 8 enter the prompt."""
    service = _chat_service(spark, sf)
    for k in range(20):
        _events(service, {"question": f"question {k}", "session_id": "s", "filter": {"service_name": "none"}})
    history = service.sessions.history("s")
    prompt = chat.build_prompt("q", "c", chat.history_text(history, 8))
    rows = [(k, role, content, f"[{role.upper()}] {content}" in prompt.split("\n")) for k, (role, content, _) in enumerate(history)]
    return spark.createDataFrame(rows, "k int, role string, content string, prompted boolean")


def service_responses(spark, sf):
    """Requests over HTTP and how they are answered."""
    server = _chat_service(spark, sf).serve(port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, rows = f"http://127.0.0.1:{server.server_address[1]}", []
    calls = [("GET", "/health", None), ("GET", "/other", None), ("POST", "/chat", "{}"), ("POST", "/chat", '{"question": "  "}'), ("POST", "/chat", "[1]"), ("POST", "/chat", '{"QUESTION": "x", "filter": {"service_name": "none"}}'), ("POST", "/ingest", ""), ("POST", "/none", "")]
    for k, (method, path, body) in enumerate(calls):
        request = urllib.request.Request(base + path, None if body is None else body.encode(), method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                status, kind, text = answer.status, answer.headers["Content-Type"], answer.read().decode()
        except urllib.error.HTTPError as e:
            status, kind, text = e.code, e.headers["Content-Type"], e.read().decode()
        rows.append((k, method, path, status, kind, ",".join(sorted(json.loads(text))) if kind == "application/json" else ",".join(e["type"] for e in chat.read_frames([text]))))
    server.shutdown()
    server.server_close()
    return spark.createDataFrame(rows, "k int, method string, path string, status int, content_type string, says string")


def options_given(spark, sf):
    """Options as they are read from JSON: what isn't given keeps its default."""
    o = load_options('{"sources": [{"id": "a", "path": "/x"}], "ingest": {"chunk_tokens": 100}, "search": {"rerank": false}, "scheduler": {"polling": true}}')
    rows = {
        "sources": len(o.sources), "chunk_tokens": o.ingest.chunk_tokens, "overlap_tokens": o.ingest.overlap_tokens, "retention_days": o.ingest.retention_days, "noise_patterns": len(o.ingest.noise_patterns),
        "poll_seconds": o.scheduler.poll_seconds, "batch_hours": o.scheduler.batch_hours, "polling": o.scheduler.polling, "dims": o.embedding.dims, "batch_size": o.embedding.batch_size,
        "parallel_batches": o.embedding.parallel_batches, "top_k": o.search.top_k, "rerank": o.search.rerank, "history_messages": o.chat.history_messages,
    }
    return spark.createDataFrame([(k, int(v)) for k, v in rows.items()], "name string, value bigint")


_ALL = (
    read_log_files, read_text_files, resume_log_files, parse_raw_tiers, normalize_mixed_lines, chunk_mixed_lines, store_upserts, store_retained, ingest_runs, stream_points,
    stored_points, scheduled_runs, chat_events, chat_sessions, service_responses, options_given,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    blank = retrieval._BLANKS
    text = retrieval._trim("raw_text")
    stamp = r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}\s*:\s*\d{2}\s*:\s*\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?"
    rule = r"^\w+\s+\d+\s+\d{2}:\d{2}:\d{2}\s+\S+\s+[\w-]+(?:\[[^\]]+\])?:\s+[A-Z]+\s+(?s:.*)$"
    retrieved = retrieval.retrieved_sql()
    no_match = chat.NO_MATCH
    return {
        "read_log_files": f"{_EVENTS} SELECT source_id, source_type, start_offset, end_offset, true AS has_path, TIMESTAMP '2026-05-01' AS ingested_at_utc, raw_text FROM events",
        "read_text_files": f"{_EVENTS} SELECT source_id, start_offset, end_offset, raw_text FROM events",
        "resume_log_files": f"{_EVENTS} SELECT source_id, start_offset, end_offset, raw_text FROM events QUALIFY k % 3 <> 1 OR e > 3 OR max(e) OVER (PARTITION BY k) <= 3",
        "parse_raw_tiers": rf"""
            WITH t AS (SELECT raw_id, raw_text, {text} AS x FROM raw_logs),
            s AS (SELECT *, regexp_extract(x, '^({stamp})\s+([\s\S]+)$', 1) AS stamp, regexp_replace(regexp_extract(x, '^({stamp})\s+([\s\S]+)$', 2), '^{blank}+|{blank}+$', '', 'g') AS rest FROM t),
            k AS (SELECT *, CASE WHEN x IS NULL THEN NULL
                WHEN starts_with(x, '{{') AND json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x END) = 'OBJECT' AND len(json_keys(CASE WHEN json_valid(x) THEN x END)) > 0 THEN 'json'
                WHEN stamp <> '' AND starts_with(rest, '{{') AND json_valid(rest) AND len(json_keys(CASE WHEN json_valid(rest) THEN rest END)) > 0 THEN 'stamped_json'
                WHEN stamp <> '' AND regexp_matches(rest, '(?:"[a-zA-Z0-9_\-]+"\s*:\s*|\b[a-zA-Z0-9_\-]+\s*=\s*)[\s\S]') THEN 'stamped_pairs'
                WHEN len(string_split(x, ',')) >= 5 THEN 'commas'
                WHEN regexp_matches(x, '{rule}') THEN 'rule:syslog-like'
                WHEN regexp_matches(x, '[a-zA-Z_][a-zA-Z0-9_]*=("[^"]+"|\S+)') THEN 'pairs'
                WHEN stamp <> '' THEN 'stamped_text' ELSE 'text' END AS tier FROM s)
            SELECT raw_id, tier, CASE WHEN tier = 'stamped_pairs' THEN raw_text WHEN tier = 'text' THEN raw_text END AS whole, CASE WHEN tier IN ('stamped_text', 'stamped_pairs') THEN stamp END AS stamp FROM k""",
        "normalize_mixed_lines": f"{_mixed_sql()} SELECT * EXCLUDE (whole) FROM n",
        "chunk_mixed_lines": rf"""{_mixed_sql()},
            r AS (SELECT log_id, strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00 [' || severity || '] ' || service_name || ' trace=' || trace_id || ' ' || message AS x FROM n WHERE tier IN ('commas', 'rule:syslog-like', 'stamped_text')),
            w AS (SELECT log_id, list_filter(list_transform(string_split(x, ' '), lambda v: {retrieval._trim("v")}), lambda v: v <> '') AS w FROM r),
            c AS (SELECT log_id, w, unnest(range(0, 1 + CAST(ceil(greatest(0, len(w) - 12) / 9.0) AS BIGINT))) AS k FROM w)
            SELECT log_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(w[k * 9 + 1 : k * 9 + 12], ' ') AS text FROM c""",
        "store_upserts": f"{_STORE} SELECT * FROM s",
        "store_retained": f"{_STORE} SELECT * FROM s WHERE ts >= TIMESTAMP '2024-01-15' UNION ALL SELECT -1, TIMESTAMP '2024-01-08', -1, 9",
        "ingest_runs": f"""{_EVENTS}, c AS (SELECT CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE {_KEPT}) AS INTEGER) AS kept, CAST(count(DISTINCT source_id || '|' || raw_text) FILTER (WHERE {_KEPT}) AS INTEGER) AS points FROM events)
            SELECT 1 AS run, n AS raw_logs_read, kept AS chunks_created, kept AS vectors_upserted, TIMESTAMP '2026-05-01' AS completed_at_utc, points AS stored FROM c
            UNION ALL SELECT 2, 0, 0, 0, TIMESTAMP '2026-05-01', points FROM c""",
        "stream_points": f"{_EVENTS} SELECT source_id, count(DISTINCT raw_text) AS n_points, count(DISTINCT raw_text) AS n_events, 768 AS dims FROM events WHERE {_KEPT} GROUP BY source_id",
        "stored_points": f"""{_EVENTS}, d AS (SELECT DISTINCT source_id, source_type, sha256(source_id || '|' || raw_text) AS log_hash FROM events WHERE {_KEPT}), i AS (SELECT *, md5(log_hash || '-0000') AS m FROM d)
            SELECT source_id, source_type, log_hash, 0 AS chunk_index, log_hash || '-0000' AS chunk_id, {_POINT_ID} AS point_id FROM i""",
        "scheduled_runs": "SELECT * FROM (VALUES (0, 'within', false), (1, 'counted', true), (2, 'fails', true), (3, 'within', false), (4, 'counted', true), (5, 'after', true)) t(step, name, ran)",
        "chat_events": f"""{retrieved}, n AS (SELECT CAST(count(*) AS INTEGER) AS n FROM ranked), first AS (SELECT rank, string_split(coalesce(text, ''), chr(10))[1] AS line FROM ranked WHERE rank <= 3),
            answer AS (SELECT string_agg(line, chr(10) ORDER BY rank) AS a FROM first),
            cited AS (SELECT string_agg('- [' || rank || '] `' || {retrieval.ISO} || '` `' || severity || '` `' || service_name || '` trace `' || trace_id || '`', chr(10) ORDER BY rank) AS c FROM ranked)
            SELECT 0 AS turn, 0 AS k, 'meta' AS type, NULL AS content, 's' AS session_id, n AS chunk_count, CAST(NULL AS INTEGER) AS n_citations FROM n
            UNION ALL SELECT 0, rank, 'token', CASE WHEN rank > 1 THEN chr(10) ELSE '' END || line, NULL, NULL, NULL FROM first
            UNION ALL SELECT 0, 1 + (SELECT CAST(count(*) AS INTEGER) FROM first), 'final', {retrieval._trim("a")} || chr(10) || chr(10) || '### Cited log chunks' || chr(10) || c, 's', NULL, n FROM answer, cited, n
            UNION ALL SELECT 1, 0, 'meta', NULL, 's', 0, NULL UNION ALL SELECT 1, 1, 'final', '{no_match}', 's', NULL, 0""",
        "chat_sessions": f"""SELECT CAST(k AS INTEGER) AS k, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN k % 2 = 0 THEN 'question ' || (4 + k // 2) ELSE '{no_match}' END AS content,
            k >= 24 OR k % 2 = 1 AS prompted FROM range(32) t(k)""",
        "service_responses": """SELECT * FROM (VALUES (0, 'GET', '/health', 200, 'application/json', 'status'), (1, 'GET', '/other', 404, 'application/json', 'error'), (2, 'POST', '/chat', 400, 'application/json', 'error'),
            (3, 'POST', '/chat', 400, 'application/json', 'error'), (4, 'POST', '/chat', 400, 'application/json', 'error'), (5, 'POST', '/chat', 200, 'text/event-stream', 'meta,final'),
            (6, 'POST', '/ingest', 200, 'application/json', 'chunks_created,completed_at_utc,raw_logs_read,vectors_upserted'), (7, 'POST', '/none', 404, 'application/json', 'error')) t(k, method, path, status, content_type, says)""",
        "options_given": """SELECT * FROM (VALUES ('sources', 1), ('chunk_tokens', 100), ('overlap_tokens', 64), ('retention_days', 30), ('noise_patterns', 7), ('poll_seconds', 30), ('batch_hours', 24), ('polling', 1), ('dims', 768),
            ('batch_size', 16), ('parallel_batches', 4), ('top_k', 8), ('rerank', 0), ('history_messages', 8)) t(name, value)""",
    }
