"""Queries of ingestion and retrieval on the driver's tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.config import NOISE
from logloom.functions import text as tx
from logloom.functions.storage import spread
from logloom.operators import chat, chunk, normalize, parse, search
from logloom.operators.embed import embed, embed_one, to_points
from logloom.operators.search import QueryFilter
from logloom.operators.timestamps import normalize_timestamps
from logloom.sources.events import START
from logloom.streaming.ingest import raw_to_points

QUESTION = "refund request delayed by the partner"
FROM, TO = datetime(2024, 1, 8, tzinfo=timezone.utc), datetime(2024, 1, 15, tzinfo=timezone.utc)
NOW = datetime(2026, 5, 1, tzinfo=timezone.utc)


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _scan(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table for work in Python or on long texts."""
    return spread(_read(spark, sf, table).select(*columns))


def _first_vector(df: DataFrame, id_col: str, vector: str) -> list[float]:
    """The query vector: that of the smallest id."""
    return list(df.orderBy(id_col).select(vector).first()[0])


# ---- vectors


def vector_topk(spark, sf):
    e = _read(spark, sf, "embeddings")
    found = search.search(e, _first_vector(e, "vec_id", "embedding"), 10, vector_col="embedding", id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


def vector_topk_filtered(spark, sf):
    e = _read(spark, sf, "embeddings")
    first = e.orderBy("vec_id").select("embedding", "label").first()
    found = search.search(e.filter(F.col("label") == first["label"]), list(first["embedding"]), 10, vector_col="embedding", id_col="vec_id")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


def retrieve_dedup_rerank(spark, sf):
    e = _read(spark, sf, "embeddings")
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    found = search.retrieve(e.join(docs, "vec_id"), QUESTION, _first_vector(e, "vec_id", "embedding"), 8, id_col="vec_id", event="label", vector_col="embedding")
    return found.select("rank", "vec_id", "label", F.round("rank_score", 6).alias("rank_score"))


def _chunk_points(spark, sf):
    points = _read(spark, sf, "vector_points").select("point_no", "chunk_id", "vector")
    return points.join(_read(spark, sf, "log_chunks").select("chunk_id", "log_hash", "severity", "service_name", "text"), "chunk_id")


def _usable_vector(spark, sf):
    p = _read(spark, sf, "vector_points")
    return p.filter(search.cosine(F.col("vector"), F.col("vector")).isNotNull() & (F.size("vector") == 128)).orderBy("point_no").select("vector").first()


def retrieve_chunks(spark, sf):
    if (first := _usable_vector(spark, sf)) is None:
        return spark.createDataFrame([], "rank int, point_no bigint, log_hash string, rank_score double")
    found = search.retrieve(_chunk_points(spark, sf), QUESTION, list(first[0]), 8, QueryFilter(severity="info"), id_col="point_no")
    return found.select("rank", "point_no", "log_hash", F.round("rank_score", 6).alias("rank_score"))


def hybrid_rank(spark, sf):
    """Hashed vectors of whole texts against the question."""
    docs = embed(_scan(spark, sf, "documents", "doc_id", "text").withColumn("log_hash", F.sha2(F.col("text"), 256)))
    found = search.retrieve(docs, QUESTION, embed_one(QUESTION), 8, id_col="doc_id")
    return found.select("rank", "doc_id", F.round("rank_score", 4).alias("rank_score"))  # vectors are single precision


def embed_documents(spark, sf):
    """Of each document's vector: size, length, how many elements aren't zero, and the first place and sign of the largest."""
    docs = embed(_scan(spark, sf, "documents", "doc_id", "text"))
    largest = F.array_max(F.transform("vector", F.abs))
    place = F.when(largest > 0, F.array_position(F.transform("vector", F.abs), largest) - 1)
    set_ = F.size(F.filter("vector", lambda x: x != 0))
    norm = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3)
    return docs.select("doc_id", F.size("vector").alias("dims"), norm.alias("norm"), set_.alias("n_set"), place.alias("place"), F.signum(F.try_element_at("vector", (place + 1).cast("int"))).alias("sign"))


# ---- filters


def metadata_filter(spark, sf):
    kept = QueryFilter(service_name="ledger", severity="error", source_type="ledger", module=" ").apply(_read(spark, sf, "log_entries"))
    return kept.select("log_id", "service_name", "severity", "source_type")


def severity_filter_unfolded(spark, sf):
    return QueryFilter(severity="warn").apply(_read(spark, sf, "log_entries")).select("log_id", "severity")


def time_range(spark, sf):
    return QueryFilter(from_utc=FROM, to_utc=TO).apply(_read(spark, sf, "events"), "ts").select("event_id", "ts")


def noise_filter(spark, sf):
    raw = _read(spark, sf, "raw_logs").select("raw_id", "raw_text")
    return parse.drop_noise(raw, (r"start retry! thread:", " ", r"callback was throttled", r"\[pid \d+\]")).select("raw_id")


_NOISY = (
    ' {"PayloadSenderV2"} Cancellation  requested', " Elastic.Apm.Metrics.MetricSet", " no TYPE was specified for the decimal property", " SqlServerObjectsInstaller",
    " processing Denomination 12 on thread 7", " START retry! thread:", " end Retry! Thread:", " start Retry Thread", " Processing denomination x on thread 7", " ElasticXApm.Metrics.MetricSet",
)


def noise_filter_shipped(spark, sf):
    """The shipped patterns, on messages of which most have something like noise at the end."""
    e = _read(spark, sf, "log_entries").filter("log_id is not null")
    noise = F.element_at(F.array(*map(F.lit, _NOISY)), (F.col("log_id") % len(_NOISY) + 1).cast("int"))
    return parse.drop_noise(e.select("log_id", F.concat(F.coalesce("message", F.lit("")), noise).alias("raw_text"))).select("log_id")


def payload_defaults(spark, sf):
    """What stands for missing metadata of chunks; times are those of loading."""
    e = _read(spark, sf, "log_entries").select("log_id", "severity", "service_name", "source_id", "source_type", "trace_id", "correlation_id", "module", "method", "log_source", "destination", "brn", F.col("load_day").cast("timestamp").alias("timestamp_utc"))
    return search.with_defaults(e, F.lit(NOW))


def event_start(spark, sf):
    raw = _read(spark, sf, "raw_logs")
    return raw.select("raw_id", F.coalesce(F.col("raw_text").rlike("(?U)" + START), F.lit(False)).alias("starts"))


# ---- functions


def lexical_overlap(spark, sf):
    docs = _read(spark, sf, "documents")
    return docs.select("doc_id", F.round(tx.overlap(tx.terms(F.lit(QUESTION)), F.coalesce("text", F.lit(""))), 6).alias("overlap"))


def severity_fold(spark, sf):
    return _read(spark, sf, "log_entries").select("log_id", tx.fold_severity(F.col("severity")).alias("severity"))


def timestamp_text(spark, sf):
    return _read(spark, sf, "log_entries").select("log_id", normalize.timestamp_text(F.col("timestamp_utc")).alias("ts"))


def event_hash(spark, sf):
    return _read(spark, sf, "log_entries").select("log_id", tx.event_hash(F.col("source_id"), F.col("message")).alias("log_hash"))


def point_id(spark, sf):
    return _read(spark, sf, "log_chunks").select("chunk_no", tx.point_id(F.col("chunk_id")).alias("point_id"))


_SECRETS = {
    "redact_jwt": (" token eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.sig-_9 end", slice(0, 1)),
    "redact_pwd": (" Server=db;Password = hunter2;pwd=abc end", slice(1, 2)),
    "redact_key": (" X-Api-Key: ABCDEFGHIJKLMNOP1 apikey=short end", slice(2, 3)),
    "redact_bearer": (" Authorization: bearer abcdefghijklmnopqrstuv.12 end", slice(3, 4)),
}
_SECRETS["redact_all"] = ("".join(s for s, _ in _SECRETS.values()), slice(0, 4))


def _redact(name):
    secret, rules = _SECRETS[name]
    return lambda spark, sf: _read(spark, sf, "documents").select("doc_id", tx.redact(F.concat(F.coalesce("text", F.lit("")), F.lit(secret)), tx.REDACTIONS[rules]).alias("text"))


def chunk_documents(spark, sf):
    docs = _scan(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2(F.col("text"), 256).alias("h"), tx.tokens(F.col("text")).alias("words"))
    cut = docs.select("doc_id", "h", F.explode(chunk.windows(F.col("words"), 64, 8)).alias("w"))
    return cut.select("doc_id", "w.chunk_index", chunk.chunk_id(F.col("h"), F.col("w.chunk_index")).alias("chunk_id"), F.array_join("w.words", " ").alias("text"))


# ---- parser tiers, on lines made of the events table


def _lines(spark, sf, *parts):
    e = _scan(spark, sf, "events", "event_id", "ts", "event_type", "user_id", "value").filter(F.col("event_type").isNotNull() & F.col("user_id").isNotNull() & F.col("value").isNotNull())
    raw = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return e.select("event_id", F.lit("ev").alias("source_id"), F.lit("app").alias("source_type"), raw.alias("raw_text"), F.lit(NOW).alias("ingested_at_utc"))


def _stamp():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _field(name):
    return F.try_element_at("fields", F.lit(name))


def csv_parse(spark, sf):
    lines = _lines(spark, sf, _stamp(), ",", F.col("event_type"), ", svc ,", F.col("user_id").cast("string"), ",paid, twice")
    return parse.parse(lines).select("event_id", "tier", _field("timestamp").alias("ts"), _field("severity").alias("severity"), _field("service_name").alias("service"), _field("trace_id").alias("trace"), "parsed_message")


def json_parse(spark, sf):
    lines = _lines(spark, sf, F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(', "MSG":"'), "event_type", F.lit('", "on":true, "none":null, "deep":{"a": 1.50}}')))
    return parse.parse(lines).select("event_id", "tier", _field("user").alias("user_text"), _field("on").alias("on_text"), _field("none").alias("none_text"), _field("deep").alias("deep"), "parsed_message")


def kv_parse(spark, sf):
    lines = _lines(spark, sf, "user=", F.col("user_id").cast("string"), ' kind="', F.col("event_type"), ' now" user=last')
    return parse.parse(lines).select("event_id", "tier", _field("user").alias("user_text"), _field("kind").alias("kind"), "parsed_message")


def ts_prefix_parse(spark, sf):
    lines = _lines(spark, sf, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " WARN: ", F.col("event_type"), " Correlation_ID: c-", F.col("user_id").cast("string"))
    return parse.parse(lines).select("event_id", "tier", _field("timestamp").alias("ts"), _field("severity").alias("severity"), _field("trace_id").alias("trace"), "parsed_message")


def regex_rule_parse(spark, sf):
    lines = _lines(spark, sf, "May  9 18:13:07 host1 svc[", F.col("user_id").cast("string"), "]: WARN ", F.col("event_type"))
    return parse.parse(lines).select("event_id", "tier", _field("service_name").alias("service"), _field("Correlation_ID").alias("trace"), _field("severity").alias("severity"), "parsed_message")


def payload_residual(spark, sf):
    lines = _lines(spark, sf, F.concat(F.lit('{"user_x":'), F.col("user_id").cast("string"), F.lit(', "level":"warn", "Entity":"E", "region":"'), "event_type", F.lit('"}')))
    out = normalize.normalize(parse.parse(lines).withColumn("source_id", F.col("event_id").cast("string")))
    return out.select(F.col("source_id").cast("bigint").alias("event_id"), "severity", F.to_json("payload").alias("payload"))


def normalize_lines(spark, sf):
    lines = _lines(spark, sf, F.concat(F.lit('{"ts":"'), F.date_format("ts", "yyyy-MM-dd HH: mm: ss"), F.lit('","level":"err","app":"cart","traceId":"t'), F.col("user_id").cast("string"), F.lit('","msg":"m","BRN":"null","IP":"1.2.3.4"}')))
    out = normalize.normalize(parse.parse(lines).withColumn("source_id", F.col("event_id").cast("string")))
    return out.select(F.col("source_id").cast("bigint").alias("event_id"), "timestamp_utc", "severity", "service_name", "trace_id", "correlation_id", "message", "brn", "ip")


def _raw_entries(spark, sf):
    """raw_logs with its times of ingestion as instants; NOW where the text denotes none."""
    raw = _scan(spark, sf, "raw_logs", "raw_id", "source_id", "source_type", "raw_text", "ingested_at_utc", "attributes")
    timed = normalize_timestamps(raw, _read(spark, sf, "sources"), "ingested_at_utc")
    return timed.select("raw_id", "source_id", "source_type", "raw_text", F.coalesce(F.timestamp_micros("utc_us"), F.lit(NOW)).alias("ingested_at_utc"), "attributes")


def parse_raw_logs(spark, sf):
    """Tiers of real lines."""
    parsed = parse.parse(parse.drop_noise(_raw_entries(spark, sf)))
    return parsed.select("raw_id", "tier", F.size("fields").alias("n_fields"), "parsed_message")


def ingest_raw_logs(spark, sf):
    """The whole pipeline, from raw entries to points."""
    return raw_to_points(_raw_entries(spark, sf)).select("point_id", "chunk_id", "log_hash", "timestamp_utc", "severity", "service_name", "text", F.size("vector").alias("dims"))


def chunk_log_entries(spark, sf):
    """Rendered, cut and redacted entries of the normalised table."""
    timed = normalize_timestamps(_read(spark, sf, "log_entries"), _read(spark, sf, "sources"), "timestamp_utc", "load_day")
    e = timed.withColumn("timestamp_utc", F.coalesce(F.timestamp_micros("utc_us"), F.lit(NOW)))
    return chunk.chunk(e, 16, 4).select("chunk_id", "chunk_index", "text")


# ---- store


def retention(spark, sf):
    return _read(spark, sf, "events").filter(F.col("ts") >= F.lit(FROM)).select("event_id", "ts")


def upsert_latest(spark, sf):
    e = _read(spark, sf, "events")
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("r", F.row_number().over(order)).filter("r = 1").select("user_id", "event_id", "ts")


def dedup_exact(spark, sf):
    docs = _read(spark, sf, "documents").filter(F.col("text").isNotNull())
    return docs.groupBy(F.sha2(F.col("text"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def ingest_counts(spark, sf):
    raw = _raw_entries(spark, sf)
    kept = parse.drop_noise(raw, ("callback was throttled",))
    a = raw.agg(F.count("*").alias("read"))
    return a.select("read", kept.agg(F.count("*")).scalar().alias("kept"))


# ---- sessions: threads of documents


def _messages(spark, sf):
    docs = _read(spark, sf, "documents").filter(F.col("thread_key").isNotNull())
    return docs.select(F.col("thread_key").alias("session_id"), F.col("doc_id").alias("seq"), F.coalesce("source", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))


def session_history(spark, sf):
    return chat.kept_messages(_messages(spark, sf)).select("session_id", "seq", "role")


def prompt_history(spark, sf):
    return chat.prompt_history(_messages(spark, sf), 8)


def _retrieved(spark, sf):
    """The chunks for the question, as retrieve_chunks finds them, with the day on which their entry was first loaded as their time."""
    chunks = _read(spark, sf, "log_chunks").select("chunk_id", "trace_id", "source_id", "source_type")
    points = _chunk_points(spark, sf).join(chunks, "chunk_id")
    first = _usable_vector(spark, sf)
    vector = list(first[0]) if first else [0.0]
    found = search.retrieve(points, QUESTION, vector, 8, QueryFilter(severity="info"), id_col="point_no")
    entries = _read(spark, sf, "log_entries").select("log_hash", "load_day").join(F.broadcast(found.select("log_hash")), "log_hash", "left_semi")
    loaded = entries.groupBy("log_hash").agg(F.min("load_day").cast("timestamp").alias("timestamp_utc"))  # of at most 8 hashes
    return found.join(F.broadcast(loaded), "log_hash", "left").withColumn("timestamp_utc", F.coalesce("timestamp_utc", F.lit(NOW)))


def context_build(spark, sf):
    return chat.context(_retrieved(spark, sf))


def citations(spark, sf):
    return chat.citations(_retrieved(spark, sf))


_ALL = (
    vector_topk, vector_topk_filtered, retrieve_dedup_rerank, retrieve_chunks, hybrid_rank, embed_documents, metadata_filter, severity_filter_unfolded,
    time_range, noise_filter, noise_filter_shipped, payload_defaults, event_start, lexical_overlap, severity_fold, timestamp_text, event_hash, point_id, chunk_documents, csv_parse, json_parse,
    kv_parse, ts_prefix_parse, regex_rule_parse, payload_residual, normalize_lines, parse_raw_logs, ingest_raw_logs, chunk_log_entries, retention,
    upsert_latest, dedup_exact, ingest_counts, session_history, prompt_history, context_build, citations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL} | {name: _redact(name) for name in _SECRETS}


_BLANKS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


def _overlap(x: str) -> str:
    words = "['refund','request','delayed','by','the','partner']"
    return f"(len(list_filter({words}, lambda w: contains(lower({x}), w))) / 6.0)"


#: The time of a chunk as text: the first load_day of its entry, or NOW.
ISO = "strftime(coalesce((SELECT min(load_day) FROM log_entries e WHERE e.log_hash = ranked.log_hash), DATE '2026-05-01'), '%Y-%m-%dT00:00:00.0000000+00:00')"
_LINES = "FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL"
_REDACT_SQL = (
    r"regexp_replace({}, 'eyJ[A-Za-z0-9_-]{{10,}}\.eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]+', '[REDACTED_JWT]', 'g')",
    r"regexp_replace({}, '(password|pwd)\s*=\s*[^;\x22\x27\s]+', '\1=[REDACTED]', 'gi')",
    r"regexp_replace({}, '(api[_-]?key|apikey|x-api-key)\s*[=:]\s*[A-Za-z0-9_\-]{{16,}}', '\1=[REDACTED_KEY]', 'gi')",
    r"regexp_replace({}, 'Bearer\s+[A-Za-z0-9_\-\.]{{20,}}', 'Bearer [REDACTED_TOKEN]', 'gi')",
)


def _redact_sql(name: str) -> str:
    secret, rules = _SECRETS[name]
    x = f"(coalesce(text, '') || '{secret}')"
    for rule in _REDACT_SQL[rules]:
        x = rule.format(x)
    return f"SELECT doc_id, {x} AS text FROM documents"


def retrieved_sql() -> str:
    """The chunks that retrieve_chunks finds, as ``ranked``."""
    return f"""
            WITH p AS MATERIALIZED (SELECT point_no, chunk_id, vector::DOUBLE[] AS v FROM vector_points WHERE len(vector) = 128 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x) OR isinf(x)))),
            u AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS n FROM p), w AS MATERIALIZED (SELECT * FROM u WHERE n > 0),
            q AS MATERIALIZED (SELECT v AS qv, n AS qn FROM w ORDER BY point_no LIMIT 1),
            found AS (SELECT w.point_no, c.*, list_dot_product(v, qv) / (sqrt(n) * sqrt(qn)) AS score FROM w JOIN log_chunks c ON w.chunk_id = c.chunk_id, q WHERE severity = 'INFO' ORDER BY score DESC, point_no LIMIT 24),
            best AS (SELECT *, 0.85 * score + 0.15 * {_overlap("coalesce(text, '')")} AS s FROM found QUALIFY row_number() OVER (PARTITION BY log_hash ORDER BY score DESC, point_no) = 1),
            ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY s DESC, score DESC, point_no) AS INTEGER) AS rank FROM best QUALIFY rank <= 8)"""


def oracle_sql() -> dict[str, str]:
    cosine = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)))"
    iso, retrieved = ISO, retrieved_sql()
    place = "CAST((('0x' || md5(w)[1:16])::UBIGINT // 2) % 768 AS INTEGER)"
    sign = "CASE WHEN ('0x' || md5(w)[1:16])::UBIGINT % 2 = 1 THEN 1 ELSE -1 END"
    hashed = rf"""
            WITH d AS (SELECT doc_id, text, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
            v AS (SELECT doc_id, {place} AS place, sum({sign}) AS x FROM d GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n, count(*) FILTER (WHERE x <> 0) AS n_set FROM v GROUP BY doc_id)"""
    return {
        "embed_documents": f"""{hashed}, top AS (SELECT doc_id, place, x FROM v WHERE x <> 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(x) DESC, place) = 1)
            SELECT doc_id, 768 AS dims, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS norm, CAST(coalesce(n_set, 0) AS INTEGER) AS n_set, place, CAST(sign(x) AS DOUBLE) AS sign
            FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN top USING (doc_id)""",
        "hybrid_rank": f"""{hashed}, q AS (SELECT unnest(string_split('{QUESTION}', ' ')) AS w), qv AS (SELECT {place} AS place, sum({sign}) AS y FROM q GROUP BY ALL),
            s AS (SELECT doc_id, sum(x * y) / (any_value(n) * (SELECT sqrt(sum(y * y)) FROM qv)) AS score FROM v JOIN n USING (doc_id) LEFT JOIN qv USING (place) WHERE n > 0 GROUP BY doc_id),
            found AS (SELECT doc_id, text, coalesce(score, 0) AS score FROM s JOIN documents USING (doc_id) ORDER BY coalesce(score, 0) DESC, doc_id LIMIT 24),
            best AS (SELECT *, 0.85 * score + 0.15 * {_overlap("coalesce(text, '')")} AS s FROM found QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, doc_id) = 1)
            SELECT CAST(row_number() OVER (ORDER BY s DESC, score DESC, doc_id) AS INTEGER) AS rank, doc_id, round(s, 4) AS rank_score FROM best QUALIFY rank <= 8""",
        "vector_topk": f"SELECT vec_id, round({cosine}, 6) AS score FROM embeddings ORDER BY {cosine} DESC, vec_id LIMIT 10",
        "vector_topk_filtered": f"""SELECT vec_id, label, round({cosine}, 6) AS score FROM embeddings
            WHERE label = (SELECT label FROM embeddings ORDER BY vec_id LIMIT 1) ORDER BY {cosine} DESC, vec_id LIMIT 10""",
        "retrieve_dedup_rerank": f"""
            WITH found AS (SELECT vec_id, label, text, {cosine} AS score FROM embeddings JOIN documents ON doc_id = vec_id ORDER BY score DESC, vec_id LIMIT 24),
            best AS (SELECT *, 0.85 * score + 0.15 * {_overlap("coalesce(text, '')")} AS s FROM found QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1)
            SELECT CAST(row_number() OVER (ORDER BY s DESC, score DESC, vec_id) AS INTEGER) AS rank, vec_id, label, round(s, 6) AS rank_score
            FROM best QUALIFY rank <= 8""",
        "retrieve_chunks": f"""{retrieved}
            SELECT rank, point_no, log_hash, round(s, 6) AS rank_score FROM ranked""",
        "metadata_filter": "SELECT log_id, service_name, severity, source_type FROM log_entries WHERE service_name = 'ledger' AND severity = 'ERROR' AND source_type = 'ledger'",
        "severity_filter_unfolded": "SELECT log_id, severity FROM log_entries WHERE severity = 'WARN'",
        "time_range": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-15'",
        "noise_filter": r"SELECT raw_id FROM raw_logs WHERE NOT coalesce(regexp_matches(raw_text, '(?i)start retry! thread:|callback was throttled|\[pid \d+\]'), false)",
        "noise_filter_shipped": rf"""WITH t AS (SELECT log_id, coalesce(message, '') || [{", ".join(f"'{x}'" for x in _NOISY)}][log_id % {len(_NOISY)} + 1] AS raw_text FROM log_entries WHERE log_id IS NOT NULL)
            SELECT log_id FROM t WHERE NOT regexp_matches(raw_text, '(?i){"|".join(NOISE)}')""",
        "payload_defaults": "SELECT log_id, " + ", ".join(f"coalesce({c}, '{v}') AS {c}" for c, v in search.DEFAULTS.items()) + ", brn, coalesce(load_day::TIMESTAMP, TIMESTAMP '2026-05-01') AS timestamp_utc FROM log_entries",
        "event_start": r"""SELECT raw_id, coalesce(regexp_matches(raw_text, '^(?:\d{4}-\d{2}-\d{2}[ T]\d{2}\s*:\s*\d{2}\s*:\s*\d{2}|[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b|\s*\{|\s*(?i:timestamp)=)'), false) AS starts FROM raw_logs""",
        "lexical_overlap": f"SELECT doc_id, round({_overlap("coalesce(text, '')")}, 6) AS overlap FROM documents",
        "severity_fold": f"SELECT log_id, CASE upper({_trim('severity')}) WHEN 'WARN' THEN 'WARNING' WHEN 'ERR' THEN 'ERROR' WHEN 'CRIT' THEN 'CRITICAL' ELSE upper({_trim('severity')}) END AS severity FROM log_entries",
        "timestamp_text": rf"""SELECT log_id, regexp_replace(regexp_replace(regexp_replace({_trim("timestamp_utc")}, '^\x22+|\x22+$', '', 'g'), '{_BLANKS}*:{_BLANKS}*', ':', 'g'), '{_BLANKS}+', ' ', 'g') AS ts FROM log_entries""",
        "event_hash": "SELECT log_id, sha256(source_id || '|' || message) AS log_hash FROM log_entries",
        "point_id": """WITH h AS (SELECT chunk_no, md5(chunk_id) AS m FROM log_chunks)
            SELECT chunk_no, m[7:8] || m[5:6] || m[3:4] || m[1:2] || '-' || m[11:12] || m[9:10] || '-' || m[15:16] || m[13:14] || '-' || m[17:20] || '-' || m[21:32] AS point_id FROM h""",
        "chunk_documents": f"""
            WITH t AS (SELECT doc_id, sha256(text) AS h, list_filter(list_transform(string_split(text, ' '), lambda x: {_trim("x")}), lambda x: x <> '') AS w FROM documents),
            c AS (SELECT doc_id, h, w, unnest(range(0, 1 + CAST(ceil(greatest(0, len(w) - 64) / 56.0) AS BIGINT))) AS k FROM t WHERE len(w) > 0)
            SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, h || '-' || lpad(CAST(k AS VARCHAR), CAST(greatest(4, len(CAST(k AS VARCHAR))) AS INTEGER), '0') AS chunk_id, array_to_string(w[k * 56 + 1 : k * 56 + 64], ' ') AS text FROM c""",
        "csv_parse": f"""SELECT event_id, 'commas' AS tier, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, event_type AS severity, 'svc' AS service, CAST(user_id AS VARCHAR) AS trace, 'paid, twice' AS parsed_message {_LINES}""",
        "json_parse": f"""SELECT event_id, 'json' AS tier, CAST(user_id AS VARCHAR) AS user_text, 'true' AS on_text, 'null' AS none_text, '{{"a": 1.50}}' AS deep, event_type AS parsed_message {_LINES}""",
        "kv_parse": f"""SELECT event_id, 'pairs' AS tier, 'last' AS user_text, event_type || ' now' AS kind, 'user=' || user_id || ' kind="' || event_type || ' now" user=last' AS parsed_message {_LINES}""",
        "ts_prefix_parse": f"""SELECT event_id, 'stamped_text' AS tier, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'WARN' AS severity, 'c-' || user_id AS trace, event_type || ' Correlation_ID: c-' || user_id AS parsed_message {_LINES}""",
        "regex_rule_parse": f"""SELECT event_id, 'rule:syslog-like' AS tier, 'svc' AS service, CAST(user_id AS VARCHAR) AS trace, 'WARN' AS severity, event_type AS parsed_message {_LINES}""",
        "payload_residual": f"""SELECT event_id, 'WARNING' AS severity, '{{"user_x":"' || user_id || '","region":"' || event_type || '"}}' AS payload {_LINES}""",
        "normalize_lines": f"""SELECT event_id, date_trunc('second', ts) AS timestamp_utc, 'ERROR' AS severity, 'cart' AS service_name, 't' || user_id AS trace_id, 't' || user_id AS correlation_id, 'm' AS message, CAST(NULL AS VARCHAR) AS brn, '1.2.3.4' AS ip {_LINES}""",
        "retention": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-08'",
        "upsert_latest": "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "dedup_exact": "SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text",
        "ingest_counts": "SELECT count(*) AS read, count(*) FILTER (WHERE NOT coalesce(regexp_matches(raw_text, '(?i)callback was throttled'), false)) AS kept FROM raw_logs",
        "session_history": "SELECT thread_key AS session_id, doc_id AS seq, coalesce(source, 'user') AS role FROM documents WHERE thread_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY thread_key ORDER BY doc_id DESC) <= 32",
        "prompt_history": """
            WITH m AS (SELECT thread_key AS session_id, doc_id, '[' || upper(coalesce(source, 'user')) || '] ' || coalesce(text, '') AS line FROM documents
              WHERE thread_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY thread_key ORDER BY doc_id DESC) <= 8)
            SELECT session_id, trim(string_agg(line, chr(10) ORDER BY doc_id), ' ') AS history FROM m GROUP BY session_id""",
        "context_build": f"""{retrieved}
            SELECT string_agg('[' || rank || '] ts=' || {iso} || ' severity=' || severity || ' service=' || service_name || ' trace=' || trace_id || ' source=' || source_id || '/' || source_type || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY rank) AS context FROM ranked""",
        "citations": f"{retrieved} SELECT rank AS id, {iso} AS timestamp, severity, service_name, trace_id, source_id FROM ranked",
        **{name: _redact_sql(name) for name in _SECRETS},
    }
