"""Parsed entries to the fixed schema. Clocks are columns or arguments, so the result depends on the input only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom import schemas
from logloom.functions.jsontext import array_items, as_text, object_items, parse
from logloom.functions.text import event_hash, first_non_blank, fold_severity, non_blank, trim, trim_quotes

# The names of each column's field, by priority.
TIMESTAMP = ("timestamp", "ts", "@timestamp", "time", "date", "logdate", "logtime")
SEVERITY = ("severity", "level", "loglevel")
SERVICE = ("service_name", "service", "application", "app")
TRACE = ("trace_id", "traceid", "correlation_id", "correlationid", "request_id")
MESSAGE = ("message", "msg", "log", "text", "messagebody")
# Fields with columns of their own, and those that are kept out of the payload besides.
OWN = {
    "correlation_id": "correlationid", "module": "module", "method": "method", "log_source": "source", "destination": "destination",
    "brn": "brn", "billing_account": "billingaccount", "denomination_id": "denominationid", "ip": "ip",
}
DROPPED = ("accountid", "entity", "statuscode", "extradata")
PROMOTED = (*TIMESTAMP, *SEVERITY, *SERVICE, *TRACE, *MESSAGE, *OWN.values(), *DROPPED)

# Times that are read besides ISO forms, and their shapes.
FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm:ss a"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}$", "d MMM yyyy HH:mm:ss"),
)


def timestamp_text(c: Column) -> Column:
    """Without quotes, blanks around colons and repeated blanks."""
    return F.regexp_replace(F.regexp_replace(trim_quotes(trim(c)), r"(?U)\s*:\s*", ":"), r"(?U)\s+", " ")


def parse_timestamp(c: Column, ingested: Column) -> Column:
    """The instant of a text; without a zone it is UTC, without a year that of ingestion, else the time of ingestion.

    The session's zone must be UTC.
    """
    text = trim(timestamp_text(c))  # blanks around are allowed
    isolike = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?$")
    iso = F.when(isolike, F.regexp_replace(F.regexp_replace(text, r" (?=Z|[+-]\d{2}:?\d{2}$)", ""), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    rfc = F.when(
        text.rlike(r"^[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT$"),
        F.try_to_timestamp(F.regexp_extract(text, r"^\w+, (.*) GMT$", 1), F.lit("d MMM yyyy HH:mm:ss")),
    )
    others = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))) for shape, form in FORMATS]
    dated = F.concat(F.date_format(ingested, "yyyy "), text)
    syslog = F.when(text.rlike(r"^[A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss")))
    return F.coalesce(iso, rfc, *others, syslog, ingested)


def find_account(value: object, written: str) -> str | None:
    """The Value of the first object, depth first, whose Key is AccountId."""
    if isinstance(value, dict):
        items = object_items(written)
        found = {k: (v, w) for k, v, w in items}
        if value.get("Key") == "AccountId" and "Value" in found:
            return as_text(*found["Value"], "null")
        children = [(v, w) for _, v, w in items]
    elif isinstance(value, list):
        children = array_items(written)
    else:
        return None
    for v, w in children:
        if (account := find_account(v, w)) is not None:
            return account
    return None


def status_of(message: str) -> int | None:
    """The whole number StatusCode of a message that is a JSON object."""
    try:
        for name, value, _ in reversed(object_items(message)):
            if name == "StatusCode":
                return value if isinstance(value, int) and not isinstance(value, bool) and -(2**31) <= value < 2**31 else None
    except ValueError:
        pass
    return None


@F.pandas_udf(T.StructType([T.StructField("account_id", T.StringType()), T.StructField("status_code", T.IntegerType())]))
def _probe(extra: pd.Series, message: pd.Series) -> pd.DataFrame:
    accounts, codes = [], []
    for e, m in zip(extra, message):
        account = None
        if e is not None:
            try:
                account = find_account(parse(e), e)
            except ValueError:
                pass
        accounts.append(account)
        codes.append(status_of(m) if m is not None else None)
    return pd.DataFrame({"account_id": pd.Series(accounts, dtype=object), "status_code": pd.array(codes, dtype="Int32")})


def residual(fields: Column) -> Column:
    """The fields without a column of their own."""
    return F.map_filter(fields, lambda k, _: ~F.lower(k).isin(*PROMOTED))


def normalize(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed entries in the normalised schema; columns in ``keep`` stay beside it."""
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    low = parsed.withColumn("_low", F.transform_keys(fields, lambda k, _: F.lower(k)))
    f = F.col("_low")

    def value(name: str) -> Column:
        x = F.try_element_at(f, F.lit(name))
        return F.when(x != "null", non_blank(x))

    message = F.coalesce(first_non_blank(f, MESSAGE), F.col("parsed_message"))
    extra = value("extradata")
    like_json = F.regexp_like(message, F.lit(r"^\s*\{"))
    probed = low.withColumn("_message", message).withColumn("_probe", _probe(extra, F.when(like_json, message)))
    trace = F.coalesce(first_non_blank(f, TRACE), F.lit("n/a"))
    own = {c: value(k) for c, k in OWN.items()}
    own["correlation_id"] = F.coalesce(own["correlation_id"], trace)
    for c in ("module", "method", "log_source", "destination"):
        own[c] = F.coalesce(own[c], F.lit(""))
    out = probed.select(
        *keep,
        "source_id", "source_type",
        parse_timestamp(first_non_blank(f, TIMESTAMP), F.col("ingested_at_utc")).alias("timestamp_utc"),
        fold_severity(F.coalesce(first_non_blank(f, SEVERITY), F.lit("INFO"))).alias("severity"),
        F.coalesce(first_non_blank(f, SERVICE), "source_id").alias("service_name"),
        trace.alias("trace_id"), F.col("_message").alias("message"),
        event_hash(F.col("source_id"), F.col("raw_text")).alias("log_hash"),
        residual(fields).alias("payload"),
        *(c.alias(n) for n, c in own.items()),
        F.col("_probe.account_id").alias("account_id"), F.col("_probe.status_code").alias("status_code"),
    )
    return out.select(*schemas.names(schemas.NORMALIZED), *keep)
