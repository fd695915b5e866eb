"""Problem 1: times in many formats, precisions and zones become one UTC instant each.

Every text is tokenised into a character-class shape mask (digits ``9``, letters ``A``, the rest as it stands).
Each distinct mask is mapped to a parser once, a list of byte slices; all texts of a mask are then converted
together by numpy, and local times go through versioned zone transition tables.

Defined results: null, empty, blank or senseless texts give a null instant (zero dates and counts, and
whatever lies outside YEARS, are senseless), as do texts whose zone,
date order or year would have to be guessed (unknown zone abbreviation or time zone name, slashes without a
date order, no year without a load day). A leap second (``:60`` at the end of a minute of 59) is the first second after
it, ``24:00:00`` the end of its day. A zone name in brackets or parentheses behind an offset shifts nothing. An
abbreviation stands for what it stood for in its zone at that time. Texts of any length are read. Repeated rows are converted alike;
empty tables give empty results.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import zones

#: Texts are padded to the widths of their classes, which grow fourfold from this.
WIDTH = 48
#: Instants before the first or from the second year on are senseless.
YEARS = (1971, 2100)
US = 1_000_000
DAY = 86_400 * US

# English, German and Spanish month names by their first three letters.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mai": 5, "okt": 10, "dez": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}

_TIME = r"(?P<h>9{1,2}): ?(?P<mi>99)(?:: ?(?P<s>99)(?:[.,](?P<f>9{1,12}))?)?"
_ZONE = r"(?: ?(?P<ap>AA)(?!A))?(?: ?\(?(?P<z>A|A{3,5})\)?(?!A))?(?: ?(?P<sign>[+-])(?P<oh>99)(?::?(?P<om>99))?(?: ?\([A ]+\)|\[[A/_+-]+\])?)?"
_COUNT = r"(?P<c>9{9,20})(?:\.(?P<cf>9{1,9}))?"
#: Shapes, over masks. n1 and n2 are day and month in the source's order.
SHAPES = [
    re.compile(x)
    for x in (
        rf"(?P<y>9{{4}})[-/.](?P<mo>99)[-/.](?P<d>99)(?:(?P<t>A)|[ _]){_TIME}{_ZONE}",
        rf"(?P<y>9999)(?P<mo>99)(?P<d>99)(?:(?P<t>A)|[ _])?(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,](?P<f>9{{1,12}}))?{_ZONE}",
        rf"(?P<n1>9{{1,2}})/(?P<n2>9{{1,2}})/(?P<y>9{{4}}),? {_TIME}{_ZONE}",
        rf"(?P<d>9{{1,2}})\.(?P<mo>9{{1,2}})\.(?P<y>9{{4}}),? {_TIME}{_ZONE}",
        rf"(?P<d>9{{1,2}})[/-](?P<mon>A{{3,9}})[/-](?P<y>9{{4}})[: ]{_TIME}{_ZONE}",
        rf"(?:A{{2,9}},? )?(?P<d>9{{1,2}})\.? (?P<mon>A{{3,9}}) (?P<y>9{{4}}),? {_TIME}{_ZONE}",
        rf"(?:A{{2,9}},? )?(?P<mon>A{{3,9}}) +(?P<d>9{{1,2}}),? (?P<y>9{{4}}),? {_TIME}{_ZONE}",
        rf"(?P<mon>A{{3}}) {{1,2}}(?P<d>9{{1,2}}) {_TIME}{_ZONE}",
        rf"(?P<y>9{{4}})-(?P<doy>999)(?:(?P<t>A)|[ _]){_TIME}{_ZONE}",
        rf"(?P<y>9{{4}})-(?P<w>A)(?P<week>99)-(?P<wd>9)(?:(?P<t>A)|[ _]){_TIME}{_ZONE}",
        _COUNT,
        rf"[^A9]*+(?:A++ ?)*+\({_COUNT}(?:[+-]9{{2}}:?9{{2}})?\)[^A9]*+",
    )
]

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("0") : ord("9") + 1] = ord("9")
for _a, _b in (("A", "Z"), ("a", "z")):
    _CLASS[ord(_a) : ord(_b) + 1] = ord("A")
_CLASS[ord("\t")] = ord(" ")


@functools.lru_cache(maxsize=16_384)
def parser_for(mask: str) -> dict[str, tuple[int, int]] | None:
    """The byte slices of the parts of all texts with this mask; None if no shape fits."""
    for shape in SHAPES:
        if m := shape.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


_EDGES = "\"'“”„«»"


def _ascii(text: str) -> str:
    """With ASCII digits, letters without accents and plain blanks; '' if it can't be a time."""
    text = "".join(str(int(c)) if c.isdecimal() else " " if c.isspace() else c for c in text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text if text.isascii() else ""


def _plain(texts) -> list[str]:
    """The texts without surrounding blanks and quotes, in ASCII; '' for what can't be a time."""
    out = [x.strip().strip(_EDGES).strip() if isinstance(x, str) else "" for x in texts]
    odd = {x for x in out if not x.isascii() or "\0" in x}
    if odd:
        good = {x: "" if "\0" in x else _ascii(x) for x in odd}  # each distinct one once
        out = [good.get(x, x) for x in out]
    return out


def _number(digits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(digits), np.int64)
    for k in range(digits.shape[1]):
        out = out * 10 + (digits[:, k] - 48)
    return out


def _words(letters: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel()


def _lookup(letters: np.ndarray, table: dict[str, int]) -> np.ndarray:
    """Numbers for words, 0 for unknown ones."""
    words, back = np.unique(_words(letters), return_inverse=True)
    return np.array([table.get(w.decode().lower(), 0) for w in words], np.int64)[back]


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of Gregorian dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def year_start(year: int) -> int:
    """Microseconds since 1970 of the first instant of a year."""
    return int(_days(np.array([year]), np.array([1]), np.array([1]))[0]) * DAY


def _leap(y: np.ndarray) -> np.ndarray:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def _latest_year(m: np.ndarray, d: np.ndarray, load_days: np.ndarray) -> np.ndarray:
    """The latest year that puts the date not after the load day (days since 1970)."""
    loaded = load_days.astype("datetime64[D]")
    year = loaded.astype("datetime64[Y]").astype(np.int64) + 1970
    year = year - (_days(year, m, d) > load_days)
    for _ in range(8):
        year = np.where((m == 2) & (d == 29) & ~_leap(year), year - 1, year)
    return year


def _month_day(days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Year, month and day of days since 1970."""
    at = days.astype("datetime64[D]")
    year, month = at.astype("datetime64[Y]"), at.astype("datetime64[M]")
    return year.astype(np.int64) + 1970, (month - year).astype(np.int64) + 1, (at - month).astype(np.int64) + 1


def _of_year(year: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Month and day of a day of the year, and whether there is one."""
    _, month, day = _month_day(_days(year, np.ones_like(year), np.ones_like(year)) + number - 1)
    return month, day, (number >= 1) & (number <= 365 + _leap(year))


def _of_week(year: np.ndarray, week: np.ndarray, weekday: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Year, month and day of a weekday (1: Monday) of a week of ISO 8601, and whether there is one."""
    fourth = _days(year, np.ones_like(year), np.full_like(year, 4))
    days = fourth - (fourth + 3) % 7 + (week - 1) * 7 + weekday - 1
    own = _month_day(days - weekday + 4)[0]  # the year that the week's Thursday lies in
    return *_month_day(days), (week >= 1) & (weekday >= 1) & (weekday <= 7) & (own == year)


_LENGTHS = np.array([0, 31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31, 0, 0, 0])


def to_utc_us(texts, zone_names, date_orders, load_days, tables: Mapping[str, zones.ZoneTable] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 UTC of each text, and whether it denotes an instant.

    zone_names and date_orders are those of each text's source, load_days the days since 1970 (negative
    before; the smallest int64 where there is none). Without ``tables`` they are made here.
    """
    plain = _plain(texts)
    zone_names, date_orders = np.asarray(zone_names, object), np.asarray(date_orders, object)
    sizes = np.array([len(x) for x in plain], np.int64)
    out, good = np.zeros(len(plain), np.int64), np.zeros(len(plain), bool)
    width, low = WIDTH, 0
    while low < sizes.max(initial=0):
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        if len(rows):
            raw = np.array([plain[k] for k in rows], f"S{width}")
            out[rows], good[rows] = _class_to_utc(raw, zone_names[rows], date_orders[rows], load_days[rows], zones.table if tables is None else tables.get)
        low, width = width, width * 4
    return out, good


def _class_to_utc(raw: np.ndarray, zone_names: np.ndarray, date_orders: np.ndarray, load_days: np.ndarray, table_of) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts of one width."""
    n, width = len(raw), raw.dtype.itemsize
    chars = raw.view(np.uint8).reshape(n, width)
    masks, group = np.unique(_CLASS[chars].view(f"S{width}").ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(masks)))
    out, good, local = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    for k, mask in enumerate(masks):
        at = parser_for(mask.decode("ascii")) if mask else None
        if at is None:
            continue
        rows = order[ends[k - 1] if k else 0 : ends[k]]
        block = chars[rows]
        part = {x: _number(block[:, a:b]) for x, (a, b) in at.items() if x not in ("ap", "z", "sign", "t", "mon", "f", "cf", "c", "w")}
        if "c" in at:
            a, b = at["c"]
            size = b - a
            if size > 18:  # nanoseconds: the digits after the sixth decimal are cut off
                value = _number(block[:, a : b - 3])
            else:
                value = _number(block[:, a:b])
                value = value * US if size <= 11 else value * 1000 if size <= 14 else value if size <= 17 else value // 1000
            if "cf" in at and size <= 11:
                a, b = at["cf"]
                value += _number(block[:, a : min(b, a + 6)]) * 10 ** max(0, 6 - (b - a))
            out[rows], good[rows] = value, True
            continue
        ok = np.ones(len(rows), bool)
        zero = np.zeros(len(rows), np.int64)
        if "t" in at:
            a, b = at["t"]
            ok &= (block[:, a] | 32) == ord("t")
        if "doy" in at:
            month, part["d"], sure = _of_year(part["y"], part["doy"])
            ok &= sure
        elif "week" in at:
            part["y"], month, part["d"], sure = _of_week(part["y"], part["week"], part["wd"])
            ok &= sure & ((block[:, at["w"][0]] | 32) == ord("w"))
        elif "mon" in at:
            a, b = at["mon"]
            month = _lookup(block[:, a : min(b, a + 3)], MONTHS)
        elif "n1" in at:
            orders = date_orders[rows]
            first_is_day = orders == "DMY"
            ok &= first_is_day | (orders == "MDY")
            month = np.where(first_is_day, part["n2"], part["n1"])
            part["d"] = np.where(first_is_day, part["n1"], part["n2"])
        else:
            month = part["mo"]
        day, hour, minute, second = part["d"], part["h"], part["mi"], part.get("s", zero)
        if "ap" in at:
            a, b = at["ap"]
            mark = _lookup(block[:, a:b], {"am": 1, "pm": 2})
            ok &= (mark > 0) & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + 12 * (mark == 2)
        if "y" in at:
            year = part["y"]
        else:
            loaded = load_days[rows]
            ok &= loaded > -(1 << 40)
            year = _latest_year(np.clip(month, 1, 12), day, np.where(ok, loaded, 0))
        midnight = (hour == 24) & (minute == 0) & (second == 0)
        ok &= (month >= 1) & (month <= 12) & (day >= 1) & ((hour < 24) | midnight) & (minute < 60) & ((second < 60) | (second == 60) & (minute == 59))
        ok &= day <= np.where((month == 2) & ~_leap(year), 28, _LENGTHS[np.clip(month, 0, 12)])
        us = _days(year, month, day) * DAY + ((hour * 60 + minute) * 60 + second) * US
        if "f" in at:
            a, b = at["f"]
            us = us + _number(block[:, a : min(b, a + 6)]) * 10 ** max(0, 6 - (b - a))
        if "sign" in at:
            a, _ = at["sign"]
            offset = part["oh"] * 60 + part.get("om", zero)
            ok &= (offset <= 15 * 60) & (part.get("om", zero) < 60)
            us = us - np.where(block[:, a] == ord("-"), -1, 1) * offset * 60 * US
            if "z" in at:  # GMT+02:00: the offset counts, if the word stands for UTC
                a, b = at["z"]
                ok &= _lookup(block[:, a:b], {x.lower(): 1 for x in zones.UNIVERSAL}) == 1
        elif "z" in at:
            a, b = at["z"]
            codes, pairs = pd.MultiIndex.from_arrays([zone_names[rows], _words(block[:, a:b])]).factorize(use_na_sentinel=False)
            for c, (zone_name, word) in enumerate(pairs):
                own, word = np.flatnonzero(codes == c), word.decode().upper()
                zone = table_of(zone_name) if isinstance(zone_name, str) else None
                found = us[own] if word in zones.UNIVERSAL else zone.by_abbreviation(us[own], word) if zone else None
                ok[own] &= found is not None
                us[own] = us[own] if found is None else found
        else:
            local[rows] = True
        out[rows], good[rows] = us, ok
    pending = np.flatnonzero(local & good)
    if len(pending):
        codes, names = pd.factorize(zone_names[pending], use_na_sentinel=False)
        for k, name in enumerate(names):
            rows = pending[codes == k]
            if (zone := table_of(name) if isinstance(name, str) else None) is None:
                good[rows] = False
            else:
                out[rows] = zone.to_utc(out[rows])
    return out, good


def utc_us(text: Column, zone: Column, date_order: Column, load_day: Column | None = None, tables=None) -> Column:
    """The instant of ``text`` in microseconds since 1970 UTC, null if it denotes none. ``tables``: a broadcast of
    zone tables by name, as shared_tables() gives it; without it each worker makes its own."""

    @F.pandas_udf(T.LongType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        first, end = (year_start(y) for y in YEARS)
        own = None if tables is None else tables.value
        for texts, names, orders, loaded in parts:
            days = loaded.fillna(-(1 << 62)).astype(np.int64).to_numpy()
            us, ok = to_utc_us(texts.tolist(), names.to_numpy(), orders.to_numpy(), days, own)
            yield pd.Series(us).astype("Int64").mask(~ok | (us < first) | (us >= end))

    days = F.lit(None).cast("bigint") if load_day is None else F.unix_date(load_day).cast("bigint")
    return run(text, zone, date_order, days)


def shared_tables(sources: DataFrame):
    """A broadcast of the tables of all zones that the sources name: no more than the zone database has, some 600."""
    listed = sources.select("time_zone").filter(F.col("time_zone").isin(*sorted(zones.names()))).distinct().collect()
    return sources.sparkSession.sparkContext.broadcast({r["time_zone"]: zones.table(r["time_zone"]) for r in listed})


def normalize_timestamps(entries: DataFrame, sources: DataFrame, text: str, load_day: str | None = None, tables=None) -> DataFrame:
    """``entries`` with ``utc_us``, the instant of column ``text`` by the zone and date order of its source.

    ``sources`` (one row a source) is joined by ``source_id``; its size decides how. Rows of unknown or null
    sources stay, only texts with their own zone get an instant there. A column ``utc_us`` is replaced.
    """
    taken = {c.lower() for c in entries.columns}
    source, zone, order = (next(n for k in range(len(taken) + 1) if (n := f"_{c}{k}") not in taken) for c in ("source", "zone", "order"))
    own = sources.select(F.col("source_id").alias(source), F.col("time_zone").alias(zone), F.col("date_order").alias(order))
    joined = entries.join(own, F.col("source_id") == F.col(source), "left")
    us = utc_us(F.col(text), F.col(zone), F.col(order), F.col(load_day) if load_day else None, tables or shared_tables(sources))
    return joined.withColumn("utc_us", us).drop(source, zone, order)


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    """All times of log_entries and raw_logs: record_kind, record_id, the text, its UTC instant and zone table version."""
    sources = spark.read.parquet(f"{sf}/sources.parquet")
    tables = shared_tables(sources)
    entries = spark.read.parquet(f"{sf}/log_entries.parquet").select("log_id", "source_id", "timestamp_utc", "load_day")
    raw = spark.read.parquet(f"{sf}/raw_logs.parquet").select("raw_id", "source_id", "ingested_at_utc")
    one = normalize_timestamps(entries, sources, "timestamp_utc", "load_day", tables).select(
        F.lit("entry").alias("record_kind"), F.col("log_id").alias("record_id"), F.col("timestamp_utc").alias("text"), "utc_us"
    )
    two = normalize_timestamps(raw, sources, "ingested_at_utc", tables=tables).select(
        F.lit("raw").alias("record_kind"), F.col("raw_id").alias("record_id"), F.col("ingested_at_utc").alias("text"), "utc_us"
    )
    return one.unionByName(two).withColumn("instant", F.timestamp_micros("utc_us")).withColumn("zone_tables", F.lit(zones.version()))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each text that denotes one instant in 2025 or 2026."""
    first, end = year_start(2025), year_start(2027)
    return normalized(spark, sf).filter((F.col("utc_us") >= first) & (F.col("utc_us") < end)).select("record_kind", "record_id", "utc_us")
