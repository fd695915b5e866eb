"""Problem 4: schemas that drift between the files of a series.

The schema of each file (its fields with counts by type, form and range of values) is read in parallel, split by
split, and summed. Neighbouring files of a series are compared and the differences logged in order; types are
folded through a promotion lattice into one union schema, and all records are cast to it.

Defined results: a record whose field map and payload are both null, or whose payload isn't a JSON object, has no
fields but stays in the table. A field whose non-null values have no type in nine tenths of them has no type: it
is never ``retyped`` or ``renamed``. Repeated rows count as often as they occur, which changes no result. A file
is compared with the one of the number before it; the first has no changes. After a missing file the changes against the last file there is
are reported apart (``p4_gaps``), and the union schema follows renames across it. Half
characters in escapes are read as replacement characters. An integer beyond the range of doubles is an integer without
a range. Records without series or file number are in the table but in no schema. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.jsontext import Digits, whole, without_halves
from logloom.functions.storage import materialize, spread

#: A type holds for a file if at least this share of the non-null values has it.
DOMINANT = 0.9
#: A name goes on under another one if this share of the forms agrees and means differ by less than this factor.
FORM_SHARE, RANGE_FACTOR = 0.6, 3.0
#: Forms are told apart by so many leading parts, and by what kinds of parts the rest has, which bounds their number.
FORM_PARTS = 6
#: Names of an object's fields up to so many characters stand in its form as they are, more as a digest of all.
NAMES_SHOWN = 64

# The promotion lattice: integer < decimal < string; boolean, object and array < string.
PROMOTE = {("integer", "decimal"): "decimal", ("decimal", "integer"): "decimal"}

_STATS = "series_id bigint, file_no int, field string, kind string, form string, n bigint, numbers bigint, total double, low double, high double, letters bigint"

_INTEGER = re.compile(r"[+-]?\d+")
_DECIMAL = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+(?:\.\d*)?[eE][+-]?\d+)")
_LEADING = re.compile(r"([+-]?\d+(?:\.\d+)?)(?: ?[A-Za-z%]{1,3})?")
_PARTS = re.compile(r"[^\W_]+|\W|_")


def promote(a: str | None, b: str | None) -> str | None:
    """The least type that holds both."""
    if a is None or b is None or a == b:
        return a or b
    return PROMOTE.get((a, b), "string")


def promoted(a: Column, b: Column) -> Column:
    """promote() of columns, from the same lattice."""
    out = F.when(a.isNull() | (a == b), b).when(b.isNull(), a)
    for (x, y), least in PROMOTE.items():
        out = out.when((a == x) & (b == y), least)
    return out.otherwise("string")


@functools.lru_cache(maxsize=262_144)
def describe_text(text: str) -> tuple[str, float | None]:
    """The form of a text (runs of letters a, digits 9, both w; the rest as it stands) and its number, if it has one."""
    if m := _LEADING.fullmatch(text):
        return ("9u" if text[-1].isalpha() or text[-1] == "%" else "9"), _number(m[1])
    out: list[str] = []
    rest: set[str] = set()
    for m in _PARTS.finditer(text):
        part = m[0]
        kind = part if not part.isalnum() else "9" if part.isdigit() else "a" if part.isalpha() else "w"
        if len(out) >= FORM_PARTS:
            rest.add(kind if kind in "a9w" or kind.isspace() else ".")
        elif not out or out[-1] != kind:
            out.append(kind)
    return "".join(out) + ("\0" + "".join(sorted(" " if x.isspace() else x for x in rest)) if rest else ""), None


def kind_of_text(text: str) -> str:
    """integer, decimal, boolean or string, of a value in a map of texts."""
    if _INTEGER.fullmatch(text):
        return "integer"
    if _DECIMAL.fullmatch(text):
        return "decimal"
    return "boolean" if text.lower() in ("true", "false") else "string"


def _number(value: int | float | str) -> float | None:
    """As a double; None beyond their range."""
    try:
        number = float(value)
    except OverflowError:
        return None
    return number if math.isfinite(number) else None


def describe(value: object, typed: bool) -> tuple[str, str, float | None, int]:
    """Kind, form, number and length of a non-null value; typed: of JSON, else a text."""
    if isinstance(value, Digits):
        return "integer", "", None, 0
    if typed and not isinstance(value, str):
        if isinstance(value, bool):
            return "boolean", "", None, 0
        if isinstance(value, int):
            return "integer", "", _number(value), 0
        if isinstance(value, float):
            return "decimal", "", _number(value), 0
        if isinstance(value, dict):
            inner = next((x for x in value.values() if isinstance(x, str)), "")
            names = ",".join(sorted(value))
            names = names if len(names) <= NAMES_SHOWN else hashlib.md5(names.encode("utf-8", "replace")).hexdigest()
            return "object", names + ":" + describe_text(inner)[0], None, 0
        inner = next((x for x in value if isinstance(x, str)), "") if isinstance(value, list) else ""
        return "array", "[" + describe_text(inner)[0], None, 0
    kind = "string" if typed else kind_of_text(value)
    if kind in ("integer", "decimal"):
        return kind, "", _number(value), 0
    if kind == "boolean":
        return kind, "", None, 0
    form, number = describe_text(value)
    return kind, form, number, len(value)


def parse_payload(text: str | None) -> dict:
    """The fields of a JSON object; none of anything else. The last of repeated keys wins."""
    try:
        found = json.loads(without_halves(text), parse_int=whole) if text else {}
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple[str, object]], bool]]:
    columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("series_id", "file_no", "fields", "payload")]
    for series, file_no, fields, payload in zip(*columns):
        if series is None or file_no is None:
            continue
        if payload is not None:
            yield series, file_no, list(parse_payload(payload).items()), True
        elif fields is not None:
            yield series, file_no, fields, False


def _partial_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one split: at most one row for each file, field, kind and form in it."""
    sums: dict[tuple, list] = {}

    def flush() -> pa.RecordBatch:
        keys, values = list(sums), list(sums.values())
        columns = [list(x) for x in zip(*keys)] + [list(x) for x in zip(*values)]
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        names = [x.split()[0] for x in _STATS.split(", ")]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        for series, file_no, fields, typed in _rows(batch):
            for name, value in fields:
                if value is None:
                    kind, form, number, length = "null", "", None, 0
                else:
                    kind, form, number, length = describe(value, typed)
                s = sums.get(key := (series, file_no, name, kind, form))
                if s is None:
                    s = sums[key] = [0, 0, 0.0, None, None, 0]
                s[0] += 1
                s[5] += length
                if number is not None:
                    s[1] += 1
                    s[2] += number
                    s[3] = number if s[3] is None or number < s[3] else s[3]
                    s[4] = number if s[4] is None or number > s[4] else s[4]
        if len(sums) > 200_000:
            yield flush()
    if sums:
        yield flush()


def file_schemas(records: DataFrame) -> DataFrame:
    """One row for each file, field, kind and form of values, with counts and ranges."""
    keys = ["series_id", "file_no", "field", "kind", "form"]
    parts = records.select("series_id", "file_no", "fields", "payload").mapInArrow(_partial_stats, _STATS)
    return parts.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("n", "numbers", "total", "letters")), F.min("low").alias("low"), F.max("high").alias("high")
    )


class FieldSchema:
    """What one file says of one field."""

    def __init__(self) -> None:
        self.kinds: dict[str, int] = defaultdict(int)
        self.forms: dict[tuple[str, str], list[float]] = {}

    def add(self, kind: str, form: str, n: int, numbers: int, total: float, letters: int) -> None:
        self.kinds[kind] += n
        self.forms[kind, form] = [n, numbers, total, letters]

    @property
    def kind(self) -> str | None:
        values = {k: n for k, n in self.kinds.items() if k != "null"}
        best = max(values, key=lambda k: (values[k], k), default=None)
        return best if best and values[best] >= DOMINANT * sum(values.values()) else None

    def profile(self) -> tuple[dict[str, float], float | None, float]:
        """Of the values of the field's kind: shares of forms, mean number, mean length."""
        own = {f: x for (k, f), x in self.forms.items() if k == self.kind}
        n = sum(x[0] for x in own.values())
        numbers = sum(x[1] for x in own.values())
        mean = sum(x[2] for x in own.values()) / numbers if numbers > 0.5 * n else None
        return {f: x[0] / n for f, x in own.items()}, mean, sum(x[3] for x in own.values()) / n


def likeness(old: FieldSchema, new: FieldSchema) -> float | None:
    """How well the values of one field go on in another; None if they don't."""
    if old.kind is None or old.kind != new.kind:
        return None
    forms_a, mean_a, length_a = old.profile()
    forms_b, mean_b, length_b = new.profile()
    shared = sum(min(x, forms_b.get(f, 0)) for f, x in forms_a.items())
    if shared < FORM_SHARE or (mean_a is None) != (mean_b is None):
        return None
    score = shared
    for a, b in ((mean_a, mean_b), (length_a or None, length_b or None)):
        if a is not None and b is not None:
            small, large = sorted((abs(a), abs(b)))
            if a * b < 0 or large > RANGE_FACTOR * small:
                return None
            score += small / large if large else 1
    return score


def changes_between(before: dict[str, FieldSchema], after: dict[str, FieldSchema]) -> list[tuple[str, str, str]]:
    """(change_kind, field_name, new_name) of each difference, ordered."""
    gone, come = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
    pairs = [(-s, a, b) for a in gone for b in come if (s := likeness(before[a], after[b])) is not None]
    renamed: dict[str, str] = {}
    for _, a, b in sorted(pairs):
        if a not in renamed and b not in renamed.values():
            renamed[a] = b
    out = [("renamed", a, b) for a, b in renamed.items()]
    out += [("removed", a, "") for a in gone if a not in renamed]
    out += [("added", b, "") for b in come if b not in renamed.values()]
    for name in before.keys() & after.keys():
        a, b = before[name].kind, after[name].kind
        if a and b and a != b:
            out.append(("retyped", name, ""))
    return sorted(out)


_CHANGE = "series_id bigint, file_no bigint, change_kind string, field_name string, new_name string"


def _compare(group: pa.Table) -> pa.Table:
    """The changes of one file: the schemas of it and its predecessor, a few rows whatever the number of records."""
    sides: dict[bool, dict[str, FieldSchema]] = {True: defaultdict(FieldSchema), False: defaultdict(FieldSchema)}
    columns = [group.column(c).to_pylist() for c in ("own", "field", "kind", "form", "n", "numbers", "total", "letters")]
    for own, field, *values in zip(*columns):
        sides[own][field].add(*values)
    rows = changes_between(sides[False], sides[True]) if sides[False] and sides[True] else []
    series, file_no = group.column("series_id")[0].as_py(), group.column("at")[0].as_py()
    arrays = [pa.array([series] * len(rows), pa.int64()), pa.array([file_no] * len(rows), pa.int64())]
    arrays += [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
    return pa.table(arrays, [x.split()[0] for x in _CHANGE.split(", ")])


def _following(schemas: DataFrame) -> DataFrame:
    """series_id, file_no, at: the next file of the series that there is."""
    files = schemas.select("series_id", "file_no").distinct()
    return files.withColumn("at", F.lead("file_no").over(W.partitionBy("series_id").orderBy("file_no")).cast("bigint")).filter("at is not null")


def schema_changes(schemas: DataFrame, gaps: bool | None = False) -> DataFrame:
    """One row for each change of a file against the file before it in its series. gaps: whether the number before is
    missing, and the last file there is stands for it; None for both kinds."""
    columns = ["series_id", "field", "kind", "form", "n", "numbers", "total", "letters"]
    following = _following(schemas)
    if gaps is not None:
        following = following.filter((F.col("at") > F.col("file_no") + 1) == F.lit(gaps))
    own = schemas.select(*columns, F.col("file_no").cast("bigint").alias("at"), F.lit(True).alias("own"))
    before = schemas.join(following, ["series_id", "file_no"]).select(*columns, "at", F.lit(False).alias("own"))
    return own.unionByName(before).groupBy("series_id", "at").applyInArrow(_compare, _CHANGE)


_NAMES = "series_id bigint, file_no int, names map<string,string>"


def _resolve(group: pd.DataFrame) -> pd.DataFrame:
    """For each file of a series, the last name that each of its fields goes by. Reads renames and field lists only."""
    renames: dict[int, dict[str, str]] = defaultdict(dict)
    files: dict[int, list[str]] = {}
    for r in group.itertuples(index=False):
        if r.new_name is not None:
            renames[r.file_no][r.field] = r.new_name
        else:
            files.setdefault(r.file_no, []).append(r.field)
    later: dict[str, str] = {}
    rows = []
    for file_no in sorted(files, reverse=True):
        rows.append((group["series_id"].iloc[0], file_no, {f: later.get(f, f) for f in files[file_no]}))
        step = {old: later.get(new, new) for old, new in renames[file_no].items()}
        later = {**{k: v for k, v in later.items() if k not in step}, **step}
    return pd.DataFrame(rows, columns=["series_id", "file_no", "names"])


def current_names(schemas: DataFrame, changes: DataFrame) -> DataFrame:
    """One row a file: a map from its field names to the names they go by in the end."""
    none = F.lit(None).cast("string")
    fields = schemas.select("series_id", "file_no", "field", none.alias("new_name")).distinct()
    renames = changes.filter("change_kind = 'renamed'").select("series_id", F.col("file_no").cast("int").alias("file_no"), F.col("field_name").alias("field"), "new_name")
    return fields.unionByName(renames).groupBy("series_id").applyInPandas(_resolve, _NAMES)


def union_schema(schemas: DataFrame, names: DataFrame) -> DataFrame:
    """series_id, field, type: the least type of the lattice that holds the field's type in every file."""
    values = schemas.filter("kind <> 'null'").groupBy("series_id", "file_no", "field", "kind").agg(F.sum("n").alias("n"))
    per_file = values.groupBy("series_id", "file_no", "field").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), (F.max("n") >= DOMINANT * F.sum("n")).alias("sure"))
    named = per_file.join(names, ["series_id", "file_no"]).withColumn("field", F.coalesce(F.element_at("names", F.col("field")), "field"))
    kinds = named.groupBy("series_id", "field").agg(F.array_sort(F.collect_set(F.when(F.col("sure"), F.col("kind")).otherwise("string"))).alias("kinds"))
    least = F.aggregate("kinds", F.lit(None).cast("string"), promoted)  # at most one element a type
    return kinds.select("series_id", "field", least.alias("type"))


_RECORD = "record_id bigint, series_id bigint, file_no int, line_no int, values map<string,string>, rescued map<string,string>"


def _text(value: object, typed: bool) -> str | None:
    return value if value is None or type(value) is str else str(value) if isinstance(value, Digits) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "series_id", "file_no", "line_no")}
        names = batch.column(batch.schema.get_field_index("names")).to_pylist()
        types = batch.column(batch.schema.get_field_index("types")).to_pylist()
        fields, payloads = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("fields", "payload"))
        values, rescued = [], []
        for own, kinds, pairs, payload in zip(names, types, fields, payloads):
            own, kinds = dict(own or []), dict(kinds or [])
            typed = payload is not None
            good: dict[str, str | None] = {}
            bad: dict[str, str | None] = {}
            for name, value in parse_payload(payload).items() if typed else pairs or []:
                target = own.get(name, name)
                want, text = kinds.get(target, "string"), _text(value, typed)
                have = None if value is None else describe(value, typed)[0]
                fits = have is None or want == "string" or promote(have, want) == want
                (good if fits else bad)[target] = text
                if not fits:
                    good[target] = None
            values.append(list(good.items()))
            rescued.append(list(bad.items()))
        kind = pa.map_(pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([cols["record_id"], cols["series_id"], cols["file_no"], cols["line_no"], pa.array(values, kind), pa.array(rescued, kind)], [x.split()[0] for x in _RECORD.split(", ")])


def cast_records(records: DataFrame, names: DataFrame, types: DataFrame) -> DataFrame:
    """Every record with its values under the fields' last names, in the union types; what doesn't fit is in ``rescued``."""
    by_series = types.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "type"))).alias("types"))
    plan = names.join(by_series, "series_id", "left")
    own = records.select("record_id", "series_id", "file_no", "line_no", "fields", "payload")
    return own.join(plan, ["series_id", "file_no"], "left").mapInArrow(_cast, _RECORD)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/parsed_logs.parquet").select("record_id", "series_id", "file_no", "line_no", "fields", "payload"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each change of a file's schema against the file before it."""
    return schema_changes(materialize(file_schemas(_records(spark, sf)), "schemas"))  # read three times


def p4_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The union schema of each series."""
    schemas = materialize(file_schemas(_records(spark, sf)), "schemas")
    return union_schema(schemas, current_names(schemas, schema_changes(schemas, None)))


def p4_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The changes of files whose number before is missing, against the last file there is, ``previous_file_no``."""
    schemas = materialize(file_schemas(_records(spark, sf)), "schemas")
    previous = _following(schemas).select("series_id", F.col("at").alias("file_no"), F.col("file_no").alias("previous_file_no"))
    return schema_changes(schemas, True).join(previous, ["series_id", "file_no"])


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    """One consistent table of all records."""
    records = _records(spark, sf)
    schemas = materialize(file_schemas(records), "schemas")
    names = materialize(current_names(schemas, schema_changes(schemas, None)), "names")
    return cast_records(records, names, union_schema(schemas, names))
