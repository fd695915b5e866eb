import json

from logloom.operators import drift
from pyspark.sql import functions as F

SCHEMA = "record_id bigint, series_id bigint, file_no int, line_no int, fields map<string,string>, payload string"


def rows_of(files, typed=True, series=1):
    out = []
    for file_no, records in files.items():
        for k, r in enumerate(records):
            out.append((len(out) + 1, series, file_no, k, None if typed else r, json.dumps(r) if typed else None))
    return out


def changes(spark, files, typed=True):
    df = spark.createDataFrame(rows_of(files, typed), SCHEMA)
    return sorted(tuple(r)[1:] for r in drift.schema_changes(drift.file_schemas(df)).collect())


def test_added_removed_renamed_retyped(spark):
    one = [{"ms": 100 + k, "ratio": 0.5 + k / 100, "sn": f"SN{k:04}", "gone": "x/y"} for k in range(20)]
    two = [{"elapsed": 120 + k, "ratio": str(0.5 + k / 100) + " u", "serial": f"SN{k + 50:04}", "new": k * 1_000_000} for k in range(20)]
    assert changes(spark, {1: one, 2: two}) == [
        (2, "added", "new", ""), (2, "removed", "gone", ""), (2, "renamed", "ms", "elapsed"), (2, "renamed", "sn", "serial"), (2, "retyped", "ratio", ""),
    ]


def test_range_and_sign_part_names(spark):
    one = [{"a": k + 1} for k in range(20)]
    assert changes(spark, {1: one, 2: [{"b": -k - 1} for k in range(20)]}) == [(2, "added", "b", ""), (2, "removed", "a", "")]
    assert changes(spark, {1: one, 2: [{"b": (k + 1) * 100} for k in range(20)]}) == [(2, "added", "b", ""), (2, "removed", "a", "")]


def test_junk_and_nulls_change_nothing(spark):
    good = [{"a": k, "b": None} for k in range(20)]
    assert changes(spark, {1: good, 2: good[:-1] + [{"a": "??", "b": 1}]}) == []


def test_text_maps_and_gaps(spark):
    one, two = [{"retry": "true"}] * 10, [{"retry": "yes"}] * 10
    assert changes(spark, {1: one, 2: two}, typed=False) == [(2, "retyped", "retry", "")]
    assert changes(spark, {1: one, 3: two}, typed=False) == []


def test_changes_across_a_missing_file(spark):
    rows = rows_of({1: [{"ms": k} for k in range(20)], 4: [{"took": k + 1} for k in range(20)], 5: [{"took": k + 0.5} for k in range(20)]})
    schemas = drift.file_schemas(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r)[1:] for r in drift.schema_changes(schemas).collect()] == [(5, "retyped", "took", "")]
    assert [tuple(r)[1:] for r in drift.schema_changes(schemas, True).collect()] == [(4, "renamed", "ms", "took")]
    types = drift.union_schema(schemas, drift.current_names(schemas, drift.schema_changes(schemas, None))).collect()
    assert [(r["field"], r["type"]) for r in types] == [("took", "decimal")]


def test_values_that_no_double_or_encoding_holds(spark):
    huge, endless = "9" * 400, "7" * 6000
    payloads = [f'{{"n": {huge}, "t": "cut \\ud83d", "o": {{"deep": "\\udc00"}}}}', f'{{"n": {endless}, "t": "whole \\ud83d\\ude00", "\\ud83d": 1e999}}', '{"a":' * 2000 + "1" + "}" * 2000]
    rows = [(k, 1, 1, k, None, p) for k, p in enumerate(payloads)] + [(9, 1, 2, 1, {"n": huge, "x": "1" * 400 + "." + "5"}, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    schemas = drift.file_schemas(df)
    kinds = {(r["field"], r["kind"]) for r in schemas.filter("file_no = 1").collect()}
    assert {("n", "integer"), ("t", "string"), ("o", "object"), ("\ufffd", "decimal"), ("a", "object")} <= kinds
    names = drift.current_names(schemas, drift.schema_changes(schemas, None))
    out = {r["record_id"]: r["values"] for r in drift.cast_records(df, names, drift.union_schema(schemas, names)).collect()}
    assert out[0]["t"] == "cut \ufffd" and out[1]["t"] == "whole \U0001f600" and out[1]["n"] == endless


def test_forms_of_whole_texts():
    long = "ab " * 500
    assert drift.describe_text(long)[0] != drift.describe_text(long + "7")[0]
    names = {f"field_{k}": 1 for k in range(100)}
    assert drift.describe(names, True)[1] != drift.describe({**names, "other": 1}, True)[1]


def test_odd_records(spark):
    rows = [(1, 1, 1, 1, None, None), (2, 1, 1, 2, None, "[1]"), (3, 1, 1, 3, None, "no json"), (4, None, None, None, {"a": None}, None), (5, 1, 2, 1, None, '{"a": 1}'), (5, 1, 2, 1, None, '{"a": 1}')]
    df = spark.createDataFrame(rows, SCHEMA)
    assert drift.schema_changes(drift.file_schemas(df)).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(drift.file_schemas(empty)).count() == 0


def test_union_table(spark):
    one = [{"ms": k, "flag": True} for k in range(20)]
    two = [{"took": k + 0.5, "flag": False} for k in range(20)]
    three = [{"took": k + 0.5, "flag": "??" if k == 3 else True} for k in range(20)]
    df = spark.createDataFrame(rows_of({1: [{"took": k} for k in range(20)], 2: two, 3: three}) + rows_of({1: one, 2: [{"elapsed": k, "flag": True} for k in range(20)]}, series=2), SCHEMA)
    schemas = drift.file_schemas(df)
    names = drift.current_names(schemas, drift.schema_changes(schemas))
    types = {(r["series_id"], r["field"]): r["type"] for r in drift.union_schema(schemas, names).collect()}
    assert types == {(1, "took"): "decimal", (1, "flag"): "boolean", (2, "elapsed"): "integer", (2, "flag"): "boolean"}
    out = drift.cast_records(df, names, drift.union_schema(schemas, names)).collect()
    assert len(out) == 100
    junk = [r for r in out if r["rescued"]]
    assert len(junk) == 1 and junk[0]["values"]["flag"] is None and junk[0]["rescued"] == {"flag": "??"}
    assert all("ms" not in r["values"] for r in out)


def test_lattice():
    assert drift.promote("integer", "decimal") == "decimal"
    assert drift.promote("boolean", "integer") == "string"
    assert drift.promote(None, "object") == "object"


def test_lattice_of_columns_is_the_same(spark):
    kinds = [None, "integer", "decimal", "boolean", "string", "object", "array"]
    df = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "a string, b string")
    for r in df.withColumn("both", drift.promoted(F.col("a"), F.col("b"))).collect():
        assert r["both"] == drift.promote(r["a"], r["b"])
