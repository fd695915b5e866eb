import hashlib

import pytest

from logloom.operators import loglines as L

CASES = [
    ("2025-11-04T01:09:54.662Z err   [worker-3] Gate.Router: charge rejected", ("2025-11-04T01:09:54.662Z", "ERROR", "Gate.Router", "charge rejected")),
    ("2025-10-16T16:26:31+02:00 [\x1b[34mWRN\x1b[0m] Notify.Outbox - posting <lane 3 & more>", ("2025-10-16T16:26:31+02:00", "WARNING", "Notify.Outbox", "posting <lane 3 & more>")),
    ("2025-10-01 12:30:43,219 Information: fund-finder[7]\r\n      callback timed out \r\n   at X()", ("2025-10-01 12:30:43,219", "INFO", "fund-finder", "callback timed out\n   at X()")),
    ("I1001 02:15:07.555792   5308 RateTable:17] voucher lookup failed", ("1001 02:15:07.555792", "INFO", "RateTable", "voucher lookup failed")),
    ("F1001 02:15:07.555792   5308 RateTable:17] x", ("1001 02:15:07.555792", "CRITICAL", "RateTable", "x")),
    ("[01/Oct/2025:07:51:18 +0300] [Gate.Router:warning] [pid 5340] refund delayed", ("01/Oct/2025:07:51:18 +0300", "WARNING", "Gate.Router", "refund delayed")),
    ("Oct  1 15:06:29 node11 ledger-sync[6258]: info limit review needs review", ("Oct  1 15:06:29", "INFO", "ledger-sync", "limit review needs review")),
    ("Oct 11 15:06:29 node11 ledger-sync[6258]: limit review needs review", ("Oct 11 15:06:29", "INFO", "ledger-sync", "limit review needs review")),
    ("DBG | 2025-10-01T02:18:36.910Z | ledger-sync | pin | lane 6", ("2025-10-01T02:18:36.910Z", "DEBUG", "ledger-sync", "pin | lane 6")),
    ("Info|2025-10-18 00:18:46,624|fund-finder|fee", ("2025-10-18 00:18:46,624", "INFO", "fund-finder", "fee")),
    ("2025-10-01 06:59:52.336,crit,ledger-sync,7ms3cf,top up, retry 2, queue 5", ("2025-10-01 06:59:52.336", "CRITICAL", "ledger-sync", "top up, retry 2, queue 5")),
    ("2025-10-26 20:40:41, INFO, fund-finder, 070074, limit review", ("2025-10-26 20:40:41", "INFO", "fund-finder", "limit review")),
    ("2025-10-26 20:40:41,INFO,fund-finder,-,limit review", ("2025-10-26 20:40:41", "INFO", "fund-finder", "limit review")),
    ("2025-10-26 20:40:41,,fund-finder,,limit review", ("2025-10-26 20:40:41", "INFO", "fund-finder", "limit review")),
    ('ts="2025-10-02 15: 28: 01.414" severity=info application=login-broker text="a \\"b\\"\\n c" trace_id=1', ("2025-10-02 15: 28: 01.414", "INFO", "login-broker", 'a "b"\n c')),
    ('{"time": "30.11.2025 23:15:48", "app": "charge_flow", "text": "top <lane> \\u00e9\\n  x ", "trace_id": "2cn5dk"}', ("30.11.2025 23:15:48", "INFO", "charge_flow", "top <lane> é\n  x")),
    ('{\r\n  "level": "Warn",\r\n  "msg": "m",\r\n  "service": "s",\r\n  "@timestamp": "T"\r\n}', ("T", "WARNING", "s", "m")),
    ('<entry ts="03.10.2025 11:44:15" lvl="INFO" src="ledger-sync">a &lt;b&gt; &amp; c\r\ninner -&gt; d</entry>', ("03.10.2025 11:44:15", "INFO", "ledger-sync", "a <b> & c\ninner -> d")),
]


@pytest.mark.parametrize("text,want", CASES)
def test_layouts(text, want):
    assert L.parse_entry(text) == want


@pytest.mark.parametrize("line", ["", "   at Foo()", "    > 2026-01-05 10:05:00 ERROR nested quote", "Caused by: x", "state: open=1 held=2", "... 3 more", "}", "# log opened", "=== new file ===", "--- end of inner trace ---", '  "time": "x",'])
def test_lines_that_continue(line):
    assert L.head(line)[0] is None


def raw(spark, rows):
    return spark.createDataFrame(rows, "raw_id bigint, raw_text string, attributes map<string,string>")


def test_entries_over_rows_and_copies(spark):
    a = lambda at, path="f": {"path": path, "start_offset": str(at)}
    rows = [
        (9, "# log opened", a(0)), (8, "Oct  1 15:06:29 n s[1]: info one", a(20)), (7, "  more", a(60)), (6, "  more", a(60)), (12, "Oct  1 15:06:29 n s[1]: info one", a(20)),
        (3, "{", a(100)), (4, '  "msg": "two",', a(102)), (5, '  "ts": "T"', a(120)), (1, "}", a(130)),
        (20, None, a(0, "g")), (None, "Oct  1 15:06:29 n s[1]: info no id", a(5000)), (21, "Oct  1 15:06:29 n s[1]: info x\nOct  1 15:06:30 n s[1]: error y", None), (22, "", a(0, "h")), (23, "orphan", {"path": "k", "start_offset": "no"}),
    ]
    got = sorted((r["raw_id"], r["severity"], r["message"]) for r in L.parse_logs(raw(spark, rows)).collect())
    assert got == [(3, "INFO", "two"), (8, "INFO", "one\n  more"), (21, "ERROR", "y"), (21, "INFO", "x")]


def test_entries_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 50)
    rows = [(1, "Oct  1 15:06:29 n s[1]: info one", {"path": "f", "start_offset": "0"})]
    rows += [(k, f"  line {k}", {"path": "f", "start_offset": str(40 * k)}) for k in range(2, 30)]
    got = L.parse_logs(raw(spark, rows)).collect()
    assert len(got) == 1 and got[0]["message"] == "one\n" + "\n".join(f"  line {k}" for k in range(2, 30))
    assert got[0]["message_md5"] == hashlib.md5(got[0]["message"].encode()).hexdigest()


def test_empty(spark):
    assert L.parse_logs(raw(spark, [])).count() == 0


def test_similar_heads_merge():
    tree = L.TemplateTree()
    one, two, far = (("<ts>", " ", "<word>", *rest) for rest in (("x", "a"), ("x", "b"), ("y", "c")))
    tree.add(one, 3, [0] * 5, [0] * 5)
    tree.add(two, 2, [0] * 5, [0] * 5)
    assert tree.find(one) is tree.find(two) and tree.find(one).tokens[-1] == "<*>" and tree.find(one).n == 5
    assert tree.find(("<word>", " ", "<ts>", "x", "a")) is None and tree.find(far) is tree.find(one)
    for k in range(100):
        tree.add(("<ts>", " ", f"{k}a", f"{k}b", f"{k}c"), 1, [0] * 5, [0] * 5)
    assert len(tree.leaves[tree.route(one)]) <= L.LEAF_AT_MOST


def lines_of(spark, files):
    """Raw rows, one a line, of files by path."""
    rows = []
    for path, lines in files.items():
        for k, line in enumerate(lines):
            rows.append((len(rows) + 1, line, {"path": path, "start_offset": str(100 * k)}))
    return raw(spark, rows)


def entries(spark, files):
    return [(r["path"], r["ts_text"], r["severity"], r["component"], r["message"]) for r in L.parse_logs(lines_of(spark, files)).orderBy("path", "raw_id").collect()]


WORDS = ["charge ok", "refund late", "limit near 3", "callback lost twice", "session ended", "quota used up", "posting done"]


def test_files_of_unlisted_layouts_are_read_by_learned_templates(spark):
    at = [f"2025-10-01 10:00:{k:02}" for k in range(7)]
    files = {
        "access": [f'10.0.{k}.{k} - - [01/Oct/2025:10:00:0{k} +0000] "GET /{w}" 200 {k}' for k, w in enumerate(WORDS)],
        "epoch": [f"17593128{k}0.125 WARN gate: {w}" for k, w in enumerate(WORDS)],
        "named": [f"router {t} ERROR {w}" for t, w in zip(at, WORDS)],
        "bare": [f"{t} ledger {w}" for t, w in zip(at, WORDS)],
        "levels": [f"INFO gate: {w}" for w in WORDS],
    }
    got = entries(spark, files)
    want = [("access", f"01/Oct/2025:10:00:0{k} +0000", "INFO", None, f'"GET /{w}" 200 {k}') for k, w in enumerate(WORDS)]
    want += [("bare", t, "INFO", "ledger", w) for t, w in zip(at, WORDS)]
    want += [("epoch", f"17593128{k}0.125", "WARNING", "gate", w) for k, w in enumerate(WORDS)]
    want += [("levels", None, "INFO", "gate", w) for w in WORDS]
    want += [("named", t, "ERROR", "router", w) for t, w in zip(at, WORDS)]
    assert got == want


def test_the_tree_decides_by_the_corpus(spark):
    """The same line begins an entry in files of its layout and continues one in files of another."""
    line = "retry 2025-10-01 10:00:09 ERROR gave up"
    own = [f"retry 2025-10-01 10:00:0{k} ERROR {w}" for k, w in enumerate(WORDS)]
    other = ["2025-10-01T10:00:00Z err [w-1] Gate: failed", line, "  at X"]
    assert entries(spark, {"a": [*own, line]})[-1] == ("a", "2025-10-01 10:00:09", "ERROR", "retry", "gave up")
    assert entries(spark, {"b": other}) == [("b", "2025-10-01T10:00:00Z", "ERROR", "Gate", f"failed\n{line}\n  at X")]
    both = entries(spark, {"a": [*own, line], "b": other})
    assert len(both) == 9 and both[-1][4] == f"failed\n{line}\n  at X"


def test_rare_places_of_a_time_are_no_layout(spark):
    lines = [x for k in range(30) for x in (f"app-{k % 2} | 2025-10-01 10:00:{k:02} | {WORDS[k % 7]}", "  at X")] + ["we saw this last at 2025-10-01 10:00:00 too"]
    got = entries(spark, {"f": lines})
    assert len(got) == 30 and got[-1][4].endswith("at X\nwe saw this last at 2025-10-01 10:00:00 too")


def test_protocol_lines(spark):
    assert L.parse_entry("<34>1 2003-10-11T22:14:15.003Z mymachine su - ID47 - failed for lonvick") == ("2003-10-11T22:14:15.003Z", "CRITICAL", "su", "failed for lonvick")
    assert L.parse_entry("<165>1 2003-10-11T22:14:15.003Z host evntslog 77 ID47 [a@1 b=\"c\"] done")[:3] == ("2003-10-11T22:14:15.003Z", "INFO", "evntslog")


def test_half_characters_in_escapes(spark):
    (found,) = entries(spark, {"f": ['{"ts":"T\\ud83d","level":"warn","msg":"cut \\ud83d","app":"\\udc00x"}']})
    assert found == ("f", "T\ufffd", "WARNING", "\ufffdx", "cut \ufffd")


def test_a_row_delivered_very_often(spark):
    rows = [(100 + k, "Oct  1 15:06:29 n s[1]: info one", {"path": "f", "start_offset": "0"}) for k in range(3000)] + [(7, "  more", {"path": "f", "start_offset": "40"})]
    df = raw(spark, rows)
    got = L.parse_logs(df).collect()
    assert [(r["raw_id"], r["message"]) for r in got] == [(100, "one\n  more")]


def test_texts_are_shuffled_once(spark):
    plan = L.parse_logs(raw(spark, [(1, "x", {"path": "f"})]))._jdf.queryExecution().optimizedPlan().toString()
    assert "raw_text" not in plan  # read from what the one pass over sorted stretches has stored


@pytest.mark.parametrize(
    "text,want",
    [
        ("2025-10-01 10:00:00 INFO app: message", ("2025-10-01 10:00:00", "INFO", "app", "message")),
        ("2025-10-01 10:00:00,123 - pay.core - WARNING - [3] slow: 5", ("2025-10-01 10:00:00,123", "WARNING", "pay.core", "[3] slow: 5")),
        ("2025-10-01T10:00:00Z ERROR [main] a.b.Pay - lost\n  at X", ("2025-10-01T10:00:00Z", "ERROR", "a.b.Pay", "lost\n  at X")),
        ("[2025-10-01 10:00:00] [error] disk full", ("2025-10-01 10:00:00", "ERROR", None, "disk full")),
        ("ERROR 2025-10-01 10:00:00 disk full", ("2025-10-01 10:00:00", "ERROR", None, "disk full")),
        ("2025-10-01 10:00:00 started", ("2025-10-01 10:00:00", "INFO", None, "started")),
    ],
)
def test_unlisted_layouts_are_entries(text, want):
    assert L.parse_entry(text) == want


@pytest.mark.parametrize("line", ["2025-10-01 10:00:00", "# 2025-10-01 10:00:00 log opened", "since 2025-10-01 10:00:00 down", "--- 2025-10-01 10:00:00 ---", "3 at 2025-10-01 10:00:00 INFO x"])
def test_lines_with_times_that_continue(line):
    assert L.head(line)[0] is None


def test_names_after_a_long_value():
    long = "x" * 5000
    assert L.parse_entry(f'text="{long}" ts=T level=warn') == ("T", "WARNING", None, long)
    assert L.parse_entry(f'<entry note="{long}" ts="T" lvl="ERROR">m</entry>') == ("T", "ERROR", None, "m")
    assert L.head(f"a={long} b={'y' * 500_000} {'z' * 500_000}")[0] is None
