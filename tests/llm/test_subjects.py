import random

from logloom.llm import subjects as s

WORDS = {
    "law": ("the statute clause", "was signed by counsel", "the auditor", "must be kept for years"),
    "sport": ("the goal keeper", "scored twice before half time", "the away team", "won the final match"),
    "music": ("the violin section", "played the slow movement", "the choir", "sang without notes"),
}
FILL = ("thanks to everyone who helped", "see note 12 for the earlier case", "this has nothing to do with the auditor", "this has nothing to do with the choir", "this has nothing to do with the keeper")


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, truth = [], {}
    for k in range(n):
        own = rng.sample(sorted(WORDS), rng.choice((1, 1, 2)))
        lines = []
        for _ in range(rng.randint(4, 12)):
            a = WORDS[rng.choice(own)]
            lines.append(f"{a[rng.choice((0, 2))]} {a[rng.choice((1, 3))]} {rng.randint(1, 99)}" if rng.random() < 0.8 else rng.choice(FILL))
        body = ". ".join(lines) + "." if k % 2 else "\n".join(f"{i}. {x}" for i, x in enumerate(lines, 1))
        docs.append((k, body, "svc", "src"))
        counts = {w: sum(any(p in x for p in (WORDS[w][0], WORDS[w][2])) and "nothing" not in x for x in lines) for w in own}
        truth[k] = {w for w, c in counts.items() if c >= len(lines) / 4}
    return docs, truth


def test_sentences():
    assert [x for _, x in s.sentences("One two. Three 4.5 four! Five;\n\nsix")] == ["One two.", "Three 4.5 four!", "Five;", "six"]
    assert s.sentences("2025-12-04 21:45:17.194 WARNING Notify.Outbox: See note\n12. A b.\n- c\nbot: d") == [("Notify.Outbox", "See note"), ("", "A b."), ("", "c"), ("bot", "d")]
    assert s.sentences(None) == [] and s.sentences(" \n \n--\n") == []


def test_held_out_accuracy():
    docs, truth = corpus(400)
    model = s.fit(docs[:300], {k: truth[k] for k in range(60)}, sorted(WORDS))
    hits = misses = 0
    for d in docs[300:]:
        got = {w for w, (k, n) in s.subject_shares(model, *d[1:]).items() if k >= n / 4}
        hits += len(got & truth[d[0]])
        misses += len(got ^ truth[d[0]])
    assert hits / (hits + misses) > 0.9


def test_operator(spark):
    docs, truth = corpus(120, 5)
    rows = docs + [(900, None, None, None), (901, "", "x", None), (902, " \n ", None, "y"), (903, docs[0][1] * 500, None, None), (None, docs[0][1], None, None), (0, *docs[0][1:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, service_name string, source string")
    labels = [(k, w) for k in range(40) for w in sorted(truth[k])] + [(None, "law"), (3, None), (7777, "law"), (5, "unknown")]
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string")
    subs = spark.createDataFrame([(w,) for w in sorted(WORDS)] + [(None,)], "subject string")
    got = {}
    for r in s.document_subjects(df, lab, subs).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert not {900, 901, 902} & set(got) and got[0] == got[903]
    assert sum(got.get(k, set()) == truth[k] for k in range(120)) > 105
    assert s.document_subjects(df, lab.limit(0), subs).count() == 0
    assert s.document_subjects(df.limit(0), lab, subs).count() == 0


def test_every_document_without_labels_teaches(spark):
    """Words that only few of many documents without labels have, next to known ones, and labels of what comes late in a text."""
    docs, truth = corpus(60, 9)
    plain = [(10_000 + k, f"see note {k} for the earlier case. thanks to everyone who helped {k}.", "svc", "src") for k in range(4000)]
    rare = [(100_000 + k, "the violin section zimbelwerk ostinato. the choir sang zimbelwerk ostinato.", "svc", "src") for k in range(6)]
    late = (200_000, "see note 12 for the earlier case. " * 600 + "the goal keeper quaddlepitch scored. " * 900, "svc", "src")
    rows = docs + plain + rare + [late, (300_000, "zimbelwerk ostinato", "svc", "src"), (300_001, "quaddlepitch", "svc", "src")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, service_name string, source string")
    lab = spark.createDataFrame([(k, w) for k in range(40) for w in sorted(truth[k])] + [(200_000, "sport")], "doc_id bigint, subject string")
    subs = spark.createDataFrame([(w,) for w in sorted(WORDS)], "subject string")
    got = {(r["doc_id"], r["subject"]) for r in s.document_subjects(df, lab, subs).filter("doc_id >= 300000").collect()}
    assert got == {(300_000, "music"), (300_001, "sport")}


def test_batches_are_classified_like_single_texts(spark):
    docs, truth = corpus(80, 3)
    rows = docs + [(500, "Gate.Router: the violin section sang without notes\n2026-01-01 10:00:00 INFO x.y: the auditor was signed by counsel", None, None), (501, "the choir\0sang without notes.", "svc", "src"), (502, "--", "", ""), (503, None, "a", "b")]
    model = s.fit(docs[:60], {k: truth[k] for k in range(40)}, sorted(WORDS))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, service_name string, source string")
    got = {(r["doc_id"], r["subject"]): (r["n_sentences"], r["n_all"]) for r in s.sentence_subjects(s.cut_documents(df), model).collect()}
    want = {(d, w): x for d, text, service, source in rows for w, x in s.subject_shares(model, text.replace("\0", " ") if text else text, service, source).items()}
    assert got == want and {d for d, _ in got} >= {500, 501}
