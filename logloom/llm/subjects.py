"""Problem 10: the subjects of each document.

Documents are cut into sentences (lines, if they are lists, chats or logs). Labelling functions vote on each
sentence: a lexicon of words, the section it opens like (first words), how it ends, the address it names (component or
service) and the source of its document. A latent model learns without sentence labels how accurate each function is
for each class, by expectation maximisation over the patterns of votes; one class beside the subjects is that of
sentences about none, such as passing mentions. Sentences get the class of highest posterior probability, and a document
the subjects that at least a quarter of its sentences have.

Texts are cut once and stored as the masked sentences of each document; every pass encodes those of a batch as a dictionary and looks at each
distinct sentence once, whatever its number of occurrences.

The functions are fitted on at most FIT_LABELLED labelled documents, those of smallest hash, and on all other
documents without theirs: their words, openings, endings, addresses and sources by class and their patterns of votes are summed
up by tasks, TURNS times, from beliefs that are rounded so that the same tables give the same model in whatever order
they are summed. A label only narrows the classes that a document's sentences may have at first, since labels can be
wrong or missing.

Defined results: null, empty and blank texts and those without id have no subject, nor have texts whose sentences the functions say nothing
of. Repeated documents get the same subjects. Very long texts are read whole. Labels with null document or subject, of
unknown documents or of subjects not in the table are ignored. Without any labels no document gets a subject. Empty
tables give empty results.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.storage import materialize, spread

#: Most labelled documents that the functions are fitted on; of others all are.
FIT_LABELLED = 4000
#: Share of the sentences that makes a subject one of the document's.
SHARE = 0.25
#: Belief that a sentence of a labelled document is about one of its labels.
TRUST = 0.97
ROUNDS = 12
#: Passes over the other documents, and rounds for the shares of each of them in a pass.
TURNS, OWN_ROUNDS = 2, 4
#: Added to each word's count in each class.
SMOOTH = 0.02
#: Sentences whose class a worker remembers.
SEEN_AT_MOST = 1 << 18

_LEAD = re.compile(
    r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?Z?\]?\s+)?(?:(?:DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL)\s+)?(?:(?P<address>[\w.-]+): )?(?:\d+[.)]\s+|[-*•–]\s+|#+\s+)?",
)
_END = re.compile(r"(?<=[.!?;。！？])[\"'”»)\]]*\s+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+")
_BARE = re.compile(r"(?:\d+[.)]|[-*•–#]+|[\W_]+)")
ABSTAIN = ""


def sentences(text: str | None) -> list[tuple[str, str]]:
    """(address, sentence) of each sentence or line."""
    out = []
    for line in (text or "").splitlines():
        if not line.strip():
            continue
        m = _LEAD.match(line)
        address, body = m["address"] or "", line[m.end() :]
        for part in _END.split(body):
            part = part.strip()
            if part and not _BARE.fullmatch(part):
                out.append((address, part))
    return out


_DIGITS = re.compile(r"\d+")


def masked(sentence: str) -> str:
    """The sentence with numbers alike: what the functions look at."""
    return _DIGITS.sub("0", sentence)


@functools.lru_cache(maxsize=1 << 15)
def features(sentence: str) -> tuple[tuple[str, ...], str, str]:
    """Words (and pairs of them), opening and ending."""
    words = _WORD.findall(sentence.casefold())
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return tuple(words + pairs), " ".join(words[:2]), " ".join(words[-2:])


Item = tuple[str, str, str, str]  # address, sentence, service, source


def values_of(item: Item) -> tuple[str, str, str, str]:
    """What the functions other than the lexicon look at."""
    _, opening, ending = features(item[1])
    return opening, ending, item[0] or item[2], item[3]


def _sums(group: np.ndarray, table: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the given rows of a table by group, a column at a time to save memory."""
    return np.stack([np.bincount(group, table[rows, c], minlength=n) for c in range(table.shape[1])], axis=1)


def _normalised(logs: np.ndarray) -> np.ndarray:
    logs = np.exp(logs - logs.max(axis=-1, keepdims=True))
    return logs / logs.sum(axis=-1, keepdims=True)


_CUT = "doc_id bigint, service string, source string, addresses array<string>, sentences array<string>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).dictionary_encode()  # copies of a batch are cut once
        addresses, found = [], []
        for text in texts.dictionary.to_pylist():
            parts = sentences(text)
            addresses.append([a for a, _ in parts])
            found.append(masked("\0".join(s for _, s in parts)).split("\0") if parts else [])
        lists = [pa.array(x, pa.list_(pa.string())).take(texts.indices) for x in (addresses, found)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k).fill_null("") for k in (2, 3)), *lists], [x.split()[0] for x in _CUT.split(", ")])


def cut_documents(docs: DataFrame) -> DataFrame:
    """The masked sentences and addresses of every document with a text, stored, as they are read several times."""
    real = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return materialize(spread(real.select("doc_id", F.translate("text", "\0", " ").alias("text"), "service_name", "source")).mapInArrow(_cut, _CUT), "sentences")


class Occurrences:
    """The sentences of a batch: distinct ones, places (address, else service) and sources, and their numbers for each occurrence."""

    def __init__(self, batch: pa.RecordBatch):
        self.lengths = batch.column(4).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.docs = np.repeat(np.arange(batch.num_rows), self.lengths)
        self.at, self.sentences = self._encoded(batch.column(4).flatten())
        services, sources = (batch.column(k).take(pa.array(self.docs)) for k in (1, 2))
        addresses = batch.column(3).flatten()
        self.places, self.place_names = self._encoded(pc.if_else(pc.equal(addresses, ""), services, addresses))
        self.sources, self.source_names = self._encoded(sources)

    @staticmethod
    def _encoded(values: pa.Array) -> tuple[np.ndarray, list[str]]:
        coded = values.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


class Model:
    """The labelling functions and the latent model over their votes."""

    FUNCTIONS = ("lexicon", "section", "ending", "address", "source")

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        self.classes = len(subjects) + 1  # the last: about none
        self.lexicon: dict[str, np.ndarray] = {}
        self.prior = np.zeros(self.classes)
        self.tables: list[dict[str, int]] = []
        self.accuracy = np.zeros((5, self.classes, self.classes + 1))
        self._seen: dict[tuple, tuple[int, float]] = {}
        self._lexicon_votes: dict[str, int] = {}

    @functools.cached_property
    def _table(self) -> tuple[dict[str, int], np.ndarray]:
        """The lexicon as numbers of words and a matrix."""
        return {w: k for k, w in enumerate(self.lexicon)}, np.array(list(self.lexicon.values())).reshape(-1, self.classes)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}  # made again where it is used

    def lexicon_votes(self, found: list[str]) -> np.ndarray:
        """For each sentence the class of highest probability by its words, if it is likelier than not."""
        numbers, matrix = self._table
        known = [[k for w in features(x)[0] if (k := numbers.get(w)) is not None] for x in found]
        sizes = np.array([len(x) for x in known], np.int64)
        votes = np.full(len(found), self.classes, np.int64)
        if (some := np.flatnonzero(sizes)).size:
            words = np.fromiter((k for x in known for k in x), np.int64, sizes.sum())
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            p = _normalised(self.prior + np.add.reduceat(matrix[words], starts, axis=0))
            best = p.argmax(axis=1)
            votes[some] = np.where(p[np.arange(len(some)), best] > 0.5, best, self.classes)
        return votes

    def lexicon_vote(self, sentence: str) -> int:
        if (vote := self._lexicon_votes.get(sentence)) is None:
            vote = int(self.lexicon_votes([sentence])[0])
            if len(self._lexicon_votes) >= SEEN_AT_MOST:
                self._lexicon_votes.clear()
            self._lexicon_votes[sentence] = vote
        return vote

    def votes(self, item: Item) -> tuple[int, ...]:
        """A class from each function; ``classes`` if it abstains."""
        return (self.lexicon_vote(item[1]), *(t.get(v, self.classes) for t, v in zip(self.tables, values_of(item))))

    def all_votes(self, found: Occurrences) -> tuple[np.ndarray, np.ndarray]:
        """The distinct patterns of votes in a batch, and the number of its pattern for each sentence."""
        none, (section, ending, address, source) = self.classes, self.tables
        said = [(section.get(a, none), ending.get(b, none)) for _, a, b in map(features, found.sentences)]
        first = np.column_stack([self.lexicon_votes(found.sentences), np.array(said, np.int64).reshape(-1, 2)])[found.at]
        places = np.array([address.get(v, none) for v in found.place_names], np.int64)[found.places]
        sources = np.array([source.get(v, none) for v in found.source_names], np.int64)[found.sources]
        votes = np.column_stack([first, places, sources])
        _, at, own = np.unique(votes @ (none + 1) ** np.arange(5), return_index=True, return_inverse=True)
        return votes[at], own

    def posterior(self, votes: tuple[int, ...]) -> np.ndarray:
        logs = self.class_share.copy()
        for k, v in enumerate(votes):
            logs = logs + np.log(self.accuracy[k, :, v])
        return _normalised(logs)

    def classify(self, item: Item) -> tuple[int, float]:
        """Class and its probability; equal sentences with equal votes of place are looked at once in a worker."""
        key = item[1], self.tables[2].get(item[0] or item[2]), self.tables[3].get(item[3])
        if (found := self._seen.get(key)) is None:
            p = self.posterior(self.votes(item))
            best = int(p.argmax())
            found = best, float(p[best])
            if len(self._seen) >= SEEN_AT_MOST:
                self._seen.clear()
            self._seen[key] = found
        return found


class Others:
    """What all documents but the labelled ones given add to the sums that the model is fitted on, by distributed aggregation."""

    def __init__(self, cut: DataFrame, n: int):
        self.cut, self.n = cut, n
        self.sums = [f"c{k}" for k in range(n)]

    def expect(self, index: dict[str, int], logs: np.ndarray, class_share: np.ndarray) -> pd.DataFrame:
        """kind, name, sums by class: of kind 0 words of at least two sentences, of 1 to 4 values of the other functions, of 5 all."""
        shared = self.cut.sparkSession.sparkContext.broadcast((index, logs, class_share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pandas(_expected(Occurrences(batch), batch.num_rows, *shared.value), preserve_index=False)

        columns = ", ".join(f"{c} double" for c in self.sums)
        found = self.cut.mapInArrow(run, f"kind int, name string, used bigint, {columns}")
        total = found.groupBy("kind", "name").agg(F.sum("used").alias("used"), *(F.sum(c).alias(c) for c in self.sums))
        return total.filter("kind > 0 or used >= 2").drop("used").orderBy("kind", "name").toPandas()

    def patterns(self, model: Model) -> Counter:
        """How many sentences have each pattern of votes."""
        shared = self.cut.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                votes, own = shared.value.all_votes(Occurrences(batch))
                yield pa.RecordBatch.from_arrays([pa.array(votes.tolist(), pa.list_(pa.int32())), pa.array(np.bincount(own.ravel(), minlength=len(votes)), pa.int64())], ["votes", "n"])

        found = self.cut.mapInArrow(run, "votes array<int>, n bigint").groupBy("votes").agg(F.sum("n").alias("n"))
        return Counter({(tuple(r["votes"]), None): r["n"] for r in found.orderBy("votes").collect()})


def _expected(found: Occurrences, n_docs: int, index: dict[str, int], logs: np.ndarray, class_share: np.ndarray) -> pd.DataFrame:
    """The sums of some documents, each with its own shares of the classes."""
    n, at, doc, place = logs.shape[1], found.at, found.docs, found.sentences
    names = ["kind", "name", "used", *(f"c{k}" for k in range(n))]
    if not len(at):
        return pd.DataFrame({c: pd.Series(dtype="int32" if c == "kind" else "object" if c == "name" else "int64" if c == "used" else "float64") for c in names})
    seen = [features(x) for x in place]
    words = [x[0] for x in seen]
    codes: list[dict[str, int]] = [{}, {}, {v: k for k, v in enumerate(found.place_names)}, {v: k for k, v in enumerate(found.source_names)}]
    values = [np.array([codes[k].setdefault(x[k + 1], len(codes[k])) for x in seen])[at] for k in range(2)] + [found.places, found.sources]
    known = [[index[w] for w in x if w in index] for x in words]
    of = np.repeat(np.arange(len(place)), [len(x) for x in known])
    scores = _sums(of, logs, np.array([w for x in known for w in x], np.int64), len(place))
    own = np.full((n_docs, n), 1.0 / n)
    for _ in range(OWN_ROUNDS):
        p = _normalised(scores[at] + np.log(own[doc]))
        own = _sums(doc, p, np.arange(len(at)), n_docs) + class_share
        own /= own.sum(axis=1, keepdims=True)
    p = np.rint(p * (1 << 20)) / (1 << 20)  # sums of these are exact
    rows = np.arange(len(at))
    by_sentence, often = _sums(at, p, rows, len(place)), np.bincount(at, minlength=len(place))
    heard: dict[str, int] = {}
    word = np.array([heard.setdefault(w, len(heard)) for x in words for w in x], np.int64)
    of = np.repeat(np.arange(len(place)), [len(x) for x in words])
    pairs = np.unique(of * max(len(heard), 1) + word)
    tables = [(0, heard, np.bincount(pairs % max(len(heard), 1), often[pairs // max(len(heard), 1)], minlength=len(heard)), _sums(word, by_sentence, of, len(heard)))]
    for k in range(4):
        tables.append((k + 1, codes[k], np.zeros(len(codes[k])), _sums(values[k], p, rows, len(codes[k]))))
    tables.append((5, {"": 0}, np.zeros(1), p.sum(axis=0, keepdims=True)))
    parts = []
    for kind, entries, used, sums in tables:
        part = pd.DataFrame(sums, columns=names[3:])
        part.insert(0, "used", used.astype(np.int64))
        part.insert(0, "name", list(entries))
        part.insert(0, "kind", np.int32(kind))
        parts.append(part)
    return pd.concat(parts, ignore_index=True)


def fit(docs: list[tuple[int, str, str, str]], labels: dict[int, set[str]], subjects: list[str], others: Others | None = None) -> Model | None:
    """The model of given documents and others. docs: doc_id, text, service, source; None without labels."""
    model = Model(sorted(subjects))
    n = model.classes
    place = {s: k for k, s in enumerate(model.subjects)}
    items: list[Item] = []
    allowed: list[frozenset[int] | None] = []
    of: list[int] = []
    for number, (doc_id, text, service, source) in enumerate(docs):
        own = frozenset(place[s] for s in labels.get(doc_id, ()) if s in place) or None
        for address, sentence in sentences(text):
            items.append((address, masked(sentence), service or "", source or ""))
            allowed.append(own)
            of.append(number)
    if not any(allowed):
        return None
    # The lexicon: a mixture of words by class, with the document's own shares of the classes.
    words = [features(i[1])[0] for i in items]
    used = Counter(w for x in words for w in set(x))
    names = sorted(w for w, c in used.items() if c >= 2)
    index = {w: k for k, w in enumerate(names)}
    known = [[index[w] for w in x if w in index] for x in words]
    at = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in known])
    word = np.array([w for x in known for w in x], np.int32)
    doc = np.array(of)
    hint = np.array([_hint(a, n) for a in allowed])
    labelled = np.array([a is not None for a in allowed])
    # Words that all subjects' documents share alike speak for a sentence about none.
    seen = labelled[at]
    start = np.where(labelled[:, None], np.exp(hint), 0.0)
    counts = _sums(word[seen], start, at[seen], len(names))
    share = counts[:, :-1] / np.maximum(counts[:, :-1].sum(axis=0), 1e-9) + 1e-12
    share = share / share.sum(axis=1, keepdims=True)
    even = -(share * np.log(share)).sum(axis=1) / np.log(max(n - 1, 2))
    even = np.where(counts.sum(axis=1) >= 3, even, 0.5) ** 4
    counts[:, -1] = counts[:, :-1].sum(axis=1) * even / 2
    counts[:, :-1] *= 1 - even[:, None]
    class_share = np.full(n, 1.0 / n)
    own_share = np.full((len(docs), n), 1.0 / n)
    for _ in range(ROUNDS):
        logs = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * len(names)))
        p = _normalised(hint + np.log(own_share[doc]) + _sums(at, logs, word, len(items)))
        counts = _sums(word, p, at, len(names))
        class_share = (p.sum(axis=0) + 1) / (p.sum() + n)
        own_share = _sums(doc, p, np.arange(len(items)), len(docs)) + class_share
        own_share /= own_share.sum(axis=1, keepdims=True)
    logs = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * len(names)))
    added: list[dict[str, np.ndarray]] = [{} for _ in range(4)]
    for _ in range(TURNS if others else 0):
        found = others.expect(index, logs, class_share)
        sums = {k: dict(zip(part["name"], part[others.sums].to_numpy())) for k, part in found.groupby("kind")}
        if not sums:
            break
        heard, added = sums.get(0, {}), [sums.get(k + 1, {}) for k in range(4)]
        for w in heard:
            index.setdefault(w, len(index))
        known = [[index[w] for w in x if w in index] for x in words]
        at = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in known])
        word = np.array([w for x in known for w in x], np.int32)
        counts = _sums(word, p, at, len(index))
        for w, x in heard.items():
            counts[index[w]] += x
        both = p.sum(axis=0) + sums[5][""]
        class_share = (both + 1) / (both.sum() + n)
        logs = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * len(index)))
        p = _normalised(hint + np.log(own_share[doc]) + _sums(at, logs, word, len(items)))
        own_share = _sums(doc, p, np.arange(len(items)), len(docs)) + class_share
        own_share /= own_share.sum(axis=1, keepdims=True)
    model.lexicon = {w: logs[k] - logs[k].mean() for w, k in index.items()}
    model.prior = np.log(class_share)
    # The other functions: what the lexicon says of the sentences with the same value, where it is of one mind.
    for k in range(4):
        codes: dict[str, int] = {}
        values = np.array([codes.setdefault(values_of(i)[k], len(codes)) for i in items])
        for v in added[k]:
            codes.setdefault(v, len(codes))
        sums = _sums(values, p, np.arange(len(items)), len(codes))
        for v, x in added[k].items():
            sums[codes[v]] += x
        total, most = sums.sum(axis=1), sums.max(axis=1)
        sure = (total >= 3) & (most > (0.8 if k < 2 else 0.3) * total)
        model.tables.append({v: int(sums[c].argmax()) for v, c in codes.items() if v and sure[c]})
    # Accuracies: EM over the distinct patterns of votes.
    said: dict[Item, tuple[int, ...]] = {}
    for i in items:
        if i not in said:
            said[i] = model.votes(i)
    patterns: Counter = Counter((said[i], a) for i, a in zip(items, allowed))
    if others:
        model._lexicon_votes.clear()
        patterns.update(others.patterns(model))
    votes = np.array([v for v, _ in patterns])
    weight = np.array(list(patterns.values()), float)
    hints = np.array([_hint(a, n) for _, a in patterns])
    first = np.full((len(votes), n), 0.02)
    for k in range(3):
        sure = votes[:, k] < n
        first[np.flatnonzero(sure), votes[sure, k]] += 1
    p = first / first.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        q = p * weight[:, None]
        for k in range(5):
            table = np.stack([np.bincount(votes[:, k], q[:, c], minlength=n + 1) for c in range(n)])
            model.accuracy[k] = (table + 0.1) / (table + 0.1).sum(axis=1, keepdims=True)
        model.class_share = np.log((q.sum(axis=0) + 1) / (q.sum() + n))
        scores = hints + model.class_share
        for k in range(5):
            scores = scores + np.log(model.accuracy[k][:, votes[:, k]]).T
        p = _normalised(scores)
    model._lexicon_votes.clear()
    return model


def _hint(own: frozenset[int] | None, n: int) -> np.ndarray:
    if not own:
        return np.zeros(n)
    p = np.full(n, (1 - TRUST) / n)
    p[list(own)] += TRUST * 0.75 / len(own)
    p[-1] += TRUST * 0.25
    return np.log(p)


def subject_shares(model: Model, text: str | None, service: str | None, source: str | None) -> dict[str, tuple[int, int]]:
    """For each subject of any sentence, its sentences and those of the whole document."""
    parts = sentences(text)
    counts = Counter(model.classify((a, masked(s), service or "", source or ""))[0] for a, s in parts)
    return {model.subjects[c]: (k, len(parts)) for c, k in counts.items() if c < len(model.subjects)}


def _sample(docs: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` documents of smallest hash."""
    return docs.select("doc_id", "text", "service_name", "source").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame, cut: DataFrame) -> Model | None:
    """Fits on a bounded sample of labelled documents on the driver, and on the sums of all others. ``cut``: cut_documents(docs)."""
    names = [r["subject"] for r in subjects.filter("subject is not null").select("subject").distinct().collect()]
    usable = labels.filter("doc_id is not null and subject is not null").select("doc_id", "subject").distinct()
    real = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = usable.select("doc_id").distinct()
    labelled = _sample(real.join(ids, "doc_id", "left_semi"), FIT_LABELLED).toPandas()
    if labelled.empty or not names:
        return None
    fitted = docs.sparkSession.createDataFrame([(int(d),) for d in labelled["doc_id"].unique()], "doc_id bigint")
    others = Others(cut.join(F.broadcast(fitted), "doc_id", "left_anti"), len(names) + 1)  # labelled ones past the bound too
    own: dict[int, set[str]] = defaultdict(set)
    # Only labels of the documents that are fitted on, so that none is pushed out by those of unknown documents.
    for r in usable.join(F.broadcast(fitted), "doc_id", "left_semi").filter(F.col("subject").isin(*names)).collect():
        own[r["doc_id"]].add(r["subject"])
    rows = [tuple(r) for r in labelled.astype(object).where(labelled.notna(), None).itertuples(index=False)]
    return fit(rows, own, names, others)


_SHARES = "doc_id bigint, subject string, n_sentences bigint, n_all bigint"


def sentence_subjects(cut: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, subject, n_sentences, n_all: how many of a document's sentences have each subject. ``cut``: cut_documents()."""
    spark = cut.sparkSession
    if model is None:
        return spark.createDataFrame([], _SHARES)
    shared = spark.sparkContext.broadcast(model)  # grows with the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names, n = pa.array(own.subjects, pa.string()), len(own.subjects)
        for batch in batches:
            found = Occurrences(batch)
            votes, which = own.all_votes(found)
            classes = np.array([int(own.posterior(tuple(v)).argmax()) for v in votes.tolist()], np.int64)[which.ravel()]
            about = classes < n
            pairs, counts = np.unique(found.docs[about] * n + classes[about], return_counts=True)
            docs = pairs // n
            columns = [batch.column(0).take(pa.array(docs)), names.take(pa.array(pairs % n)), pa.array(counts, pa.int64()), pa.array(found.lengths[docs], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "subject", "n_sentences", "n_all"])

    return cut.mapInArrow(run, _SHARES)


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row for each subject of at least a quarter of a document's sentences."""
    cut = cut_documents(docs)
    shares = sentence_subjects(cut, train(docs, labels, subjects, cut))
    return shares.filter(F.col("n_sentences") >= SHARE * F.col("n_all"))


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "subject_labels", "subjects"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return document_subjects(*_tables(spark, sf)).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    """The make-up of the corpus: documents and sentences of each subject."""
    found = document_subjects(*_tables(spark, sf))
    return found.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))
