"""Problem 7: log lines of programs with different layouts become rows of timestamp, severity, component, message.

Every line's head is tokenised and its variables masked (``<ts>``, ``<lvl>``, ``<num>``, ``<word>``). Heads of listed
layouts (LAYOUTS, and JSON, pairs and markup, which name their fields) are entries wherever they stand. Files in which no line has
a listed layout are read by templates that are learned from all of them: a tree of fixed depth routes each masked head by the number of its
tokens and its leading tokens to a leaf, similar heads of a leaf are merged, and the positions of the merged template
are mapped to fields: where the time and the level stand, which name is closed by a mark or is the same throughout each file while
what follows varies. Whether such a head begins an entry at all depends on the corpus too: on what share of the lines with a time in
their files has their time in that place. Splits learn on their own; the leaves are merged in one order, so that the same
table gives the same templates however it is split. Any other line continues the entry before it in its file.

Entries are put together without a task per file: files are cut into stretches of bytes, each shuffled once, sorted, and
cut, assembled and parsed in one pass; only what a stretch begins with and its last entry, which may go on in the next
stretch, are shuffled again. So a file that holds a third of all rows is worked on by all tasks.

Defined results: rows with null text or id are skipped; rows without a path or offset are files of their own. A row
delivered again (same path and offset) counts once, as the one with the smallest raw_id. Blank lines continue
their entry; lines before a file's first entry belong to none. An entry without severity has INFO, without component
a null component, of a layout without times a null time. Half characters in JSON escapes are read as replacement characters. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.jsontext import well_formed
from logloom.functions.storage import materialize, spread
from logloom.operators.skew import ALIASES

#: Bytes of a file that one stretch spans.
STRETCH = 4 << 20
#: Head tokens looked at, leading tokens that route, and the share of equal tokens from which heads merge.
HEAD, DEPTH, SIMILAR = 16, 2, 0.6
#: Templates of a leaf; when it is full, the most similar one takes a head. With the alphabet of masks this bounds the tree.
LEAF_AT_MOST = 16
#: A place of the time is one of a layout if this share of the lines with a time or level in their files has it.
LAYOUT_SHARE = 0.1
#: A word is a name if in this share of its files it is the same, in files of at least so many lines of its template.
NAME_SHARE, NAME_LINES = 0.9, 5
#: A row delivered so often in one batch is counted as a possibly hot one; hot are those with more than a thousandth of all.
OFTEN, HOT = 16, 1000

# Names of fields in layouts of named fields.
FIELD_NAMES = {
    "ts": ("timestamp", "ts", "@timestamp", "time", "date", "datetime"),
    "severity": ("level", "severity", "loglevel", "lvl", "log_level"),
    "component": ("service", "service_name", "application", "app", "component", "src", "logger"),
    "message": ("message", "msg", "log", "text"),
}
ROLE = {name: role for role, names in FIELD_NAMES.items() for name in names}
SEVERITY = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
GLOG = {"D": "DEBUG", "I": "INFO", "W": "WARNING", "E": "ERROR", "C": "CRITICAL", "F": "CRITICAL"}

_CLOCK = r"\d\d: ?\d\d(?:: ?\d\d(?:[.,]\d+)?)?"
_STAMP = (
    rf"\d{{4}}[-/]\d\d[-/]\d\d[Tt ]{_CLOCK}(?: ?[Zz]\b| ?[+-]\d\d:?\d\d)?|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}},? {_CLOCK}(?: [AP]M\b)?"
    r"|\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}|[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d|(?<=^[DIWECF])\d{4} \d\d:\d\d:\d\d\.\d{3,9}"
)
_LEVELS = "|".join(sorted(SEVERITY, key=lambda x: (-len(x), x)))
_TOKEN = re.compile(
    rf"(?P<ts>{_STAMP})|(?P<epoch>(?:^|(?<=^\[))1\d{{9}}(?:\d{{3}}){{0,3}}(?:\.\d{{1,9}})?(?![\w.-]))|(?P<glog>^[DIWECF](?=\d{{4}} \d\d:\d\d:\d\d\.))|(?P<lvl>(?i:\b(?:{_LEVELS})\b)(?![.\w-]))"
    r"|(?P<num>\d+\b(?![.\w-]))|(?P<word>@?\w+(?:[.\-/]\w+)*)|(?P<gap>[ \t]+)|(?P<mark>.)"
)
_COLOUR = re.compile(r"\x1b\[[\d;]*m")
# Names begin where no other name could have begun and are never tried shorter, so that long lines take no longer a byte.
_PAIR = re.compile(r'(?<![@\w.\-])([@\w.\-]++)=("(?:[^"\\]|\\.)*"|[^\s"]*)')
_ATTRIBUTE = re.compile(r"(?<![\w.:-])([\w.:-]++)\s*+=\s*(\"[^\"]*\"|'[^']*')")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "'": "'", "\\": "\\", "/": "/"}

Token = tuple[str, int, int]


def tokenize(line: str) -> list[Token]:
    """Masked head tokens with their places; a gap is one token."""
    out: list[Token] = []
    for m in _TOKEN.finditer(line):
        kind = m.lastgroup
        out.append(((m[0] if m[0].isascii() else "<mark>") if kind == "mark" else " " if kind == "gap" else f"<{kind}>", m.start(), m.end()))
        if len(out) == HEAD:
            break
    return out


# Layouts as sequences of masked tokens, in which ? marks an optional group. Names in braces are fields.
_SEQUENCES = (
    ("glog", "{severity:<glog>}{ts:<ts>} <num> {component:<word>}:<num>] {message}"),
    ("bracketed", "[{ts:<ts>}] [{component:<word>}(?::{severity:<lvl>})?] (?:\\[<word> <num>\\] )?{message}"),
    ("event", "{ts:<ts>} (?:{severity:<lvl>}: )?{component:<word>}[<num>]$"),
    ("threaded", "{ts:<ts>} (?:{severity:<lvl>} )?[<any>] {component:<word>}: {message}"),
    ("dashed", "{ts:<ts>} (?:\\[{severity:<lvl>}\\] )?{component:<word>} - {message}"),
    ("syslog", "{ts:<ts>} <word> {component:<word>}(?:\\[<num>\\])?: (?:{severity:<lvl>}:? )?{message}"),
    ("piped", "(?:{severity:<lvl>} ?\\| ?)?{ts:<ts>} ?| ?{component:<word>} ?| ?{message}"),
    ("protocol", "<{priority:<num>}><num> {ts:<ts>} <any> {component:<word>} <any> <any> (?:- ?)?{message}"),
    ("listed", "{ts:<ts>}, ?{severity:<lvl>}?, ?{component:<word>}, ?<any>?, ?{message}"),
)


def _compile(sequence: str) -> re.Pattern:
    """A regex over the concatenated masks of a head."""
    parts = re.split(r"(\(\?:.*?\)\?|\{\w+(?::<\w+>)?\}\??|<\w+>\??|\$| \?)", sequence)
    out = []
    for part in parts:
        if m := re.fullmatch(r"\{(\w+)(?::<(\w+)>)?\}(\??)", part):
            out.append((f"(?P<{m[1]}>{f'<{m[2]}>' if m[2] else ''})" + m[3]))
        elif part.startswith("(?:"):
            out.append("(?:" + re.sub(r"\{(\w+):(<\w+>)\}", r"(?P<\1>\2)", part[3:-2]) + ")?")
        elif m := re.fullmatch(r"<(\w+)>(\??)", part):
            out.append(("(?:<num>|<word>|-)" if m[1] == "any" else f"<{m[1]}>") + m[2])
        elif part in ("$", " ?"):
            out.append(part)
        else:
            out.append(re.escape(part))
    return re.compile("".join(out))


LAYOUTS = [(name, _compile(sequence)) for name, sequence in _SEQUENCES]


@functools.lru_cache(maxsize=65_536)
def map_positions(tokens: tuple[str, ...]) -> tuple[str | None, dict[str, int]]:
    """The layout of a template and the token positions of its fields; message is the position it begins at."""
    text = "".join(tokens)
    if text.startswith("{"):
        return "json", {}
    if text.startswith("<<word>") and "=" in tokens:
        return "markup", {}
    if tokens[1:2] == ("=",) and tokens[0] == "<word>":
        return "pairs", {}
    starts, at = {}, 0
    for k, token in enumerate(tokens):
        starts[at] = k
        at += len(token)
    starts[at] = len(tokens)
    for name, shape in LAYOUTS:
        if m := shape.match(text):
            places = {f: starts.get(m.start(f)) for f in m.groupdict() if m.group(f) is not None}
            if all(p is not None for p in places.values()):
                return name, places
    return _unlisted(tokens)


_AROUND = (" ", "[", "]", "(", ")", "|", ",", ":", "-")


def _name_end(tokens: tuple[str, ...], k: int, listed: bool) -> int:
    """Where the name at k ends with what closes it (brackets, a colon, a bar, a dash); 0 if nothing does."""
    end = k + 1
    if tokens[k - 1] in ("[", "("):
        return end + 1 if tokens[end : end + 1] in (("]",), (")",)) else 0
    if tokens[end : end + 1] == ("[",) and tokens[end + 1 : end + 3] in (("<num>", "]"), ("<word>", "]")):
        end += 3
    if tokens[end : end + 1] == (":",) and tokens[end + 1 : end + 2] in ((" ",), ()):
        return end + 1
    if tokens[end : end + 1] == ("|",) or listed and tokens[end : end + 1] == (",",):
        return end + 1
    return end + 2 if tokens[end : end + 2] in ((" ", "-"), (" ", "|")) else 0


def _unlisted(tokens: tuple[str, ...]) -> tuple[str | None, dict[str, int]]:
    """Positions in a head of no listed layout that begins with a time, at most after a level: level and component if
    there are any, the rest is the message."""
    at = tokens.index("<ts>") if "<ts>" in tokens else len(tokens)
    if at + 1 >= len(tokens) or tokens[0] not in ("<ts>", "<lvl>", "[", "(") or any(t != "<lvl>" and t not in _AROUND for t in tokens[:at]):
        return None, {}
    places = {"ts": at} | ({"severity": tokens.index("<lvl>")} if "<lvl>" in tokens[:at] else {})
    k, named, listed = at + 1, False, tokens[at + 1] == ","
    while k < len(tokens):
        if tokens[k] in (_AROUND if not named else (" ", "-", "|", ",")):
            k += 1
        elif tokens[k] == "<lvl>" and "severity" not in places:
            places["severity"] = k
            k += 1
            while tokens[k : k + 1] in (("]",), (":",), (")",)):
                k += 1
        elif not named and tokens[k] in ("<word>", "<num>") and (end := _name_end(tokens, k, listed)):
            if tokens[k] == "<word>":
                places["component"] = k
                named = tokens[k - 1] not in ("[", "(")
            k = end
        else:
            break
    if k == len(tokens) and len(places) == 1:
        return None, {}
    return "unlisted", places | {"message": k}


TIMES = ("<ts>", "<epoch>")


def time_place(tokens: tuple[str, ...]) -> int | None:
    """The position of the time of a head, or of its level, if that comes first in a head without a time."""
    at = next((k for k, t in enumerate(tokens) if t in TIMES), None)
    if at is None and (lead := next((k for k, t in enumerate(tokens) if t not in _AROUND), None)) is not None and tokens[lead] == "<lvl>":
        return lead
    return at


class Template:
    """Heads of a leaf that are alike: merged tokens, the number of lines, and at each position how many files have
    NAME_LINES lines that begin alike up to it, and in how many of these the word is the same."""

    __slots__ = ("tokens", "place", "n", "files", "same", "fields")

    def __init__(self, tokens: tuple[str, ...]):
        self.tokens, self.place = tokens, time_place(tokens)
        self.n, self.files, self.same = 0, [0] * len(tokens), [0] * len(tokens)
        self.fields: dict[str, int] = {}

    def similarity(self, tokens: tuple[str, ...]) -> float:
        """0 if the times stand in different places."""
        if time_place(tokens) != self.place or tokens[self.place] != self.tokens[self.place]:
            return 0.0
        return sum(a == b for a, b in zip(self.tokens, tokens)) / len(tokens)

    def merge(self, tokens: tuple[str, ...], n: int, files: list[int], same: list[int]) -> None:
        """Positions that differ become variable."""
        self.tokens = tuple(a if a == b else "<*>" for a, b in zip(self.tokens, tokens))
        self.n += n
        self.files, self.same = ([a + b for a, b in zip(x, y)] for x, y in ((self.files, files), (self.same, same)))

    def is_name(self, k: int) -> bool:
        """Whether the word at k is the same throughout files, while a later one isn't."""

        def constant(at: int) -> bool:
            return self.tokens[at] == "<word>" and self.files[at] > 0 and self.same[at] >= NAME_SHARE * self.files[at]

        later = [at for at in range(k + 1, len(self.tokens)) if self.tokens[at] in ("<word>", "<num>", "<*>")]
        return constant(k) and any(not constant(at) for at in later)

    def map_fields(self) -> dict[str, int]:
        """The token positions of the fields; message is the position it begins at."""
        tokens, at = self.tokens, self.place
        places = {"ts": at} if tokens[at] in TIMES else {"severity": at}
        before = [k for k in range(at) if tokens[k] == "<word>"]
        if "ts" in places and (level := next((k for k in range(at) if tokens[k] == "<lvl>"), None)) is not None:
            places["severity"] = level
        k, named, listed = at + 1, False, tokens[at + 1 : at + 2] == (",",)
        while k < len(tokens):
            if tokens[k] in (_AROUND if not named else (" ", "-", "|", ",")) or tokens[k] in ("]", ")", ":") and k == at + 1:
                k += 1
            elif tokens[k] == "<lvl>" and "severity" not in places:
                places["severity"] = k
                k += 1
                while tokens[k : k + 1] in (("]",), (":",), (")",)):
                    k += 1
            elif not named and tokens[k] in ("<word>", "<num>") and (end := _name_end(tokens, k, listed)):
                if tokens[k] == "<word>":
                    places["component"] = k
                    named = tokens[k - 1] not in ("[", "(")
                k = end
            elif not named and "component" not in places and self.is_name(k):
                places["component"], named = k, True
                k += 1
            else:
                break
        if "component" not in places and (names := [x for x in before if self.is_name(x)]):
            places["component"] = names[-1]
        return places | {"message": k}


Leaf = tuple[int, tuple[str, ...]]


class TemplateTree:
    """Fixed depth: number of head tokens, then DEPTH leading tokens, then a leaf of templates."""

    def __init__(self) -> None:
        self.leaves: dict[Leaf, list[Template]] = {}

    @staticmethod
    def route(tokens: tuple[str, ...]) -> Leaf:
        return len(tokens), tuple(tokens[:DEPTH])

    def find(self, tokens: tuple[str, ...]) -> Template | None:
        """The most similar template of the leaf, the first of equals."""
        if time_place(tokens) is None:
            return None
        best = max(self.leaves.get(self.route(tokens), ()), key=lambda t: t.similarity(tokens), default=None)
        return best if best is not None and best.similarity(tokens) > 0 else None

    def add(self, tokens: tuple[str, ...], n: int, files: list[int], same: list[int]) -> None:
        leaf = self.leaves.setdefault(self.route(tokens), [])
        best = self.find(tokens)
        if best is None or best.similarity(tokens) < SIMILAR and len(leaf) < LEAF_AT_MOST:
            leaf.append(best := Template(tokens))
        best.merge(tokens, n, files, same)


def clean(line: str) -> str:
    return _COLOUR.sub("", line).removeprefix("\ufeff") if "\x1b" in line or "\ufeff" in line else line


def _has_fields(line: str) -> bool:
    """Whether pairs name two fields, of which one is the time or the first name is one; reads no further than it must."""
    roles, first = set(), None
    for m in _PAIR.finditer(line):
        role = ROLE.get(m[1].lower())
        first = role is not None if first is None else first
        if role is not None:
            roles.add(role)
            if len(roles) > 1 and (first or "ts" in roles):
                return True
    return False


Head = tuple[str | None, dict[str, int], list[Token]]


def head(line: str, tree: TemplateTree | None = None) -> Head:
    """Layout (None: the line continues an entry), positions of fields, tokens. With ``tree``, that of files without
    listed layouts, it decides on heads that aren't listed."""
    line = line.rstrip("\r")
    if not line or line[0].isspace():
        return None, {}, []
    tokens = tokenize(line)
    masks = tuple(t[0] for t in tokens)
    layout, fields = map_positions(masks)
    if layout == "pairs":
        if not _has_fields(line):
            layout = None
    elif layout == "markup" and not any(ROLE.get(m[1].lower()) == "ts" for m in _ATTRIBUTE.finditer(line)):
        layout = None
    if tree is not None and layout in (None, "unlisted") and (template := tree.find(masks)) is not None:
        layout, fields = "learned", template.fields
    return layout, fields, tokens


def severity_of(text: object) -> str:
    return SEVERITY.get(str(text).strip().upper(), "INFO") if text is not None else "INFO"


def _unescape(text: str) -> str:
    if len(text) > 1 and text[0] == text[-1] == '"':
        text = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S)
    return text


def _named(pairs: Iterator[tuple[str, object]]) -> dict[str, object]:
    """The first value of each field's names, in the order of FIELD_NAMES."""
    values = {}
    for k, v in pairs:
        values.setdefault(k.lower(), v)
    return {role: next((values[n] for n in names if values.get(n) is not None), None) for role, names in FIELD_NAMES.items()}


# Severities by the last three bits of a priority.
PRIORITY = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARNING", "INFO", "INFO", "DEBUG")

_JSON = json.JSONDecoder(strict=False, parse_float=str, parse_int=str)
_JSON_PAIR = re.compile(r'"([@\w.\-]+)"\s*:\s*("(?:[^"\\]|\\.)*"|[^\s,}]+)')


def tidy(text: str) -> str:
    return "\n".join(x.rstrip(" \t\r") for x in text.split("\n")).strip()


def parse_entry(text: str, tree: TemplateTree | None = None, found: Head | None = None) -> tuple[str | None, str, str | None, str]:
    """timestamp as it stands, severity, component, message of a whole entry. ``found``: the head of its first line, if known."""
    ts, severity, component, message = _parse_entry(clean(text), tree, found)
    return ts if ts is None else well_formed(ts), severity, component if component is None else well_formed(component), well_formed(message)


def _parse_entry(text: str, tree: TemplateTree | None, found: Head | None) -> tuple[str | None, str, str | None, str]:
    first, _, rest = text.partition("\n")
    layout, fields, tokens = found or head(first, tree)
    if layout in ("json", "pairs", "markup"):
        if layout == "json":
            try:
                found, _ = _JSON.raw_decode(text)
                named = _named(found.items())
            except (ValueError, RecursionError):
                named = _named((k, _unescape(v)) for k, v in _JSON_PAIR.findall(text))
        elif layout == "pairs":
            named = _named((k, _unescape(v)) for k, v in _PAIR.findall(text))
        else:
            opening, _, body = text.partition(">")
            named = _named((k, html.unescape(v[1:-1])) for k, v in _ATTRIBUTE.findall(opening))
            tag = re.match(r"<([\w.:-]+)", opening)[1]
            end = body.rfind(f"</{tag}>")
            named["message"] = html.unescape(body[:end] if end >= 0 else body)
        ts, component, message = (named[x] if named[x] is None or isinstance(named[x], str) else json.dumps(named[x], ensure_ascii=False) for x in ("ts", "component", "message"))
        return ts, severity_of(named["severity"]), component, tidy(message or "")
    if layout is None:
        return None, "INFO", None, tidy(text)

    def at(name: str) -> str | None:
        return first[tokens[fields[name]][1] : tokens[fields[name]][2]] if name in fields else None

    severity = GLOG[first[0]] if layout == "glog" else PRIORITY[int(at("priority")) % 8] if layout == "protocol" else severity_of(at("severity"))
    begin = fields.get("message")
    start = len(first) if begin is None else tokens[begin][1] if begin < len(tokens) else tokens[-1][2]
    return at("ts"), severity, at("component"), tidy(first[start:] + ("\n" + rest if rest else ""))


def _lines_of(raw: DataFrame) -> DataFrame:
    """raw_id, path, at, raw_text of the rows that count; rows without path or offset are files of their own."""
    at = F.try_element_at("attributes", F.lit("start_offset")).try_cast("bigint")
    path = F.when(at.isNotNull(), F.try_element_at("attributes", F.lit("path")))
    kept = raw.filter(F.col("raw_text").isNotNull() & F.col("raw_id").isNotNull())
    return kept.select("raw_id", F.coalesce(path, F.concat(F.lit("\0"), F.col("raw_id").cast("string"))).alias("path"), F.coalesce(at, F.lit(0)).alias("at"), "raw_text")


# What the first pass hands on: files with a listed layout, masked heads of others (``at``: the place of the time), and rows that are
# often delivered (``at``: their offset).
_LISTED, _HEADS, _COPIES = range(3)
_LEARNED = "kind int, path string, tokens array<string>, names array<string>, n bigint, at bigint, raw_id bigint"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first pass: a file is looked at until it shows a listed layout."""
    listed: set[str] = set()
    for batch in batches:
        heads: dict[tuple[str, tuple[str, ...]], list] = {}
        copies: dict[tuple[str, int], list[int]] = {}
        new: set[str] = set()
        for raw_id, path, at, text in zip(*(c.to_pylist() for c in batch.columns)):
            (copy := copies.setdefault((path, at), [0, raw_id]))[0] += 1
            copy[1] = min(copy[1], raw_id)
            if path in listed:
                continue
            for line in text.split("\n"):
                layout, _, tokens = head(line := clean(line))
                if layout not in (None, "unlisted"):
                    new.add(path)
                    listed.add(path)
                    break
                if time_place(masks := tuple(t[0] for t in tokens)) is None:
                    continue
                words = [line[a:b] if kind == "<word>" else None for kind, a, b in tokens]
                if (have := heads.get((path, masks))) is None:
                    heads[path, masks] = [1, words]
                else:
                    have[0] += 1
                    have[1] = [a if a == b else None for a, b in zip(have[1], words)]
        rows = [(_LISTED, path, None, None, 1, None, None) for path in sorted(new)]
        rows += [(_HEADS, path, list(t), names, n, time_place(t), None) for (path, t), (n, names) in heads.items() if path not in listed]
        rows += [(_COPIES, path, None, None, n, at, raw_id) for (path, at), (n, raw_id) in copies.items() if n >= OFTEN]
        if len(listed) > 1 << 20:
            listed.clear()
        texts = pa.list_(pa.string())
        types = (pa.int32(), pa.string(), texts, texts, pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in _LEARNED.split(", ")])


_TEMPLATE = "tokens array<string>, n bigint, files array<bigint>, same array<bigint>"


def _merge_leaf(group: pd.DataFrame) -> pd.DataFrame:
    """The templates of one leaf, from its distinct heads, the most frequent first."""
    tree = TemplateTree()
    rows = sorted(((tuple(t), int(n), [int(x) for x in f], [int(x) for x in s]) for t, n, f, s in zip(group["tokens"], group["n"], group["files"], group["same"])), key=lambda r: (-r[1], r[0]))
    for row in rows:
        tree.add(*row)
    found = [t for leaf in tree.leaves.values() for t in leaf]
    return pd.DataFrame([(list(t.tokens), t.n, t.files, t.same) for t in found], columns=["tokens", "n", "files", "same"])


def odd_files(learned: DataFrame) -> DataFrame:
    """The files in which no line has a listed layout but some have a time or level."""
    by_file = learned.filter(F.col("kind") != _COPIES).groupBy("path").agg(F.bool_or(F.col("kind") == _LISTED).alias("listed"))
    return by_file.filter(~F.col("listed")).select("path", F.lit(True).alias("odd"))


def learn_tree(learned: DataFrame, odd: DataFrame) -> TemplateTree:
    """The tree of the odd files' layouts. The driver sees its templates: LEAF_AT_MOST for each number of tokens and
    DEPTH leading masks."""
    heads = learned.filter(F.col("kind") == _HEADS).join(odd, "path", "left_semi").select("path", "tokens", "names", "n", F.col("at").cast("int").alias("place"))
    # The beginning of a head up to its time, and how many of the lines of its files have it.
    begun = heads.groupBy("path", "tokens", "place").agg(F.sum("n").alias("n")).withColumn("begin", F.slice("tokens", F.lit(1), F.col("place") + 1))
    totals = begun.groupBy("path").agg(F.sum("n").alias("total"))
    shares = begun.groupBy("path", "begin").agg(F.sum("n").alias("n")).join(totals, "path").groupBy("begin").agg(F.sum("n").alias("own"), F.sum("total").alias("total"))
    good = shares.filter(F.col("own") >= LAYOUT_SHARE * F.col("total")).select("begin")
    kept = begun.join(good, "begin", "left_semi")
    # In each file: whether all heads that begin alike up to a position have one word there.
    words = heads.select("path", "tokens", "n", F.posexplode("names").alias("k", "word")).withColumn("begin", F.slice("tokens", F.lit(1), F.col("k") + 1))
    alike = words.groupBy("path", "begin").agg(F.sum("n").alias("lines"), ((F.count("word") == F.count("*")) & (F.min("word") == F.max("word"))).alias("same"))
    at = kept.select("path", "tokens", "n", F.posexplode("tokens").alias("k", "_")).withColumn("begin", F.slice("tokens", F.lit(1), F.col("k") + 1)).join(alike, ["path", "begin"])
    enough = F.col("lines") >= NAME_LINES
    by_place = at.groupBy("tokens", "k").agg(F.sum("n").alias("n"), F.count_if(enough).alias("files"), F.count_if(enough & F.coalesce("same", F.lit(False))).alias("same"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "files", "same")))
    distinct = by_place.groupBy("tokens").agg(F.max("n").alias("n"), F.transform(ordered, lambda x: x["files"]).alias("files"), F.transform(ordered, lambda x: x["same"]).alias("same"))
    leaves = distinct.groupBy(F.size("tokens"), F.slice("tokens", 1, DEPTH)).applyInPandas(_merge_leaf, _TEMPLATE)
    tree = TemplateTree()
    for r in leaves.orderBy(F.desc("n"), "tokens").collect():
        template = Template(tuple(r["tokens"]))
        template.n, template.files, template.same = r["n"], list(r["files"]), list(r["same"])
        template.fields = template.map_fields()
        tree.leaves.setdefault(tree.route(template.tokens), []).append(template)
    return tree


# What the second pass hands on: whole entries, what a stretch begins with, and its last entry.
_ENTRY, _FRONT, _LAST = range(3)
_PARSED = "raw_id bigint, path string, ts_text string, severity string, component string, message string, message_md5 string"
_ASSEMBLED = f"kind int, stretch bigint, odd boolean, text string, {_PARSED}"


def _row(kind: int, stretch: int | None, odd: bool, text: str | None, raw_id: int | None, path: str, parsed: tuple | None, messages: bool) -> tuple:
    if parsed is None:
        return kind, stretch, odd, text, raw_id, path, None, None, None, None, None
    md5 = hashlib.md5(parsed[3].encode("utf-8", "surrogatepass")).hexdigest()
    return kind, stretch, odd, text, raw_id, path, *parsed[:3], parsed[3] if messages else None, md5


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


class _Stretch:
    """The lines of one stretch of a file, in order: closed entries are handed on as they end."""

    def __init__(self, path: str, stretch: int, odd: bool, tree: TemplateTree, messages: bool):
        self.path, self.stretch, self.odd, self.messages = path, stretch, odd, messages
        self.tree = tree if odd else None
        self.front: list[str] = []
        self.raw_id: int | None = None
        self.begun: Head | None = None
        self.lines: list[str] = []
        self.at: int | None = None

    def add(self, raw_id: int, at: int, text: str, out: list[tuple]) -> None:
        if at == self.at:  # delivered again: rows come by raw_id
            return
        self.at = at
        for line in text.split("\n"):
            found = head(clean(line), self.tree)
            if found[0] is not None:
                self._close(out)
                self.raw_id, self.begun, self.lines = raw_id, found, [line]
            elif self.begun is None:
                self.front.append(line)
            else:
                self.lines.append(line)

    def _close(self, out: list[tuple]) -> None:
        if self.begun is not None:
            parsed = parse_entry("\n".join(self.lines), self.tree, self.begun)
            out.append(_row(_ENTRY, None, self.odd, None, self.raw_id, self.path, parsed, self.messages))

    def end(self, out: list[tuple]) -> None:
        if self.front:
            out.append(_row(_FRONT, self.stretch, self.odd, "\n".join(self.front), None, self.path, None, False))
        if self.begun is not None:
            out.append(_row(_LAST, self.stretch, self.odd, "\n".join(self.lines), self.raw_id, self.path, None, False))


def _assemble(shared, messages: bool):
    """Cuts, assembles and parses sorted rows of whole stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own = shared.value, None
        out: list[tuple] = []
        for batch in batches:
            for path, stretch, at, raw_id, text, odd in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or own.path != path or own.stretch != stretch:
                    if own is not None:
                        own.end(out)
                    own = _Stretch(path, stretch, bool(odd), tree, messages)
                own.add(raw_id, at, text, out)
            yield _batch(out, _ASSEMBLED)
            out = []
        if own is not None:
            own.end(out)
            yield _batch(out, _ASSEMBLED)

    return run


def _parse(shared, messages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            rows = [_row(0, None, odd, None, raw_id, path, parse_entry(text, tree if odd else None), messages)[4:] for raw_id, path, odd, text in zip(*(c.to_pylist() for c in batch.columns))]
            yield _batch(rows, _PARSED)

    return run


def parse_logs(raw: DataFrame, messages: bool = True) -> DataFrame:
    """raw_id, path, ts_text, severity, component, message (null unless ``messages``) and its MD5, one row an entry. ``raw`` has raw_id,
    raw_text and the attributes path and start_offset."""
    spark = raw.sparkSession
    rows = _lines_of(raw)
    learned = materialize(rows.mapInArrow(_learn, _LEARNED), "learned")
    odd = materialize(odd_files(learned), "odd")
    shared = spark.sparkContext.broadcast(learn_tree(learned, odd))  # bounded, see learn_tree
    # Rows delivered so often that one stretch would be most of a task: all but those of the smallest id seen go here already.
    total = rows.agg(F.count("*")).scalar()
    often = learned.filter(F.col("kind") == _COPIES).groupBy("path", "at").agg(F.sum("n").alias("n"), F.min("raw_id").alias("first"))
    hot = often.filter(F.col("n") * HOT > total).select("path", "at", "first")  # fewer than HOT by counting
    once = rows.join(F.broadcast(hot), ["path", "at"], "left").filter(F.col("first").isNull() | (F.col("raw_id") <= F.col("first")))
    # Spark broadcasts the odd files if they are few, by the size of what is stored, and shuffles otherwise.
    placed = once.join(odd, "path", "left").withColumn("stretch", F.floor(F.col("at") / STRETCH))
    sorted_ = placed.select("path", "stretch", "at", "raw_id", "raw_text", "odd").repartition("path", "stretch").sortWithinPartitions("path", "stretch", "at", "raw_id")
    made = materialize(sorted_.mapInArrow(_assemble(shared, messages), _ASSEMBLED), "entries")
    ends = made.filter(F.col("kind") != _ENTRY).select("kind", "path", "stretch", "odd", "raw_id", "text")
    # A front belongs to the last entry of the last stretch before it that has one; the window sees keys only.
    before = W.partitionBy("path").orderBy("stretch", "kind").rowsBetween(W.unboundedPreceding, 0)
    keys = ends.select("path", "stretch", "kind").withColumn("entry", F.max(F.when(F.col("kind") == _LAST, F.col("stretch"))).over(before))
    owned = ends.join(keys.filter("entry is not null"), ["path", "stretch", "kind"])
    parts = F.array_sort(F.collect_list(F.struct("stretch", "kind", "text")))
    whole = owned.groupBy("path", "entry").agg(parts.alias("parts"), F.max("raw_id").alias("raw_id"), F.bool_or("odd").alias("odd"))
    joined = whole.select("raw_id", "path", "odd", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    last = joined.mapInArrow(_parse(shared, messages), _PARSED)
    return made.filter(F.col("kind") == _ENTRY).select(*last.columns).unionByName(last)


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/raw_logs.parquet").select("raw_id", "raw_text", "attributes"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return parse_logs(_raw(spark, sf), False).select("raw_id", "ts_text", "severity", "component", "message_md5")


def p7_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries with their messages and files."""
    out = parse_logs(_raw(spark, sf)).drop("message_md5")
    return out.withColumn("path", F.when(~F.col("path").startswith("\0"), F.col("path")))
