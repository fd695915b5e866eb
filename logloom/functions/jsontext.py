"""Strict JSON that keeps numbers and nested values as they are written."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_GAP = re.compile(r"[ \t\n\r]*")
_SURROGATE = re.compile("[\ud800-\udfff]")
#: Digits of the longest integer that is read as a number; longer ones stay texts of digits.
LONGEST_INTEGER = 4000
#: An escape: a pair of halves of a character, one half, or any other.
_ESCAPE = re.compile(r"\\(u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[dD][89a-fA-F][0-9a-fA-F]{2}|.)", re.S)


class Digits(str):
    """An integer that is too long to be counted with, as it is written."""


def whole(digits: str) -> int | Digits:
    return int(digits) if len(digits) <= LONGEST_INTEGER else Digits(digits)


def well_formed(text: str) -> str:
    """Half characters, which no encoding can hold, become replacement characters."""
    return text if text.isascii() or not _SURROGATE.search(text) else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def without_halves(text: str) -> str:
    """JSON whose escapes stand for whole characters only, as a cut text may end in half of one."""
    if "\\ud" not in text and "\\uD" not in text:
        return text
    return _ESCAPE.sub(lambda m: "\\ufffd" if len(m[1]) == 5 else m[0], text)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=whole)


def _skip(text: str, at: int) -> int:
    return _GAP.match(text, at).end()


def object_items(text: str) -> list[tuple[str, object, str]]:
    """(name, value, text as written) of each property; ValueError if the text isn't one JSON object."""
    return _members(text, "{", "}")


def array_items(text: str) -> list[tuple[object, str]]:
    """(value, text as written) of each element; ValueError if the text isn't one JSON array."""
    return [(v, w) for _, v, w in _members(text, "[", "]")]


def _members(text: str, opening: str, closing: str) -> list[tuple[str, object, str]]:
    at = _skip(text, 0)
    if text[at : at + 1] != opening:
        raise ValueError(f"no {opening}")
    out: list[tuple[str, object, str]] = []
    at = _skip(text, at + 1)
    if text[at : at + 1] == closing:
        at += 1
    else:
        while True:
            name = ""
            if opening == "{":
                if text[at : at + 1] != '"':
                    raise ValueError("no name")
                name, at = scanstring(text, at + 1, True)
                name = well_formed(name)
                at = _skip(text, at)
                if text[at : at + 1] != ":":
                    raise ValueError("no colon")
                at += 1
            begin = _skip(text, at)
            try:
                value, at = _DECODER.raw_decode(text, begin)
            except RecursionError:
                raise ValueError("too deep") from None
            out.append((name, value, text[begin:at]))
            at = _skip(text, at)
            mark = text[at : at + 1]
            at += 1
            if mark == closing:
                break
            if mark != ",":
                raise ValueError("no comma")
            at = _skip(text, at)
    if _skip(text, at) != len(text):
        raise ValueError("text after the end")
    return out


def as_text(value: object, written: str, null: str) -> str:
    """The text of a property: strings without quotes, null as given, anything else as written."""
    if isinstance(value, str):
        return well_formed(value)
    return null if value is None else written


class Fields(dict):
    """name -> value, names without regard to case; the first spelling of a name stays, its last value wins."""

    def __init__(self) -> None:
        super().__init__()
        self._names: dict[str, str] = {}

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(self._names.setdefault(name.lower(), name), value)

    def find(self, name: str) -> str | None:
        own = self._names.get(name.lower())
        return None if own is None else self[own]


def parse(text: str) -> object:
    """Any JSON value, strictly."""
    try:
        return json.loads(text, parse_constant=_no_constant, parse_int=whole)
    except RecursionError:
        raise ValueError("too deep") from None
