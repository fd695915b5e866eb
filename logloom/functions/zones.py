"""Versioned zone transition tables and vectorised local-to-UTC conversion.

Tables are made once, on the driver, from the zone database of the ``tzdata`` package, whose version they carry; the
operators send them to the executors, so that all convert by the same version whatever their systems have. Only where the package is
missing the system's database is read, and the version says so.
"""

from __future__ import annotations

import functools
import importlib.metadata
import importlib.resources
import zoneinfo
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np

FIRST_YEAR, LAST_YEAR = 1970, 2101

# Names of zones without letters of their own in the zone database.
NUMERIC_NAMES = {"Asia/Kathmandu": "NPT", "Asia/Dubai": "GST", "America/Sao_Paulo": "BRT", "Asia/Singapore": "SGT"}
# Abbreviations that mean UTC everywhere.
UNIVERSAL = {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0}


@functools.cache
def version() -> str:
    """The version of the zone database that the tables are made from."""
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "system"


@functools.cache
def names() -> frozenset[str]:
    """All zones of the database."""
    if version() == "system":
        return frozenset(zoneinfo.available_timezones())
    return frozenset(importlib.resources.files("tzdata").joinpath("zones").read_text().split())


def _zone(name: str) -> ZoneInfo:
    if version() == "system":
        return ZoneInfo(name)
    with importlib.resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).open("rb") as f:
        return ZoneInfo.from_file(f, key=name)


class ZoneTable:
    """Transitions of one zone: when, and the offsets on both sides, in microseconds; and when each abbreviation was used."""

    def __init__(self, name: str):
        zone, at, offsets = _zone(name), [], []
        day, end = datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc), datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc)

        def state(t: datetime) -> tuple[int, str]:
            x = t.astimezone(zone)
            letters = x.tzname().upper()
            return int(x.utcoffset().total_seconds()), letters if letters[0].isalpha() else NUMERIC_NAMES.get(name, letters)

        before = state(day)
        offsets.append(before[0])
        used: dict[str, list[tuple[int, int]]] = {before[1]: [(-(1 << 62), before[0])]}
        while day < end:
            after = state(nxt := day + timedelta(days=7))
            if after != before:
                low, high = int(day.timestamp()), int(nxt.timestamp())
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if state(datetime.fromtimestamp(mid, timezone.utc)) == before else (low, mid)
                if after[0] != before[0]:
                    at.append(high)
                    offsets.append(after[0])
                used.setdefault(after[1], []).append((high * 1_000_000, after[0]))
            day, before = nxt, after
        self.name = name
        # Of each abbreviation: since when (UTC), and the offset it stands for.
        self.used = {k: (np.array([t for t, _ in v], np.int64), np.array([o for _, o in v], np.int64) * 1_000_000) for k, v in used.items()}
        self.offsets = np.array(offsets, np.int64) * 1_000_000
        # A local time that occurs twice or never lies within the larger offset of the transition: up to there
        # the offset in force before the change holds.
        self.local_until = np.array([t * 1_000_000 for t in at], np.int64) + np.maximum(self.offsets[:-1], self.offsets[1:])

    def to_utc(self, local_us: np.ndarray) -> np.ndarray:
        return local_us - self.offsets[np.searchsorted(self.local_until, local_us, side="right")]

    def by_abbreviation(self, local_us: np.ndarray, word: str) -> np.ndarray | None:
        """UTC of local times with an abbreviation of this zone, by what it stood for then: the last use of it that had
        begun, or its first. None if the zone never used it."""
        if word in UNIVERSAL:
            return local_us
        if word not in self.used:
            return None
        since, offsets = self.used[word]
        return local_us - offsets[np.maximum(np.searchsorted(since + offsets, local_us, side="right") - 1, 0)]


@functools.lru_cache(maxsize=1024)
def table(name: str | None) -> ZoneTable | None:
    """The table of a zone; None for a name that the database doesn't have."""
    return ZoneTable(name) if name in names() else None
