"""Byte offsets of sources between runs, in a small JSON file."""

from __future__ import annotations

import json
import logging
import os

log = logging.getLogger(__name__)


class Checkpoints:
    """``{id}|{absolute path}`` to offset. A missing or corrupt file starts afresh; a failed write is only logged."""

    def __init__(self, path: str):
        self.path = path
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            self._offsets = {str(k): max(0, int(v)) for k, v in found.items()}
        except (OSError, ValueError, TypeError, AttributeError):
            self._offsets = {}

    @staticmethod
    def key(source_id: str, path: str) -> str:
        return f"{source_id}|{os.path.abspath(path)}"

    def get(self, key: str) -> int:
        return self._offsets.get(key, 0)

    def save(self, offsets: dict[str, int]) -> None:
        self._offsets.update({k: max(0, int(v)) for k, v in offsets.items()})
        try:
            os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
            with open(self.path + ".tmp", "w", encoding="utf-8") as f:
                json.dump(self._offsets, f, indent=1)
            os.replace(self.path + ".tmp", self.path)
        except OSError as e:
            log.warning("offsets not saved: %s", e)
