"""Caches of one driver: embeddings, hits and answers by question, bounded, cleared together."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import Any


class Cache:
    """The last ``size`` values per kind, keyed by what they depend on (question, repository, table version)."""

    KINDS = ("embedding", "retrieval", "answer")

    def __init__(self, size: int = 1000) -> None:
        self.size = size
        self.kept: dict[str, OrderedDict] = {k: OrderedDict() for k in self.KINDS}
        self.hits = self.misses = 0

    def get(self, kind: str, key: tuple, make: Callable[[], Any]) -> Any:
        """The kept value, or ``make()`` which is then kept; an unknown kind raises KeyError."""
        at = self.kept[kind]
        if key in at:
            at.move_to_end(key)
            self.hits += 1
        else:
            self.misses += 1
            at[key] = make()
            if len(at) > self.size:
                at.popitem(last=False)
        return at[key]

    def clear(self) -> None:
        for at in self.kept.values():
            at.clear()
