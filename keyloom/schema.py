"""The ordered keys that address every value of a dataset."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class DatasetSchema:
    """Key names from the coarsest to the finest level, for example subject, session, trial."""

    keys: tuple[str, ...]

    def __init__(self, keys: Iterable[str]):
        if isinstance(keys, (set, frozenset, str)):
            raise TypeError("keys must be ordered: give a list or tuple of names")
        keys = tuple(keys)
        if len(set(keys)) != len(keys):
            raise ValueError(f"repeated key in {keys}")
        object.__setattr__(self, "keys", keys)

    def level(self, given: Iterable[str]) -> str | None:
        """The finest key among those given; None if none is."""
        given = set(given)
        return next((k for k in reversed(self.keys) if k in given), None)

    def depth(self, given: Iterable[str]) -> int:
        """Number of levels down to the finest key given."""
        level = self.level(given)
        return 0 if level is None else self.keys.index(level) + 1

    def split(self, metadata: Mapping) -> tuple[dict, dict]:
        """Metadata as (schema keys in order, version keys)."""
        return {k: metadata[k] for k in self.keys if k in metadata}, {k: v for k, v in metadata.items() if k not in self.keys}

    def below(self, given: Iterable[str]) -> str | None:
        """The key one level below the finest key given; None at the bottom."""
        depth = self.depth(given)
        return self.keys[depth] if depth < len(self.keys) else None
