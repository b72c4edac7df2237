"""What an engine looks for, as plain values: patterns, edit limits, costs, likeness of characters, search options."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

KINDS = ("insertions", "deletions", "substitutions", "swaps")
ORDERS = ("unsorted", "default", "greedy", "coverage_weighted")
OVERLAPS = ("keep", "non_overlapping", "non_overlapping_unique")


@dataclass(frozen=True)
class Limits:
    """Most edits of each kind and in all, each 0 to 255; None is open, as ``final`` settles."""

    insertions: int | None = None
    deletions: int | None = None
    substitutions: int | None = None
    swaps: int | None = None
    edits: int | None = None

    def __post_init__(self):
        for name in (*KINDS, "edits"):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= 255:
                raise ValueError(f"{name} is 0 to 255, not {v}")

    def final(self) -> "Limits":
        """Without a total, kinds left open allow none; with a total they are bounded by it alone."""
        return self if self.edits is not None else replace(self, **{k: getattr(self, k) or 0 for k in KINDS})

    def most(self) -> int:
        """The most edits that any match can have."""
        kinds = [getattr(self, k) for k in KINDS]
        total = math.inf if None in kinds else sum(kinds)
        return int(min(total, 255 if self.edits is None else self.edits))


@dataclass(frozen=True)
class Penalties:
    insertion: float = 0.52
    deletion: float = 0.91
    substitution: float = 1.43
    swap: float = 0.52

    def __post_init__(self):
        if any(not (math.isfinite(v) and v >= 0) for v in (self.insertion, self.deletion, self.substitution, self.swap)):
            raise ValueError("penalties are finite and not negative")


def _default_likeness() -> dict[tuple[str, str], float]:
    vowels = "aeiou"
    consonants = [chr(c) for c in range(97, 123) if chr(c) not in vowels]
    out = {(a, b): v for group, v in ((vowels, 0.6), (consonants, 0.4)) for a in group for b in group if a != b}
    for a, b, v in (("o", "0", 0.6), ("l", "1", 0.7), ("i", "1", 0.6), ("s", "5", 0.5)):
        out[a, b] = out[b, a] = v
    return out


@dataclass(frozen=True)
class Similarity:
    """How like a pattern's character a text's is, 0 to 1; the pair is (pattern character, text character)."""

    table: Mapping[tuple[str, str], float] = field(default_factory=_default_likeness)

    def __post_init__(self):
        for (a, b), v in self.table.items():
            if len(a) != 1 or len(b) != 1 or not 0 <= v <= 1:
                raise ValueError(f"not a pair of characters with a likeness of 0 to 1: {a!r}, {b!r}, {v}")

    @staticmethod
    def from_map(table: Mapping[tuple[str, str], float]) -> "Similarity":
        return Similarity(dict(table))

    def get(self, a: str, b: str) -> float:
        return 1.0 if a == b else self.table.get((a, b), 0.0)

    def max_off_diagonal(self) -> float:
        return max((v for (a, b), v in self.table.items() if a != b), default=0.0)


@dataclass(frozen=True)
class Pattern:
    text: str
    weight: float = 1.0
    limits: Limits | None = None
    custom_unique_id: int | None = None

    def __post_init__(self):
        if not self.text:
            raise ValueError("a pattern has at least one character")
        if not (math.isfinite(self.weight) and self.weight > 0):
            raise ValueError("a pattern's weight is finite and above 0")

    @staticmethod
    def of(x) -> "Pattern":
        """From a Pattern, a text, (text, weight) or (text, weight, most edits)."""
        if isinstance(x, Pattern):
            return x
        if isinstance(x, str):
            return Pattern(x)
        text, weight, *rest = x
        return Pattern(text, weight, Limits(edits=rest[0]) if rest else None)

    @staticmethod
    def from_rows(rows: Iterable) -> list["Pattern"]:
        """From rows with ``pattern`` and optionally weight, limits (a struct) and custom_unique_id, in their order."""
        out = []
        for r in rows:
            d = r.asDict(recursive=True) if hasattr(r, "asDict") else dict(r)
            lim = d.get("limits")
            out.append(Pattern(d["pattern"], 1.0 if d.get("weight") is None else d["weight"], Limits(**lim) if lim else None, d.get("custom_unique_id")))
        return out

    @property
    def byte_len(self) -> int:
        return len(self.text.encode())

    def __len__(self) -> int:
        return self.byte_len

    def __str__(self) -> str:
        return self.text

    def weighted(self, weight: float) -> "Pattern":
        return replace(self, weight=weight)

    def fuzzy(self, limits: Limits) -> "Pattern":
        return replace(self, limits=limits)

    def unique_id(self, custom: int) -> "Pattern":
        return replace(self, custom_unique_id=custom)


@dataclass(frozen=True)
class Options:
    """A search's threshold, order and treatment of overlaps."""

    threshold: float = 0.0
    order: str = "unsorted"
    overlap: str = "keep"

    def __post_init__(self):
        if self.order not in ORDERS or self.overlap not in OVERLAPS:
            raise ValueError(f"order is one of {ORDERS}, overlap one of {OVERLAPS}")
        if math.isnan(self.threshold):
            raise ValueError("the threshold is a number")

    def ranked(self) -> "Options":
        """Resolving overlaps needs an order: the default one where none is given."""
        return replace(self, order="default") if self.overlap != "keep" and self.order == "unsorted" else self

    def segmenting(self) -> "Options":
        """What segments, replacements and the like use: ordered, and without overlaps."""
        return replace(self, order="default" if self.order == "unsorted" else self.order, overlap="non_overlapping" if self.overlap == "keep" else self.overlap)
