"""An engine compiled on the driver: small, picklable, broadcast to the workers.

A text or pattern becomes a string of symbols, one for each grapheme cluster: without mappings a symbol is a cluster's
first character, with mappings the whole cluster (clusters of several characters get a code point of their own).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import regex

from driftmatch.plans.spec import KINDS, Limits, Pattern, Penalties, Similarity


def clusters(text: str) -> list[str]:
    return regex.findall(r"\X", text)


MOST_USEFUL = 24


@dataclass(frozen=True)
class Candidate:
    """A symbol string to align, and the pattern that it stands for."""

    u: str
    index: int


@dataclass
class Compiled:
    patterns: list[Pattern]
    limits: Limits | None = None
    penalties: Penalties = field(default_factory=Penalties)
    similarity: Similarity = field(default_factory=Similarity)
    case_insensitive: bool = False
    mappings: list[tuple[str, str, float]] = field(default_factory=list)
    floor: float = 0.0
    beam_width: int | None = None
    auto_beam: tuple[int, int] | None = None
    suffix_outputs: bool = True

    def __post_init__(self):
        self._codes: dict[str, str] = {}
        if not 0 <= self.floor <= 1:
            raise ValueError("the least symbol similarity is 0 to 1")
        for a, b, s in self.mappings:
            if not a or not b or not 0 <= s <= 1:
                raise ValueError("a mapping has two texts and a score of 0 to 1")
        self.shared = self._shared_limits()
        self.own = [(p.limits.final() if p.limits else self.shared or Limits().final()) for p in self.patterns]
        units = [[self.fold(g) for g in clusters(p.text)] for p in self.patterns]
        self.lengths = [len(g) for g in units]
        texts = ["".join(map(self.symbol, g)) for g in units]
        self.candidates = [Candidate(t, k) for k, t in enumerate(texts)]
        if self.suffix_outputs:
            # A beginning of one pattern that ends with another pattern reports that one too, over the whole beginning.
            named: dict[str, list[int]] = {}
            for k, t in enumerate(texts):
                named.setdefault(t, []).append(k)
            more: dict[int, set[str]] = {}
            for v in {t[:n] for t in texts for n in range(2, len(t) + 1)}:
                for at in range(1, len(v)):
                    for k in named.get(v[at:], ()):
                        more.setdefault(k, set()).add(v)
            self.candidates += [Candidate(v, k) for k in sorted(more) for v in sorted(more[k])]
        both = [(a, b, s) for a, b, s in self.mappings] + [(b, a, s) for a, b, s in self.mappings if a != b]
        self.blocks = [(self.text_symbols(a), self.text_symbols(b), self.penalties.substitution * (1 - s)) for a, b, s in both]
        self.bytes_of = [p.byte_len for p in self.patterns]
        self.unique = [2 * p.custom_unique_id + 1 if p.custom_unique_id is not None else 2 * k for k, p in enumerate(self.patterns)]

    def _shared_limits(self) -> Limits | None:
        if self.limits:
            return self.limits.final()
        given = [p.limits.final() for p in self.patterns if p.limits]
        if not given:
            return None
        # Patterns without limits take the loosest of those that the others have, field by field.
        most = lambda name: None if any(getattr(x, name) is None for x in given) else max(getattr(x, name) for x in given)
        edits = [x.edits for x in given if x.edits is not None]
        return Limits(**{k: most(k) for k in KINDS}, edits=max(edits) if edits else None)

    def fold(self, cluster: str) -> str:
        return cluster.lower() if self.case_insensitive else cluster

    def symbol(self, folded: str) -> str:
        if not self.mappings:
            return folded[0]
        if len(folded) == 1:
            return folded
        if folded not in self._codes:
            self._codes[folded] = chr(0xF0000 + len(self._codes))
        return self._codes[folded]

    def first(self, symbol: str) -> str:
        """The first character of a symbol's cluster, by which likeness is looked up."""
        if ord(symbol) < 0xF0000:
            return symbol
        return next((k[0] for k, v in self._codes.items() if v == symbol), symbol)

    def text_symbols(self, text: str) -> str:
        return "".join(self.symbol(self.fold(g)) for g in clusters(text))

    def plan(self, threshold: float) -> list["Job"]:
        return [Job.of(self, c, threshold) for c in self.candidates]

    @property
    def reducible(self) -> bool:
        p = self.penalties
        costs = (p.insertion, p.deletion, p.substitution * (1 - self.similarity.max_off_diagonal()), p.swap)
        return not self.mappings and bool(self.patterns) and all(c > 0 for c in costs) and all(1 <= n <= 63 for n in self.lengths)

    def max_match_graphemes(self) -> int:
        """The longest text, in clusters, that any pattern can match."""
        widest = max((len(b) for _, b, _ in self.blocks), default=1)
        return max((len(c.u) + self.own[c.index].most() * widest for c in self.candidates), default=0)


@dataclass(frozen=True)
class Job:
    """One candidate under one threshold.

    ``edits`` is the most edits that limits and threshold allow. ``pieces`` are (offset, piece): every match holds one of
    them verbatim, at most ``edits`` places from its offset; None where there is no such set. An edit spoils one piece
    of the candidate, a swap across a border two, so there is a piece more for each edit and each swap. With one edit in
    all there are two pieces, and the swap across their border is a seed of its own.
    """

    u: str
    index: int
    budget: float
    limits: Limits
    edits: int
    pieces: tuple[tuple[int, str], ...] | None

    @staticmethod
    def of(c: Compiled, x: Candidate, threshold: float) -> "Job":
        n, w, lim, u = c.lengths[x.index], c.patterns[x.index].weight, c.own[x.index], x.u
        budget = n * (1 - threshold / w) + 1e-6
        if lim.most() == 0 and not c.mappings:
            return Job(u, x.index, budget, lim, 0, ((0, u),))
        if not c.reducible or budget < 0:
            return Job(u, x.index, budget, lim, lim.most(), None)
        p = c.penalties
        costs = {"insertions": p.insertion, "deletions": p.deletion, "substitutions": p.substitution * (1 - c.similarity.max_off_diagonal()), "swaps": p.swap}
        most = {k: int(min(255 if getattr(lim, k) is None else getattr(lim, k), budget // costs[k])) for k in KINDS}
        edits = int(min(lim.most(), sum(most.values()), budget // min(costs.values())))
        swaps = min(edits, most["swaps"])
        if edits == 1 and swaps and len(u) > 1:
            h = len(u) // 2
            return Job(u, x.index, budget, lim, 1, ((0, u[:h]), (h, u[h:]), (0, u[: h - 1] + u[h] + u[h - 1] + u[h + 1 :])))
        parts = edits + swaps + 1
        if parts > MOST_USEFUL or len(u) < parts:
            return Job(u, x.index, budget, lim, edits, None)
        cut = [round(i * len(u) / parts) for i in range(parts + 1)]
        return Job(u, x.index, budget, lim, edits, tuple((a, u[a:b]) for a, b in zip(cut, cut[1:])))
