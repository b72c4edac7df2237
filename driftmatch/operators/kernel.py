"""Weighted alignment of one text with an engine's patterns: plain Python, no Spark."""

from __future__ import annotations

import bisect
from typing import NamedTuple

import numpy as np

from driftmatch.plans.compiled import Compiled, Job, clusters

try:
    import ahocorasick
except ImportError:  # every piece is then looked for on its own, which finds the same
    ahocorasick = None

#: From so many pieces on, one automaton finds them all in one pass over a text.
SCAN = 24
MOST_SYMBOLS = (1 << 32) - 1


class TextTooLarge(ValueError):
    """A text of more symbols than offsets are defined for."""

    def __init__(self, symbols: int):
        super().__init__(f"the text has {symbols} symbols, more than {MOST_SYMBOLS}")
        self.symbols = symbols


class Match(NamedTuple):
    pattern_index: int
    start: int
    end: int
    similarity: float
    insertions: int
    deletions: int
    substitutions: int
    swaps: int
    edits: int


def _single(text: str) -> bool:
    """Whether every character is a cluster of its own and folds to one character: so in Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Offsets:
    """Byte offsets of a text's characters, worked out for the few that are asked for."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def __getitem__(self, i: int) -> int:
        if i not in self.known:
            self.known[i] = len(self.text[:i].encode())
        return self.known[i]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of each text, -1 after its end; lengths)."""
    raw = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32) for x in texts]
    n = np.array([len(x) for x in raw])
    out = np.full((len(raw), int(n.max(initial=0))), -1, np.int32)
    for row, x in zip(out, raw):
        row[: len(x)] = x
    return out, n


class Matcher:
    """A compiled engine under one threshold, with what it learns while it runs."""

    def __init__(self, engine: Compiled, threshold: float, prefilter: bool = True):
        self.e, self.threshold = engine, float(np.float32(threshold))
        self.jobs = engine.plan(self.threshold)
        self.prefilter = prefilter
        self.costs: dict[tuple[str, str], float | None] = {}
        self.spent = 0
        p = engine.penalties
        self.p = (p.insertion, p.deletion, p.substitution, p.swap)
        self.seeded = prefilter and not (engine.beam_width or engine.auto_beam)
        self.automaton = self._automaton()

    def _automaton(self):
        """Of the pieces of all jobs that have some; None where there are few."""
        jobs = [(k, j) for k, j in enumerate(self.jobs) if j.budget >= 0 and j.pieces is not None]
        if not self.seeded or ahocorasick is None or sum(len(j.pieces) for _, j in jobs) < SCAN:
            return None
        of: dict[str, list[tuple[int, int]]] = {}
        for k, j in jobs:
            for off, piece in j.pieces:
                of.setdefault(piece, []).append((k, off))
        found = ahocorasick.Automaton()
        for i, piece in enumerate(of):
            found.add_word(piece, i)
        found.make_automaton()
        users = [x for v in of.values() for x in v]
        self.sizes = np.array([len(x) for x in of])
        self.first = np.concatenate([[0], np.cumsum([len(v) for v in of.values()])])
        self.users = np.array(users)
        self.edits = np.array([j.edits for j in self.jobs])
        self.units, self.widths = _codes([j.u for j in self.jobs])
        return found

    def sub_cost(self, a: str, b: str) -> float | None:
        """Of pattern symbol a read as text symbol b; None where they are too unlike."""
        key = (a, b)
        if key not in self.costs:
            like = self.e.similarity.get(self.e.first(a), self.e.first(b))
            self.costs[key] = None if like < self.e.floor else self.p[2] * (1 - like)
        return self.costs[key]

    def symbols(self, text: str):
        """The text's symbols, and the byte offset of each and of the end (None: the positions themselves)."""
        e = self.e
        if text.isascii():
            return (text.lower() if e.case_insensitive else text), None
        if "\r\n" not in text and _single(text):
            return (text.lower() if e.case_insensitive else text), _Offsets(text)
        offs, out, at = [0], [], 0
        for g in clusters(text):
            out.append(e.symbol(e.fold(g)))
            at += len(g.encode())
            offs.append(at)
        return "".join(out), offs

    def search(self, text: str) -> list[Match]:
        """The best match of every (start, end, pattern), by start, end and pattern."""
        t, offs = self.symbols(text)
        if len(t) > MOST_SYMBOLS:
            raise TextTooLarge(len(t))
        best: dict[tuple[int, int, int], tuple] = {}
        self.spent = 0
        jobs = self.jobs
        if self.automaton is not None:
            self.scan(t, best)
            jobs = [j for j in jobs if j.pieces is None]
        for job in jobs:
            if job.budget < 0:
                continue
            exact = job.limits.most() == 0 and not self.e.blocks
            if exact:
                s = t.find(job.u)
                while s >= 0:
                    best[s, s + len(job.u), job.index] = (0.0, 0, 0, 0, 0, 0)
                    s = t.find(job.u, s + 1)
                continue
            for s in self.starts(job, t):
                if job.edits != 1 or job.pieces is None or _one_edit(job.u, t, s):
                    self.align(job, t, s, best)
        out = []
        for (s, end, i), (cost, edits, ins, dele, sub, swp) in best.items():
            n = self.e.lengths[i]
            sim = float(np.float32((n - cost) / n * self.e.patterns[i].weight))
            if sim >= self.threshold:
                out.append(Match(i, offs[s] if offs else s, offs[end] if offs else end, sim, ins, dele, sub, swp, edits))
        out.sort(key=lambda m: (m.start, m.end, m.pattern_index))
        return out

    def starts(self, job: Job, t: str):
        n = len(t)
        if not self.seeded or job.pieces is None:
            return range(n)
        found: set[int] = set()
        for off, piece in job.pieces:
            k = job.edits if off else 0  # nothing stands before the first piece
            at = t.find(piece)
            while at >= 0:
                found.update(range(max(0, at - off - k), min(n, at - off + k + 1)))
                at = t.find(piece, at + 1)
        return sorted(found)

    def scan(self, t: str, best: dict) -> None:
        """The jobs with pieces, by one pass over the text."""
        hits = np.array(list(self.automaton.iter(t)), np.int64).reshape(-1, 2)
        n = np.diff(self.first)[hits[:, 1]]
        user = self.users[np.repeat(self.first[hits[:, 1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        job, start = user[:, 0], np.repeat(hits[:, 0] + 1 - self.sizes[hits[:, 1]], n) - user[:, 1]
        reach = np.where(user[:, 1] > 0, self.edits[job], 0)  # nothing stands before the first piece
        wide = 2 * reach + 1
        job = np.repeat(job, wide)
        start = np.repeat(start - reach, wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        ok = (start >= 0) & (start < len(t))
        key = np.unique(job[ok] * (len(t) + 1) + start[ok])
        job, start = key // (len(t) + 1), key % (len(t) + 1)
        edits = self.edits[job]
        may = edits != 1
        one = np.flatnonzero(~may)
        codes = np.append(_codes([t])[0][0], np.full(self.units.shape[1] + 2, -2))
        for i in range(0, len(one), 1 << 14):
            part = one[i : i + (1 << 14)]
            may[part] = self._one_edit(codes, job[part], start[part])
        for k, s in zip(job[may].tolist(), start[may].tolist()):
            j = self.jobs[k]
            if j.edits == 0 and not self.e.blocks:
                best[s, s + len(j.u), j.index] = (0.0, 0, 0, 0, 0, 0)
            else:
                self.align(j, t, s, best)

    def _one_edit(self, codes: np.ndarray, job: np.ndarray, start: np.ndarray) -> np.ndarray:
        """As the function of that name, for many jobs and places of one text."""
        u, m = self.units[job], self.widths[job]
        w = u.shape[1]
        place = np.arange(w)
        past = place >= m[:, None]
        near = {d: codes[np.maximum(start[:, None] + place + d, 0)] for d in (-1, 0, 1)}
        same = {d: (x == u) | past for d, x in near.items()}
        ends = np.zeros((len(job), 1), bool)
        ahead = np.append(same[0] & ~past, ends, 1).argmin(1)  # symbols that agree from the start
        back = {d: np.append(x[:, ::-1], ends, 1).argmin(1) - (w - m) for d, x in same.items()}  # and up to the end
        row = np.arange(len(job))
        at, then = np.minimum(ahead, w - 1), np.minimum(ahead + 1, w - 1)
        swapped = (ahead + 1 < m) & (u[row, at] == near[0][row, then]) & (u[row, then] == near[0][row, at])
        return (ahead + 1 + np.maximum(back[0], back[-1]) >= m) | (ahead + back[1] >= m) | swapped & (ahead + 2 + back[0] >= m)

    def align(self, job: Job, t: str, s: int, best: dict) -> None:
        """All alignments of ``job.u`` that begin at ``s``: a breadth-first sweep over (pattern place, text place, end,
        counts), each with its least cost."""
        u, budget, lim, blocks = job.u, job.budget, job.limits, self.e.blocks
        p_ins, p_del, _, p_swap = self.p
        cap_i, cap_d, cap_s, cap_w = (255 if c is None else c for c in (lim.insertions, lim.deletions, lim.substitutions, lim.swaps))
        cap = 255 if lim.edits is None else lim.edits
        m, n, index = len(u), len(t), job.index
        level: dict[tuple, float] = {(0, s, s, 0, 0, 0, 0): 0.0}
        width = self.e.beam_width
        budgeted = self.e.auto_beam if width is None else None
        while level:
            self.spent += len(level)
            if budgeted and self.spent > budgeted[0]:
                width = budgeted[1]
            if width and len(level) > width:
                level = dict(sorted(level.items(), key=lambda x: (round(x[1], 9), x[0]))[:width])
            nxt: dict[tuple, float] = {}

            def put(key: tuple, cost: float) -> None:
                old = nxt.get(key)
                if old is None or cost < old:
                    nxt[key] = cost

            for (i, j, e, ins, dele, sub, swp), cost in level.items():
                edits = ins + dele + sub + swp
                if i == m:
                    key, value = (s, e, index), (cost, edits, ins, dele, sub, swp)
                    old = best.get(key)
                    if old is None or _better(value, old):
                        best[key] = value
                    continue
                c = u[i]
                more = edits < cap
                if j < n:
                    x = t[j]
                    if x == c:
                        put((i + 1, j + 1, j + 1, ins, dele, sub, swp), cost)
                    elif more and sub < cap_s:
                        d = self.sub_cost(c, x)
                        if d is not None and cost + d <= budget:
                            put((i + 1, j + 1, j + 1, ins, dele, sub + 1, swp), cost + d)
                    if more:
                        if swp < cap_w and i + 1 < m and j + 1 < n and t[j + 1] == c and x == u[i + 1] and cost + p_swap <= budget:
                            put((i + 2, j + 2, j + 2, ins, dele, sub, swp + 1), cost + p_swap)
                        if ins < cap_i and e > s and cost + p_ins <= budget:
                            put((i, j + 1, e, ins + 1, dele, sub, swp), cost + p_ins)
                if more:
                    if dele < cap_d and cost + p_del <= budget:
                        put((i + 1, j, e, ins, dele + 1, sub, swp), cost + p_del)
                    if blocks and sub < cap_s:
                        for a, b, d in blocks:
                            if cost + d <= budget and u.startswith(a, i) and t.startswith(b, j):
                                put((i + len(a), j + len(b), j + len(b), ins, dele, sub + 1, swp), cost + d)
            level = nxt


def _one_edit(u: str, t: str, s: int) -> bool:
    """Whether ``u`` is read from place ``s`` of ``t`` on with one edit or none, of any kind and cost."""
    m, k = len(u), 0
    part = t[s : s + m + 1]
    if part.startswith(u):
        return True
    size = len(part)
    while k < m and k < size and u[k] == part[k]:
        k += 1
    rest = u[k + 1 :]
    if rest == part[k + 1 : m] or rest == part[k : m - 1] or u[k:] == part[k + 1 :]:
        return True
    return k + 1 < size and k + 1 < m and u[k] == part[k + 1] and u[k + 1] == part[k] and u[k + 2 :] == part[k + 2 : m]


def _better(a: tuple, b: tuple) -> bool:
    """Lower cost, then fewer edits, then fewer insertions, deletions, substitutions, swaps; costs within 1e-9 are equal."""
    if abs(a[0] - b[0]) > 1e-9:
        return a[0] < b[0]
    return a[1:] < b[1:]


def rank(matches: list[Match], order: str, bytes_of: list[int]) -> list[Match]:
    if order == "unsorted":
        return matches
    tail = lambda m: (m.start, m.end, m.pattern_index)
    keys = {
        "default": lambda m: (-m.similarity, -bytes_of[m.pattern_index], -(m.end - m.start), *tail(m)),
        "greedy": lambda m: (-bytes_of[m.pattern_index], -m.similarity, *tail(m)),
        "coverage_weighted": lambda m: (-float(np.float32(np.float32(m.similarity) * np.float32(m.similarity) * np.float32(bytes_of[m.pattern_index]))), -m.similarity, *tail(m)),
    }
    return sorted(matches, key=keys[order])


def resolve(matches: list[Match], overlap: str, unique: list[int]) -> list[Match]:
    """Accepts matches in their order where they meet no accepted one; the result is by start."""
    if overlap == "keep":
        return matches
    starts: list[int] = []
    kept: list[Match] = []
    ids: set[int] = set()
    for m in matches:
        if overlap == "non_overlapping_unique" and unique[m.pattern_index] in ids:
            continue
        at = bisect.bisect_left(starts, m.start)
        if at and kept[at - 1].end > m.start or at < len(kept) and kept[at].start < m.end:
            continue
        starts.insert(at, m.start)
        kept.insert(at, m)
        ids.add(unique[m.pattern_index])
    return kept
