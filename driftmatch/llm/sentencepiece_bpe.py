"""Exact SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The encoder walks a chunk from left to right and takes the longest vocabulary piece (found in an Aho-Corasick automaton
of the pieces; the next shorter ones follow on failure). A piece may follow
another only if the two stay apart when the merges are run again over their joined text; otherwise a shorter piece is
tried, and where none is left the walk steps back. A bit field marks positions from which the walk failed, so each one
fails once at most. A sequence whose neighbours are all compatible is the one that the merges give.

Chunks: no piece has a word mark after another character, so merges never cross from a character to a following word
mark; chunks begin at such marks and are encoded once per worker while they stay in a bounded cache. A character that
the vocabulary lacks becomes its UTF-8 bytes' pieces. Texts are taken as they are (the models served have the identity
normaliser, a dummy prefix, kept white space and byte fallback; others are refused).

A null text is empty: it has the end id alone. Repeated documents are rows of their own; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from hashlib import sha256
from itertools import accumulate as _running

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmatch.llm.common import opened, tidy

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Chunks that a worker keeps: fewer where other stages share its memory.
CACHE, CACHE_ALONE = 120_000, 300_000
#: Texts whose ids are in a worker's memory at once.
ROWS = 1024
#: Longer chunks are not kept.
LONG = 64


class Codec:
    """One model's vocabulary with an encoder and a decoder; ``path`` is a SentencePiece model file."""

    def __init__(self, path: str, most: int = CACHE):
        self.most = most
        sp = sentencepiece.SentencePieceProcessor(model_file=path)  # reads the file; it encodes nothing here
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.pieces: list[str] = []
        self.special: set[int] = set()
        self.bytes_of: dict[int, int] = {}
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            self.pieces.append(p)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of[i] = int(p[3:5], 16)
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.special.add(i)
            else:
                self.ids[p], self.scores[p] = i, sp.get_score(i)
        if MARK not in self.ids or not self.bytes_of or sp.normalize("  a  ﬁ ") != f"{MARK * 3}a {MARK}ﬁ{MARK}":
            raise ValueError("the model needs byte fallback, a dummy prefix and no normalisation")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark after another character")
        self.end = sp.eos_id()
        order = sorted(self.scores, key=lambda p: -self.scores[p])
        #: When a piece is made, in the order of merges; single characters are there before any.
        self.rank = {p: k for k, p in enumerate(p for p in order if len(p) > 1)}
        self.halves: dict[str, tuple[str, str]] = {}
        often = Counter(self.scores[p] for p in self.rank)
        #: Pieces of one score are merged by place, not in an order of their own.
        self.tied = {p for p in self.rank if often[self.scores[p]] > 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.rank:
            if self.merged(p, self.halves) == [p]:  # a piece that its own merges don't reach is never in an encoding
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.words, self.widest = frozenset(self.automaton), max(map(len, self.automaton))
        for p in order:
            if p in self.halves and not self.tied.isdisjoint(self.halves[p]):
                self.tied.add(p)
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache = Chunks(self.chunk, most)
        self.id_cache = Chunks(self.chunk_ids, most // 2)

    def merged(self, s: str, halves: dict | None = None) -> list[str]:
        """The merges themselves: the best-scored adjacent pair first, the leftmost among equals; ``halves`` gets what the
        last one joined."""
        part, n = list(s), len(s)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b < n and (v := self.scores.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-v, a, b, part[a], part[b]))

        for k in range(n - 1):
            push(k, k + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or part[a] != x or part[b] != y or nxt[a] != b:
                continue
            if halves is not None:
                halves[s] = x, y
            part[a] += part[b]
            alive[b] = False
            nxt[a] = nxt[b]
            if nxt[b] < n:
                prv[nxt[b]] = a
            push(prv[a], a)
            push(a, nxt[a])
        return [p for p, ok in zip(part, alive) if ok]

    def fit(self, a: str, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > self.most:
                self.fits.clear()
            got = self.fits[a, b] = self.apart(a, b)
        return got

    def apart(self, a: str, b: str) -> bool:
        """Whether the merges over ``a + b`` leave the two pieces as they are.

        The two sides' merges are run again from the last one back: at each step the later-made of the two pieces at the
        border gives way to its half there, and if the pieces at the border make a piece that comes before the merge just
        undone (or the same one, further left), that merge would have crossed the border. Where pieces of one score are
        met, all merges are run over the joined text instead.
        """
        rank, halves, limit, whole = self.rank, self.halves, len(self.rank) + 1, (a, b)
        x, y = rank.get(a, -1), rank.get(b, -1)
        while True:
            c = rank.get(a + b)
            if a in self.tied or b in self.tied or c is not None and a + b in self.tied:
                return self.merged(whole[0] + whole[1]) == [*whole]
            if c is not None and c < limit:
                return False
            if x > y:
                limit, a = x, halves[a][1]
                x = rank.get(a, -1)
            elif y >= 0:
                limit, b = y + 1, halves[b][0]
                y = rank.get(b, -1)
            else:
                return True

    def split(self, s: str) -> list[str]:
        """The pieces of one chunk; characters outside the vocabulary stand alone."""
        n, pos, longest, widest = len(s), 0, self.automaton.longest_prefix, self.widest
        words, known, fit = self.words, self.fits.get, self.fit
        out: list[str] = []
        prev, failed = "", 0  # a bit for each position
        size = longest(s[:widest])
        while pos < n:
            while True:
                if size > 1:
                    p = s[pos : pos + size]
                    if p not in words:
                        size -= 1
                        continue
                    e = pos + size
                else:
                    p, size, e = s[pos], 1, pos + 1
                if not (failed and failed >> e & 1):
                    if not prev:
                        break
                    ok = known((prev, p))
                    if fit(prev, p) if ok is None else ok:
                        break
                if size == 1:  # no continuation is left here, whatever comes before: step back
                    p = None
                    break
                size -= 1
            if p is None:
                failed |= 1 << pos
                while True:
                    if not out:
                        raise AssertionError("no encoding")
                    size = len(out.pop())
                    pos -= size
                    prev = out[-1] if out else ""
                    if size > 1:
                        size -= 1
                        break
                    failed |= 1 << pos
            else:
                out.append(p)
                prev, pos = p, e
                size = longest(s[pos : pos + widest])
        return out

    def chunk(self, s: str) -> tuple[str, str]:
        """A chunk's ids in decimal, each with a space after it, and the text that these ids decode to."""
        ids = self.chunk_ids(s)
        return "".join([f"{i} " for i in ids]), self.raw(ids)

    def chunk_ids(self, s: str) -> list[int]:
        ids = self.ids
        try:
            return [ids[p] for p in self.split(s)]
        except KeyError:
            pass
        out: list[int] = []
        for p in self.split(s):
            i = ids.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode()]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids without the end id."""
        return [i for c in CHUNK.findall(self.marked(text)) for i in self.chunk_ids(c)]

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def raw(self, ids: list[int]) -> str:
        """The text of ids before a dummy prefix is taken off."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i not in self.special:
                out.append(self.pieces[i].replace(MARK, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the first piece's word mark, which the encoder puts there, goes."""
        first = next((i for i in ids if i not in self.special), None)
        text = self.raw(ids)
        return text[1:] if first is not None and first not in self.bytes_of and self.pieces[first].startswith(MARK) else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids with the end, SHA-256 of the ids, SHA-256 of the text that they decode to).

        Both ways go by chunk: a chunk begins with a word mark, which is no byte's piece, so no run of bytes goes on from
        one chunk into the next, and the decoded chunks joined are the decoded whole.
        """
        if not text:
            return 1, sha256(str(self.end).encode()).hexdigest(), sha256(b"").hexdigest()
        ids, back = zip(*map(self.cache.__getitem__, CHUNK.findall(self.marked(text))))
        ids, back = "".join(ids), "".join(back)
        return ids.count(" ") + 1, sha256(f"{ids}{self.end}".encode()).hexdigest(), sha256(back[1:].encode()).hexdigest()


class Chunks(dict):
    """``make`` of each chunk, remembered in two generations of at most ``most`` chunks; long ones are not kept."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, s: str):
        got = self.old.get(s)
        if got is None:
            got = self.make(s)
        if len(s) <= LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[s] = got
        return got


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that is no part of a character gives U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def codec(path: str, most: int = CACHE) -> Codec:
    """A worker's codec of a model file, built once."""
    return opened((path, most), lambda: Codec(path, most))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with the end id and no other special ids."""

    def run(batches):
        c = codec(path, CACHE_ALONE)
        for b in batches:
            got = [c.digest(t or "") for t in b.column(1).to_pylist()]
            n, i, d = zip(*got) if got else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, keep=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids array<int>), with the end id, and the columns in ``keep``."""

    def run(batches):
        c = codec(path)
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            cache = c.id_cache
            rows = []
            for t in b.column(1).to_pylist():
                ids: list[int] = []
                for got in map(cache.__getitem__, CHUNK.findall(c.marked(t or ""))):
                    ids += got
                ids.append(c.end)
                rows.append(pa.array(ids, pa.int32()))
            offsets = pa.array([0, *_running(map(len, rows))], pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.concat_arrays(rows) if rows else pa.array([], pa.int32()))
            yield pa.record_batch([b.column(0), ids, *(b.column(k) for k in range(2, b.num_columns))], ["doc_id", "ids", *keep])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[2:])
    return chosen.mapInArrow(tidy(run, keep=True), "doc_id long, ids array<int>" + kept)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
