"""Interpolated modified Kneser-Ney n-gram model (order 2 or 3), counted in Spark and memory-mapped by the workers.

Counting: every task sums equal n-grams in bounded runs and ships them, as compressed blocks with a vocabulary of their
own, to shards by context. There is a shard for every ``SHARD_BYTES`` bytes of text. A context that would fill a good part
of one (found in a sample of whole texts, about 8 KB for each shard) is fanned out over as many as it needs; that moves
work only, never a count. A shard's task merges its blocks, writes its sorted hash arrays to the shared folder as one
file, and passes each n-gram's suffix on to the next lower order, where distinct predecessors are counted (a suffix that
begins a text keeps its own count). To the driver go counts of counts and the size of its file for each shard, and the
sums of the fanned contexts, of which there are twice as many as shards at most.

Files are written under a task's own name and moved into place, so a task that runs twice leaves one whole file. Workers
map a file into memory when they first need it, a bounded number of them at a time; a file that is missing or of
another size than the one written is an error. Where the shared folder isn't in the file system, files are read whole.

p(w|h) = (max(c - D(c), 0) + (D1 N1 + D2 N2 + D3 N3+) p(w|h')) / c(h), down to the uniform 1/(V+1), so that the known
words and one unknown word sum to 1. Texts are words ``[^\\x20\\x09-\\x0D]+`` of the A-Z-lower-cased text and one end.

A null text is empty and has one token, its end. Repeated ids are rows of their own; an empty table gives no rows; no
training rows give the uniform distribution; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmatch.llm import common
from driftmatch.llm.common import U, buffers, by_shard, drop_table, mix, pair, pieces, shared_dir, shards_for, text_bytes, tokens, written

END, BOS, EMPTY = U(0x51AB3F9D7C2E8841), U(0xB7E151628AED2A6B), U(0x243F6A8885A308D3)
#: Tokens that a task sums at a time; bytes of the sample for each shard; files that a worker has open.
RUN, SAMPLE, OPEN = 1 << 21, 1 << 13, 1 << 12
_ROWS = "shard int, block binary"


def text_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with each text's end, and where each text's tokens begin (one longer than the texts)."""
    h, _, _, at, _ = tokens(data, offs)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def contexts(h: np.ndarray, at: np.ndarray, order: int, bos=BOS) -> list[np.ndarray]:
    """[words before, last first]: the words 1, 2... places back, ``bos`` before a text's start."""
    out, prev = [], h
    for _ in range(order - 1):
        prev = np.concatenate([[bos], prev[:-1]]).astype(h.dtype)
        prev[at[:-1][at[:-1] < len(h)]] = bos
        out.append(prev)
    return out


def context_hash(before: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    out = np.full(len(like), EMPTY)
    for x in before:
        out = pair(out, x)
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths and types, compressed."""
    head = json.dumps([(x.dtype.str, len(x)) for x in arrays]).encode()
    raw = len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _least(x: np.ndarray) -> np.ndarray:
    """Of the smallest unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal sorted keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _order(cols: list[np.ndarray], bits: int) -> np.ndarray:
    """The sort order of rows of word numbers below 2**bits."""
    if bits * len(cols) > 63:
        return np.lexsort(cols[::-1])
    key = cols[0].astype(np.int64)
    for c in cols[1:]:
        key = key << bits | c
    return np.argsort(key)


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else np.zeros(0, x.dtype)


class Spread:
    """How contexts go to shards: most as one, the fanned ones by n-gram over as many shards as they need."""

    def __init__(self, shards: int, hot: np.ndarray, fans: np.ndarray):
        self.shards, self.hot, self.fans = shards, hot, fans

    def is_hot(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hot, ctx), max(len(self.hot) - 1, 0))
        return at, (self.hot[at] == ctx) if len(self.hot) else np.zeros(len(ctx), bool)

    def shard(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = (mix(ctx) % U(self.shards)).astype(np.int64)
        at, hot = self.is_hot(ctx)
        if hot.any():
            fan = self.fans[at[hot]]
            out[hot] = (out[hot] + (pair(ctx[hot], word[hot]) % fan.astype(U)).astype(np.int64)) % self.shards
        return out


def _blocks(words: np.ndarray, cols: list[np.ndarray], raw: np.ndarray, adj: np.ndarray, spread: Spread, fine: bool = False):
    """One block for each shard (with very many shards by ``by_shard``'s first, unless ``fine``) of distinct n-grams, which
    are rows of numbers of ``words``: the words before, last first, and the word."""
    own = [words[c] for c in cols]
    shard = spread.shard(context_hash(own[:-1], own[-1]), own[-1])
    del own
    if spread.shards > common.MOST_SHARDS and not fine:
        shard %= common.MOST_SHARDS
    by = np.argsort(shard.astype(np.uint16) if spread.shards <= 1 << 16 else shard, kind="stable")
    edge = np.append(_starts(shard[by]), len(by))
    place = np.empty(len(words), np.int64)
    blocks, names = [], []
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        i = by[s:e]
        mine = [c[i] for c in cols]
        held = np.unique(np.concatenate(mine))
        place[held] = np.arange(len(held))
        blocks.append(pack(words[held], *(_least(place[c]) for c in mine), _least(raw[i]), _least(adj[i])))
        names.append(shard[i[0]])
    return pa.record_batch([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])


def _gathered(blocks: list[bytes]):
    """(words, number columns, raw, adj) of blocks, not yet summed."""
    parts = [unpack(x) for x in blocks]
    words = np.unique(np.concatenate([p[0] for p in parts]))
    at = [np.searchsorted(words, p[0]).astype(np.int32) for p in parts]
    cols = [np.concatenate([t[p[k]] for t, p in zip(at, parts)]) for k in range(1, len(parts[0]) - 2)]
    return words, cols, *(np.concatenate([p[k].astype(np.int64) for p in parts]) for k in (-2, -1))


def _summed(words: np.ndarray, cols: list[np.ndarray], raw: np.ndarray, adj: np.ndarray):
    """Distinct n-grams in order, with their counts."""
    o = _order(cols, len(words).bit_length())
    cols = [c[o] for c in cols]
    first = _starts(*cols)
    return words, [c[first] for c in cols], _sum(raw[o], first), _sum(adj[o], first)


def _count_texts(order: int, spread: Spread):
    most = max(RUN, 128 * min(spread.shards, common.MOST_SHARDS))

    def flush(held):
        h, at = np.concatenate([x for x, _ in held]), [np.zeros(1, np.int64)]
        for _, t in held:
            at.append(t[1:] + at[-1][-1])
        words, own = np.unique(np.append(h, BOS), return_inverse=True)
        bos, own = own[-1], own[:-1].astype(np.int32)
        cols = [*contexts(own, np.concatenate(at), order, bos), own]
        one = np.ones(len(h), np.int64)
        words, cols, raw, _ = _summed(words, cols, one, one)
        return _blocks(words, cols, raw, raw, spread)

    def run(batches):
        held, n = [], 0
        for b in batches:
            for _, _, data, offs in pieces(*buffers(b.column(0))):
                held.append(text_hashes(data, offs))
                n += len(held[-1][0])
                if n >= most:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _split(spread: Spread):
    """For ``by_shard``: blocks of the first exchange cut by shard; lines and sums of lower orders don't come here."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            for x in b.column(1).to_pylist():
                held.append(x)
                n += int.from_bytes(x[:8], "little")
                if n >= 1 << 25:
                    yield _blocks(*_summed(*_gathered(held)), spread, True)
                    held, n = [], 0
        if held:
            yield _blocks(*_summed(*_gathered(held)), spread, True)

    return run


class Store:
    """Files of arrays in the shared folder."""

    def __init__(self, uri: str):
        self.uri = uri if ":" in uri.split("/")[0] else f"file://{uri}"

    def _at(self, name: str = "") -> tuple[fs.FileSystem, str]:
        if m := re.match(r"file:/*", self.uri):
            return fs.LocalFileSystem(), f"/{self.uri[m.end():]}/{name}"
        store, path = fs.FileSystem.from_uri(self.uri)
        return store, f"{path}/{name}"

    def make(self) -> None:
        store, path = self._at()
        store.create_dir(path)

    def delete(self) -> None:
        store, path = self._at()
        store.delete_dir(path)

    def save(self, name: str, arrays: dict[str, np.ndarray]) -> int:
        """Writes one file; returns its bytes. Arrays begin at multiples of 16."""
        store, path = self._at(name)
        places, at = {}, 0
        for k, x in arrays.items():
            places[k] = (x.dtype.str, x.shape, at)
            at += -(-x.nbytes // 16) * 16
        head = json.dumps(places).encode()
        head += b" " * (-(len(head) + 16) % 16)
        tmp = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(tmp) as f:
            f.write(len(head).to_bytes(16, "little") + head)
            for x in arrays.values():
                f.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 16))
        store.move(tmp, path)
        return 16 + len(head) + at

    def load(self, name: str, size: int) -> dict[str, np.ndarray]:
        store, path = self._at(name)
        info = store.get_file_info(path)
        if info.type != fs.FileType.File or info.size != size:
            raise FileNotFoundError(f"{path}: a file of {size} bytes was written there, now there is {info.type.name} of {info.size}")
        if isinstance(store, fs.LocalFileSystem):
            raw = np.memmap(path, np.uint8, "r")
        else:
            with store.open_input_file(path) as f:
                raw = np.frombuffer(f.readall(), np.uint8)
        at = 16 + int.from_bytes(raw[:16].tobytes(), "little")
        out = {}
        for k, (kind, shape, s) in json.loads(raw[16:at].tobytes()).items():
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            out[k] = raw[at + s : at + s + n].view(kind).reshape(shape)
        return out


def _merge(level: int, store: Store, spread: Spread, lower: Spread):
    """Merges a shard's blocks: writes its file; returns lower-order blocks (shard >= 0), one line (-1) and sums of fanned
    contexts (-2)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        words, cols, raw, adj = _summed(*_gathered(table.column("block").to_pylist()))
        of = np.bincount(np.minimum(adj, 5), minlength=6)[1:5]
        cf = _starts(*cols[:-1]) if level > 1 else np.zeros(min(len(raw), 1), np.int64)
        ctx = context_hash([words[c[cf]] for c in cols[:-1]], cf)
        word = words[cols[-1]]
        keys = word if level == 1 else pair(np.repeat(ctx, np.diff(np.append(cf, len(raw)))), word)
        o = np.argsort(keys)
        small = _least(np.minimum(adj[o], 255))
        file = {"key": keys[o], "n": small, "big": adj[o][small == 255]}
        if level == 1:
            file["raw"] = raw[o]
        stats = np.stack([_sum(adj, cf), *(_sum((np.minimum(adj, 3) == k).astype(np.int64), cf) for k in (1, 2, 3))], 1)
        _, hot = spread.is_hot(ctx)
        one = stats[:, 0] == 1  # one n-gram counted once: nothing else to keep
        rest = ~hot & ~one
        c = np.argsort(ctx[rest])
        file |= {"one": np.sort(ctx[~hot & one]), "ctx": ctx[rest][c], "stat": _least(stats[rest][c])}
        line = pack(np.array([shard, store.save(f"{level}-{shard}", file), len(raw), raw.sum(), *of]))
        out = pa.table({"shard": pa.array([-1, -2], pa.int32()), "block": pa.array([line, pack(ctx[hot], *stats[hot].T)], pa.binary())})
        if level == 1:
            return out
        # A lower n-gram counts one for each distinct n-gram that it ends; one that begins a text keeps its own count.
        counts = np.where(words[cols[-3]] == BOS, raw, 1) if level > 2 else np.ones(len(raw), np.int64)
        left = [*cols[:-2], cols[-1]]
        return pa.concat_tables([out, pa.Table.from_batches([_blocks(*_summed(words, left, raw, counts), lower)])])

    return run


class Level:
    """One order's memory-mapped arrays."""

    def __init__(self, spec: dict, store: Store):
        self.spread, self.level, self.d, self.hot_stats, self.sizes = spec["spread"], spec["level"], spec["d"], spec["hot_stats"], spec["sizes"]
        self.store, self.open = store, {}

    def part(self, k: int) -> dict[str, np.ndarray]:
        if k not in self.open:
            if len(self.open) >= OPEN:
                del self.open[next(iter(self.open))]
            self.open[k] = self.store.load(f"{self.level}-{k}", int(self.sizes[k]))
        return self.open[k]

    @staticmethod
    def _find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, q)
        at[at == len(keys)] = 0
        return at, (keys[at] == q) if len(keys) else np.zeros(len(q), bool)

    def look(self, ctx: np.ndarray, word: np.ndarray):
        """(count, raw count, context's count, N1, N2, N3+) of each (context, word)."""
        n, key = len(word), word if self.level == 1 else pair(ctx, word)
        shard = self.spread.shard(ctx, word)
        count, raw, stat = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 4), np.float64)
        order = np.argsort(key)
        order = order[np.argsort(shard[order], kind="stable")]
        edge = np.append(_starts(shard[order]), n)
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            i = order[s:e]
            if not self.sizes[k := int(shard[i[0]])]:
                continue  # no n-gram of the corpus belongs here
            part = self.part(k)
            at, ok = self._find(part["key"], key[i])
            got, at = i[ok], at[ok]
            c = part["n"][at].astype(np.int64)
            big = c == 255
            if big.any():
                if "rank" not in part:
                    part["rank"] = np.flatnonzero(part["n"] == 255)
                c[big] = part["big"][np.searchsorted(part["rank"], at[big])]
            count[got] = c
            if self.level == 1:
                raw[got] = part["raw"][at]
            own, back = np.unique(ctx[i], return_inverse=True)
            at, ok = self._find(part["ctx"], own)
            t = np.zeros((len(own), 4))
            if ok.any():
                t[ok] = part["stat"][at[ok]]
            if len(part["one"]):
                t[self._find(part["one"], own)[1], :2] = 1
            stat[i] = t[back]
        if len(self.hot_stats[0]):
            at, ok = self._find(self.hot_stats[0], ctx)
            stat[ok] = self.hot_stats[1][at[ok]]
        return count, raw, stat

    def interpolate(self, ctx: np.ndarray, word: np.ndarray, lower: np.ndarray):
        count, raw, stat = self.look(ctx, word)
        d = self.d
        kept = np.maximum(count - np.where(count > 0, d[np.minimum(count, 3)], 0), 0)
        total = stat[:, 0]
        seen = total > 0
        p = np.where(seen, (kept + (stat[:, 1:] @ d[1:]) * lower) / np.where(seen, total, 1), lower)
        return p, raw


def discounts(of: np.ndarray) -> np.ndarray:
    """(0, D1, D2, D3+) from the numbers of n-grams counted 1 to 4 times; fixed ones where these don't define them."""
    n1, n2, n3, n4 = map(float, of)
    fallback = np.array([0, 0.5, 1.0, 1.5])
    if not (n1 and n2 and n3 and n4):
        return fallback
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if all(0 < d[k] < k for k in (1, 2, 3)) else fallback


class Model:
    def __init__(self, order: int, store: Store, levels: list[dict], train_tokens: int, vocabulary: int):
        self.order, self.store, self.levels = order, store, levels
        self.train_tokens, self.vocabulary = train_tokens, vocabulary
        self._open: list[Level] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def delete(self) -> None:
        """Removes the model's files, once nothing is scored with it any more."""
        self.store.delete()

    def score(self, data: np.ndarray, offs: np.ndarray):
        """By text: tokens, known tokens, add-0.1 unigram log10, model log10."""
        if self._open is None:
            self._open = [Level(x, self.store) for x in self.levels]
        h, at = text_hashes(data, offs)
        before, v = contexts(h, at, self.order), self.vocabulary
        p, base = np.full(len(h), 1 / (v + 1)), np.zeros(len(h))
        known = np.zeros(len(h), np.int64)
        for level in self._open:
            p, raw = level.interpolate(context_hash(before[: level.level - 1], h), h, p)
            if level.level == 1:
                known, c = (raw > 0).astype(np.int64), raw
                base = np.log10((c + 0.1) / (self.train_tokens + 0.1 * (v + 1)))
        add = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else x[:0]
        return np.diff(at), add(known), add(base), add(np.log10(p))


def train(docs: DataFrame, text_col: str = "text", order: int = 3, shards: int | None = None) -> Model:
    """``shards`` bounds a task's memory; it follows the bytes of the texts unless given."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    nbytes = text_bytes(texts)
    shards = shards or shards_for(spark, nbytes)
    store = Store(shared_dir(spark, "ngram-lm"))
    store.make()
    spreads = _spreads(texts, nbytes, order, shards)
    levels, train_tokens, vocabulary, before = [], 0, 0, None
    rows = texts.mapInArrow(_count_texts(order, spreads[order]), _ROWS)
    for level in range(order, 0, -1):
        grouped = by_shard(rows, shards, _split(spreads[level]))
        made = written(spark, grouped.applyInArrow(_merge(level, store, spreads[level], spreads.get(level - 1)), _ROWS), f"ngram-blocks-{level}")
        if before is not None:
            drop_table(spark, before)
        lines, sizes = np.zeros(6, np.int64), np.zeros(shards, np.int64)
        for r in made.where("shard = -1").toLocalIterator():  # a few numbers for each shard
            k, size, *more = unpack(r.block)[0].tolist()
            sizes[k] = size
            lines += more
        levels.insert(0, {"level": level, "spread": spreads[level], "d": discounts(lines[2:]), "hot_stats": _hot_stats(made), "sizes": sizes})
        if level == 1:
            vocabulary, train_tokens = int(lines[0]), int(lines[1])
        rows, before = made.where("shard >= 0"), made
    drop_table(spark, before)
    return Model(order, store, levels, train_tokens, vocabulary)


def _hot_stats(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the fanned contexts, of which there are twice as many as shards for each order at most."""

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                ctx, *stats = unpack(x)
                yield pa.record_batch([pa.array(ctx.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in stats)], list("cabde"))

    sums = made.where("shard = -2").select("block").mapInArrow(run, "c long, a long, b long, d long, e long").groupBy("c").agg(*(F.sum(x).alias(x) for x in "abde")).toArrow()
    keys = np.asarray(sums.column("c").combine_chunks()).view(U)
    o = np.argsort(keys)
    return keys[o], np.stack([np.asarray(sums.column(x).combine_chunks()) for x in "abde"], 1).astype(np.float64).reshape(-1, 4)[o]


def _spreads(texts: DataFrame, nbytes: int, order: int, shards: int) -> dict[int, Spread]:
    """For each order the contexts that hold more than half of a shard's share of a sample, and their fans.

    The sample is of whole texts by a hash, about SAMPLE bytes for each shard; it only steers the load.
    """
    out = {1: Spread(shards, np.array([EMPTY]), np.array([shards]))}
    every = max(1, nbytes // (SAMPLE * shards))

    def run(batches):
        for b in batches:
            for _, _, data, offs in pieces(*buffers(b.column(0))):
                h, at = text_hashes(data, offs)
                before = contexts(h, at, order)
                for n in range(1, order):
                    ctx, count = np.unique(context_hash(before[:n], h), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(ctx), n + 1, np.int32)), pa.array(ctx.view(np.int64)), pa.array(count)], ["level", "ctx", "n"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = some.mapInArrow(run, "level int, ctx long, n long").groupBy("level", "ctx").agg(F.sum("n").alias("n"))
    shares = counts.groupBy("level").agg(F.sum("n").alias("total"))
    hot = counts.join(F.broadcast(shares), "level").select("level", "ctx", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") * 2 * shards > 1).collect()
    for level in range(2, order + 1):
        mine = sorted((r.ctx % (1 << 64), r.share) for r in hot if r.level == level)
        out[level] = Spread(shards, np.array([x for x, _ in mine], U), np.array([min(shards, int(2 * s * shards) + 1) for _, s in mine], np.int64))
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of whole texts."""

    # More shards get more text at a time, so that each is asked for some of it.
    size = min(max(2 * common.BLOCK, model.levels[0]["spread"].shards << 12), 16 * common.BLOCK)

    def run(batches):
        for b in batches:
            got = [model.score(data, offs) for _, _, data, offs in pieces(*buffers(b.column(1)), size)]
            cols = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0)] * 4
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str = "doc_id", folds: int = 10) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == 0
