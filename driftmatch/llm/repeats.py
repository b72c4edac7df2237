"""Removal of bytes that repeat earlier ones: exact, for strings of ``width`` bytes, over any number of documents.

How the repeats are found. A window of ``width`` bytes is owned by its least ``gram``-byte gram (by hash, the leftmost
among equals), so equal windows are owned by equal grams at equal places in them, and a text has an owner about every 36
bytes. An owner's span is all its windows together. Equal spans are wholly repeated: the first stays, the others go,
and this settles all but the borders of repeats. At a border two owners have one gram and different spans; they can
share a window only if half the bytes around the gram agree on the left or on the right. Those few spans are cut into
windows, and equal windows (128-bit hashes) are grouped the same way.

Every task first settles what repeats inside its own run of texts, so a passage that a third of all documents share
reaches a shard once for each run. A gram with very many different spans in one run goes straight to windows, and a
marker makes the other runs do so too. Nothing is capped, and no group is collected but a shard, of which there is one
for every ``SHARD_BYTES`` bytes of text.

``suffix_array`` is the linear grouping construction (groups of suffixes by Lyndon prefix, in descending order). It is
the method dealt for this operator; in Python it takes microseconds a byte, which no budget of a whole corpus allows
(the README has the figures), so it serves ``removed_by_suffix_array`` for one block of texts and the tests.

A null or empty text has no bytes. Rows of one id and different texts are documents of their own, in the order of a hash
of their texts; rows of one id and one text are one document, with one result for each row. A row without an id keeps
all its bytes and takes none from others. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmatch.llm import common
from driftmatch.llm.common import BYTE, U, buffers, by_shard, drop_table, mix, pack, pieces, powers, shards_for, text_bytes, unpack, written

WIDTH, GRAM, RUN, HOT = 100, 32, 1 << 18, 64
#: Columns of the packed blocks. A document is its id and a tie, which is 0 unless ids repeat.
OWNERS = (np.uint64, np.uint64, np.uint16, np.uint16, np.int64, np.int64, np.int64, np.int32)  # gram, span, left, right, doc, tie, first window, windows - 1
RANGES = (np.int64, np.int64, np.int64, np.int64)  # doc, tie, start, end
WINDOWS = (np.uint64, np.uint64, np.int64, np.int64, np.int64)  # two hashes, doc, tie, start
_ALT = mix(BYTE)


def _hashes(x: np.ndarray, values: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(x))
    sums = np.zeros(len(x) + 1, U)
    np.cumsum(values[x] * up[: len(x)], out=sums[1:])
    return sums, down


def owners(x: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """(gram hash, span hash, left hash, right hash, first window, windows - 1) of a text's owners, in order."""
    n, reach = len(x), width - gram + 1
    sums, down = _hashes(x)
    h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    m, w = h, 1
    while w * 2 <= reach:
        m = np.minimum(m[: len(m) - w], m[w:])
        w *= 2
    if reach > w:
        m = np.minimum(m[: len(m) - (reach - w)], m[reach - w :])
    cut = np.flatnonzero(m[1:] != m[:-1]) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(m) - 1]])
    at = np.empty(len(a), np.int64)
    for s in range(0, len(a), 1 << 12):  # the least gram's place in a run's first window
        e = s + (1 << 12)
        at[s:e] = a[s:e] + (h[a[s:e, None] + np.arange(reach)] == m[a[s:e], None]).argmax(1)
    many = np.flatnonzero(b > at)
    if len(many):  # the least gram comes again within the run: each window belongs to the first that it holds
        more = []
        for k in many.tolist():
            p = a[k] + np.flatnonzero(h[a[k] : b[k] + reach] == m[a[k]])
            starts = np.concatenate([[a[k]], p[:-1] + 1])
            ok = starts <= b[k]
            more.append(np.stack([starts[ok], np.minimum(p[ok], b[k]), p[ok]]))
        keep = np.ones(len(a), bool)
        keep[many] = False
        a, b, at = (np.concatenate([x[keep], *(y[i] for y in more)]) for i, x in enumerate((a, b, at)))
        o = np.argsort(a, kind="stable")
        a, b, at = a[o], b[o], at[o]
    piece = lambda s, e, v: mix((sums[e] - sums[s]) * down[s] + v.astype(U))
    half = (width - gram) // 2
    left, right = np.maximum(at - half, 0), np.minimum(at + gram + half, n)
    return h[at], piece(a, b + width, b - a), (piece(left, at, at - left) >> U(48)).astype(np.uint16), (piece(at + gram, right, right - at) >> U(48)).astype(np.uint16), a, (b - a).astype(np.int32)


def windows(x: np.ndarray, first: np.ndarray, more: np.ndarray, width: int = WIDTH):
    """(two hashes, start) of the windows first .. first + more."""
    n = more + 1
    s = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = []
    for values in (BYTE, _ALT):
        sums, down = _hashes(x, values)
        out.append(mix((sums[s + width] - sums[s]) * down[s]))
    return out[0], out[1], s


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray, tie: np.ndarray, pos: np.ndarray):
    """(order by keys, doc, tie, pos; whether each in that order has an earlier equal; where groups begin)."""
    o = np.lexsort((pos, tie, doc, *keys[::-1]))
    new = np.ones(len(o), bool)
    for i, k in enumerate(keys):
        s = k[o]
        new[1:] = (s[1:] != s[:-1]) if i == 0 else new[1:] | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    later = np.zeros(len(o), bool)
    for x in (doc, tie, pos):
        s = x[o]
        later |= s != s[first][group]
    return o, later, new


def merged(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping and touching ranges of a document joined."""
    o = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[o], tie[o], start[o], end[o]
    if not len(doc):
        return doc, tie, start, end
    shift = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))]) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], tie[at], start[at], np.append(reach[at[1:] - 1], reach[-1]) - shift[at]


def _emit(found: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kind, shard, block = zip(*found) if found else ((), (), ())
    return pa.record_batch([pa.array(kind, pa.string()), pa.array(shard, pa.int32()), pa.array(block, pa.binary())], ["kind", "shard", "block"])


def _sharded(kind: str, shards: int, cols) -> list[tuple[str, int, bytes]]:
    """A block for each shard of the rows by their first column; with many shards see ``by_shard``."""
    shard, n = (cols[0] % U(shards)).astype(np.int64), shards
    if shards > common.MOST_SHARDS:
        n = common.MOST_SHARDS
        shard %= n
    return _cut(kind, shard, n, cols)


def _cut(kind: str, shard: np.ndarray, n: int, cols) -> list[tuple[str, int, bytes]]:
    o = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[o], np.arange(n + 1))
    return [(kind, k, pack(*(c[o[cut[k] : cut[k + 1]]] for c in cols))) for k in np.flatnonzero(np.diff(cut)).tolist()]


def _split(kind: str, types, shards: int):
    """For ``by_shard``: blocks of ``kind`` cut by shard, the others as they are."""

    def run(batches):
        held, n = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*held)]
            shard = (cols[0] % U(shards)).astype(np.int64)
            own, shard = np.unique(shard, return_inverse=True)
            return _emit([(k, int(own[s]), x) for k, s, x in _cut(kind, shard, len(own), cols)])

        for b in batches:
            for k, s, x in zip(*(c.to_pylist() for c in b.columns)):
                if k != kind:
                    yield _emit([(k, s, x)])
                    continue
                held.append(unpack(x, *types))
                n += len(held[-1][0])
                if n >= 8 * RUN:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


_COLS = "kind string, shard int, block binary"


def _settle(rows: list, texts: list, shards: int, width: int) -> list[tuple[str, int, bytes]]:
    """A run's owners: its inner repeats as ranges, its hot grams' windows, the rest for the shards."""
    g, s, left, right, doc, tie, a, more, row = (np.concatenate(c) for c in zip(*rows))
    o, later, new = _later((g, s), doc, tie, a)
    out = []
    d = o[later]
    if len(d):
        out.append(("range", 0, pack(*merged(doc[d], tie[d], a[d], a[d] + more[d] + width))))
    o = o[new]
    begins = np.concatenate([[True], g[o][1:] != g[o][:-1]]) if len(o) else np.zeros(0, bool)
    group = np.cumsum(begins) - 1
    hot = np.bincount(group)[group] > HOT if len(o) else begins
    cold, warm = o[~hot], o[hot]
    marks = o[hot & begins]  # one row without a document for each hot gram
    cols = [np.concatenate([c[cold], c[marks]]) for c in (g, s, left, right, doc, tie, a, more)]
    cols[-1][len(cold) :] = -1
    out += _sharded("owner", shards, cols)
    if len(warm):
        parts = []
        for k in np.unique(row[warm]).tolist():
            mine = warm[row[warm] == k]
            w = windows(texts[k], a[mine], more[mine], width)
            parts.append((w[0], w[1], np.full(len(w[0]), doc[mine[0]]), np.full(len(w[0]), tie[mine[0]]), w[2]))
        out += _window_rows(parts, shards, width)
    return out


def _window_rows(parts: list, shards: int, width: int) -> list:
    h1, h2, doc, tie, pos = (np.concatenate(c) for c in zip(*parts))
    o, later, new = _later((h1, h2), doc, tie, pos)
    out, d = [], o[later]
    if len(d):
        out.append(("range", 0, pack(*merged(doc[d], tie[d], pos[d], pos[d] + width))))
    o = o[new]
    return out + _sharded("window", shards, (h1[o], h2[o], doc[o], tie[o], pos[o]))


def _find_owners(shards: int, width: int, gram: int):
    most = max(RUN, 64 * min(shards, common.MOST_SHARDS))

    def run(batches):
        rows, texts, n = [], [], 0
        for b in batches:
            ids, ties = (np.asarray(b.column(k)) for k in (0, 1))
            for first, _, data, offs in pieces(*buffers(b.column(2))):
                for i in np.flatnonzero(np.diff(offs) >= width).tolist():
                    x = data[offs[i] : offs[i + 1]]
                    got = owners(x, width, gram)
                    same = lambda v: np.full(len(got[0]), v, np.int64)
                    rows.append((*got[:4], same(ids[first + i]), same(ties[first + i]), *got[4:], same(len(texts))))
                    texts.append(x.copy())
                    n += len(got[0])
                    if n >= most:
                        yield _emit(_settle(rows, texts, shards, width))
                        rows, texts, n = [], [], 0
        if n:
            yield _emit(_settle(rows, texts, shards, width))

    return run


def _match_owners(width: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        blocks = table.column("block")
        out = [(k, int(n.as_py()), x.as_py()) for k, n, x in zip(kinds, table.column("shard"), blocks) if k != "owner"]
        parts = [unpack(x.as_py(), *OWNERS) for k, x in zip(kinds, blocks) if k == "owner"]
        if not parts:
            return pa.Table.from_batches([_emit(out)])
        g, s, left, right, doc, tie, a, more = map(np.concatenate, zip(*parts))
        mark = more < 0
        marked = np.isin(g, np.unique(g[mark]))
        g, s, left, right, doc, tie, a, more, marked = (x[~mark] for x in (g, s, left, right, doc, tie, a, more, marked))
        o, later, new = _later((g, s), doc, tie, a)
        d = o[later]
        if len(d):
            out.append(("range", -1, pack(*merged(doc[d], tie[d], a[d], a[d] + more[d] + width))))
        o = o[new]
        unclear = marked[o]
        for side in (left, right):
            key = np.lexsort((side[o], g[o]))
            x, y = g[o][key], side[o][key]
            same = np.zeros(len(o) + 1, bool)
            same[1:-1] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            unclear[key[same[1:] | same[:-1]]] = True
        d = o[unclear]
        if len(d):
            out.append(("border", -1, pack(doc[d], tie[d], a[d], a[d] + more[d])))
        return pa.Table.from_batches([_emit(out)])

    return run


def _match_windows(width: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x, *WINDOWS) for x in table.column("block").to_pylist()]
        h1, h2, doc, tie, pos = map(np.concatenate, zip(*parts))
        o, later, _ = _later((h1, h2), doc, tie, pos)
        d = o[later]
        return pa.Table.from_batches([_emit([("range", -1, pack(*merged(doc[d], tie[d], pos[d], pos[d] + width)))] if len(d) else [])])

    return run


def _flat(blocks: DataFrame) -> DataFrame:
    """(doc_id, tie, s, e) of packed ranges."""

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.record_batch([pa.array(c) for c in unpack(x, *RANGES)], ["doc_id", "tie", "s", "e"])

    return blocks.select("block").mapInArrow(run, "doc_id long, tie long, s long, e long")


def _small(texts: DataFrame) -> DataFrame:
    """(doc_id, tie, z): the texts compressed one by one, for joins that shuffle them."""

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(2))
            z = [pack(data[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(z, pa.binary())], ["doc_id", "tie", "z"])

    return texts.mapInArrow(run, "doc_id long, tie long, z binary")


def _bytes(z: pa.Scalar) -> np.ndarray:
    return unpack(z.as_py(), np.uint8)[0]


def _by_doc(ranges: DataFrame) -> DataFrame:
    """A document's ranges in one array: no more of them than it has bytes."""
    return ranges.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("s", "e")).alias("r"))


def _pairs(col: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    r = col[i].values
    return np.asarray(r.field("s")), np.asarray(r.field("e"))


def _border_windows(shards: int, width: int):
    def run(batches):
        parts, n = [], 0
        for b in batches:
            r = b.column(3)
            for i in range(len(b)):
                x = _bytes(b.column(2)[i])
                a, last = _pairs(r, i)
                keep = last + width <= len(x)
                w = windows(x, a[keep], last[keep] - a[keep], width)
                same = lambda k: np.full(len(w[0]), b.column(k)[i].as_py(), np.int64)
                parts.append((w[0], w[1], same(0), same(1), w[2]))
                n += len(w[0])
                if n >= RUN:
                    yield _emit(_window_rows(parts, shards, width))
                    parts, n = [], 0
        if parts:
            yield _emit(_window_rows(parts, shards, width))

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tie, text)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = own.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return own.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie") if repeated else F.lit(0).cast("long").alias("tie"), "text")


def _removed(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(doc_id, tie, s, e): byte ranges that repeat earlier ones; they may overlap."""
    spark = texts.sparkSession
    texts = texts.where("doc_id is not null")
    shards = shards_for(spark, text_bytes(texts))
    found = by_shard(texts.mapInArrow(_find_owners(shards, width, gram), _COLS), shards, _split("owner", OWNERS, shards)).applyInArrow(_match_owners(width), _COLS)
    clear = written(spark, found, "repeats-spans")
    borders = _by_doc(_flat(clear.where("kind = 'border'")))
    cut = written(spark, _small(texts).join(borders, ["doc_id", "tie"]).select("doc_id", "tie", "z", "r").mapInArrow(_border_windows(shards, width), _COLS), "repeats-windows")
    some = cut.where("kind = 'window'").union(clear.where("kind = 'window'"))
    matched = written(spark, by_shard(some, shards, _split("window", WINDOWS, shards)).applyInArrow(_match_windows(width), _COLS), "repeats-matched")
    pure = lambda df: df.where("kind = 'range'")
    ranges = written(spark, _flat(pure(clear).union(pure(cut)).union(pure(matched))), "repeats-ranges")
    for done in (clear, cut, matched):
        drop_table(spark, done)
    return ranges


def removed_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, s, e): byte ranges that repeat earlier ones; they may overlap. ``tie`` tells rows of one id apart by their texts."""
    return _removed(_texts(docs, id_col, text_col), width, gram)


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and the kept bytes as ``kept`` if ``with_bytes``."""
    texts = _texts(docs, id_col, text_col)
    ranges = _by_doc(_removed(texts, width, gram))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes

    def run(batches):
        for b in batches:
            rows = []
            for i in range(len(b)):
                x = _bytes(b.column(1)[i])
                gone = n = 0
                if b.column(2)[i].is_valid:
                    s, e = _pairs(b.column(2), i)
                    none = np.zeros(len(s), np.int64)
                    *_, s, e = merged(none, none, s, e)
                    n, gone = len(s), int((e - s).sum())
                    stay = np.stack([np.concatenate([[0], e]), np.concatenate([s, [len(x)]])], 1).tolist()
                    kept = b"".join(x[a:z].tobytes() for a, z in stay)
                else:
                    kept = x.tobytes()
                rows.append((len(x), gone, n, sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols[: len(names) - 1], types))], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return _small(texts).join(ranges, ["doc_id", "tie"], "left").select("doc_id", "z", "r").mapInArrow(run, schema)


def suffix_array(text) -> list[int]:
    """Starts of the sorted suffixes of a sequence of integers, by linear grouping.

    First phase: suffixes are grouped by their first symbol; the groups are taken in descending order, and every suffix
    of one points to the nearest one on its left that no group taken so far holds. Those pointed at k times continue
    with k copies of the taken group's prefix, so they leave their group for a higher one. In the end each group holds
    the suffixes of one longest Lyndon prefix. Second phase: what follows a suffix's Lyndon prefix is a smaller suffix,
    so one ascending pass puts every suffix at its group's next free place.
    """
    n = len(text)
    length: list[int] = []
    members: list[list[int]] = []
    below: list[int] = []  # the next lower group
    group = [0] * n
    by: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by.setdefault(int(c), []).append(i)
    top = -1
    for c in sorted(by):
        for i in by[c]:
            group[i] = len(members)
        members.append(by[c])
        length.append(1)
        below.append(top)
        top = len(members) - 1
    done, prev = bytearray(n), [-1] * n
    above = {below[g]: g for g in range(len(members))}
    order: list[int] = []
    g = top
    while g >= 0:
        mine = sorted(i for i in members[g] if group[i] == g)
        members[g] = mine
        for i in mine:
            done[i] = 1
        hits: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in hits.items():
            moved.setdefault((group[j], k), []).append(j)
        for h, k in sorted(moved, key=lambda x: (x[0], -x[1])):  # more copies stand higher
            new, up = len(members), above[h] if h in above else g
            members.append(moved[h, k])
            length.append(length[h] + k * length[g])
            for j in moved[h, k]:
                group[j] = new
            # Directly above h: what was put there a moment ago has more copies.
            below.append(h)
            below[up] = new
            above[h], above[new] = new, up
        if mine:
            order.append(g)
        g = below[g]
    order.reverse()
    slot, at = {}, 0
    for g in order:
        slot[g] = at
        at += len(members[g])
    kids: list[list[int]] = [[] for _ in range(n + 1)]
    for g in order:
        for i in members[g]:
            kids[i + length[g]].append(i)
    sa = [0] * n
    for j in kids[n]:
        sa[slot[group[j]]] = j
        slot[group[j]] += 1
    for p in range(n):
        for j in kids[sa[p]]:
            sa[slot[group[j]]] = j
            slot[group[j]] += 1
    return sa


def removed_by_suffix_array(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For texts in their order, whether each byte repeats an earlier one's string: for one block that fits a task."""
    flat: list[int] = []
    for k, t in enumerate(texts):
        flat += [*t, 256 + k]  # its own end for each text: no common prefix runs over it
    sa, n = suffix_array(flat), len(flat)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    lcp, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = sa[rank[i] - 1]
            while i + h < n and j + h < n and flat[i + h] == flat[j + h]:
                h += 1
            lcp[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    gone = np.zeros(n, bool)
    s = 0
    while s < n:
        e = s + 1
        while e < n and lcp[e] >= width:
            e += 1
        first = min(sa[s:e])
        for i in sa[s:e]:
            if i != first:
                gone[i : i + width] = True
        s = e
    out, at = [], 0
    for t in texts:
        out.append(gone[at : at + len(t)])
        at += len(t) + 1
    return out
