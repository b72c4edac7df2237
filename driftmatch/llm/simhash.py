"""SimHash near-duplicates: exact links at a Hamming distance of 2 or less.

Candidates come from a segment-popcount embedding. A fingerprint's 64 bits are cut into 32 segments of two bits; the
vector of their popcounts moves by at most one unit for every flipped bit, so the Manhattan distance of two vectors is
a lower bound of the Hamming distance. Two vectors within distance 2 agree to within 1 on the first 16 coordinates or
on the last 16, so each half is a grid whose cells are joined with themselves and with the cells one step up; the pairs
are then verified by ``bit_count(a ^ b)``. No link is lost. Equal fingerprints are one node from the start, so groups of
copies never expand into pairs. Components: alternating large-star and small-star rounds, each written to the shared
folder.

Nulls count as empty texts, empty texts have fingerprint zero and are linked like any others, repeated ``doc_id`` give
one row each, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmatch.llm.common import buffers, drop_table, fresh, tidy, written

SEED, CHUNK = 42, 1 << 17


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text`` (UTF-8), repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        h = xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return h - (1 << 64) if h >> 63 else h
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        h = np.array([digest(join(x), SEED) for x in zip(*(part[k:] for k in range(shingle)))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long)."""

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            raw = memoryview(data)
            fps = [fingerprint(bytes(raw[s:e]), shingle) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


#: Popcounts of the sixteen two-bit segments of a half, as two-bit fields: 11 becomes 10, 10 becomes 01.
_COUNTS = "(({h} - (shiftrightunsigned({h}, 1) & 1431655765L)))"


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b for all pairs of distinct ``fp`` that differ in one or two bits."""
    halves = nodes.select("fp", F.explode(F.expr("array(named_struct('half', 0, 'h', fp & 4294967295L), named_struct('half', 1, 'h', shiftrightunsigned(fp, 32)))")).alias("x"))
    cells = halves.select("fp", F.col("x.half").alias("half"), F.expr(_COUNTS.format(h="x.h")).alias("cell"))
    # A step up in coordinate i is possible where its two-bit count is below 2.
    up = F.expr("transform(filter(sequence(0, 15), i -> (shiftrightunsigned(cell, 2 * i) & 3L) < 2), i -> cell + shiftleft(1L, 2 * i))")
    probes = cells.select(F.col("fp").alias("q"), "half", F.explode(F.concat(F.array("cell"), up)).alias("cell"), F.col("cell").alias("own"))
    # In the same cell both sides probe each other; of these the smaller one's probe counts.
    near = (F.expr("bit_count(q ^ fp)") <= 2) & ((F.col("own") != F.col("cell")) | (F.col("q") < F.col("fp")))
    found = probes.join(cells, ["half", "cell"]).where(near)
    return found.select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b")).distinct()


def components(spark: SparkSession, pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``pairs`` (a, b), root being the component's least node (large-star, small-star)."""
    edges, before = written(spark, pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), "edges"), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select("v", "m").where("v <> m").distinct()  # v hangs on the least neighbour
        low = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(low, "v").select(F.explode(F.expr("array(struct(v as u, r as v), struct(m as u, r as v))")).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(spark, small, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(spark, edges)
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the least doc_id of all documents reachable over links."""
    spark = docs.sparkSession
    fps = written(spark, fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    of = components(spark, links(nodes))
    roots = nodes.join(of, nodes.fp == of.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = roots.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


BANDS, SAMPLED = 10, 4
_PERMUTE = (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles; of fewer words, the whole sequence; of none, nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    k = min(shingle, len(words))
    return np.unique(np.array([digest(join(x), SEED) for x in zip(*(words[i:] for i in range(k)))], np.uint64))


def _sampled(h: np.ndarray) -> np.ndarray:
    """For each band the SimHash of the SAMPLED shingles that its permutation puts first."""
    x = h[None, :] * _PERMUTE[:, None]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    if len(h) > SAMPLED:
        x = np.take_along_axis(x, np.argpartition(x, SAMPLED - 1, axis=1)[:, :SAMPLED], 1)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(BANDS, -1, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(1) > x.shape[1], axis=1, bitorder="little").view("<i8")[:, 0]


#: One document of so many is counted for the order of shingles; the most shingles that it holds.
FREQUENT_OF, FREQUENT = 16, 1 << 19


def _need(x: float) -> int:
    """The least whole number that is ``x`` or more; a rounding error above a whole number doesn't count."""
    return math.ceil(x - 1e-9)


def _prefix(h: np.ndarray, seen: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles in one order for all texts, rarest first: so many that a text of the likeness, of the same
    number of shingles or less, must hold one of them."""
    hashes, counts = seen
    if len(h) and len(hashes):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        h = h[np.argsort(np.where(hashes[at] == h, counts[at], 0), kind="stable")]
    return h[: len(h) - _need(similarity * len(h)) + 1].copy() if len(h) else h


def _frequent(base: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles found most often in a fixed share of the texts, so that those which are left out
    stand in about as many texts at every size; bounded. It only sets the order of ``_prefix``."""
    spark = base.sparkSession

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(0))
            raw = memoryview(data)
            for at in range(0, len(b), 256):
                part = [_shingles(bytes(raw[s:e]), shingle) for s, e in zip(offs[at:-1][:256].tolist(), offs[at + 1 :][:256].tolist())]
                h, n = np.unique(np.concatenate(part), return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    some = base.where(F.pmod(F.xxhash64("doc_id"), F.lit(FREQUENT_OF)) == 0).select("text")
    counted = some.mapInArrow(tidy(run), "h long, n int").groupBy("h").agg(F.sum("n").cast("int").alias("n")).where("n > 2")
    counted, rows, least = written(spark, counted, "frequent"), 0, 3
    for n, more in sorted(((r.n, r["count"]) for r in counted.groupBy("n").count().collect()), reverse=True):
        rows += more
        if rows > FREQUENT:
            least = n + 1
            break
    found = counted.where(F.col("n") >= least).toArrow()
    drop_table(spark, counted)
    h, n = np.asarray(found.column("h").combine_chunks()).view(np.uint64), np.asarray(found.column("n").combine_chunks())
    o = np.argsort(h)
    return h[o], n[o]


#: Cells of 64 bits of the filter of ids.
CELLS = 1 << 18


def _marked(rows: DataFrame, id_col: str, ids: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a boolean ``mark``: false where the id isn't one of ``ids`` (id), true where it may be. A bitmap of CELLS
    cells at most is broadcast, no row is shuffled."""
    spot = lambda c: F.xxhash64(F.col(c).cast("long"))
    cell, bits = fresh(rows, "__cell"), fresh(rows, "__bits")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), spot(c).bitwiseAND(F.lit(63)).cast("int"))
    place = lambda c: F.shiftrightunsigned(spot(c), 6).bitwiseAND(F.lit(CELLS - 1))
    cells = ids.groupBy(place("id").alias(cell)).agg(F.bit_or(bit("id")).alias(bits))
    found = rows.join(F.broadcast(cells), place(id_col) == F.col(cell), "left")
    return found.withColumn(mark, F.coalesce(F.col(bits).bitwiseAND(bit(id_col)), F.lit(0)) != 0).drop(cell, bits)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose whole shingle sets are alike."""
    ta, tb = (_marked(texts, "doc_id", pairs.select(F.col(k).alias("id")), "in").where(F.col("in")).select(F.col("doc_id").alias(k), F.col("text").alias("t" + k)) for k in "ab")
    both = pairs.join(tb, "b").join(ta, "a")

    def verify(batches):
        for b in batches:
            last: tuple = (None, None)
            keep = []
            for i in range(len(b)):  # one text at a time in Python's memory
                x, y = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                if x != last[0]:
                    last = (x, _shingles((x or "").encode(), shingle))
                other = _shingles((y or "").encode(), shingle)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                if both >= similarity * (len(last[1]) + len(other) - both):
                    keep.append(i)
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(verify), "a long, b long")


def copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) by verified likeness: a Jaccard similarity of ``similarity`` or more on word shingles.

    Components are those of all links of that likeness; none is lost. Texts of equal words are one node. The first round
    takes the links that are cheap to find: texts whose SimHashes are within two bits, or whose SimHashes of a few
    sampled shingles are equal (each member of such a group is compared with the one that has most neighbours in its
    groups). The second round is exact: two alike texts share some of the first shingles of each in a common order, rarest
    first (prefix filter); all pairs that share as many as sizes and places ask for, and that the first round has
    not put in one component are compared. Every candidate is verified on its whole shingle sets. Ids are taken to be unique;
    texts without words are copies of each other.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    shared = spark.sparkContext.broadcast(_frequent(base, shingle))

    def sketch(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            raw, same, whole, bands, sizes, first = memoryview(data), [], [], [], [], []
            for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
                text = bytes(raw[s:e])
                same.append(xxhash.xxh128_hexdigest(b" ".join(text.lower().split())))
                whole.append(fingerprint(text, shingle))
                h = _shingles(text, shingle)
                bands.append(_sampled(h).tolist() if len(h) else [])
                sizes.append(len(h))
                first.append(_prefix(h, shared.value, similarity).view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(same, pa.string()), pa.array(whole, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "same", "fp", "bands", "size", "prefix"])

    sketches = written(spark, base.mapInArrow(tidy(sketch), "doc_id long, same string, fp long, bands array<long>, size int, prefix array<long>"), "sketches")
    firsts = sketches.groupBy("same").agg(F.min("doc_id").alias("first")).select(F.col("first").alias("doc_id"), "first")
    nodes = written(spark, sketches.join(firsts, "doc_id").select("same", "first", "fp", "bands", "size", "prefix"), "nodes")
    whole, sketches = sketches, written(spark, sketches.select("doc_id", "same"), "words")
    drop_table(spark, whole)
    texts = base.select("doc_id", "text")

    keyed = nodes.select("first", F.posexplode("bands").alias("band", "key")).withColumn("n", F.count("*").over(Window.partitionBy("band", "key"))).where("n > 1")
    groups = written(spark, keyed, "samples")
    degrees = groups.groupBy("first").agg(F.sum("n").alias("degree"))
    hubs = groups.join(degrees, "first").groupBy("band", "key").agg(F.max_by("first", F.struct("degree", -F.col("first"))).alias("hub"))
    by_sample = groups.join(hubs, ["band", "key"]).select(F.least("hub", "first").alias("a"), F.greatest("hub", "first").alias("b"))
    by_fp = nodes.groupBy("fp").agg(F.min("first").alias("a"))
    equal = nodes.join(by_fp, "fp").select("a", F.col("first").alias("b"))
    one, two = by_fp.select(F.col("fp").alias("x"), F.col("a").alias("d1")), by_fp.select(F.col("fp").alias("y"), F.col("a").alias("d2"))
    near = links(by_fp.select("fp"))
    near = near.join(one, near.a == one.x).join(two, near.b == two.y).select(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b"))
    pairs = written(spark, by_sample.union(equal).union(near).where("a <> b").distinct(), "pairs")
    found = written(spark, _verified(pairs, texts, shingle, similarity), "found")
    of = components(spark, found)

    # What alike texts x and y have in common is t/(1+t) of both their numbers of shingles or more.
    least = similarity / (1 + similarity)
    common = Window.partitionBy("key")
    held = nodes.select("first", "size", F.posexplode("prefix").alias("at", "key")).withColumn("n", F.count("*").over(common)).where("n > 1").drop("n")
    held = held.join(of, held["first"] == of.node, "left").select("first", "size", "at", "key", F.coalesce("root", "first").alias("root"))
    held = held.withColumn("lo", F.min("root").over(common)).withColumn("hi", F.max("root").over(common)).where("lo <> hi").drop("lo", "hi")
    # Shingles that stand in the same texts are one row of each: ``n`` of them, from place ``at`` to place ``last``.
    for c, e in (("same", F.xxhash64("first")), ("texts", F.xxhash64("first", "size"))):
        held = held.withColumn(c, F.bit_xor(e).over(common))
    held = written(spark, held.groupBy("same", "texts", "first", "size", "root").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.max("at").alias("last")), "prefixes")
    x, y = (held.select("same", "texts", *(F.col(c).alias(c + k) for c in ("first", "size", "n", "at", "last", "root"))) for k in "xy")
    smaller = F.struct("sizex", "firstx") < F.struct("sizey", "firsty")
    needed = least * (F.col("sizex") + F.col("sizey")) - 1e-6
    most = F.least("atx", "aty") + F.least(F.col("sizex") - F.col("atx"), F.col("sizey") - F.col("aty"))
    rest = x.join(y, ["same", "texts"]).where((F.col("rootx") != F.col("rooty")) & smaller & (F.col("sizex") >= similarity * F.col("sizey") - 1e-6) & (most >= needed))
    # Both prefixes are whole, so what else is common lies behind the last common shingle in both, and behind the prefix of one.
    rest = rest.groupBy("firstx", "firsty", "sizex", "sizey").agg(F.sum("nx").alias("n"), F.max("lastx").alias("lastx"), F.max("lasty").alias("lasty"))
    behind = lambda k: F.ceil(similarity * F.col("size" + k) - 1e-9) - 1
    after = lambda k: F.col("size" + k) - F.col("last" + k) - 1
    rest = rest.where(F.col("n") + F.greatest(F.least(behind("x"), after("y")), F.least(after("x"), behind("y"))) >= needed)
    rest = rest.select(F.least("firstx", "firsty").alias("a"), F.greatest("firstx", "firsty").alias("b")).join(pairs, ["a", "b"], "left_anti")
    rest = written(spark, rest, "rest")
    of = components(spark, found.union(_verified(rest, texts, shingle, similarity)))
    ids = nodes.join(of, nodes["first"] == of.node, "left").select("same", F.coalesce("root", "first").alias("component_id"))
    return sketches.join(ids, "same").select("doc_id", "component_id")


def without_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are copies of one with a smaller id."""
    spark = docs.sparkSession
    name, mark = fresh(docs, "__copy"), fresh(docs, "__mark")
    extra = written(spark, copies(docs, shingle, similarity, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "copies")
    marked = _marked(docs, id_col, extra.select(F.col(name).alias("id")), mark)
    kept, others = marked.where(~F.col(mark)).drop(mark), marked.where(F.col(mark)).drop(mark)
    return kept.union(others.join(extra, F.col(id_col).cast("long") == F.col(name), "left_anti"))
