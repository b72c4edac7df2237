"""Benchmark decontamination by spaced seeds that miss no overlap.

Texts are lower-cased word sequences (runs of letters, digits and non-ASCII characters; punctuation is dropped). A mask
looks at some of the words in a window and ignores the others. ``FAMILY`` is four masks of six words each of which one
at least finds six agreeing words in every stretch of 13 words or more of which 80 % agree, wherever the substitutions
are (``tests/llm`` goes through all of them); other settings, and items shorter than ``min_words``, have masks by the
rule in ``masks``: runs of words that no way to spread the substitutions breaks.

1. Items of equal words are one class: its least id stands for it, ``n_items`` counts its members.
2. The seeds of the classes fill a Bloom filter of at most ``MOST_BITS`` bits, the one thing that all tasks get. A larger
   benchmark only makes it let more through.
3. Documents are read once; those with a seed that passes the filter keep their words' hashes and those seeds. Equal
   texts go on as one.
4. Seeds of documents and of items are joined in Spark; a hot one is split as a skewed partition is.
5. Every distinct (text, class, shift) is laid out and verified: all disjoint stretches of at least ``min_words`` words (or
   the whole item, where that is shorter) of which at least ``min_identity`` agree. Of each stretch that is left, the
   best-scoring part (a match counts 1, a substitution -3) where it qualifies, else the longest that does.

Items of under five words must agree in every word. A null text is empty; an item without words is in no text; a class
whose ids are all null has a null id; repeated documents give a row each; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmatch.llm.common import U, buffers, fresh, mix, pieces, tidy, tokens, written

FAMILY, FAMILY_FOR = ("1101111", "110010001011", "110101011", "1110111"), (13, 0.8)
MOST_BITS, BITS_A_SEED, PROBES = 1 << 29, 32, 6
FOUND = "item_id long, n_items long, doc_start int, item_start int, n_words int, n_matched int, identity double, coverage double"
SCHEMA = f"doc_id long, {FOUND}"


def masks(words: int, min_words: int, min_identity: float) -> tuple[str, ...]:
    """Masks that hit each stretch of an item of ``words`` words that qualifies, wherever the substitutions are. Of a stretch
    of twice the least length one part qualifies, so shorter ones stand for all."""
    if (min_words, min_identity) == FAMILY_FOR and words >= min_words:
        return FAMILY
    least = max(min(min_words, words), 1)
    lengths = [(n, n - math.ceil(min_identity * n - 1e-9)) for n in range(least, min(words, 2 * least - 1) + 1)]
    k = min(least, *(1 + (n - e) // (e + 1) for n, e in lengths))
    return tuple(sorted({"1" * k} | {"0".join(["1" * (k - 1)] * (e + 1)) for n, e in lengths if k > 1 and n - e == (e + 1) * (k - 1)}))


def seeds(h: np.ndarray, at: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of a mask's windows inside one text each; texts begin at ``at``."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    picked = [j for j, c in enumerate(mask) if c == "1"]
    weights = mix(np.arange(1, len(picked) + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(int(mask, 2))) | U(1)
    out = np.zeros(n, U)
    for w, j in zip(weights, picked):
        out += h[j : j + n] * w
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pos = np.flatnonzero(text[:n] == text[len(mask) - 1 :])  # no window runs over a text's end
    return pos, mix(out[pos])


def _bits(key: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Where a seed's ``probe``-th bit stands in a filter of ``bits`` (a power of two) bits."""
    return ((key + U(probe) * (mix(key) | U(1))) & U(bits - 1)).astype(np.int64)


class Filter:
    def __init__(self, bits: int, words: np.ndarray, used: tuple[str, ...]):
        self.bits, self.words, self.used = bits, words, used

    def found(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, seed) of the windows whose seed may be an item's."""
        out = []
        for mask in self.used:
            pos, key = seeds(h, at, mask)
            for probe in range(PROBES):
                b = _bits(key, probe, self.bits)
                keep = np.flatnonzero(self.words[b >> 6] >> (b & 63).astype(U) & U(1))
                pos, key = pos[keep], key[keep]
            out.append((pos, key))
        pos, key = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, U))
        o = np.argsort(pos, kind="stable")
        return pos[o], key[o]


def _binary(x: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The bytes of the runs of ``x`` between the places in ``cut``."""
    raw = memoryview(np.ascontiguousarray(x)).cast("B")
    size = x.itemsize
    return pa.array([bytes(raw[s * size : e * size]) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def classes(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item long, item_id, n_items, n, h): classes of items of equal words, as hashes of their words."""

    def run(batches):
        for b in batches:
            for s, e, data, offs in pieces(*buffers(b.column(1))):
                h, _, _, at, _ = tokens(data, offs, letters=True)
                yield pa.record_batch([b.column(0).slice(s, e - s), pa.array(np.diff(at).astype(np.int32)), _binary(h, at)], ["id", "n", "h"])

    words = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n int, h binary").where("n > 0")
    return words.groupBy(F.md5("h").alias("k")).agg(F.min("id").alias("item_id"), F.count("*").alias("n_items"), F.first("n").alias("n"), F.first("h").alias("h")).select(F.xxhash64("k").alias("item"), "item_id", "n_items", "n", "h")


def item_seeds(items: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """(key, item, item_at): every seed of every class."""

    def run(batches):
        for b in batches:
            n = np.asarray(b.column(1))
            for i in range(len(b)):
                h = np.frombuffer(b.column(2)[i].as_py(), U)
                for mask in masks(int(n[i]), min_words, min_identity):
                    pos, key = seeds(h, np.array([0, len(h)]), mask)
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.full(len(key), b.column(0)[i].as_py())), pa.array(pos.astype(np.int32))], ["key", "item", "item_at"])

    return items.select("item", "n", "h").mapInArrow(run, "key long, item long, item_at int")


def make_filter(items: DataFrame, keys: DataFrame, min_words: int, min_identity: float) -> Filter:
    """The Bloom filter of all seeds; what comes to the driver is at most MOST_BITS bits."""
    lengths = [r[0] for r in items.select(F.least("n", F.lit(min_words)).alias("n")).distinct().collect()]  # at most min_words rows
    used = tuple(sorted({m for n in lengths for m in masks(n, min_words, min_identity)}))
    bits = 1 << min(max((BITS_A_SEED * keys.count()).bit_length(), 16), MOST_BITS.bit_length() - 1)

    def run(batches):
        own = np.zeros(bits >> 6, U)
        for b in batches:
            key = np.asarray(b.column(0)).view(U)
            for probe in range(PROBES):
                at = _bits(key, probe, bits)
                np.bitwise_or.at(own, at >> 6, U(1) << (at & 63).astype(U))
        at = np.flatnonzero(own)
        for s in range(0, len(at), 1 << 16):
            yield pa.record_batch([pa.array(at[s : s + (1 << 16)]), pa.array(own[at[s : s + (1 << 16)]].view(np.int64))], ["at", "w"])

    got = keys.select("key").mapInArrow(run, "at long, w long").groupBy("at").agg(F.bit_or("w").alias("w")).toArrow()
    words = np.zeros(bits >> 6, U)
    words[np.asarray(got.column("at").combine_chunks())] = np.asarray(got.column("w").combine_chunks()).view(U)
    return Filter(bits, words, used)


def stretches(same: np.ndarray, least: int, min_identity: float):
    """(start, words, matches) of the disjoint stretches of ``least`` words or more of which ``min_identity`` agree: of what is
    left, the best-scoring part (a match counts 1, a substitution -3) where it qualifies, else the longest that does."""
    todo = [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        part = same[lo:hi]
        if np.count_nonzero(part) < min_identity * least - 1e-9 or hi - lo < least:
            continue
        total = np.concatenate([[0], np.cumsum(np.where(part, 1, -3))])
        low = np.minimum.accumulate(total)
        gain = total - low
        end = int(gain.argmax())
        start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
        n, m = end - start, int(part[start:end].sum())
        if n < least or m < min_identity * n:
            start, n, m = longest(part, least, min_identity)
        if n:
            yield lo + start, n, m
            todo += [(lo, lo + start), (lo + start + n, hi)]


def longest(same: np.ndarray, least: int, min_identity: float) -> tuple[int, int, int]:
    """(start, words, matches) of the longest stretch of ``least`` words or more of which ``min_identity`` agree, the first of equals; zeros if there is none."""
    m = np.concatenate([[0], np.cumsum(same)])
    over = m - min_identity * np.arange(len(m))  # a stretch qualifies where this doesn't fall; rounding doesn't count
    low = np.minimum.accumulate(over)
    starts = np.searchsorted(-low, -(over + 1e-9), "left")
    n = np.arange(len(m)) - starts
    end = int(n.argmax())
    if n[end] < max(least, 1):
        return 0, 0, 0
    return int(starts[end]), int(n[end]), int(m[end] - m[starts[end]])


def verified(doc: np.ndarray, item: np.ndarray, shifts: list[int], min_words: int, min_identity: float):
    """(word of text, word of item, words, matches) of the overlaps of two texts at the given shifts."""
    least = min(min_words, len(item))
    for shift in shifts:
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        for start, n, m in stretches(item[lo:hi] == doc[lo + shift : hi + shift], least, min_identity):
            yield lo + shift + start, lo + start, n, m


def _candidates(texts: DataFrame, use: Filter) -> DataFrame:
    """(doc_id, digest, h, pos, key) of the documents with a seed that passes the filter."""
    shared = texts.sparkSession.sparkContext.broadcast(use)  # at most MOST_BITS bits

    def run(batches):
        for b in batches:
            for s, _, data, offs in pieces(*buffers(b.column(2))):
                h, _, _, at, _ = tokens(data, offs, letters=True)
                pos, key = shared.value.found(h, at)
                cut = np.searchsorted(pos, at)
                some = np.flatnonzero(np.diff(cut))
                if not len(some):
                    continue
                own = pos - np.repeat(at[:-1], np.diff(cut))
                edge = np.append(cut[some], len(pos))  # texts without a seed have no width
                words = pa.array([h[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())
                rows = pa.array(some + s)
                yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), words, _binary(own.astype(np.int32), edge), _binary(key, edge)], ["doc_id", "digest", "h", "pos", "key"])

    return texts.mapInArrow(tidy(run), "doc_id long, digest string, h binary, pos binary, key binary")


def _doc_seeds(texts: DataFrame) -> DataFrame:
    """(key, digest, doc_at) of the candidates' seeds."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                pos, key = np.frombuffer(b.column(1)[i].as_py(), np.int32), np.frombuffer(b.column(2)[i].as_py(), np.int64)
                yield pa.record_batch([pa.array(key), pa.array([b.column(0)[i].as_py()] * len(key), pa.string()), pa.array(pos)], ["key", "digest", "doc_at"])

    return texts.select("digest", "pos", "key").mapInArrow(run, "key long, digest string, doc_at int")


def _matches(docs: DataFrame, benchmark: DataFrame, min_words: int, min_identity: float, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of the candidates, and (digest, FOUND) of the texts with a verified overlap."""
    spark = docs.sparkSession
    items = written(spark, classes(benchmark, item_id_col, item_text_col), "benchmark-classes")
    keys = written(spark, item_seeds(items, min_words, min_identity), "benchmark-seeds")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", digest(F.col("text")).alias("digest"), "text")
    some = written(spark, _candidates(texts, make_filter(items, keys, min_words, min_identity)), "overlap-candidates")
    own = some.dropDuplicates(["digest"])
    hits = _doc_seeds(own).join(keys, "key").select("digest", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    # A text and an item have fewer shifts than words.
    pairs = hits.groupBy("digest", "item").agg(F.collect_list("shift").alias("shifts"))
    laid = pairs.join(items.select("item", "item_id", "n_items", F.col("h").alias("hi")), "item").join(own.select("digest", F.col("h").alias("hd")), "digest")

    def verify(batches):
        for b in batches:
            rows = []
            for i in range(len(b)):
                doc, item = (np.frombuffer(b.column(k)[i].as_py(), U) for k in (4, 5))
                for d, t, n, m in verified(doc, item, sorted(b.column(3)[i].as_py()), min_words, min_identity):
                    rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(), d, t, n, m, m / n, n / len(item)))
            if rows:
                types = (pa.string(), pa.int64(), pa.int64(), *(pa.int32(),) * 4, pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["digest", *(x.split()[0] for x in FOUND.split(", "))])

    found = laid.select("digest", "item_id", "n_items", "shifts", "hd", "hi").mapInArrow(verify, f"digest string, {FOUND}")
    return some.select("doc_id", "digest"), written(spark, found, "overlaps")


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document, class of equal items and verified overlap."""
    some, found = _matches(docs, benchmark, min_words, min_identity, id_col, text_col, item_id_col, item_text_col)
    return some.join(found, "digest").select(*(x.split()[0] for x in SCHEMA.split(", ")))


BROADCAST_ROWS = 1 << 20


def without_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_identity: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have a verified overlap with any benchmark item."""
    _, found = _matches(docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text")), benchmark, min_words, min_identity, "id", "text", item_id_col, item_text_col)
    name = fresh(docs, "found_digest")
    bad = found.select(F.col("digest").alias(name)).distinct()
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, digest(F.col(text_col)) == F.col(name), "left_anti")
