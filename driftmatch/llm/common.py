"""Pieces that the operators share: the shared folder, written tables, and a vectorised tokenizer."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BLOCK = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text bytes for which there is a shard, and the most shards that one exchange of blocks makes.
SHARD_BYTES, MOST_SHARDS, MOST_PARTITIONS = 1 << 24, 1 << 13, 1 << 16


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``; only a session on one machine may leave that setting out."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftmatch-")
        spark.conf.set("spark.checkpoint.dir", base)
        weakref.finalize(sc, shutil.rmtree, base[7:], True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs a reread only."""
    path = shared_dir(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the write's own shuffle files go once it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def parallel(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(texts: DataFrame, text_col: str = "text") -> int:
    """The UTF-8 bytes of a text column: one native pass."""
    return texts.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def shards_for(spark: SparkSession, nbytes: int) -> int:
    """Shards that hold about as much each at every size of the input."""
    return max(2 * parallel(spark), nbytes // SHARD_BYTES + 1)


def by_shard(rows: DataFrame, shards: int, split):
    """Groups by the column ``shard`` of tables of packed blocks.

    With more than MOST_SHARDS shards the rows come by shard modulo MOST_SHARDS, as blocks for more of them would hold next
    to nothing; ``split`` (of batches, for mapInArrow) cuts them anew once they are together.
    """
    if shards > MOST_SHARDS:
        rows = rows.repartition(MOST_SHARDS, "shard").mapInArrow(split, rows.schema)
    return rows.repartition(min(shards, MOST_PARTITIONS), "shard").groupBy("shard")


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


_opened: dict = {}


def opened(key, make):
    """A worker's value of ``key``, made once; a ``tidy`` task that doesn't ``keep`` it lets go of it."""
    if key not in _opened:
        _opened[key] = make()
    return _opened[key]


def forget() -> None:
    if _opened:
        _opened.clear()
        gc.collect()  # codecs and their caches refer to each other


def tidy(run, keep: bool = False):
    """A function of batches whose task hands back the memory that it no longer uses: workers live on from stage to stage.
    What other stages have ``opened`` goes before it begins, unless it is to ``keep`` that."""

    def tidied(batches):
        if not keep:
            forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            release()

    return tidied


def release() -> None:
    if _trim is not None:
        _trim(0)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins and ends; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray, size: int = 2 * BLOCK):
    """(first text, text after the last, bytes, offsets) of runs of whole texts of about ``size`` bytes: bounds the arrays made of a batch."""
    s, n = 0, len(offs) - 1
    while s < n:
        e = max(s + 1, int(np.searchsorted(offs, offs[s] + size, "right")) - 1)
        yield s, e, data[offs[s] : offs[e]], offs[s : e + 1] - offs[s]
        s = e


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a, b) -> np.ndarray:
    """One hash of an ordered pair of hashes."""
    return mix(np.asarray(a, U) * U(0x9E3779B97F4A7C15) + np.asarray(b, U))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_OTHER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
_WORD_VALUE = BYTE[_LOWER]
_BASE, _BASE_INV = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse, both modulo 2**64."""
    if _powers.get("n", 0) < n:
        n = max(n, BLOCK)
        up, down = np.full(n + 1, U(_BASE)), np.full(n + 1, U(_BASE_INV))
        up[0] = down[0] = 1
        _powers.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def blocks(data: np.ndarray, offs: np.ndarray):
    """Cuts at white space or at a text's start, so that no word is split; a longer word makes a longer block."""
    s, total = 0, len(data)
    while s < total:
        e = min(s + BLOCK, total)
        if e < total:
            back = np.flatnonzero(_SPACE[data[s:e]])
            edge = offs[np.searchsorted(offs, e, "right") - 1]
            best = max(int(back[-1]) + s + 1 if len(back) else s, int(edge))
            if best > s:
                e = best
            else:
                ahead = np.flatnonzero(_SPACE[data[e:]])
                k = np.searchsorted(offs, e, "left")
                e = min(int(ahead[0]) + e if len(ahead) else total, int(offs[k]) if k < len(offs) else total)
        yield s, e
        s = e


def tokens(data: np.ndarray, offs: np.ndarray, prefixes: tuple[int, ...] = (), letters: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z-lower-cased texts: (hashes, starts, ends, token offsets by text, prefix hashes).

    A word's hash is a polynomial over random byte values, mixed; a prefix hash covers the first k characters' bytes
    (the whole word where it is shorter). With ``letters`` words are runs of ASCII letters, digits and non-ASCII bytes,
    and Latin-1 capitals are lower-cased too.
    """
    hs, ss, es, ps = [], [], [], [[] for _ in prefixes]
    for s, e in blocks(data, offs):
        x = data[s:e]
        w = ~(_OTHER if letters else _SPACE)[x]
        if letters:
            up = np.zeros(len(x), bool)
            up[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
            x = x + up.astype(np.uint8) * np.uint8(32)
        a, z = w.copy(), w.copy()
        a[1:] &= ~w[:-1]
        z[:-1] &= ~w[1:]
        edge = offs[np.searchsorted(offs, s, "right") : np.searchsorted(offs, e, "left")] - s
        a[edge] = w[edge]
        z[edge - 1] = w[edge - 1]
        a, z = np.flatnonzero(a), np.flatnonzero(z) + 1
        up, down = powers(len(x))
        sums = np.zeros(len(x) + 1, U)
        np.cumsum(_WORD_VALUE[x] * up[: len(x)], out=sums[1:])
        hs.append(mix((sums[z] - sums[a]) * down[a]))
        if prefixes:
            first = np.flatnonzero((x & 0xC0) != 0x80)
            at = np.searchsorted(first, a)
            first = np.append(first, len(x))
            for k, out in zip(prefixes, ps):
                stop = np.minimum(first[np.minimum(at + k, len(first) - 1)], z)
                out.append(mix((sums[stop] - sums[a]) * down[a] + U(k)))
        ss.append(a + s)
        es.append(z + s)
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    starts = cat(ss, np.int64)
    return cat(hs, U), starts, cat(es, np.int64), np.searchsorted(starts, offs), [cat(p, U) for p in ps]


def pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays, column by column, compressed."""
    raw = np.array([len(arrays[0])], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out
