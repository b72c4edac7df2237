"""Byte streams as rows of overlapping text windows, so that one stream is searched by many tasks.

A window owns the matches that start before its ``commit``; its text runs on far enough for any of them. Windows start
at fixed byte places, moved on to the next cluster's start, so every task cuts its own without the others.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmatch.operators.engine import Engine
from driftmatch.plans.compiled import clusters

WINDOW = 256 * 1024
SCHEMA = "stream_id string, seq bigint, base bigint, text string, commit bigint"
_LOOK = 64


def _starts(raw: bytes, at: int, origin: int, size: int) -> int:
    """The first cluster's start at or after stream place ``at``; ``raw`` begins at stream place ``origin``."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    k = max(0, at - _LOOK - origin)
    while k < len(raw) and raw[k] & 0xC0 == 0x80:
        k += 1
    e = min(len(raw), at - origin + _LOOK)
    while e < len(raw) and raw[e] & 0xC0 == 0x80:
        e += 1
    while e > k and e == len(raw) and e + origin < size and (raw[e - 1] & 0x80):
        e -= 1  # the read may have ended inside a character
    place = k + origin
    for g in clusters(raw[k:e].decode("utf-8", "strict")):
        if place >= at:
            return place
        place += len(g.encode())
    return place


def cut_window(read, size: int, seq: int, window: int, overlap: int):
    """(base, text, commit) of a stream's window ``seq``; ``read(start, end)`` gives bytes; ``overlap`` is in clusters."""
    lo, hi = seq * window, min((seq + 1) * window, size)
    more = 32 * overlap + _LOOK * 4
    while True:
        origin, end = max(0, lo - 2 * _LOOK), min(size, hi + more)
        raw = read(origin, end)
        base, stop = _starts(raw, lo, origin, size), _starts(raw, hi, origin, size)
        tail = raw[stop - origin :]
        if end < size:
            while tail and tail[-1] & 0xC0 == 0x80:
                tail = tail[:-1]
            tail = tail[:-1] if tail and tail[-1] & 0x80 else tail
        after = clusters(tail.decode("utf-8", "strict"))
        if end == size or len(after) > overlap:
            break
        more *= 2  # clusters of many bytes
    text = raw[base - origin : stop - origin].decode("utf-8", "strict") + "".join(after[:overlap])
    return base, text, stop - base


def windows_of_texts(df: DataFrame, engine: Engine, stream_id: str = "stream_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Windows of a column of whole streams; a stream's text need not be short, but fits a row."""
    overlap = engine.max_match_graphemes() + 1

    def run(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (t or "").encode()
                rows = []
                for seq in range(max(1, -(-len(raw) // window))):
                    base, part, commit = cut_window(lambda s, e: raw[s:e], len(raw), seq, window, overlap)
                    rows.append((k, seq, base, part, commit))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], [x.split()[0] for x in SCHEMA.split(", ")])

    return df.select(F.col(stream_id).cast("string"), F.col(text)).mapInArrow(run, SCHEMA)


def read_windows(spark: SparkSession, path: str, engine: Engine, window: int = WINDOW) -> DataFrame:
    """Windows of the files at ``path``: tasks read byte ranges, so a file of any size is spread over the cluster."""
    overlap = engine.max_match_graphemes() + 1
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    per_task = 64
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("length") / window) - 1, F.lit(0)).cast("bigint"), F.lit(per_task).cast("bigint"))).alias("first"))

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path, size, first in zip(*(b.column(k).to_pylist() for k in range(3))):
                if urlparse(path).scheme in ("", "file"):
                    source, name = fs.LocalFileSystem(), unquote(urlparse(path).path)
                else:
                    source, name = fs.FileSystem.from_uri(path)
                with source.open_input_file(name) as f:
                    for seq in range(first, min(first + per_task, max(1, -(-size // window)))):
                        base, text, commit = cut_window(lambda s, e: f.read_at(e - s, s), size, seq, window, overlap)
                        yield pa.record_batch([pa.array([x], t) for x, t in zip((path, seq, base, text, commit), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], [x.split()[0] for x in SCHEMA.split(", ")])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(n, "path", "first").mapInArrow(run, SCHEMA)
