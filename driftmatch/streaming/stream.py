"""Search and replacement over windows of byte streams, in batch and with Structured Streaming.

A window is searched sorted and without overlaps; the matches that start before its commit are its own. Matches of
neighbouring windows may overlap; a replacement skips those that start inside text already written. Windows are at
least twice as long as any match, so that what is already written at a window's start depends on the window before it
alone: one grouping by (stream, place) settles it and no stream is serial.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from driftmatch.functions import matches as fm
from driftmatch.operators.engine import Engine, Replacer
from driftmatch.operators.kernel import rank, resolve


def _own(engine: Engine, windows: DataFrame, threshold: float) -> DataFrame:
    found = windows.withColumn("__m", engine.search("text", threshold, "default", "non_overlapping"))
    return found.withColumn("__m", F.filter("__m", lambda m: m["start"] < F.col("commit")))


def search_windows(engine: Engine, windows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(stream_id, match fields) with offsets in the stream."""
    m = _own(engine, windows, threshold).select("stream_id", "base", F.explode_outer("__m").alias("m")).where(F.col("m").isNotNull())  # see Engine.search_df
    return m.select("stream_id", "m.pattern_index", "m.pattern", (F.col("m.start") + F.col("base")).alias("start"), (F.col("m.end") + F.col("base")).alias("end"), "m.similarity", "m.insertions", "m.deletions", "m.substitutions", "m.swaps", "m.edits", "m.text")


def bytes_read(windows: DataFrame) -> DataFrame:
    return windows.groupBy("stream_id").agg(F.sum("commit").alias("bytes"))


def stream_matches(engine: Engine, windows: DataFrame, threshold: float = 0.0) -> Iterator[Row]:
    """Matches one after another on the driver, a partition at a time."""
    return search_windows(engine, windows, threshold).toLocalIterator()


def replace_windows(engine: Engine, windows: DataFrame, callback: Callable[[Column], Column], threshold: float = 0.0) -> DataFrame:
    """(stream_id, seq, text): each window's share of the output; in order of seq they make the whole."""
    own = _own(engine, windows, threshold)
    # Each window meets the place that the window before it wrote up to: two rows of one scan, grouped, so the search runs once.
    written = F.col("base") + F.coalesce(F.try_element_at("__m", F.lit(-1))["end"], F.lit(0).cast("bigint"))
    w = F.struct("base", "text", "commit", "__m")
    both = own.withColumn("w", w).withColumn("at", written).select("stream_id", F.explode(F.array(F.struct("seq", "w", F.lit(None).cast("bigint").alias("at")), F.struct((F.col("seq") + 1).alias("seq"), F.lit(None).cast(own.select(w.alias("w")).schema["w"].dataType).alias("w"), "at"))).alias("x"))
    met = both.groupBy("stream_id", F.col("x.seq").alias("seq")).agg(F.first("x.w", ignorenulls=True).alias("w"), F.max("x.at").alias("__written")).where(F.col("w").isNotNull())
    j = met.select("stream_id", "seq", "w.*", "__written").withColumn("__from", F.greatest(F.coalesce(F.col("__written") - F.col("base"), F.lit(0)), F.lit(0)).cast("bigint"))
    m = F.filter("__m", lambda x: x["start"] >= F.col("__from"))
    t = F.col("text")
    j = j.withColumn("__m", m)
    before = lambda i: F.when(i == 0, F.col("__from")).otherwise(F.get("__m", i - 1)["end"])
    parts = F.transform("__m", lambda x, i: F.concat(fm.cut(t, before(i), x["start"]), F.coalesce(callback(x).cast("string"), x["text"])))
    done = F.coalesce(F.try_element_at("__m", F.lit(-1))["end"], F.col("__from"))
    rest = F.when(done < F.col("commit"), fm.cut(t, done, F.col("commit"))).otherwise("")
    return j.select("stream_id", "seq", F.concat(F.array_join(parts, ""), rest).alias("text"))


def replace_stream(replacer: Replacer, windows: DataFrame, threshold: float = 0.0) -> DataFrame:
    return replace_windows(replacer.engine, windows, replacer.value, threshold)


def bytes_written(replaced: DataFrame) -> DataFrame:
    return replaced.groupBy("stream_id").agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))


FOUND = "stream_id string, pattern_index int, pattern string, start bigint, end bigint, similarity float, insertions smallint, deletions smallint, substitutions smallint, swaps smallint, edits smallint, text string"


def search_chunks(engine: Engine, chunks: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Matches of streaming chunks (stream_id, seq, text, last boolean), each stream's in order of seq across triggers.

    The state of a stream is the tail that a match may still reach into, and its place; a chunk with ``last`` ends the
    stream. Matches come out once the text after them is known.
    """
    from pyspark.sql.streaming.state import GroupState

    shared = chunks.sparkSession.sparkContext.broadcast(engine.compiled)
    overlap = engine.max_match_graphemes() + 1

    def run(key, parts, state: GroupState):
        from driftmatch.operators.kernel import Matcher
        from driftmatch.plans.compiled import clusters

        c = shared.value
        matcher = Matcher(c, threshold)
        base, tail = state.get if state.exists else (0, "")
        rows = []
        data = pd.concat(list(parts)).sort_values("seq")
        for text, ends in zip(data["text"], data["last"]):
            tail += text or ""
            units = clusters(tail)
            keep = 0 if ends else min(overlap, len(units))
            commit = len("".join(units[: len(units) - keep]).encode())
            if not commit and not ends:
                continue
            raw = tail.encode()
            for m in resolve(rank(matcher.search(tail), "default", c.bytes_of), "non_overlapping", c.unique):
                if m.start < commit:
                    rows.append((key[0], m.pattern_index, c.patterns[m.pattern_index].text, base + m.start, base + m.end, m.similarity, m.insertions, m.deletions, m.substitutions, m.swaps, m.edits, raw[m.start : m.end].decode()))
            base, tail = base + commit, raw[commit:].decode()
            if ends:
                base, tail = 0, ""
        state.update((base, tail))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, FOUND, "base bigint, tail string", "append", "NoTimeout")


def search_stream(engine: Engine, windows: DataFrame, on_match: Callable[[Row], None], threshold: float = 0.0) -> int:
    """Calls ``on_match`` on the driver for every match, a partition at a time, in no fixed order; returns the bytes read."""
    for row in stream_matches(engine, windows, threshold):
        on_match(row)
    return bytes_read(windows).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def write_replaced(replaced: DataFrame, path: str) -> None:
    """Parquet files whose rows, file after file, are in order of (stream_id, seq): each stream's output is its texts joined."""
    replaced.repartitionByRange("stream_id", "seq").sortWithinPartitions("stream_id", "seq").write.parquet(path)
