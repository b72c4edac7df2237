"""Exact multi-pattern search without Python: an equi-join of a text's symbol strings with the patterns.

For each distinct pattern length the text's substrings of that length are joined with the patterns (and the beginnings
that stand for other patterns). The patterns are a driver-side list of an engine, so that side is small; Spark broadcasts
it by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmatch.functions import matches as fm
from driftmatch.operators.engine import Engine


def exact_matches(df: DataFrame, engine: Engine, text: str = "text") -> DataFrame:
    """The columns of ``df`` and, for each exact occurrence, pattern_index, pattern, start, end, similarity, match_text.

    Where ``df`` has a column of such a name, the match's is called ``match_`` and that name (``match_match_text``).
    """
    c = engine.compiled
    if c.mappings or any(lim.most() for lim in c.own):
        raise ValueError("the engine allows edits or mappings; use Engine.search")
    spark = df.sparkSession
    rows = [(len(x.u), x.u, x.index, c.patterns[x.index].text, float(c.patterns[x.index].weight)) for x in c.candidates]
    patterns = spark.createDataFrame(rows, "__len int, __gram string, __index int, __pattern string, __similarity float")
    t = F.col(text)
    ascii_only = F.octet_length(t) == F.char_length(t)
    clusters = F.when(ascii_only, F.filter(F.split(t, ""), lambda x: x != "")).otherwise(F.regexp_extract_all(t, F.lit(r"(\X)"), F.lit(1)))
    fold = (lambda g: F.lower(g)) if c.case_insensitive else (lambda g: g)
    prepared = df.withColumn("__c", clusters).withColumn("__s", F.array_join(F.transform("__c", lambda g: F.substring(fold(g), 1, 1)), ""))
    # Byte offset of every cluster, and of the end; for ASCII texts these are the positions themselves.
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array(F.lit(0).cast("bigint")).alias("offs"))
    running = F.aggregate("__c", zero, lambda a, g: F.struct((a["at"] + F.octet_length(g)).alias("at"), F.concat(a["offs"], F.array((a["at"] + F.octet_length(g)).cast("bigint"))).alias("offs")), lambda a: a["offs"])
    prepared = prepared.withColumn("__o", F.when(~ascii_only, running)).drop("__c")

    def places(n: int) -> Column:
        """(place, length) of every substring of one length."""
        last = F.length("__s") - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("i"), F.lit(n).alias("n")))).otherwise(F.array().cast("array<struct<i:int,n:int>>"))

    span = F.explode(F.flatten(F.array(*map(places, sorted({r[0] for r in rows})))) if rows else F.array().cast("array<struct<i:int,n:int>>"))
    grams = prepared.select("*", span.alias("__g")).withColumn("__gram", F.substring("__s", F.col("__g.i") + 1, F.col("__g.n"))).withColumn("__len", F.col("__g.n"))
    off = lambda i: F.coalesce(F.get("__o", i), i.cast("bigint"))
    start, end = off(F.col("__g.i")), off(F.col("__g.i") + F.col("__g.n"))
    out = {"pattern_index": F.col("__index"), "pattern": F.col("__pattern"), "start": start, "end": end, "similarity": F.col("__similarity"), "match_text": fm.cut(t, start, end)}
    taken = {c.lower() for c in df.columns}
    return grams.join(patterns, ["__len", "__gram"]).select(*df.columns, *(v.alias(f"match_{k}" if k in taken else k) for k, v in out.items()))
