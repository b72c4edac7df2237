"""Joins of texts with patterns by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmatch.operators.engine import Engine
from driftmatch.plans.spec import Pattern


def fuzzy_join(docs: DataFrame, patterns: DataFrame, text: str = "text", threshold: float = 0.8, pattern_id: str = "pattern_index", most: int = 10_000, how: str = "inner", order: str = "unsorted", overlap: str = "keep", **settings) -> DataFrame:
    """Rows of ``docs`` with the patterns (pattern_id, pattern and, if any, weight, limits, custom_unique_id) that occur in them.

    Patterns go to the workers in engines of at most ``most`` patterns; more of them take one pass over ``docs`` for
    each engine, so nothing that grows is broadcast whole. ``how``: inner (a row for each match), left_semi or left_anti.
    Overlaps are resolved within one engine. Limits that some patterns lack follow the engine's rule for them, so give
    ``limits`` or all of them where there are several engines.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError("how is inner, left_semi or left_anti")
    engines = [(Engine(block, **settings), ids) for block, ids in _blocks(patterns, pattern_id, most)]
    if how != "inner":
        hit = docs.withColumn("__hits", F.array(*(F.coalesce(F.size(e.search(text, threshold, pinned=True)), F.lit(0)) for e, _ in engines)).cast("array<int>"))
        some = F.exists("__hits", lambda n: n > 0)
        return hit.where(some if how == "left_semi" else ~some).drop("__hits")
    kind, out = dict(patterns.dtypes)[pattern_id], None
    for engine, ids in engines or [(Engine([], **settings), [])]:
        index = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"__i int, pattern_id {kind}")  # at most ``most`` rows
        part = engine.search_df(docs, text, threshold, order, overlap).join(F.broadcast(index), F.col("pattern_index") == F.col("__i")).drop("__i")
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(patterns: DataFrame, pattern_id: str, most: int):
    """(patterns, their ids) of at most ``most`` patterns, in order of the ids."""
    names = [c for c in ("pattern", "weight", "limits", "custom_unique_id") if c in patterns.columns]
    block, ids = [], []
    for r in patterns.select(F.col(pattern_id).alias("__id"), *names).orderBy("__id").toLocalIterator():
        ids.append(r["__id"])
        block += Pattern.from_rows([r])
        if len(block) == most:
            yield block, ids
            block, ids = [], []
    if block:
        yield block, ids
