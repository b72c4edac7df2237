"""The engine on Spark: search as a column or as rows, and what follows from it.

The compiled engine is broadcast; one Arrow function aligns, ranks and resolves, behind a native predicate that keeps
texts without any seed out of Python. Everything after the match array is Catalyst expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmatch.functions import matches as fm
from driftmatch.operators.kernel import Matcher, rank, resolve
from driftmatch.plans.compiled import Compiled
from driftmatch.plans.spec import Limits, Options, Pattern, Penalties, Similarity

MATCHES = f"array<{fm.MATCH}>"
_FIELDS = [("pattern_index", pa.int32()), ("pattern", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float32()), *((k, pa.int16()) for k in ("insertions", "deletions", "substitutions", "swaps", "edits")), ("text", pa.string())]
MOST_SEEDS = 256
ARROW_MATCH = pa.struct(_FIELDS)


def match_array(found: list[list | None], texts: list[bytes | None], patterns: list[Pattern]) -> pa.Array:
    """Matches of each text as one Arrow list array; None for a null text."""
    offsets, rows, raw = [0], [], []
    for ms, t in zip(found, texts):
        for m in ms or ():
            rows.append(m)
            raw.append(t[m.start : m.end].decode())
        offsets.append(len(rows))
    names = [p.text for p in patterns]
    cols = list(zip(*rows)) if rows else [()] * 9
    i, s, e, sim, ins, dele, sub, swp, edits = cols
    arrays = [pa.array(i, pa.int32()), pa.array([names[k] for k in i], pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(sim, pa.float32()), *(pa.array(x, pa.int16()) for x in (ins, dele, sub, swp, edits)), pa.array(raw, pa.string())]
    values = pa.StructArray.from_arrays(arrays, fields=[pa.field(n, t) for n, t in _FIELDS])
    mask = pa.array([f is None for f in found], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


class Engine:
    """An immutable set of patterns with its limits, costs and likeness table.

    ``limits``: for patterns without their own (none at all: exact). ``mappings``: (text, text) or (text, text, score)
    pairs that may stand for each other. ``floor``: the least likeness that a substitution needs. ``beam``: most states
    kept at a step (approximate); ``auto_beam``: (states until then exact, beam from there). ``suffix_outputs``: report
    a pattern that ends a beginning of another over that whole beginning, too.
    """

    def __init__(self, patterns: Iterable, limits: Limits | None = None, penalties: Penalties | None = None, similarity: Similarity | None = None, case_insensitive: bool = False, mappings: Iterable = (), floor: float = 0.0, beam: int | None = None, auto_beam: tuple[int, int] | None = None, suffix_outputs: bool = True):
        self.compiled = Compiled(
            [Pattern.of(p) for p in patterns], limits, penalties or Penalties(), similarity or Similarity(), case_insensitive,
            [(m[0], m[1], m[2] if len(m) > 2 else 1.0) for m in mappings], floor, beam, auto_beam, suffix_outputs,
        )

    @property
    def patterns(self) -> list[Pattern]:
        return self.compiled.patterns

    def patterns_df(self, spark: SparkSession) -> DataFrame:
        lim = lambda x: (x.insertions, x.deletions, x.substitutions, x.swaps, x.edits) if x else None
        schema = "pattern_index int, pattern string, grapheme_len int, byte_len int, weight float, custom_unique_id bigint, limits struct<insertions:smallint,deletions:smallint,substitutions:smallint,swaps:smallint,edits:smallint>"
        c = self.compiled
        return spark.createDataFrame([(i, p.text, c.lengths[i], p.byte_len, p.weight, p.custom_unique_id, lim(p.limits)) for i, p in enumerate(c.patterns)], schema)

    @property
    def prefilter_active(self) -> bool:
        return self.compiled.reducible

    def max_match_graphemes(self) -> int:
        return self.compiled.max_match_graphemes()

    # --- search ---------------------------------------------------------------------------------------------------

    def matcher(self, threshold: float, prefilter: str = "auto") -> Matcher:
        return Matcher(self.compiled, threshold, prefilter != "off")

    def search_local(self, text: str, threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto") -> list:
        """One text on the driver."""
        o = Options(threshold, order, overlap).ranked()
        c = self.compiled
        return resolve(rank(self.matcher(threshold, prefilter).search(text), o.order, c.bytes_of), o.overlap, c.unique)

    def _udf(self, o: Options, prefilter: str) -> Callable:
        spark = SparkSession.getActiveSession()
        shared = spark.sparkContext.broadcast(self.compiled) if spark else None
        compiled, made = None if shared else self.compiled, {}
        key, threshold, use = (o, prefilter), o.threshold, prefilter != "off"

        def run(texts: pa.Array) -> pa.Array:
            if key not in made:
                made[key] = Matcher(shared.value if shared else compiled, threshold, use)
            m = made[key]
            c = m.e
            found, raw = [], []
            for t in texts.to_pylist():
                found.append(None if t is None else resolve(rank(m.search(t), o.order, c.bytes_of), o.overlap, c.unique))
                raw.append(None if t is None else t.encode())
            return match_array(found, raw, c.patterns)

        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, T._parse_datatype_string(MATCHES))

    def seeds(self, threshold: float) -> list[str] | None:
        """Texts of which any match holds one, lower-cased where the engine folds; None where there is no such set."""
        jobs = [j for j in self.compiled.plan(float(np.float32(threshold))) if j.budget >= 0]
        if not self.compiled.reducible or any(j.pieces is None for j in jobs):
            return None
        return sorted({p for j in jobs for _, p in j.pieces})

    def may_match(self, text: Column | str, threshold: float = 0.0) -> Column:
        """A native predicate that is true for every text with a match, and for some others."""
        seeds, t = self.seeds(threshold), fm.col(text)
        if seeds is None:
            return t.isNotNull()
        if len(seeds) > MOST_SEEDS:
            return t.isNotNull()  # the kernel's automaton is faster than so long an alternation
        if not seeds:
            return F.lit(False)
        # Outside ASCII a cluster's first character stands for it, so only ASCII texts are judged here.
        quoted = "|".join(re.escape(s) for s in seeds if s.isascii())
        ascii_only = F.octet_length(t) == F.char_length(t)
        return ~ascii_only | (F.lower(t) if self.compiled.case_insensitive else t).rlike(quoted) if quoted else ~ascii_only

    def search(self, text: Column | str, threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto", pinned: bool = False) -> Column:
        """The array of matches of a text column; null for a null text.

        ``prefilter``: "auto"; "inside" leaves the native predicate out (where a filter has applied it already); "off"
        leaves the seeds out altogether. ``pinned`` keeps Catalyst from copying the function to other places of a plan (a
        filter on the result would be inferred for the other side of a join, too).
        """
        o = Options(threshold, order, overlap).ranked()
        t = fm.col(text)
        found = self._udf(o, prefilter)
        found = found.asNondeterministic() if pinned else found
        if prefilter in ("off", "inside") or self.seeds(threshold) is None:
            return found(t)
        # The function gets nulls for texts that can't match: they cross to Python as nulls, not as text.
        return F.when(t.isNotNull(), F.coalesce(found(F.when(self.may_match(t, threshold), t)), F.array().cast(MATCHES)))

    def search_df(self, df: DataFrame, text: str = "text", threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto", keep: Iterable[str] | None = None) -> DataFrame:
        """One row for each match: the columns in ``keep`` (all) and the match's fields."""
        keep = list(df.columns if keep is None else keep)
        base = df if prefilter == "off" else df.where(self.may_match(text, threshold))
        found = base.select(*keep, self.search(text, threshold, order, overlap, "off" if prefilter == "off" else "inside").alias("__matches"))
        names = [n for n, _ in _FIELDS]
        clash = {n for n in names if n in keep}
        # An inner explode makes Catalyst infer a filter on the array's size and run the function twice; an outer one doesn't.
        rows = found.select(*keep, F.explode_outer("__matches").alias("__m")).where(F.col("__m").isNotNull())
        return rows.select(*keep, *(F.col(f"__m.{n}").alias(f"match_{n}" if n in clash else n) for n in names))

    # --- what follows from a search -------------------------------------------------------------------------------

    def _ordered(self, text: Column | str, threshold: float, order: str, overlap: str, prefilter: str) -> Column:
        o = Options(threshold, order, overlap).segmenting()
        return self.search(text, threshold, o.order, o.overlap, prefilter)

    def segments(self, text: Column | str, threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto") -> Column:
        return self._once(text, threshold, order, overlap, prefilter, lambda t, m: fm.segments(t, m, resolved=True))

    def _once(self, text, threshold, order, overlap, prefilter, body: Callable[[Column, Column], Column]) -> Column:
        """``body`` of the text and its matches, which are bound once: a Python node is never evaluated twice."""
        t = fm.col(text)
        pair = F.struct(t.alias("t"), self._ordered(t, threshold, order, overlap, prefilter).alias("m"))
        return F.transform(F.array(pair), lambda x: body(x["t"], x["m"]))[0]

    def segment_text(self, text: Column | str, threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto") -> Column:
        return self._once(text, threshold, order, overlap, prefilter, lambda t, m: fm.segment_text_of(fm.segments(t, m, True)))

    def split(self, text: Column | str, threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto") -> Column:
        return self._once(text, threshold, order, overlap, prefilter, lambda t, m: fm.split_of(fm.segments(t, m, True)))

    def strip_prefix(self, text: Column | str, threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto") -> Column:
        return self._once(text, threshold, order, overlap, prefilter, lambda t, m: fm.strip_prefix_of(fm.segments(t, m, True)))

    def strip_suffix(self, text: Column | str, threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto") -> Column:
        return self._once(text, threshold, order, overlap, prefilter, lambda t, m: fm.strip_suffix_of(fm.segments(t, m, True)))

    def replace(self, text: Column | str, callback: Callable[[Column], Column], threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto") -> Column:
        return self._once(text, threshold, order, overlap, prefilter, lambda t, m: fm.replace_matches(t, m, callback, True))

    # --- SQL ------------------------------------------------------------------------------------------------------

    def register(self, spark: SparkSession, name: str, threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep") -> None:
        """SQL functions: ``name(text)`` gives the array, ``name_rows(text)`` the matches as rows for LATERAL."""
        spark.udf.register(name, self._udf(Options(threshold, order, overlap).ranked(), "auto"))
        shared, o = spark.sparkContext.broadcast(self.compiled), Options(threshold, order, overlap).ranked()
        made: list[Matcher] = []

        class Rows:
            def eval(self, text: str):
                if text is None:
                    return
                if not made:
                    made.append(Matcher(shared.value, o.threshold))
                m = made[0]
                raw = text.encode()
                for x in resolve(rank(m.search(text), o.order, m.e.bytes_of), o.overlap, m.e.unique):
                    yield x.pattern_index, m.e.patterns[x.pattern_index].text, x.start, x.end, x.similarity, x.insertions, x.deletions, x.substitutions, x.swaps, x.edits, raw[x.start : x.end].decode()

        spark.udtf.register(f"{name}_rows", F.udtf(Rows, returnType=fm.MATCH.replace("struct<", "", 1)[:-1].replace(":", " ")))


class Replacer:
    """An engine with one replacement for each pattern; the settings are an ``Engine``'s."""

    def __init__(self, pairs: Iterable[tuple], **settings):
        pairs = list(pairs)
        self.engine = Engine([p for p, _ in pairs], **settings)
        self.replacements = [r for _, r in pairs]

    def value(self, match: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.replacements)), match["pattern_index"] + 1) if self.replacements else F.lit(None).cast("string")

    def replace(self, text: Column | str, threshold: float = 0.0, order: str = "unsorted", overlap: str = "keep", prefilter: str = "auto") -> Column:
        return self.engine.replace(text, self.value, threshold, order, overlap, prefilter)
