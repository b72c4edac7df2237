"""A query for every operator family, over whole tables, with SQL that checks it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmatch import oracle as sql
from driftmatch.functions import matches as fm
from driftmatch.operators.engine import Engine, Replacer
from driftmatch.operators.exact import exact_matches
from driftmatch.operators.join import fuzzy_join
from driftmatch.oracle import Case
from driftmatch.plans.spec import Limits, Pattern, Penalties, Similarity
from driftmatch.sources.windows import windows_of_texts
from driftmatch.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def engine(case: Case, **more) -> Engine:
    return Engine(case.patterns, **{**case.settings(), **more})


def distinct_first(spark: SparkSession, sf_dir: str, case: Case, value: Callable[[Column], Column], name: str) -> DataFrame:
    """``value`` of a low-cardinality text column: worked out for its distinct texts and joined back."""
    rows = table(spark, sf_dir, case.table).select(case.key, case.column)
    texts = rows.select(case.column).distinct().select(case.column, value(F.col(case.column)).alias(name))
    return rows.join(texts, case.column)


def match_rows(df: DataFrame, case: Case, full: bool = True) -> DataFrame:
    """One row for each match in the array column ``m``."""
    sim = F.round(F.col("x.similarity").cast("double"), 4).alias("sim")
    base = df.select(case.key, F.explode_outer("m").alias("x")).where(F.col("x").isNotNull())  # see Engine.search_df
    cols = [F.col("x.pattern").alias("pattern"), F.col("x.start").alias("m_start"), F.col("x.end").alias("m_end"), sim]
    if full:
        cols += [F.col(f"x.{a}").cast("int").alias(b) for a, b in (("insertions", "ins"), ("deletions", "del"), ("substitutions", "sub"), ("swaps", "swp"), ("edits", "edits"))]
    return base.select(case.key, *cols)


def search_rows(case: Case, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(case, **more)
        return match_rows(distinct_first(spark, sf_dir, case, lambda t: e.search(t, case.threshold), "m"), case)

    return run


PARTS = Case("part", "p_partkey", "p_name", ("wigdet", "anvl", "gizmo"), 0.751, Limits(edits=1))
FUZZY = {
    "search_edits1": PARTS,
    "search_edits2": replace(PARTS, patterns=("wdgit", "gizom", "plaet", "rnig"), threshold=0.5551, limits=Limits(edits=2)),
    "search_type_limits": replace(PARTS, patterns=("widgett", "gera", "blot"), threshold=0.5051, limits=Limits(insertions=1, deletions=2, substitutions=1, swaps=1)),
    "search_total_and_type_limits": replace(PARTS, patterns=("wodget", "annvil", "bolt"), threshold=0.5051, limits=Limits(edits=2, swaps=0, deletions=1)),
    "search_pattern_limits": replace(PARTS, patterns=(Pattern("wigdet", 1.0, Limits(edits=2)), Pattern("gizma", 1.0, Limits(substitutions=1)), Pattern("bolt")), threshold=0.5051, limits=None),
    "search_weights": replace(PARTS, patterns=(("gear", 1.25, 1), ("gaer", 0.9, 1), ("rod", 2.0, 1)), threshold=0.6051, limits=None),
    "search_penalties": replace(PARTS, patterns=("wigdet", "gizzmo", "plat"), threshold=0.6051, limits=Limits(edits=2), penalties=Penalties(0.5, 0.8, 1.2, 0.6)),
    "search_case_fold": Case("region", "r_regionkey", "r_name", ("africa", "amerca", "middel east", "asai"), 0.6051, Limits(edits=2), case_insensitive=True),
    "search_case_sensitive": Case("region", "r_regionkey", "r_name", ("africa", "EUROPE", "ASAI"), 0.6051, Limits(edits=1)),
    "search_custom_similarity": Case("orders", "o_orderkey", "o_orderpriority", ("2-HAGH", "MEDXUM", "LOX"), 0.7051, Limits(edits=1), similarity=Similarity.from_map({("A", "I"): 0.9, ("X", "I"): 0.5, ("X", "W"): 0.75})),
    "search_symbol_floor": replace(PARTS, patterns=("wodget", "gxzmo", "balt"), threshold=0.5051, limits=Limits(edits=1), floor=0.5),
    "search_mapping": Case("customer", "c_custkey", "c_mktsegment", ("AUTOMOBYLE", "HAUSEHOLD", "PHURNITURE", "MAXINERY"), 0.8051, Limits(edits=1), mappings=(("Y", "I"), ("AU", "OU", 0.8), ("PH", "F"), ("X", "CH", 0.9))),
    "search_exact_engine": Case("customer", "c_custkey", "c_mktsegment", ("BUILD", "MACHINE", "HOLD"), 0.9, None),
    "search_empty_spans": Case("region", "r_regionkey", "r_name", ("x",), 0.0, Limits(edits=1)),
}
for _name, _case in FUZZY.items():
    query(_name, sql.rows_sql(_case))(search_rows(_case))

MANY = replace(PARTS, patterns=("large", "large widget", "widget", "wigdet gear", "gizmo", "hot", "hot gi", "gear"), threshold=0.5551, limits=Limits(edits=1))
#: Patterns that share ids, so that one match of each group is accepted.
GROUPS = replace(MANY, patterns=tuple(Pattern(p, custom_unique_id=k) for p, k in zip(MANY.patterns, (1, 1, 1, 1, 2, 2, 1, 2))))
for _order in ("default", "greedy", "coverage_weighted"):

    @query(f"rank_{_order}", sql.ranked_sql(MANY, _order))
    def _ranked(spark: SparkSession, sf_dir: str, order: str = _order) -> DataFrame:
        e = engine(MANY)
        rows = distinct_first(spark, sf_dir, MANY, lambda t: e.search(t, MANY.threshold), "m").withColumn("m", fm.rank("m", order))
        return rows.select("p_partkey", F.posexplode_outer("m").alias("place", "x")).where(F.col("x").isNotNull()).select("p_partkey", F.col("place").cast("long").alias("place"), "x.pattern", F.col("x.start").alias("m_start"), F.col("x.end").alias("m_end"), F.round(F.col("x.similarity").cast("double"), 4).alias("sim"))

    for _unique in (False, True):

        @query(f"resolve_{'unique_' * _unique}{_order}", sql.kept_sql(GROUPS, _order, _unique))
        def _resolved(spark: SparkSession, sf_dir: str, order: str = _order, unique: bool = _unique) -> DataFrame:
            e = engine(GROUPS)
            overlap = "non_overlapping_unique" if unique else "non_overlapping"
            return match_rows(distinct_first(spark, sf_dir, MANY, lambda t: e.search(t, GROUPS.threshold, order, overlap), "m"), GROUPS, full=False)


_IDS = replace(PARTS, patterns=(Pattern("large", custom_unique_id=7), Pattern("larg", custom_unique_id=7), Pattern("wigdet"), Pattern("gear", custom_unique_id=1)), threshold=0.5551)


@query("resolve_custom_ids", sql.kept_sql(_IDS, "default", True))
def resolve_custom_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(_IDS)
    native = lambda t: fm.resolve(fm.rank(e.search(t, _IDS.threshold)), "non_overlapping_unique", e.compiled.unique)
    return match_rows(distinct_first(spark, sf_dir, _IDS, native, "m"), _IDS, full=False)


WORDS = replace(PARTS, patterns=("wigdet", "larg", "gizmo", "hto"), threshold=0.7051)
_SEGMENTS = f"WITH RECURSIVE {sql.pieces_sql(WORDS)} "


@query("segments", _SEGMENTS + "SELECT d.p_partkey, g.seq - 1 AS seq, g.matched, g.s AS g_start, g.e AS g_end, g.x AS g_text FROM part d JOIN seg g ON g.t = d.p_name")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(WORDS)
    rows = distinct_first(spark, sf_dir, WORDS, lambda t: e.segments(t, WORDS.threshold), "g")
    return rows.select("p_partkey", F.posexplode_outer("g").alias("seq", "x")).where(F.col("x").isNotNull()).select("p_partkey", F.col("seq").cast("long").alias("seq"), "x.matched", F.col("x.start").alias("g_start"), F.col("x.end").alias("g_end"), F.col("x.text").alias("g_text"))


@query("segment_text", _SEGMENTS + """, spaced AS (
  SELECT t, seq, x, matched, lag(matched) OVER w AS prev, lag(x) OVER w AS px FROM seg WINDOW w AS (PARTITION BY t ORDER BY seq))
SELECT d.p_partkey, v.out AS text_out FROM part d JOIN (
  SELECT t, string_agg(CASE WHEN matched AND (coalesce(prev, false) OR (px IS NOT NULL AND right(px, 1) <> ' ')) THEN ' ' WHEN NOT matched AND coalesce(prev, false) AND left(x, 1) NOT IN (',', '.', '?', '!', ';', ':', '-') THEN ' ' ELSE '' END || x, '' ORDER BY seq) AS out
  FROM spaced GROUP BY t) v ON v.t = d.p_name""")  # fmt: skip
def segment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(WORDS)
    return distinct_first(spark, sf_dir, WORDS, lambda t: e.segment_text(t, WORDS.threshold), "text_out").select("p_partkey", "text_out")


@query("split", _SEGMENTS + "SELECT d.p_partkey, coalesce(v.pieces, '') AS pieces FROM part d LEFT JOIN (SELECT t, string_agg(x, '|' ORDER BY seq) AS pieces FROM seg WHERE NOT matched GROUP BY t) v ON v.t = d.p_name")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(WORDS)
    return distinct_first(spark, sf_dir, WORDS, lambda t: F.array_join(e.split(t, WORDS.threshold), "|"), "pieces").select("p_partkey", "pieces")


_STRIP = _SEGMENTS + ", solid AS (SELECT *, NOT matched AND trim(x) <> '' AS solid FROM seg), ends AS (SELECT t, min(seq) FILTER (solid) AS a, max(seq) FILTER (solid) AS z FROM solid GROUP BY t) "


@query("strip_prefix", _STRIP + "SELECT d.p_partkey, coalesce(v.out, '') AS text_out FROM part d LEFT JOIN (SELECT t, string_agg(CASE WHEN seq = a THEN ltrim(x) ELSE x END, '' ORDER BY seq) AS out FROM seg JOIN ends USING (t) WHERE seq >= a GROUP BY t) v ON v.t = d.p_name")
def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(WORDS)
    return distinct_first(spark, sf_dir, WORDS, lambda t: e.strip_prefix(t, WORDS.threshold), "text_out").select("p_partkey", "text_out")


@query("strip_suffix", _STRIP + "SELECT d.p_partkey, coalesce(v.out, '') AS text_out FROM part d LEFT JOIN (SELECT t, string_agg(CASE WHEN seq = z THEN rtrim(x) ELSE x END, '' ORDER BY seq) AS out FROM seg JOIN ends USING (t) WHERE seq <= z GROUP BY t) v ON v.t = d.p_name")
def strip_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(WORDS)
    return distinct_first(spark, sf_dir, WORDS, lambda t: e.strip_suffix(t, WORDS.threshold), "text_out").select("p_partkey", "text_out")


@query("replace_table", _SEGMENTS + "SELECT d.p_partkey, v.out AS text_out FROM part d JOIN (SELECT s.t, string_agg(CASE WHEN NOT s.matched THEN s.x ELSE ['gadget', 'big', 'thing', 'warm'][k.m.pid + 1] END, '' ORDER BY s.seq) AS out FROM seg s LEFT JOIN kept k ON k.t = s.t AND k.m.s = s.s AND s.matched GROUP BY s.t) v ON v.t = d.p_name")
def replace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Replacer(list(zip(WORDS.patterns, ("gadget", "big", "thing", "warm"))), **WORDS.settings())
    return distinct_first(spark, sf_dir, WORDS, lambda t: r.replace(t, WORDS.threshold), "text_out").select("p_partkey", "text_out")


@query("replace_callback", _SEGMENTS + "SELECT d.p_partkey, v.out AS text_out FROM part d JOIN (SELECT s.t, string_agg(CASE WHEN NOT s.matched OR k.m.pid <> 0 THEN s.x ELSE '<' || s.x || '>' END, '' ORDER BY s.seq) AS out FROM seg s LEFT JOIN kept k ON k.t = s.t AND k.m.s = s.s AND s.matched GROUP BY s.t) v ON v.t = d.p_name")
def replace_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(WORDS)
    mark = lambda m: F.when(m["pattern_index"] == 0, F.concat(F.lit("<"), m["text"], F.lit(">")))
    return distinct_first(spark, sf_dir, WORDS, lambda t: e.replace(t, mark, WORDS.threshold), "text_out").select("p_partkey", "text_out")


@query("filter_and_spans", f"WITH RECURSIVE {sql.resolved_sql(WORDS)} SELECT d.p_partkey, count(k.m) AS n, coalesce(string_agg(k.m.s || '-' || k.m.e || ':' || substr(k.t, (k.m.s + 1)::INT, (k.m.e - k.m.s)::INT), ',' ORDER BY k.m.s), '') AS spans FROM part d LEFT JOIN (SELECT * FROM kept WHERE m.pid <> 2) k ON k.t = d.p_name GROUP BY d.p_partkey")
def filter_and_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(WORDS)
    rows = distinct_first(spark, sf_dir, WORDS, lambda t: fm.filter_matches(e.search(t, WORDS.threshold, "default", "non_overlapping"), lambda m: m["pattern_index"] != 2), "m")
    both = F.zip_with(fm.matched_spans("m"), fm.matched_strings("m"), lambda s, x: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), x))
    return rows.select("p_partkey", fm.count("m").cast("long").alias("n"), F.array_join(both, ",").alias("spans"))


_EXACT = ("the", "and the", "tion", "thion")
_EXACT_SQL = "WITH p(pattern) AS (VALUES {}), b AS (SELECT item_id, text, unnest(range(0, length(text))) AS i FROM benchmark) SELECT item_id, pattern, strlen(left(text, i::INT)) AS m_start, strlen(left(text, i::INT)) + strlen(pattern) AS m_end, 1.0::DOUBLE AS sim FROM b JOIN p ON substr(text, (i + 1)::INT, length(pattern)) = pattern".format(", ".join(f"('{p}')" for p in _EXACT))


@query("exact_join", _EXACT_SQL)
def exact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_matches(table(spark, sf_dir, "benchmark").select("item_id", "text"), Engine(_EXACT, suffix_outputs=False))
    return found.select("item_id", "pattern", F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.col("similarity").cast("double").alias("sim"))


@query("exact_search", _EXACT_SQL)
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(_EXACT, suffix_outputs=False)
    found = e.search_df(table(spark, sf_dir, "benchmark"), "text", 0.9, keep=["item_id"])
    return found.select("item_id", "pattern", F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.col("similarity").cast("double").alias("sim"))


_INSULTS = ("idiot", "worthless", "pathetic", "disgusting")


@query("documents_exact", "WITH p(pattern) AS (VALUES {}) SELECT doc_id, pattern, (length(text) - length(replace(text, pattern, ''))) // length(pattern) AS n FROM documents, p WHERE contains(text, pattern)".format(", ".join(f"('{p}')" for p in _INSULTS)))
def documents_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(_INSULTS)
    return e.search_df(table(spark, sf_dir, "documents"), "text", 0.9, keep=["doc_id"]).groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))


@query("documents_fuzzy")
def documents_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt words in whole documents, behind the seed predicate."""
    e = Engine(_INSULTS, limits=Limits(edits=1), case_insensitive=True)
    found = e.search_df(table(spark, sf_dir, "documents"), "text", 0.85, "default", "non_overlapping", keep=["doc_id"])
    return found.select("doc_id", "pattern", "start", "end", F.round(F.col("similarity").cast("double"), 4).alias("sim"), "edits", "text")


@query("prefilter_is_exact", f"WITH RECURSIVE {sql.best_sql(PARTS)} SELECT d.p_partkey, count(b.pid) AS n_with, count(b.pid) AS n_without, true AS same FROM part d LEFT JOIN best b ON b.t = d.p_name GROUP BY d.p_partkey")
def prefilter_is_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(PARTS)
    both = lambda t: F.struct(e.search(t, PARTS.threshold).alias("a"), e.search(t, PARTS.threshold, prefilter="off").alias("b"))
    rows = distinct_first(spark, sf_dir, PARTS, both, "x")
    return rows.select("p_partkey", F.size("x.a").cast("long").alias("n_with"), F.size("x.b").cast("long").alias("n_without"), (F.col("x.a") == F.col("x.b")).alias("same"))


#: Two edits over short patterns: three states at a step lose matches that the exact search finds.
NARROW = replace(PARTS, patterns=("wdgit", "gizom", "plaet", "rnig"), threshold=0.5551, limits=Limits(edits=2), beam=3)


@query("beam_search", sql.rows_sql(NARROW))
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rows(distinct_first(spark, sf_dir, NARROW, lambda t: engine(NARROW).search(t, NARROW.threshold), "m"), NARROW)


@query("auto_beam_search", sql.rows_sql(NARROW))
def auto_beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget that the first state spends: the beam from the start."""
    e = engine(replace(NARROW, beam=None), auto_beam=(0, 3))
    return match_rows(distinct_first(spark, sf_dir, NARROW, lambda t: e.search(t, NARROW.threshold), "m"), NARROW)


@query("auto_beam_unspent", sql.rows_sql(PARTS))
def auto_beam_unspent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget that is never spent is the exact search."""
    return match_rows(distinct_first(spark, sf_dir, PARTS, lambda t: engine(PARTS, auto_beam=(1 << 40, 8)).search(t, PARTS.threshold), "m"), PARTS)


#: Patterns that end beginnings of others are reported over these, too.
NESTED = replace(PARTS, patterns=("hot gear", "gear", "hot gi", "ot", "large widget", "widget", "gea"), threshold=0.7051, suffix_outputs=True)
query("suffix_outputs", sql.rows_sql(NESTED))(search_rows(NESTED))


@query("documents_dictionary", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(p_name, '[a-z]+')) AS pattern FROM part UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) FROM benchmark),
p AS (SELECT pattern FROM w), hit AS (SELECT item_id, pattern, (length(text) - length(replace(text, pattern, ''))) // length(pattern) AS n FROM benchmark JOIN p ON contains(text, pattern))
SELECT item_id, count(*) AS patterns FROM hit GROUP BY item_id""")
def documents_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of a dictionary of thousands each benchmark text holds, anywhere in it."""
    words = table(spark, sf_dir, "part").select(F.explode(F.expr("regexp_extract_all(p_name, '[a-z]+', 0)")).alias("pattern"))
    words = words.union(table(spark, sf_dir, "benchmark").select(F.explode(F.expr("regexp_extract_all(text, '[A-Za-z]{5,}', 0)")))).distinct()
    pats = words.orderBy("pattern").select(F.xxhash64("pattern").alias("pattern_index"), "pattern")
    found = fuzzy_join(table(spark, sf_dir, "benchmark").select("item_id", "text"), pats, "text", 0.9, suffix_outputs=False)
    return found.groupBy("item_id").agg(F.count_distinct("pattern").alias("patterns"))


@query("patterns", "SELECT * FROM (VALUES (0, 'wigdet', 6, 6), (1, 'anvl', 4, 4), (2, 'gizmo', 5, 5)) v(pattern_index, pattern, grapheme_len, byte_len)")
def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(PARTS).patterns_df(spark).select("pattern_index", "pattern", "grapheme_len", "byte_len")


@query("sql_lateral", f"WITH RECURSIVE {sql.best_sql(PARTS)} SELECT pattern, count(*) AS n FROM part JOIN best ON t = p_name GROUP BY pattern")
def sql_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine(PARTS).register(spark, "part_typos", PARTS.threshold)
    table(spark, sf_dir, "part").createOrReplaceTempView("driftmatch_part")
    return spark.sql("SELECT m.pattern, sum(p.n) AS n FROM (SELECT p_name, count(*) AS n FROM driftmatch_part GROUP BY p_name) p, LATERAL part_typos_rows(p.p_name) m GROUP BY m.pattern")


@query("sql_array", f"WITH RECURSIVE {sql.best_sql(PARTS)} SELECT p_partkey, count(pid) AS n FROM part LEFT JOIN best ON t = p_name GROUP BY p_partkey")
def sql_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine(PARTS).register(spark, "part_typos", PARTS.threshold)
    table(spark, sf_dir, "part").createOrReplaceTempView("driftmatch_part")
    return spark.sql("SELECT p_partkey, cast(size(part_typos(p_name)) AS bigint) AS n FROM driftmatch_part")


_KINDS = replace(PARTS, patterns=("wigdet", "gizmo", "anvl", "gera"), threshold=0.7051)


@query("fuzzy_join_revenue", f"WITH RECURSIVE {sql.resolved_sql(_KINDS)} SELECT k.m.pattern AS pattern, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey JOIN kept k ON k.t = p_name GROUP BY 1")
def fuzzy_join_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    pats = spark.createDataFrame([(i, p) for i, p in enumerate(_KINDS.patterns)], "pattern_index int, pattern string")
    kinds = fuzzy_join(parts.select("p_name").distinct(), pats, "p_name", _KINDS.threshold, order="default", overlap="non_overlapping", limits=_KINDS.limits)
    named = parts.select("p_partkey", "p_name").join(kinds.select("p_name", "pattern"), "p_name")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    # Summed by part before the join: the larger table is shuffled once, already reduced.
    by_part = lines.groupBy("p_partkey").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    return named.join(by_part, "p_partkey").groupBy("pattern").agg(F.sum("n").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))


_SEGMENT_NAMES = Case("customer", "c_custkey", "c_mktsegment", ("MACHINRY", "BIULDING"), 0.8051, Limits(edits=1))
for _how, _not in (("left_semi", ""), ("left_anti", "NOT ")):

    @query(f"fuzzy_{_how[5:]}_join", f"WITH RECURSIVE {sql.best_sql(_SEGMENT_NAMES)} SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment {_not}IN (SELECT t FROM best)")
    def _some(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        pats = spark.createDataFrame([(i, p) for i, p in enumerate(_SEGMENT_NAMES.patterns)], "pattern_index int, pattern string")
        rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        texts = fuzzy_join(rows.select("c_mktsegment").distinct(), pats, "c_mktsegment", _SEGMENT_NAMES.threshold, how=how, limits=_SEGMENT_NAMES.limits)
        return rows.join(texts, "c_mktsegment").select("c_custkey", "c_mktsegment")


_WINDOW = 2048


@query("stream_search", "WITH p(pattern) AS (VALUES {}) SELECT doc_id::VARCHAR AS stream_id, pattern, (length(text) - length(replace(text, pattern, ''))) // length(pattern) AS n FROM documents, p WHERE contains(text, pattern)".format(", ".join(f"('{p}')" for p in _INSULTS)))
def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a byte stream, in windows of 2 KiB."""
    e = Engine(_INSULTS)
    w = windows_of_texts(table(spark, sf_dir, "documents"), e, "doc_id", "text", _WINDOW)
    return stream.search_windows(e, w, 0.9).groupBy("stream_id", "pattern").agg(F.count("*").alias("n"))


@query("stream_bytes", "SELECT doc_id::VARCHAR AS stream_id, strlen(text)::BIGINT AS bytes FROM documents")
def stream_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.bytes_read(windows_of_texts(table(spark, sf_dir, "documents"), Engine(_INSULTS), "doc_id", "text", _WINDOW)).select("stream_id", F.col("bytes").cast("long").alias("bytes"))


@query("stream_replace", "SELECT doc_id::VARCHAR AS stream_id, md5(replace(replace(replace(replace(text, 'idiot', 'person'), 'worthless', '#'), 'pathetic', ''), 'disgusting', 'dis')) AS digest FROM documents")
def stream_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Replacer(list(zip(_INSULTS, ("person", "#", "", "dis"))))
    w = windows_of_texts(table(spark, sf_dir, "documents"), r.engine, "doc_id", "text", _WINDOW)
    out = stream.replace_stream(r, w, 0.9)
    # A stream here is one document, so its windows fit one row again.
    whole = out.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("w"))
    return whole.select("stream_id", F.md5(F.array_join(F.transform("w", lambda x: x["text"]), "").cast("binary")).alias("digest"))


@query("stream_replace_fuzzy")
def stream_replace_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Replacer([(p, f"<{i}>") for i, p in enumerate(_INSULTS)], limits=Limits(edits=1), case_insensitive=True)
    return stream.replace_stream(r, windows_of_texts(table(spark, sf_dir, "documents"), r.engine, "doc_id", "text", _WINDOW), 0.85)


@query("pattern_counts", f"WITH RECURSIVE {sql.resolved_sql(PARTS)} SELECT k.m.pattern AS pattern, count(*) AS n FROM part JOIN kept k ON k.t = p_name GROUP BY 1")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the misspelt word that their name holds."""
    e = engine(PARTS)
    rows = distinct_first(spark, sf_dir, PARTS, lambda t: e.search(t, PARTS.threshold, "default", "non_overlapping"), "m")
    return rows.select(F.explode_outer("m").alias("m")).where(F.col("m").isNotNull()).groupBy("m.pattern").agg(F.count("*").alias("n"))
