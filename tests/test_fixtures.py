"""Search, ranking, overlap, segmentation and replacement on known inputs; plain Python, then the same on Spark."""

import pytest

from driftmatch.functions import matches as fm
from driftmatch.operators.engine import Engine, Replacer
from driftmatch.plans.spec import Limits, Options, Pattern, Penalties, Similarity

E = lambda n, **k: Limits(edits=n, **k)
NO, NOU = ("default", "non_overlapping"), ("default", "non_overlapping_unique")


def found(patterns, text, theta, how=("unsorted", "keep"), **settings):
    e = Engine(patterns, **settings)
    raw = text.encode()
    return [(e.patterns[m.pattern_index].text, raw[m.start : m.end].decode(), m.start, m.end, m.similarity) for m in e.search_local(text, theta, *how)]


def pairs(*args, **kw):
    return [x[:2] for x in found(*args, **kw)]


CI = {"case_insensitive": True}
LONG = ["RUSSISCHE", "NATIONALE", "RUCKVERSICHERUNGSGESELLSCHAFT", "JSC", "PUBLIC", "JOINT", "STOCK", "COMPANY", "GESELLSCHAFT", "LIMITED", "LLC"]


@pytest.mark.parametrize("patterns,settings,text,theta,how,expected", [
    (["NA", "MENA"], {"limits": E(2), **CI}, "NA MENA", 0.6, NO, [("MENA", "MENA")]),
    (["KO", "KO", "LWIN"], {"limits": E(1), **CI}, "KWO KO LWIN", 0.6, NO, [("KO", "KWO")]),
    (["AL", "WASEL", "AND", "BABEL", "GENERAL", "TRADING", "LLC"], {"limits": E(1), **CI}, "AL WASL ANT BBEL GNERAL TRATING LC", 0.6, NOU, [("WASEL", "WASL"), ("BABEL", "BBEL")]),
    (["world"], CI, "HeLlO WoRlD", 0.9, NO, [("world", "WoRlD")]),
    (["юрий"], CI, "ЮРИЙ ГАГАРИН", 0.9, NO, [("юрий", "ЮРИЙ")]),
    (["saddam", "hussein"], {"limits": E(2)}, "saddamhussein", 0.5, NO, [("saddam", "saddam"), ("hussein", "hussein")]),
    (["saddam", "hussein"], {"limits": E(2)}, "saddmhussin", 0.3, ("unsorted", "keep"), [("saddam", "saddm")]),
    (["saddam", "hussein"], {"limits": E(2)}, "saddamhuzein", 0.2, ("unsorted", "keep"), [("hussein", "huzein")]),
    (["ALI", "KONY"], {"limits": E(2), **CI}, "ALIKOYN", 0.6, NO, [("KONY", "KOYN")]),
    ([("TOLA", 1, 2)], {}, "TOL", 0.5, NO, [("TOLA", "TOL")]),
    ([("WALIJAN", 1, 3)], CI, "alijan", 0.7, NO, [("WALIJAN", "alijan")]),
    (["WALIJAN"], {"limits": E(3), **CI}, "alijan", 0.7, NO, [("WALIJAN", "alijan")]),
    ([("TOLA", 1, 2)], CI, "OLA", 0.5, NO, [("TOLA", "OLA")]),
    ([("DJAMEL", 1, 3)], CI, "Tjamel", 0.7, NO, [("DJAMEL", "Tjamel")]),
    ([("MOMIR", 1, 3)], CI, "Mmir", 0.5, NO, [("MOMIR", "Mmir")]),
    ([("AMINULLAH", 1, 3)], CI, "Aminulah", 0.7, NO, [("AMINULLAH", "Aminulah")]),
    (LONG, {"limits": Limits(edits=3, substitutions=1, deletions=2, insertions=2, swaps=0), **CI}, "RUSSISCHE NATIONALE RUCKVERSICHERUNGSGESELLSCHAFT JSC", 0.8, ("greedy", "non_overlapping"), [("JSC", "JSC")]),
    (["tincidunt", "porta"], {"limits": E(1), **CI}, "sed tincidutn, at Tincidunt porta", 0.8, NO, [("tincidunt", "tincidutn"), ("tincidunt", "Tincidunt"), ("porta", "porta")]),
])
def test_contains(patterns, settings, text, theta, how, expected):
    got = pairs(patterns, text, theta, how, **settings)
    for e in expected:
        assert e in got


def test_similarities_and_spans():
    got = found(["hello", "world"], "helllo wolrd", 0.8, NO, limits=E(1), **CI)
    assert [x[2:4] for x in got] == [(0, 6), (7, 12)]
    assert [round(x[4], 3) for x in got] == [0.896, 0.896]
    (x,) = found([("DJAMEL", 1, 3)], "Tjamel", 0.7, NO, **CI)
    assert round(x[4], 3) == 0.857
    (x,) = found([("MOMIR", 1, 3)], "Mmir", 0.7, NO, **CI)
    assert round(x[4], 3) == 0.818


def test_nothing_found():
    assert not found(["CO"], "CA", 0.8, **CI)
    assert not found(["zavod"], "NARODNY", 0.8, NO, limits=E(2, substitutions=1), **CI)


def test_pattern_limits_count():
    p = [("saddam", 1, 2), ("ddamhu", 1, 2)]
    assert {"saddam", "ddamhu"} <= {x[0] for x in found(p, "saddamddamhu", 0.5)}
    assert len(found(p, "saddamhussein", 0.7, NO)) == 1
    assert len(found(p, "sadam ddamhu", 0.4, NO)) == 2


def test_long_pattern_wins():
    got = pairs(["JOINT STOCK COMPANY", "STOCK"], "JOINT STOCK COMPANY GAZPROM", 0.8, NO)
    assert ("JOINT STOCK COMPANY", "JOINT STOCK COMPANY") in got and not any(p == "STOCK" and t == "STOCK" for p, t in got)


def test_mappings():
    ae = {"limits": E(1), "mappings": [("æ", "ae")], **CI}
    for p, t in (("encyclopaedia", "encyclopædia"), ("encyclopædia", "encyclopaedia")):
        (x,) = found([p], t, 0.95, NO, **ae)
        assert x[4] > 0.999
    assert not found(["encyclopaedia"], "encyclopædia", 0.9, limits=E(1), **CI)
    assert len(found(["strasse"], "straße", 0.9, limits=E(1), mappings=[("ß", "ss")])) == 1
    assert not found(["strasse"], "straße", 0.9, limits=E(0), mappings=[("ß", "ss")])
    best = lambda s: max(x[4] for x in found(["alexandr"], "aleksandr", 0.5, limits=E(1), mappings=[("ks", "x", s)]))
    assert best(1.0) > best(0.8) and round(best(0.8), 3) == 0.964


def test_floor():
    v = {"limits": E(1), **CI}
    assert len(found(["vestibulum"], "vxstibulum", 0.8, NO, **v)) == 1
    assert not found(["vestibulum"], "vxstibulum", 0.8, NO, floor=0.3, **v)
    for t in ("vestibulom", "vestibulum"):
        assert len(found(["vestibulum"], t, 0.8, NO, floor=0.3, **v)) == 1


def test_beams():
    words = ["saddam", "hussein", "general", "trading", "company", "limited"]
    text = "sadam husein generl tradign compny limted and others"
    exact = found(words, text, 0.6, limits=E(2), **CI)
    assert found(words, text, 0.6, limits=E(2), auto_beam=(1 << 60, 8), **CI) == exact
    assert "saddam" in {x[0] for x in found(words, text, 0.6, limits=E(2), auto_beam=(1, 16), **CI)}
    assert "saddam" in {x[0] for x in found(words[:2], "saddamhusein", 0.7, NO, limits=E(2), beam=100, **CI)}


class TestTraps:
    def test_suffix_outputs(self):
        p = ["JOINT STOCK COMPANY", "STOCK"]
        assert {x[2:4] for x in found(p, "JOINT STOCK", 0.8)} == {(6, 11), (0, 11)}
        assert {x[2:4] for x in found(p, "JOINT STOCK", 0.8, suffix_outputs=False)} == {(6, 11)}

    def test_non_ascii_substitution(self):
        (x,) = found(["юрий"], "юрай", 0.5, NO, limits=E(1))
        assert x[1] == "юрай" and round(x[4], 4) == 0.6425

    def test_first_character_stands_for_a_cluster(self):
        (x,) = found(["cafe"], "café", 0.9)
        assert x[1] == "café"
        assert not found(["cafe"], "café", 0.9, mappings=[("q", "k")])

    def test_crlf(self):
        assert not found(["a\r\nb"], "a\r\nb", 0.9)
        assert [x[2:4] for x in found(["a\r\nb"], "éa\r\nb", 0.9)] == [(2, 6)]

    def test_empty_spans(self):
        assert [(x[2], x[3], round(x[4], 2)) for x in found(["x"], "ae", 0.0, limits=E(1))] == [(0, 0, 0.09), (1, 1, 0.09)]

    def test_inherited_limits(self):
        assert ("world", "wrld") in pairs([Pattern("hello", 1, E(1)), "world"], "wrld", 0.7)

    def test_invalid(self):
        for bad in (lambda: Pattern(""), lambda: Pattern("a", 0), lambda: Penalties(swap=-1), lambda: Limits(edits=300), lambda: Options(order="x"), lambda: Similarity.from_map({("ab", "c"): 1})):
            with pytest.raises(ValueError):
                bad()

    def test_overlap_without_order_uses_the_default(self):
        e = Engine(["abc", "bcd"], limits=E(1))
        assert e.search_local("abcd", 0.5, "unsorted", "non_overlapping") == e.search_local("abcd", 0.5, *NO)


def one(spark, text, f):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("r")).first().r


LOREM = Engine(["LOREM", "IPSUM"], limits=E(1), **CI)


@pytest.mark.parametrize("engine,text,theta,op,expected", [
    (Engine(["saddam", "hussein"], limits=E(3)), "sadamhusein", 0.8, "segment_text", "sadam husein"),
    (Engine(["saddam", "hussein"], limits=E(3)), "sadamhuseinaltikriti", 0.8, "segment_text", "sadam husein altikriti"),
    (Engine(["input", "more"], limits=E(1)), "someinptandm0re", 0.75, "segment_text", "some inpt and m0re"),
    (Engine(["SHANE", "DOMINIC", "CRAWFORD"], limits=E(3)), "SHANEDOM INICCRAWFORD", 0.8, "segment_text", "SHANE DOM INIC CRAWFORD"),
    (Engine(["HASAN", "JAMAL", "HUSSEIN", "ZEINIYE"], **CI), "ZEINIYEHussEINHASaNJAMAL", 0.8, "segment_text", "ZEINIYE HussEIN HASaN JAMAL"),
    (Engine(["hello", "world"], **CI), "justheLLowOrLd!", 1.0, "segment_text", "just heLLo wOrLd!"),
    (Engine(["юрий"], **CI), "ЮРИЙГАГАРИН", 0.9, "segment_text", "ЮРИЙ ГАГАРИН"),
    (Engine(["saddam", "hussein"]), "sadam husein", 0.8, "segment_text", "sadam husein"),
    (Engine(["foo"]), "foo bar", 0.8, "segment_text", "foo  bar"),
    (LOREM, "LrEM ISuM Lorm ZZZ", 0.8, "strip_prefix", "ZZZ"),
    (LOREM, "ZZZ LrEM ISuM Lorm", 0.8, "strip_suffix", "ZZZ"),
    (LOREM, "LrEM ISuM", 0.8, "strip_prefix", ""),
    (LOREM, "LrEM ISuM", 0.8, "strip_suffix", ""),
    (LOREM, " x ", 0.8, "strip_prefix", "x "),
    (LOREM, " x ", 0.8, "strip_suffix", " x"),
    (LOREM, "ZZZLrEMISuMAAA", 0.8, "split", ["ZZZ", "AAA"]),
    (Engine(["FOO", "BAR"], limits=E(1), **CI), "xxFo0yyBAARzz", 0.8, "split", ["xx", "yy", "zz"]),
    (LOREM, "", 0.8, "split", []),
    (LOREM, None, 0.8, "segment_text", None),
])
def test_text_operations(spark, engine, text, theta, op, expected):
    assert one(spark, text, lambda c: getattr(engine, op)(c, theta)) == expected


@pytest.mark.parametrize("pairs_,settings,text,theta,expected", [
    ([("PUBLIC JOINT STOCK COMPANY", "PJSC"), ("JOINT STOCK COMPANY", "JSC"), ("LIMITED LIABILITY COMPANY", "LLC"), ("OPEN", "O")], CI, "PUBLIC JOINT STOCK COMPANY GAZPROM", 0.8, "PJSC GAZPROM"),
    ([("foo", "bar"), ("baz", "qux")], {"limits": Limits(substitutions=1), **CI}, "fo0 and BAZ!", 0.7, "bar and qux!"),
    ([("CZECHOSLOVAKIA", "SERBIA")], {"limits": E(5), **CI}, "CHEKHOSLOVAKIA", 0.7, "SERBIA"),
    ([("hello", "hi"), ("world", "earth")], {"limits": E(1), **CI}, "hell0 w0rld!", 0.8, "hi earth!"),
])
def test_replacers(spark, pairs_, settings, text, theta, expected):
    assert one(spark, text, lambda c: Replacer(pairs_, **settings).replace(c, theta)) == expected


def test_replace_callback(spark):
    from pyspark.sql import functions as F

    e = Engine(["FOO", "BAR", "BAZ"])
    assert one(spark, "FOO BAR BAZ", lambda c: e.replace(c, lambda m: F.when(m["pattern"] == "BAR", F.lit("###")), 0.8)) == "FOO ### BAZ"
    e = Engine(["hair", "bear", "wuzzy"], **CI)
    swap = lambda m: F.when(m["pattern"] == "hair", "bear").when(m["pattern"] == "bear", "hair")
    assert one(spark, "Fuzzy Wuzzy was a bear, had no hair", lambda c: e.replace(c, swap, 0.8)) == "Fuzzy Wuzzy was a hair, had no bear"
    e = Engine(["ipsum", "lorem"], limits=E(1), **CI)
    df = spark.createDataFrame([("ipsum and l0rem",)], "text string").withColumn("m", e.search("text", 0.5, *NO))
    kept = fm.filter_matches("m", lambda m: m["text"].contains("0"))
    got = df.select(fm.replace_matches("text", kept, lambda m: F.concat(F.lit("**"), m["text"], F.lit("**"))).alias("r")).first().r
    assert got == "ipsum and **l0rem**"


def test_native_functions_equal_the_kernel(spark):
    e = Engine([Pattern("hello", custom_unique_id=3), Pattern("hell", 0.9, custom_unique_id=3), "world", "lo wo"], limits=E(2), **CI)
    texts = ["helllo wolrd hello world", "HELL", "", "lo world", "héllo wörld", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for order in ("default", "greedy", "coverage_weighted"):
        for overlap in ("keep", "non_overlapping", "non_overlapping_unique"):
            a = fm.resolve(fm.rank("raw", order), overlap, e.compiled.unique)
            for r in df.select(e.search("text", 0.4).alias("raw"), e.search("text", 0.4, order, overlap).alias("k")).select(a.alias("n"), "k").collect():
                assert r.n == r.k


def test_resolve_with_empty_spans(spark):
    def m(i, s, e):
        return (i, "p", s, e, 1.0, 0, 0, 0, 0, 0, "")

    df = spark.createDataFrame([([m(0, 2, 2), m(1, 2, 4), m(2, 0, 2)],)], f"m array<{fm.MATCH}>")
    assert [x.pattern_index for x in df.select(fm.resolve("m").alias("r")).first().r] == [2, 0]
    df = spark.createDataFrame([([m(1, 2, 4), m(0, 2, 2)],)], f"m array<{fm.MATCH}>")
    assert [x.pattern_index for x in df.select(fm.resolve("m").alias("r")).first().r] == [0, 1]


def test_rows_sql_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "helllo wolrd", "x"), (2, None, "y"), (3, "none", "z")], "id int, text string, pattern string")
    e = Engine(["hello", "world"], limits=E(1))
    got = e.search_df(df, "text", 0.8, *NO)
    assert {"pattern", "match_pattern", "match_text"} <= set(got.columns) and got.count() == 2
    e.register(spark, "typos", 0.8, *NO)
    df.createOrReplaceTempView("typo_rows")
    assert spark.sql("SELECT t.id, m.pattern FROM typo_rows t, LATERAL typos_rows(t.text) m").count() == 2
    assert [r.n for r in spark.sql("SELECT size(typos(text)) n FROM typo_rows ORDER BY id").collect()] == [2, None, 0] or [r.n for r in spark.sql("SELECT size(typos(text)) n FROM typo_rows ORDER BY id").collect()] == [2, -1, 0]


def test_exact_join_equals_search(spark):
    from driftmatch.operators.exact import exact_matches

    texts = ["café CAFE café", "a\r\nb", "éa\r\nb", "", None, "JOINT STOCK", "cafecafe"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for ci in (False, True):
        e = Engine(["cafe", "a\r\nb", "JOINT STOCK COMPANY", "STOCK", "café"], case_insensitive=ci)
        a = {tuple(r) for r in exact_matches(df, e).select("id", "pattern", "start", "end", "match_text").collect()}
        b = {tuple(r) for r in e.search_df(df, "text", 0.9).select("id", "pattern", "start", "end", "match_text").collect()}
        assert a == b and len(a) > 5


def test_joins(spark):
    from driftmatch.operators.join import fuzzy_join

    docs = spark.createDataFrame([(1, "helllo there"), (2, "nothing"), (3, None), (4, "wrold")], "id int, text string")
    pats = spark.createDataFrame([(10, "hello"), (20, "world")], "pattern_index int, pattern string")
    for most in (1, 10):
        got = fuzzy_join(docs, pats, threshold=0.8, most=most, limits=E(1), order="default", overlap="non_overlapping")
        assert {(r.id, r.pattern_id) for r in got.collect()} == {(1, 10), (4, 20)}
        assert {r.id for r in fuzzy_join(docs, pats, threshold=0.8, most=most, how="left_semi", limits=E(1)).collect()} == {1, 4}
        assert {r.id for r in fuzzy_join(docs, pats, threshold=0.8, most=most, how="left_anti", limits=E(1)).collect()} == {2, 3}
    none = fuzzy_join(docs, pats.where("false"), threshold=0.8)
    assert none.count() == 0
