"""The language model, toxicity and decontamination."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmatch.llm import common, decontaminate, ngram_lm, toxicity
from driftmatch.llm.common import buffers, tokens


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "extra") for i, t in enumerate(texts)], "doc_id int, text string, toxic string")


def brute_lm(train, texts, order):
    end = "\0end"
    seq = lambda t: (t or "").lower().split() + [end]
    grams = [collections.Counter() for _ in range(order + 1)]
    raw = collections.Counter()
    for t in train:
        s = seq(t)
        raw.update(s)
        p = ["\0bos"] * (order - 1) + s
        grams[order].update(tuple(p[i : i + order]) for i in range(len(s)))
    for n in range(order - 1, 0, -1):
        for g, c in grams[n + 1].items():
            grams[n][g[1:]] += c if n > 1 and g[1] == "\0bos" else 1

    def disc(c):
        of = collections.Counter(c.values())
        if not all(of[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = of[1] / (of[1] + 2 * of[2])
        d = [0, 1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3]]
        return d if all(0 < d[k] < k for k in (1, 2, 3)) else [0, 0.5, 1.0, 1.5]

    ds = [disc(c) if c else None for c in grams]

    def p(g):
        if not g:
            return 1 / (len(raw) + 1)
        c = grams[len(g)]
        rows = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        low = p(g[1:])
        if not rows:
            return low
        d = ds[len(g)]
        return (max(c.get(g, 0) - d[min(c.get(g, 0), 3)], 0) + sum(d[min(v, 3)] for v in rows.values()) * low) / sum(rows.values())

    out = []
    for t in texts:
        s = seq(t)
        q = ["\0bos"] * (order - 1) + s
        out.append((len(s), sum(raw[w] > 0 for w in s), sum(math.log10(p(tuple(q[i : i + order]))) for i in range(len(s)))))
    return out, sum(raw.values())


@pytest.mark.parametrize("order", [2, 3])
def test_model_equals_brute_force(spark, order):
    r = random.Random(order)
    texts = [" ".join(r.choices("a b c d e f g h The of".split(), [9, 8, 7, 6, 5, 4, 3, 2, 9, 1], k=r.randint(0, 14))) for _ in range(60)] + [None, "", "  \n", "zz unknown"]
    df = docs(spark, texts)
    model = ngram_lm.train(df.where("doc_id < 50"), order=order, shards=3)
    want, n = brute_lm(texts[:50], texts, order)
    assert model.train_tokens == n
    for r, w in zip(sorted(ngram_lm.score(df, model).collect()), want):
        assert (r.n_tokens, r.n_known) == w[:2] and r.score == pytest.approx(w[2], rel=1e-9)


def test_model_sums_to_one(spark):
    """Over the known words, the end and one unknown word, after a known and an unknown context."""
    model = ngram_lm.train(docs(spark, ["a b a c", "b a", "c c c a b", None]), shards=2)
    import pyarrow as pa

    h = ngram_lm.text_hashes(*buffers(pa.array(["a b c unknown"])))[0]
    for before in (h[0], h[3]):
        p = np.full(len(h), 1 / (model.vocabulary + 1))
        for spec in model.levels[:2]:
            level = ngram_lm.Level(spec, model.store)
            ctx = ngram_lm.context_hash([np.full(len(h), before)][: level.level - 1], h)
            p, _ = level.interpolate(ctx, h, p)
        assert p.sum() == pytest.approx(1)


def test_model_edges(spark):
    model = ngram_lm.train(docs(spark, []), shards=2)
    r = ngram_lm.score(docs(spark, ["x y", None]), model).collect()
    assert [x.score for x in r] == [0.0, 0.0] and model.train_tokens == 0
    assert ngram_lm.score(docs(spark, []), model).count() == 0
    held = [r.h for r in docs(spark, ["x"] * 40).orderBy("doc_id").select(ngram_lm.held_out().alias("h")).collect()]
    assert held == [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(40)]
    with pytest.raises(ValueError):
        ngram_lm.train(docs(spark, []), order=4)


def test_counts_above_a_byte(spark):
    texts = ["a b " * 400, "b a"]
    model = ngram_lm.train(docs(spark, texts), shards=2)
    want, _ = brute_lm(texts, texts, 3)
    assert [r.score for r in sorted(ngram_lm.score(docs(spark, texts), model).collect())] == pytest.approx([w[2] for w in want])


def test_many_shards_go_in_two_exchanges(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_SHARDS", 3)
    r = random.Random(3)
    texts = [" ".join(r.choices("abcdefgh", k=30)) for _ in range(60)] + ["x" * 70_000 + " y " * 3000]
    df = docs(spark, texts).withColumn("doc_id", F.lit(4))  # one id for all rows
    model = ngram_lm.train(df.repartition(3), shards=10)
    want, n = brute_lm(texts, texts, 3)
    got = [(x.doc_id, x.n_tokens, x.n_known, round(x.score, 6)) for x in ngram_lm.score(df, model).collect()]
    assert sorted(got) == sorted((4, a, b, round(c, 6)) for a, b, c in want) and model.train_tokens == n
    assert all((x["sizes"] > 0).sum() > 3 for x in model.levels)


def test_a_lost_file_is_an_error(spark):
    df = docs(spark, ["a b c", "b c d"])
    model = ngram_lm.train(df, shards=2)
    k = int(np.flatnonzero(model.levels[1]["sizes"])[0])
    store, path = model.store._at(f"2-{k}")
    store.delete_file(path)
    with pytest.raises(Exception, match="a file of"):
        ngram_lm.score(df, model).collect()
    model.delete()


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"
        getConf = dict
        get = None

    class Session:
        sparkContext, conf = Context(), {}

    Session.sparkContext.getConf = lambda: {}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(), "x")


def test_tokenizer_equals_split():
    import pyarrow as pa

    texts = ["The  quick\tbrown\x0bfox", "", None, "a", " a ", "É é", "x" * 3_000_000, "b\x1cc d\xa0e"]
    _, starts, ends, at, _ = tokens(*buffers(pa.array(texts, pa.string())))
    data, offs = buffers(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        got = [data[s:e].tobytes() for s, e in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]])]
        assert got == (t or "").encode().split()
    h = tokens(*buffers(pa.array(["The the THE thE x", "the"])))[0]
    assert len(set(h.tolist())) == 2 and h[0] == h[-1]


WORDS = [a + b + c for a in ("la", "mo", "ti", "ne") for b in ("ra", "su", "ki", "po") for c in ("n", "s", "l", "")]
INSULTS = ["gronk", "vexilar", "vexilon", "plumbat"]


def toxic_corpus(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = r.choices(WORDS, k=r.randint(5, 120))
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.choice([2, 3, 6, 9])):
                w.insert(r.randrange(len(w) + 1), r.choice(INSULTS))
        out.append((" ".join(w), int(bad)))
    return out


def test_toxicity_held_out(spark):
    data = toxic_corpus(900, 1)
    df = docs(spark, [t for t, _ in data])
    labels = spark.createDataFrame([(i, b, 1) for i, (_, b) in enumerate(data[:600])], "doc_id int, toxic int, quality int")
    model = toxicity.train(df, labels, F.expr("int(toxic > 0)"), levels=3)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    hits = [(got[i].toxic, bool(b)) for i, (_, b) in enumerate(data) if i >= 600]
    assert sum(a == b for a, b in hits) / len(hits) > 0.97 and not any(a and not b for a, b in hits)
    more = toxicity.score(docs(spark, ["gronk vexilar laran", "gronk " * 4 + "vexilar vexilon plumbat " * 4, "laran mosus", "VEXILOX!! gronk,"]), model).orderBy("doc_id").collect()
    assert more[0].expected_severity < more[1].expected_severity and more[2].grade == 0 and more[3].toxic
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r.toxic}


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id int, toxic int")
    df = docs(spark, ["a", None, "", "a"])
    model = toxicity.train(df, none, F.expr("int(toxic > 0)"), levels=3)
    assert [r.toxic for r in toxicity.score(df, model).collect()] == [False] * 4
    one = spark.createDataFrame([(0, 1), (1, None), (None, 1)], "doc_id int, toxic int")
    assert not any(r.toxic for r in toxicity.score(df, toxicity.train(df, one, F.expr("int(toxic > 0)"))).collect())
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 400)
    row, count = np.arange(400), np.maximum(1, 3**y)
    m = toxicity.fit(np.array([5]), row[y > 0], np.zeros((y > 0).sum(), int), count[y > 0], y)
    s = np.array([0, *(1 + np.log(3.0**k) for k in (1, 2, 3))]) * m.weights[5]
    assert (np.diff(m.above(s).sum(1)) > 0).all() and np.round(m.above(s).sum(1)).tolist() == [0, 1, 2, 3]


def brute_shifts(doc, item, min_words=13):
    """The shifts at which some stretch of min_words words (or the whole item) or more agrees in 80 %: all starts and ends."""
    least, found = min(min_words, len(item)), set()
    for shift in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[k] == doc[k + shift] for k in range(lo, hi)]
        m = [0, *itertools.accumulate(same)]
        if any(5 * (m[y] - m[x]) >= 4 * (y - x) for x in range(len(same)) for y in range(x + least, len(same) + 1)):
            found.add(shift)
    return found


def test_decontamination_equals_brute_force(spark):
    r = random.Random(15)
    items = [[f"i{k}w{j}" if r.random() < 0.9 else r.choice(WORDS) for j in range(r.choice([2, 5, 8, 12, 13, 14, 16, 20, 30, 45]))] for k in range(24)]
    texts = []
    for _ in range(300):
        body = [r.choice(WORDS) for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(0, 2)):
            item = r.choice(items)
            a = r.randint(0, max(0, len(item) - 14))
            part = [w if r.random() > r.choice([0, 0.1, 0.2, 0.25]) else "changed" for w in item[a:]]
            body[len(body) // 2 : len(body) // 2] = part
        texts.append(body)
    want = {(d, i, s) for d, t in enumerate(texts) for i, x in enumerate(items) for s in brute_shifts(t, x)}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id int, text string")
    df = docs(spark, [" ".join(t) for t in texts])
    got = decontaminate.overlaps(df, bench).collect()
    assert {(x.doc_id, x.item_id, x.doc_start - x.item_start) for x in got} == want and len(want) > 150
    spans = {}
    for x in got:
        d, i = texts[x.doc_id][x.doc_start :][: x.n_words], items[x.item_id][x.item_start :][: x.n_words]
        assert len(d) == len(i) == x.n_words >= min(13, len(items[x.item_id])) and sum(map(str.__eq__, d, i)) == x.n_matched >= 0.8 * x.n_words
        assert x.identity == x.n_matched / x.n_words and x.coverage == x.n_words / len(items[x.item_id])
        spans.setdefault((x.doc_id, x.item_id, x.doc_start - x.item_start), []).append((x.item_start, x.item_start + x.n_words))
    for at in map(sorted, spans.values()):
        assert all(e <= s for (_, e), (s, _) in zip(at, at[1:]))
    kept = {x.doc_id for x in decontaminate.without_overlaps(df, bench).collect()}
    assert kept == set(range(300)) - {d for d, _, _ in want}


def test_decontamination_edges(spark):
    r = random.Random(16)
    word = lambda: f"w{r.randrange(10**6)}"
    one, two, far = ([word() for _ in range(30)] for _ in range(3))
    item = " ".join(one + [word() for _ in range(100)] + two)
    long = " ".join(word() for _ in range(200_000)) + " " + " ".join(far)
    texts = [(1, " ".join(one + [word() for _ in range(100)] + two), "a"), (2, long, "b"), (2, "nothing here", "c"), (None, " ".join(far), None), (4, None, "e"), (5, "", "f"), (6, " ".join(far), "g"), (6, " ".join(far), "g")]
    df = spark.createDataFrame(texts, "doc_id int, text string, found_digest string")
    bench = spark.createDataFrame([(7, item, 1), (None, " ".join(far), 2), (-1, " ".join(far).upper(), 3), (9, None, 4), (10, "?!", 5), (None, "all of this is null", 6)] + [(100 + k, item, 7) for k in range(2000)], "item_id int, text string, doc_id int")
    got = sorted((x.doc_id or 0, x.item_id, x.n_items, x.item_start, x.n_words) for x in decontaminate.overlaps(df, bench).collect())
    assert got == [(0, -1, 2, 0, 30), (1, 7, 2001, 0, 30), (1, 7, 2001, 130, 30), (2, -1, 2, 0, 30), (6, -1, 2, 0, 30), (6, -1, 2, 0, 30)]
    kept = decontaminate.without_overlaps(df, bench)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(2, "nothing here", "c"), (4, None, "e"), (5, "", "f")]
    null = decontaminate.overlaps(spark.createDataFrame([(1, "now all of this is null, too")], "doc_id int, text string"), bench).collect()
    assert [(x.item_id, x.n_items) for x in null] == [(None, 1)]
    assert decontaminate.overlaps(docs(spark, []), bench).count() == 0
    assert decontaminate.overlaps(df, bench.where("false")).count() == 0
    assert decontaminate.without_overlaps(df, bench.where("false")).count() == 8


def test_decontamination(spark):
    r = random.Random(5)
    word = lambda: r.choice(WORDS) + r.choice(WORDS)
    items = [" ".join(word() for _ in range(r.randint(15, 40))) for _ in range(12)] + ["short item of six words here", "tiny", None, ""]
    texts, want = [], []
    for k in range(60):
        body = [word() for _ in range(r.randint(0, 80))]
        if k % 3 == 0:
            i = r.randrange(12)
            part = items[i].split()
            if k % 2:
                for j in range(3, len(part), 9):
                    part[j] = "changed"
            at = r.randrange(len(body) + 1)
            body[at:at] = [p.upper() + "," if k % 4 == 0 else p for p in part]
            want.append((k, i))
        texts.append(" ".join(body))
    texts += [None, "", "xx short, item; OF six words here yy", " ".join(items[0].split()[:7])]
    want.append((62, 12))
    df = docs(spark, texts)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id int, text string, doc_id string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(df, bench).collect()} == set(want)
    kept = {x.doc_id for x in decontaminate.without_overlaps(df, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_longest_qualifying_stretch():
    r = random.Random(9)
    for k in range(3000):
        same = np.array([r.random() < 0.75 for _ in range(r.randint(1, 40))])
        least = r.choice([1, 4, 13])
        want = max((b - a for a in range(len(same)) for b in range(a + least, len(same) + 1) if 5 * same[a:b].sum() >= 4 * (b - a)), default=0)
        at, n, m = decontaminate.longest(same, least, 0.8)
        assert n == want and m == same[at : at + n].sum() and 5 * m >= 4 * n


def test_substitutions_near_the_ends(spark):
    word = lambda k: f"w{k}"
    item = [word(k) for k in range(20)]
    texts = []
    for places in ((1,), (0, 1, 18, 19), (1, 2, 17, 18)):
        texts.append(" ".join("changed" if k in places else w for k, w in enumerate(item)))
    texts.append(" ".join("changed" if k == 1 else w for k, w in enumerate(item[:13])))
    got = {x.doc_id: x for x in decontaminate.overlaps(docs(spark, texts), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[3].n_words, got[3].n_matched) == (13, 12)


def test_masks_hit_all_substitutions():
    # From 26 words on a stretch has a shorter part that qualifies.
    for words, lengths in [(w, [w]) for w in range(1, 13)] + [(13, [13]), (14, [13, 14]), (40, [*range(13, 26)])]:
        spans = [sum(1 << j for j, c in enumerate(m) if c == "1") for m in decontaminate.masks(words, 13, 0.8)]
        for n in lengths:
            for places in itertools.combinations(range(n), n - math.ceil(0.8 * n)):
                ok = (1 << n) - 1 - sum(1 << k for k in places)
                assert any(ok >> a & x == x for x in spans for a in range(n - x.bit_length() + 1)), (words, n, places)


def test_all_substitutions_of_short_overlaps(spark):
    items = [[f"i{n}w{k}" for k in range(n)] for n in (1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 15)]
    texts, want = [], set()
    for i, item in enumerate(items):
        for e in (len(item) // 5, len(item) // 5 + 1):
            for places in itertools.combinations(range(len(item)), e):
                if e == len(item) // 5:
                    want.add((len(texts), i))
                texts.append("before " + " ".join("changed" if k in places else w for k, w in enumerate(item)) + " after")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id int, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs(spark, texts), bench).collect()}
    # One substitution more leaves 15 words with a part of 13 or 14 that qualifies where it is near an end.
    few = {(d, i) for d, i in got - want if len(items[i]) > 13}
    assert got - few == want
    assert all(max(sum(w != "changed" for w in texts[d].split()[1 + a : 1 + b]) / (b - a) for a in range(3) for b in range(a + 13, 16)) >= 0.8 for d, i in few)
