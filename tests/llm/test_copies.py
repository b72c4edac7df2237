"""SimHash near-duplicates and repeated byte strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmatch.llm import common, repeats, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, shift=0):
    return spark.createDataFrame([(i + shift, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, fp string")


def brute_fp(text, k=3):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text("aB é\t\n\x0b漢", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == brute_fp(text)


def test_links_and_components(spark):
    r = random.Random(2)
    fps = {0, 1, 2, 3, (1 << 63), (1 << 63) | 1, 2**64 - 1, 2**64 - 4}
    for _ in range(60):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 5)):
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    pairs = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {(p.a, p.b) for p in pairs.collect()}
    assert got == want and len(want) > 50
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    of = {c.node: c.root for c in simhash.components(spark, pairs).collect()}
    assert all(of.get(x, x) == find(x) for x in signed)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {(c.node, c.root) for c in simhash.components(spark, edges).collect()} == {(i, 0) for i in range(301)}


def test_near_duplicates(spark):
    r = random.Random(4)
    base = [" ".join(r.choices("abcdefghij", k=r.randint(0, 300))) for _ in range(30)]
    texts = base + base[:10] + [t + " z" for t in base[10:20]] + [None, "", " \n", "One two", "one TWO", "x " * 60_000]
    got = {x.doc_id: x for x in simhash.near_duplicates(docs(spark, texts, 5)).collect()}
    fps = [brute_fp(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            comp[i] = min(comp[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 2)
    for i, x in enumerate(fps):
        assert got[i + 5].fingerprint == f"{x:016x}" and got[i + 5].component_id == comp[i] + 5
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_verified_copies(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    base = [[word() for _ in range(r.randint(60, 200))] for _ in range(12)]
    texts = [" ".join(w) for w in base]
    for w in base[:8]:
        for _ in range(4):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [texts[0].upper(), None, "", base[9][0], " ".join(base[10][: len(base[10]) // 3])]
    got = {x.doc_id: x.component_id for x in simhash.copies(docs(spark, texts)).collect()}

    def sh(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    sets = [sh(t) for t in texts]
    for i in range(len(texts)):
        close = [j for j in range(i) if like(sets[i], sets[j]) >= 0.8]
        assert (got[i] != i) == bool(close)
    kept = {x.doc_id for x in simhash.without_copies(docs(spark, texts)).collect()}
    assert kept == {i for i, c in got.items() if i == c}
    assert simhash.without_copies(docs(spark, [])).count() == 0


def brute_copies(texts, t=0.8):
    """The least number reachable over links of a likeness of ``t`` or more."""

    def sh(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [sh(x) for x in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and ((not a and not b) or len(a & b) >= t * len(a | b)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


@pytest.mark.parametrize("place", [0, 30, 60])
def test_copies_of_an_original_anywhere(spark, place):
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(60):
        v = list(base)
        for at in r.sample(range(0, 300, 10), 5):  # 0.83 to 0.86 to the original, less to each other
            v[at + 4] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(v))
    texts.insert(place, " ".join(base))
    want = brute_copies(texts)
    assert want == [0] * 61
    got = {x.doc_id: x.component_id for x in simhash.copies(docs(spark, texts)).collect()}
    assert [got[i] for i in range(61)] == want


def test_copies_of_few_shingles(spark):
    r = random.Random(8)
    texts = []
    for n in (8, 9, 12, 13, 16) * 40:  # one word more, a likeness of 0.8 or more
        w = [f"w{r.randrange(10**6)}" for _ in range(n + 1)]
        texts += [" ".join(w[:n]), " ".join(w)]
    want = brute_copies(texts)
    assert want == [i - i % 2 for i in range(400)]
    got = {x.doc_id: x.component_id for x in simhash.copies(docs(spark, texts)).collect()}
    assert [got[i] for i in range(400)] == want


def test_copies_compares_few_long_texts(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**9)}"
    texts = [[word() for _ in range(6000)] for _ in range(24)]
    for a, b in zip(texts, texts[1:]):  # each shares a passage with the next one
        b[:60] = a[-60:]
    texts += [[*t[:300], *(word() for _ in range(300)), *t[600:]] for t in texts[:3]]
    compared, old = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *x: compared.append(pairs.count()) or old(pairs, *x))
    got = {x.doc_id: x.component_id for x in simhash.copies(docs(spark, [" ".join(t) for t in texts])).collect()}
    assert [got[i] for i in range(27)] == [*range(24), 0, 1, 2]
    assert sum(compared) <= 10


def test_copies_of_texts_with_shared_passages(spark):
    r = random.Random(10)
    word = lambda: f"w{r.randrange(10**6)}"
    lines = [[word() for _ in range(r.randint(5, 40))] for _ in range(12)]
    texts = []
    for _ in range(60):
        t = [w for x in r.choices(lines, k=r.randint(0, 5)) for w in x] + [word() for _ in range(r.randint(0, 60))]
        texts.append(t)
        for _ in range(r.randint(0, 3)):
            t = list(t)
            for _ in range(r.randint(0, 3)):
                t.insert(r.randrange(len(t) + 1), word())
            texts.append(t)
    texts = [" ".join(t) for t in texts]
    want = brute_copies(texts)
    assert 30 < len(set(want)) < len(texts) - 20
    got = {x.doc_id: x.component_id for x in simhash.copies(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_without_copies_keeps_other_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (7, "a b", 3), (8, "A  b", 4), (9, None, 5)], "doc_id int, text string, __mark int")
    out = simhash.without_copies(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(x[2] for x in out.collect()) == [1, 2, 3, 5]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(xs):
    assert repeats.suffix_array(xs) == sorted(range(len(xs)), key=lambda i: xs[i:])


def brute_gone(texts, width):
    seen, out = set(), []
    for t in texts:
        m = np.zeros(len(t), bool)
        for s in range(len(t) - width + 1):
            if t[s : s + width] in seen:
                m[s : s + width] = True
            seen.add(t[s : s + width])
        out.append(m)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), max_size=6))
def test_removed_by_suffix_array(texts):
    for a, b in zip(repeats.removed_by_suffix_array(texts, 5), brute_gone(texts, 5)):
        assert (a == b).all()


def corpus(seed):
    r = random.Random(seed)
    shared = ["".join(r.choices("abcdefgh ", k=r.randint(20, 400))) for _ in range(12)]
    out = []
    for _ in range(80):
        parts = [r.choice(shared) if r.random() < 0.4 else "".join(r.choices("abcdefgh é", k=r.randint(0, 250))) for _ in range(r.randint(0, 6))]
        out.append("".join(parts))
    line = "a common first line of fifty bytes or somewhat more.\n"
    out += [line + "".join(r.choices("xyz ", k=200)) for _ in range(90)]
    return out + out[:10] + [None, "", "De " * 3000, "ab" * 500 + "x" + "ab" * 500, "q" * 99, "q" * 100, "q" * 101, "q" * 250, "é" * 300]


@pytest.mark.parametrize("hot, most", [(2, 1 << 13), (64, 1 << 13), (2, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, most):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(common, "MOST_SHARDS", most)
    monkeypatch.setattr(repeats, "RUN", 300)
    texts = corpus(3)
    got = {x.doc_id: x for x in repeats.remove(docs(spark, texts).repartition(5), with_bytes=True).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (b, m) in enumerate(zip(raw, brute_gone(raw, 100))):
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(b), int(m.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert bytes(x.kept) == kept


def test_repeats_edges(spark):
    assert repeats.remove(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "z" * 300), (1, "z" * 300), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in repeats.remove(df).collect()}
    assert got[None] == 0  # a row without an id neither loses bytes nor takes any
    assert got[1] == 299 and got[2] == 0


def test_repeats_of_repeated_ids(spark, monkeypatch):
    r = random.Random(11)
    gram, tail = "g" * 64, "".join(r.choices("abcdefgh ", k=150))
    texts = [(1, "".join(gram + "".join(r.choices("abcdefgh", k=60)) for _ in range(600))), (1, tail), (1, tail), (2, "x" + tail), (0, None), (None, tail), (3, "short"), (3, "other " * 40)]
    got = repeats.remove(spark.createDataFrame(texts, "doc_id int, text string").repartition(1), with_bytes=True).collect()
    by = sorted(((x.doc_id is None, x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans) for x in got))
    assert len(by) == 8 and by[0] == (False, 0, 0, 0, 0) and by[-1] == (True, 0, 150, 0, 0)
    # Rows equal in id and text are one document, rows of one id and different texts are not.
    assert [x[2:] for x in by if x[1] == 1 and x[2] == 150] == [(150, 0, 0)] * 2
    assert (False, 2, 151, 150, 1) in by and (False, 3, 5, 0, 0) in by
    assert sum(x[2] for x in by if x[1] == 1) == 600 * 124 + 300


def test_exchanges_of_blocks(spark):
    grouped = common.by_shard(spark.range(10).selectExpr("cast(id as int) shard", "cast('' as binary) block"), 9, None).applyInArrow(lambda t: t, "shard int, block binary")
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
