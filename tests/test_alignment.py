"""The kernel against an independent exhaustive alignment, and the seed filter against the full search."""

import random
import time
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmatch.operators import kernel
from driftmatch.operators.engine import Engine
from driftmatch.operators.exact import exact_matches
from driftmatch.plans.spec import Limits, Pattern, Penalties, Similarity


def brute(u, t, n, lim, pen, sim):
    """(start, end) -> least (cost, edits, counts) over every alignment."""
    caps = [255 if getattr(lim, k) is None else getattr(lim, k) for k in ("insertions", "deletions", "substitutions", "swaps")]
    total = 255 if lim.edits is None else lim.edits
    best = {}
    for s in range(len(t)):

        @cache
        def walk(i, j, e, c):
            if sum(c) > total or any(x > y for x, y in zip(c, caps)):
                return ()
            if i == len(u):
                return ((e, 0, c),)
            out, more = [], lambda k: tuple(x + (q == k) for q, x in enumerate(c))
            add = lambda got, d: out.extend((e2, round(x + d, 6), c2) for e2, x, c2 in got)
            if j < len(t):
                add(walk(i + 1, j + 1, j + 1, c if u[i] == t[j] else more(2)), 0 if u[i] == t[j] else pen.substitution * (1 - sim.get(u[i], t[j])))
                if e > s:
                    add(walk(i, j + 1, e, more(0)), pen.insertion)
            if i + 1 < len(u) and j + 1 < len(t) and u[i] == t[j + 1] and u[i + 1] == t[j]:
                add(walk(i + 2, j + 2, j + 2, more(3)), pen.swap)
            add(walk(i + 1, j, e, more(1)), pen.deletion)
            return tuple(set(out))

        for e, cost, c in walk(0, s, s, (0, 0, 0, 0)):
            v = (round(cost, 6), sum(c), c)
            if (s, e) not in best or v < best[s, e]:
                best[s, e] = v
    return best


LIMITS = st.one_of(st.builds(Limits, edits=st.integers(0, 3)), st.builds(Limits, insertions=st.integers(0, 1), deletions=st.integers(0, 1), substitutions=st.integers(0, 1), swaps=st.integers(0, 1)), st.builds(Limits, edits=st.integers(1, 2), swaps=st.integers(0, 1)))
COSTS = st.sampled_from([Penalties(), Penalties(0.5, 0.8, 1.2, 0.6)])
WORD = st.text("abeo", min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(WORD, st.text("abeo0", max_size=7), LIMITS, COSTS, st.sampled_from([0.0, 0.3517, 0.7013]))
def test_kernel_equals_brute_force(u, t, lim, pen, theta):
    e = Engine([u], limits=lim, penalties=pen, suffix_outputs=False)
    want = {k: v for k, v in brute(u, t, len(u), lim.final(), pen, Similarity()).items() if (len(u) - v[0]) / len(u) >= theta}
    got = {(m.start, m.end): m for m in e.search_local(t, theta)}
    assert set(got) == set(want)
    for k, (cost, edits, c) in want.items():
        m = got[k]
        assert abs(m.similarity - (len(u) - cost) / len(u)) < 1e-4
        assert (m.insertions, m.deletions, m.substitutions, m.swaps, m.edits) == (*c, edits)


VOCABULARY = st.sampled_from(["hello", "world", "vestibulum", "abc", "lorem", "cell", "café", "naïve", "Москва", "école", "señor"])


@settings(max_examples=300, deadline=None)
@given(st.lists(VOCABULARY, min_size=1, max_size=3, unique=True), st.integers(0, 2), st.booleans(), COSTS, st.sampled_from([0.6, 0.7, 0.8, 0.9]), st.lists(st.one_of(VOCABULARY, st.text("helo wrdabcéМq", max_size=5)), max_size=8))
def test_seed_filter_is_exact(patterns, edits, ci, pen, theta, parts):
    e = Engine(patterns, limits=Limits(edits=edits), penalties=pen, case_insensitive=ci)
    text = "".join(parts)
    assert e.search_local(text, theta) == e.search_local(text, theta, prefilter="off")


def test_which_engines_are_reducible():
    assert Engine(["hello"], limits=Limits(edits=1)).prefilter_active
    assert not Engine(["hello"], limits=Limits(edits=1), mappings=[("a", "b")]).prefilter_active
    assert not Engine(["hello"], limits=Limits(edits=1), penalties=Penalties(swap=0)).prefilter_active


def test_longest_match():
    assert Engine([Pattern("hello", 1, Limits(edits=2)), "hi"]).max_match_graphemes() == 7
    assert Engine(["hello"], limits=Limits(edits=1), mappings=[("a", "bcd")]).max_match_graphemes() == 8


def _dictionary(n, seed=3):
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "an", "ous", "re", "st", "ing", "ü"]
    words = sorted({"".join(r.choices(syllables, k=r.randint(2, 5))) for _ in range(3 * n)})
    r.shuffle(words)
    return words[:n], r


@pytest.mark.parametrize("limits, threshold", [(None, 0.9), (Limits(edits=1), 0.85), (Limits(edits=1), 0.6), (Limits(edits=2), 0.75), (Limits(substitutions=1, swaps=1), 0.7)])
@pytest.mark.parametrize("fold", [False, True])
def test_many_patterns_find_what_no_prefilter_finds(limits, threshold, fold):
    words, r = _dictionary(60)
    e = Engine(words, limits=limits, case_insensitive=fold)
    assert e.matcher(threshold).automaton is not None
    for _ in range(12):
        t = " ".join(r.choice(words) if r.random() < 0.5 else "".join(r.sample(w := r.choice(words), len(w))) for _ in range(r.randint(0, 12)))
        t = "".join(c for c in t if r.random() > 0.05)
        t = t.upper() if fold and r.random() < 0.5 else t
        assert e.search_local(t, threshold) == e.search_local(t, threshold, prefilter="off")


def test_thousands_of_patterns_build_and_search():
    words, _ = _dictionary(3000, 5)
    began = time.perf_counter()
    e = Engine(words, limits=Limits(edits=1))
    assert time.perf_counter() - began < 5 and len(e.compiled.candidates) >= len(e.patterns) > 2000
    m = e.matcher(0.85)
    text = " ".join(words[:40])
    assert {x.pattern_index for x in m.search(text)} >= set(range(40))


def test_text_too_large(monkeypatch):
    monkeypatch.setattr(kernel, "MOST_SYMBOLS", 5)
    e = Engine(["abc"])
    assert len(e.search_local("xabcx")) == 1
    with pytest.raises(kernel.TextTooLarge):
        e.search_local("xabcxx")


def test_exact_matches_with_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "a cat", "p", 5, 0.5, 9)], "id int, text string, pattern string, len int, similarity double, start int")
    got = exact_matches(df, Engine(["cat", "at"], suffix_outputs=False))
    assert got.columns == [*df.columns, "pattern_index", "match_pattern", "match_start", "end", "match_similarity", "match_text"]
    assert sorted((x.pattern, x.len, x.start, x.match_pattern, x.match_start, x.end) for x in got.collect()) == [("p", 5, 9, "at", 3, 5), ("p", 5, 9, "cat", 2, 5)]
