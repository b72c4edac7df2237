"""SentencePiece encoding against the library, page extraction, licences and nearest neighbours against brute force."""

import hashlib
import math
import random
from functools import cache
from xml.etree import ElementTree

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmatch.llm import ann, html_text, licenses
from driftmatch.llm import sentencepiece_bpe as sb

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")


@cache
def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture
def library():
    return _library()


ALPHABET = st.sampled_from([" ", "  ", "▁", "a", "e", "ing", "the", "The", "\n", "\t", "é", "漢", "ﬁ", "​", "😀", "0", "12", "<s>", "</s>", "<0x41>", "\0", "_", "xx", "́", "�", "\xa0", "-----", "=="])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=20).map("".join))
def test_encoding_equals_the_library(text):
    sp, c = _library(), sb.codec(PATH)
    want = sp.encode(text, add_eos=True)
    assert [*c.encode(text), c.end] == want
    assert c.decode(want) == sp.decode(want)
    n, ids, back = c.digest(text)
    assert (n, ids, back) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(sp.decode(want).encode()).hexdigest())


def test_compatibility_equals_remerging():
    r, c = random.Random(1), sb.codec(PATH)
    pieces = sorted(c.words)
    for _ in range(4000):
        w = r.choice(pieces) + r.choice(pieces).lstrip("▁")
        k = r.randint(1, len(w) - 1) if len(w) > 1 else 1
        a, b = w[:k], w[k:]
        if b and c.merged(a) == [a] and c.merged(b) == [b]:
            assert c.apart(a, b) == (c.merged(a + b) == [a, b])


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "ab" * 3000 + "é" * 2000, "漢" * 3000, "x y " * 20_000])
def test_long_texts(library, text):
    c = sb.codec(PATH)
    want = library.encode(text)
    assert c.encode(text) == want and c.decode(want) == text


def test_decoding_of_odd_ids(library):
    c, r = sb.codec(PATH), random.Random(2)
    for _ in range(300):
        ids = [r.choice([*c.byte_ids, 2, *range(259, 32000, 997)]) for _ in range(r.randint(0, 8))]
        assert c.decode(ids) == library.decode(ids), ids


def test_encoding_dataframes(spark, library):
    texts = [None, "", "one two", "one two", "é" * 70, "long " * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = {r.doc_id: r for r in sb.digests(df, PATH).collect()}
    enc = sb.encoded(df, PATH)
    ids = {r.doc_id: list(r.ids) for r in enc.collect()}
    back = {r.doc_id: r.text for r in sb.decoded(enc, PATH).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_eos=True)
        assert ids[i] == want and got[i].n_tokens == len(want) and back[i] == (t or "")
    assert sb.digests(df.where("false"), PATH).count() == 0 and sb.encoded(df.where("false"), PATH).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>{open}<h1>Title &amp; more</h1>
<p>First   paragraph with <b>bold</b>&nbsp;text and a <a href="x">link</a>.<br>Second line.<p>Unclosed <i>paragraph &eacute;&#233;
<ul><li>one<li>two</ul><div class="ad">Buy now</div><form>mail <input></form><table><tr><td>a<td>b</table>{close}
<aside>side</aside><section id="comments"><p>I disagree with all of this, at length and with many words.</p></section><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\n\nFirst paragraph with bold text and a link. Second line.\n\nUnclosed paragraph éé\n\none\n\ntwo\n\na\n\nb"


@pytest.mark.parametrize("tag", ["article", "main", 'div class="story"'])
def test_main_text(tag):
    assert html_text.main_text(PAGE.format(open=f"<{tag}>", close=f"</{tag.split()[0]}>")) == TEXT


def test_density_picks_the_article_among_boxes():
    words = "some words of a paragraph that go on for a while, "
    story = "".join(f"<p>{words * 3}{k}.</p>" for k in range(5))
    links = "".join(f'<a href="/{k}">teaser {k}</a> ' for k in range(30))
    got = html_text.main_text(f"<body><div class=x1>{links}</div><div class=x2><div>{story}</div></div><div class=x3>{links}</div></body>")
    assert got.count("\n\n") == 4 and "teaser" not in got


def brute_main_text(html):
    """Composite text density by its definition, over an XML parse: sums are taken afresh for every node."""
    body = ElementTree.fromstring(html).find("body")
    up = {k: n for n in body.iter() for k in n}
    squeeze = lambda t: len("".join((t or "").split()))
    chars = lambda n: squeeze("".join(n.itertext()))
    tags = lambda n, only=None: sum(k is not n and (only is None or k.tag == only) for k in n.iter())
    links = lambda n: chars(n) if n.tag == "a" else sum(chars(k) for k in n.iter("a"))

    def density(n):
        c, t, lc, lt = chars(n), max(tags(n), 1), links(n), max(tags(n, "a"), 1)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + links(body) / max(chars(body), 1) * c + math.e**math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / lt, 1)) / math.log(base)

    of = {n: density(n) for n in body.iter()}
    total = {n: sum(of[k] for k in n) for n in body.iter()}
    greatest = lambda n: max(n.iter(), key=lambda k: total[k])
    best = n = greatest(body)
    path = [best]
    while n is not body:
        path.append(n := up[n])
    least = min(of[k] for k in path)
    wanted = {greatest(n) for n in body.iter() if of[n] >= least and of[n] > 0} or {body}
    out, run = [], []

    def close():
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    def walk(n, inside):
        begins = n in wanted and not inside
        edge = n.tag in ("div", "p", "body", "section") or begins
        inside = inside or n in wanted
        if edge:
            close()
        if inside:
            run.append(n.text or "")
        for k in n:
            walk(k, inside)
            if inside:
                run.append(k.tail or "")
        if edge:
            close()

    walk(body, False)
    return "\n\n".join(out)


def test_main_text_equals_brute_force():
    r = random.Random(21)

    def node(depth):
        tag = r.choice(["div", "div", "p", "section", "a", "b"]) if depth else "div"
        inner = "".join(r.choice(["", " some words of text ", f"word{r.randrange(99)} " * r.randint(1, 40)]) if r.random() < 0.5 or depth > 4 or tag in "pab" else node(depth + 1) for _ in range(r.randint(0, 5)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(400):
        html = f"<html><body>{''.join(node(0) for _ in range(r.randint(1, 5)))}</body></html>"
        assert html_text.main_text(html) == brute_main_text(html)


def test_two_articles_and_boxes_without_names():
    words = "some words of a paragraph that go on for a while, "
    part = lambda n, k: "<h2>Part</h2>" + "".join(f"<p>{words * 3}{k}.{j}</p>" for j in range(n))
    box = "<div class=q1>Eat at this place</div>"
    got = html_text.main_text(f"<body>{box}<main><article>{part(6, 1)}</article>{box}<article>{part(4, 2)}</article></main>{box}</body>")
    assert got.count("\n\n") == 11 and "Eat" not in got
    got = html_text.main_text(f"<body>{box}<article><div><h1>Heading</h1></div><div>{part(6, 1)}</div></article>{box}</body>")
    assert got.startswith("Heading\n\nPart\n\n") and "Eat" not in got


@pytest.mark.parametrize("html", ["", "<", "<p", "<!-- never ends <p>x</p>", "<script>never ends", "<a href='x>y", "</p></div>", "<div>" * 3000 + "x", "&am", "<p>&lt;b&gt;</p>", "text only", "<p></p>" * 50, "<br>" * 50])
def test_broken_pages(html):
    assert isinstance(html_text.main_text(html), str)


def test_text_of_odd_pages():
    assert html_text.main_text("text only") == "text only"
    assert html_text.main_text("<p>&lt;b&gt; x") == "<b> x"
    assert html_text.main_text("<nav>only a menu</nav>") == ""


def test_pages_dataframe(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>é</p>", "x"), (3, "u", "<p>é</p>", "x")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "", 0), (2, "", 0), (3, "é", 1), (3, "é", 1)]
    assert html_text.extract(df.where("false")).count() == 0


def test_licences(spark):
    mit = licenses.KNOWN["MIT"][0]
    texts = [
        None, "", "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " , "), mit.replace("sublicense", "sub-license"), mit[:-20], "prose\nLICENCED UNDER the apache LICENCE, version 2.0!\nprose", "no such words", "x " * 100_000 + "license",
        "Licensed under CC BY-NC 4.0.\nLicensed under the MIT License\nLicensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0.",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, license string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].license for i in range(10)] == [None, None, "MIT", "MIT", None, None, None, None, None, "CC-BY-NC-4.0"]
    assert [got[i].line_licenses for i in range(4, 10)] == ["", "Apache-2.0", "", "", "CC-BY-NC-4.0,MIT", "CC-BY-NC-4.0"]
    for i, t in enumerate(texts):
        if got[i].digest:
            assert got[i].digest == hashlib.md5(licenses.canonical(t).encode()).hexdigest()
    assert licenses.scan(df.where("false")).count() == 0


def brute_nearest(vectors, k):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float(np.dot(ok[q], x)), i) for i, x in ok.items() if i != q))[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12))
    x[:500] = x[0] + rng.normal(size=(500, 12)) * 1e-3
    x[700:760] = x[700]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [None] + [1.0] * 11), (2004, [float("nan")] + [1.0] * 11), (2005, [float("inf")] + [1.0] * 11)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id int, embedding array<float>, score string")
    from pyspark.sql import functions as F

    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, sample=400, calibration=30, recall=0.95, slice_rows=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, 20)
    assert set(got) == set(want)
    hit = 0
    for q, g in got.items():
        g.sort()
        assert [r for r, *_ in g] == list(range(1, 21))
        assert [(-s, i) for _, i, s in g] == sorted((-s, i) for _, i, s in g)
        assert all(s == pytest.approx(np.dot(rows[q][1], rows[i][1]), rel=1e-12, abs=1e-12) for _, i, s in g)
        hit += len({i for _, i, _ in g} & {i for _, i in want[q]})
    assert hit / (20 * len(want)) >= 0.9


def test_few_vectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id int, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3)]
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id > 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    from driftmatch.llm.queries import QUERIES, table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after.cache()
    done = corpus_pipeline.run(spark, sf)
    assert done.count() == before.count() and {r.n == len(r.ids) for r in done.selectExpr("n_tokens n", "ids").collect()} == {True}
    empty = corpus_pipeline.STAGES
    frame = docs.where("false")
    for name, stage in empty:
        frame = stage(spark, frame, sf)
    assert frame.count() == 0 and {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}


def test_other_tasks_let_go_of_the_codec():
    from driftmatch.llm import common

    first = sb.codec(PATH)
    list(common.tidy(lambda batches: batches, keep=True)([1]))
    assert sb.codec(PATH) is first
    list(common.tidy(lambda batches: batches)([1]))
    assert sb.codec(PATH) is not first


def test_licence_notices_and_whole_texts(spark):
    from pathlib import Path

    lines = {
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the terms of the GNU GPL v2 or later": "GPL-2.0",
        "This software is released under the Apache License 2.0": "Apache-2.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Released under a license of our own.": "",
    }
    df = spark.createDataFrame(list(enumerate("words before\n" + x for x in lines)), "doc_id int, text string")
    got = {x.doc_id: x.line_licenses for x in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(licenses.FULL)
    there = [(k, p.read_text()) for k, n in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0")) if (p := Path("/usr/share/common-licenses", n)).exists()]
    if there:
        df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(there)], "doc_id int, text string")
        assert {x.doc_id: x.license for x in licenses.scan(df).collect()} == {i: k for i, (k, _) in enumerate(there)}


def test_every_notice_is_found(spark):
    known = licenses.digests()
    lines = [f"{lead} under {name}." for lead in ("Released", "Distributed", "This software is released", "This work is distributed") for names in licenses.NAMES.values() for name in (names[0], names[-1])]
    lines += ["Released under CC BY 4.0.", "Distributed under the GNU GPL v2", "released\tunder MIT", "Released under terms of our own.", "The film was distributed in May."]
    want = [known.get(hashlib.md5(licenses.canonical(x).encode()).hexdigest()) for x in lines]
    assert want[-5:] == ["CC-BY-4.0", "GPL-2.0", "MIT", None, None] and None not in want[:-2]
    df = spark.createDataFrame([(2 * i + whole, x if whole else f"words before\n{x}") for i, x in enumerate(lines) for whole in (0, 1)], "doc_id int, text string")
    got = {x.doc_id: (x.license, x.line_licenses) for x in licenses.scan(df).collect()}
    assert [got[2 * i][1] for i in range(len(lines))] == [x or "" for x in want]
    assert [got[2 * i + 1][0] for i in range(len(lines))] == want
