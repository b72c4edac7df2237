"""Toxicity grades by cumulative-link (proportional odds) regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all thresholds, theta ascending. Weights are not negative
and only features with evidence for toxicity have one, so no amount of harmless text hides a toxic passage. x has 1 + log(count)
of the words and word beginnings of 3 to 8 characters in a text. The weights are fitted on a bounded sample of labelled rows
(``max_rows`` toxic ones and twice as many others, least hashes of doc_id first), on the MAX_FEATURES features of 2**BITS
with most evidence at most; nothing else is sampled, and every document is scored over its whole text.

Where labels are marks of 0 and 1, ``levels`` makes grades of the marked ones by how much evidence for the mark they
hold: such a grade is a degree of likeness to marked texts, not one that a reader gave.

A null or empty text has no features and the grade that the thresholds alone give. Repeated ids each get their row;
labels are joined by doc_id, and of repeated labels the highest grade counts; null grades and ids are left out of the
fit. With no labelled rows, or one grade only, no text is rejected. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmatch.llm.common import U, buffers, pieces, tidy, tokens

BITS, PREFIXES, MAX_ROWS, MAX_FEATURES, EVIDENCE = 20, (3, 4, 5, 6, 7, 8), 4096, 1 << 14, 20.0


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of every word and word beginning, repeats included."""
    h, _, _, at, pre = tokens(data, offs, PREFIXES, letters=True)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.tile(text, 1 + len(pre)), (np.concatenate([h, *pre]) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Ordinal:
    """weights over 2**BITS features, ascending thresholds (one fewer than grades)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, one row for each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        text, f = features(data, offs)
        keep = self.weights[f] != 0
        key, count = np.unique(text[keep] << BITS | f[keep], return_counts=True)
        return np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)] * (1 + np.log(count)), n) if n else np.zeros(0)


def _minimise(fun, x: np.ndarray, rounds: int = 600, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    f, g = fun(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).sum())
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step, slope = 1.0, -(g @ q)
        while True:
            x2 = x - step * q
            f2, g2 = fun(x2)
            if f2 <= f + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = x2 - x, g2 - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(f - f2) <= 1e-9 * abs(f)
        x, f, g = x2, f2, g2
        if done:
            break
    return x


def _evidence(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The log-likelihood ratio (G squared) of each feature's presence against the grade being above 0."""
    g = np.zeros(len(pos))
    for seen, expected in ((pos, (pos + neg) * n1), (neg, (pos + neg) * n0), (n1 - pos, (n1 + n0 - pos - neg) * n1), (n0 - neg, (n1 + n0 - pos - neg) * n0)):
        expected = expected / max(n1 + n0, 1)
        g += np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0)
    return 2 * g


def choose(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The features, ascending, whose presence in ``pos`` of n1 toxic and ``neg`` of n0 other texts is evidence enough."""
    evidence = np.where(pos * n0 > neg * n1, _evidence(pos, neg, n1, n0), 0)
    best = np.argsort(-evidence, kind="stable")[:MAX_FEATURES]
    return np.sort(best[evidence[best] >= EVIDENCE])


def fit(chosen: np.ndarray, row: np.ndarray, col: np.ndarray, count: np.ndarray, y: np.ndarray, levels: int = 1, l2: float = 0.02) -> Ordinal:
    """From the texts' grades ``y`` (0, 1, ...) and (text, place in ``chosen``, occurrences) entries.

    With ``levels`` above 1 the texts have a mark 0 or 1 only, and those marked are graded 1 to ``levels`` in equal parts
    by how much of the evidence for the mark they hold.
    """
    weights = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        return Ordinal(weights, np.full(1, 40.0))
    y, value, m, n = np.unique(y, return_inverse=True)[1], 1 + np.log(count), len(chosen), len(y)
    if levels > 1:
        amount = np.bincount(row, value, n)
        cuts = np.unique(np.quantile(amount[y > 0], np.arange(1, levels) / levels))
        y = np.unique(np.where(y > 0, 1 + np.searchsorted(cuts, amount, "left"), 0), return_inverse=True)[1]
    k = int(y.max())

    def loss(v: np.ndarray):
        w, d = v[:m] ** 2, v[m:]
        theta = d[0] + np.concatenate([[0.0], np.cumsum(np.exp(d[1:]))])
        s = np.bincount(row, w[col] * value, n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = edge[y + 1] - s, edge[y] - s
        with np.errstate(over="ignore"):
            ph, pl = 1 / (1 + np.exp(-hi)), 1 / (1 + np.exp(-lo))
        p = np.maximum(ph - pl, 1e-12)
        dh, dl = ph * (1 - ph) / p, pl * (1 - pl) / p
        gs = (dh - dl) / n
        gt = np.zeros(k)
        for j in range(k):
            gt[j] = (dl[y == j + 1].sum() - dh[y == j].sum()) / n
        gd = np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(d[j]) for j in range(1, k)]])
        cost = -np.log(p).mean() + l2 / 2 * (w @ w) / n
        return cost, np.concatenate([2 * v[:m] * (np.bincount(col, gs[row] * value, m) + l2 * w / n), gd])

    v = _minimise(loss, np.concatenate([np.full(m, 0.5), [1.0], np.zeros(k - 1)]))
    weights[chosen] = v[:m] ** 2
    return Ordinal(weights, v[m] + np.concatenate([[0.0], np.cumsum(np.exp(v[m + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, grade: Column, levels: int = 1, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fits on at most ``max_rows`` rows of grade above 0 and twice as many of grade 0; ``levels`` as in ``fit``."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), grade.cast("int").alias("grade")).where("id is not null and grade >= 0").groupBy("id").agg(F.max("grade").alias("grade"))
    order = F.xxhash64("id")
    bounded = own.where("grade > 0").orderBy(order, "id").limit(max_rows).union(own.where("grade = 0").orderBy(order, "id").limit(2 * max_rows))
    # At most 3 max_rows ids and grades: a proven bound for the broadcast.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(bounded), "id")
    size = 1 << BITS

    def counted(batches):
        """Texts that hold each feature, by grade above 0 or not; feature -1 counts all texts."""
        sums = np.zeros((2, size), np.int64)
        n = np.zeros(2, np.int64)
        for b in batches:
            marked = np.asarray(b.column("grade")) > 0
            n += [(~marked).sum(), marked.sum()]
            for s, e, data, offs in pieces(*buffers(b.column("text"))):
                text, f = features(data, offs)
                key = np.unique(text << BITS | f)
                on = marked[s:e][key >> BITS]
                sums[0] += np.bincount(key[~on] & (size - 1), minlength=size)
                sums[1] += np.bincount(key[on] & (size - 1), minlength=size)
        f = np.flatnonzero(sums.any(0))
        yield pa.record_batch([pa.array(np.append(f, -1)), pa.array(np.append(sums[1, f], n[1])), pa.array(np.append(sums[0, f], n[0]))], ["f", "pos", "neg"])

    # One row for each of the 2**BITS features at most.
    got = texts.mapInArrow(tidy(counted), "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    f, p, q = (np.asarray(got.column(c).combine_chunks()) for c in ("f", "pos", "neg"))
    pos, neg = np.zeros(size), np.zeros(size)
    pos[f[f >= 0]], neg[f[f >= 0]] = p[f >= 0], q[f >= 0]
    chosen = choose(pos, neg, int(p[f < 0].sum()), int(q[f < 0].sum()))

    def held(batches):
        """The chosen features of each text."""
        place = np.full(size, -1)
        place[chosen] = np.arange(len(chosen))
        for b in batches:
            for s, e, data, offs in pieces(*buffers(b.column("text"))):
                text, f = features(data, offs)
                c = place[f]
                key, count = np.unique(text[c >= 0] << BITS | c[c >= 0], return_counts=True)
                cut = np.searchsorted(key, np.arange(e - s + 1) << BITS)
                cells = [pa.array([x[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for x in (key & (size - 1), count)]
                yield pa.record_batch([b.column("id").slice(s, e - s), b.column("grade").slice(s, e - s), *cells], ["id", "grade", "f", "n"])

    got = texts.mapInArrow(tidy(held), "id long, grade int, f binary, n binary").toArrow().sort_by([("id", "ascending"), ("f", "ascending")])  # at most 3 max_rows rows of chosen features
    cells = got.column("f").to_pylist()
    row = np.repeat(np.arange(len(cells)), [len(x) // 4 for x in cells])
    col, count = (np.frombuffer(b"".join(x), np.int32) for x in (cells, got.column("n").to_pylist()))
    return fit(chosen, row, col, count, np.asarray(got.column("grade").combine_chunks()), levels)


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """(doc_id, p_toxic, expected_severity, grade, toxic): grade is the likeliest one; toxic is P(grade > 0) >= reject_at."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches):
        m = Ordinal(*shared.value)
        for b in batches:
            s = np.concatenate([m.scores(data, offs) for _, _, data, offs in pieces(*buffers(b.column(1)))] or [np.zeros(0)])
            up = m.above(s)
            p = -np.diff(np.concatenate([np.ones((len(s), 1)), up, np.zeros((len(s), 1))], 1), axis=1)
            yield pa.record_batch([b.column(0), pa.array(up[:, 0]), pa.array(up.sum(1)), pa.array(p.argmax(1).astype(np.int32)), pa.array(up[:, 0] >= reject_at)], ["doc_id", "p_toxic", "expected_severity", "grade", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: Ordinal, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """``docs`` without the rows of which P(grade > 0) is ``reject_at`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches):
        m = Ordinal(*shared.value)
        for b in batches:
            s = np.concatenate([m.scores(data, offs) for _, _, data, offs in pieces(*buffers(b.column(text_col)))] or [np.zeros(0)])
            yield b.filter(pa.array(m.above(s)[:, 0] < reject_at))

    return docs.mapInArrow(tidy(run), docs.schema)
