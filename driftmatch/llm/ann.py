"""Nearest neighbours by inner product with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample (``sample`` vectors, least hashes of the id first) and every vector is put into
a leaf. A query walks the tree with a priority queue: the node with the greatest bound q.c + |q| r comes first (c the
node's centre, r a quantile of its members' distances), so leaves come out best bin first. How many leaves are visited
is calibrated: true neighbours of ``calibration`` queries are found among all vectors, and visits widen until their mean
recall reaches ``recall``; visiting every leaf is exact, so the target is always reached.

Neighbouring leaves form bundles of up to ``slice_rows`` vectors, and a leaf that is larger is cut into slices of about
that size; a slice is the unit that a task scores, so a leaf that holds a third of all rows is spread over many tasks. Each unit keeps its best k for each query before the last
merge. Scores are sums of products of the original vectors in double precision; ties go to the smaller id.

Vectors that are null, of zero length in any sense (no components, all zero), or hold a null or non-finite component
take no part; so do vectors whose size differs from the commonest one in the sample. Repeated ids are told apart only by
their vectors as candidates, and one of them is the query; a query never finds its own id. An empty table, or one without a query, gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmatch.llm.common import written

RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(ok & F.col("vec_id").isNotNull())


def matrix(col: pa.Array, size: int = 0) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1 if len(col) else size)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of equally many rows; equal rows give equal sums, wherever they stand."""
    return np.einsum("ij,ij->i", q, x)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (((c * c).sum(1) / 2)[None, :] - x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        c = np.stack([x[near == j].mean(0) if n[j] else c[j] for j in range(k)])
    return c


class Tree:
    """Centres, radii and children; a leaf has no children."""

    def __init__(self, x: np.ndarray, fan: int = 8, leaf: int = 32, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.kids: list[list[int]] = []
        rng = np.random.default_rng(seed)
        self._grow(x, fan, leaf, rng)
        self.leaf_of = np.full(len(self.kids), -1)
        leaves = [i for i, k in enumerate(self.kids) if not k]
        self.leaf_of[leaves] = np.arange(len(leaves))
        self.n_leaves = len(leaves)
        self.c, self.r = np.array(self.centres), np.array(self.radii)

    def _grow(self, x: np.ndarray, fan: int, leaf: int, rng) -> int:
        i = len(self.kids)
        c = x.mean(0)
        self.centres.append(c)
        self.radii.append(float(np.quantile(np.sqrt(((x - c) ** 2).sum(1)), 0.5)))
        self.kids.append([])
        if len(x) > leaf and (x != x[0]).any():
            k = _kmeans(x, min(fan, len(x)), rng)
            near = (((k * k).sum(1) / 2)[None, :] - x @ k.T).argmin(1)
            if len(np.unique(near)) > 1:
                self.kids[i] = [self._grow(x[near == j], fan, leaf, rng) for j in np.unique(near)]
        return i

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down the nearest centres."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            i, rows = todo.pop()
            if not self.kids[i]:
                out[rows] = self.leaf_of[i]
                continue
            c = self.c[self.kids[i]]
            near = (((c * c).sum(1) / 2)[None, :] - x[rows] @ c.T).argmin(1)
            todo += [(k, rows[near == j]) for j, k in enumerate(self.kids[i]) if (near == j).any()]
        return out

    def visits(self, q: np.ndarray, limit: int) -> list[int]:
        """The first ``limit`` leaves, best bin first."""
        bound = self.c @ q + np.sqrt(q @ q) * self.r
        heap, out = [(-bound[0], 0)], []
        while heap and len(out) < limit:
            _, i = heapq.heappop(heap)
            if not self.kids[i]:
                out.append(int(self.leaf_of[i]))
            for k in self.kids[i]:
                heapq.heappush(heap, (-bound[k], k))
        return out


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, open_leaf: np.ndarray | None = None, leaf: np.ndarray | None = None):
    """(query row, x row, score) of each query's best k of ``x`` but its own id, in the leaves open to it; blocks of
    queries bound the memory."""
    step = max(1, 4_000_000 // max(len(x), 1))
    for s in range(0, len(q), step):
        rough = q[s : s + step] @ x.T
        rough[query_ids[s : s + step, None] == ids[None, :]] = -np.inf
        if open_leaf is not None:
            rough[~open_leaf[s : s + step][:, leaf]] = -np.inf
        for j, row in enumerate(rough):
            n = min(k, len(row))
            cut = np.partition(row, len(row) - n)[len(row) - n]
            near = np.flatnonzero((row >= cut - 1e-9 * max(1.0, abs(cut) if np.isfinite(cut) else 1.0)) & (row > -np.inf))
            score = exact(np.broadcast_to(q[s + j], (len(near), q.shape[1])), x[near])
            o = np.lexsort((ids[near], -score))[:k]
            yield s + j, near[o], score[o]


def bundles(counts: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """Leaf -> bundle and bundle -> rows: neighbouring leaves together, up to ``most`` rows; a larger leaf is alone."""
    of: dict[int, int] = {}
    rows: dict[int, int] = {}
    last = -1
    for leaf in sorted(counts):
        if last < 0 or rows[last] + counts[leaf] > most:
            last += 1
            rows[last] = 0
        of[leaf] = last
        rows[last] += counts[leaf]
    return of, rows


def _merge(found: DataFrame, k: int) -> DataFrame:
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), F.col("vec_id")))), 1, k)
    # At most k rows for each unit visited, so a query's list is bounded by visits x slices x k.
    return found.groupBy("query_id").agg(top.alias("t")).select("query_id", F.posexplode("t").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.n")).alias("score"))


def _batch(query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


def brute_force(vectors: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of a bounded set of queries against all rows of ``usable`` vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        query_ids, q = shared.value
        for b in batches:
            x, ids = matrix(b.column(1)), np.asarray(b.column(0))
            rows = list(best(query_ids, q, ids, x, k))
            if rows:
                yield _batch(np.concatenate([np.full(len(r), query_ids[j]) for j, r, _ in rows]), np.concatenate([ids[r] for _, r, _ in rows]), np.concatenate([s for *_, s in rows]))

    return _merge(vectors.mapInArrow(run, "query_id long, vec_id long, score double"), k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, calibration: int = 200, recall: float = 0.97, leaf: int = 32, slice_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (of the column vec_id) holds."""
    spark: SparkSession = vectors.sparkSession
    all_rows = usable(vectors, id_col, vector_col)
    order = F.xxhash64("vec_id")
    fitted = all_rows.orderBy(order, "vec_id").limit(sample).toArrow()
    if not len(fitted):
        return spark.createDataFrame([], RESULT)
    sizes = np.asarray(pc.list_value_length(fitted.column("v").combine_chunks()))
    size = int(np.bincount(sizes).argmax())
    all_rows = all_rows.where(F.size("v") == size)
    tree = Tree(matrix(fitted.filter(pa.array(sizes == size)).column("v")), leaf=leaf)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(shared.value.assign(matrix(b.column(1), size)).astype(np.int32))], ["vec_id", "v", "leaf"])

    index = written(spark, all_rows.mapInArrow(place, "vec_id long, v array<double>, leaf int"), "ann-index")
    counts = {r.leaf: r.n for r in index.groupBy("leaf").agg(F.count("*").alias("n")).toLocalIterator()}  # bounded by the leaves
    limit = _calibrate(index, tree, is_query, k, calibration, recall, order)
    bundle_of, rows_of = bundles(counts, slice_rows)

    def walk(batches):
        for b in batches:
            for j, v in enumerate(matrix(b.column(1), size)):
                to: dict[int, list[int]] = {}
                for leaf in shared.value.visits(v, limit):
                    if leaf in bundle_of:
                        to.setdefault(bundle_of[leaf], []).append(leaf)
                yield pa.record_batch([pa.array(np.full(len(to), b.column(0)[j].as_py())), pa.array(list(to), pa.int32()), pa.array(list(to.values()), pa.list_(pa.int32()))], ["query_id", "bundle", "leaves"])

    visits = written(spark, index.where(is_query).select("vec_id", "v").mapInArrow(walk, "query_id long, bundle int, leaves array<int>"), "ann-visits")
    # Where many queries meet at a bundle they come in runs, each with its own copy of the bundle's slices.
    asked = {r.bundle: r.n for r in visits.groupBy("bundle").agg(F.count("*").alias("n")).toLocalIterator()}  # bounded by the leaves
    of = spark.createDataFrame([(i, -(-rows_of[i] // slice_rows), -(-n // slice_rows)) for i, n in asked.items()], "bundle int, slices int, runs int")
    asks = visits.join(F.broadcast(of), "bundle").withColumn("run", F.pmod(F.xxhash64("query_id"), "runs").cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    asks = asks.join(index.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id"]), "query_id").select("query_id", "q", "leaves", "bundle", "slice", "run")
    own = spark.createDataFrame(sorted(bundle_of.items()), "leaf int, bundle int")
    rows = index.join(F.broadcast(own), "leaf").join(F.broadcast(of), "bundle").withColumn("slice", F.pmod(F.xxhash64("vec_id"), "slices").cast("int")).withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).select("vec_id", "v", "leaf", "bundle", "slice", "run")
    unit = ["bundle", "slice", "run"]

    def score(key, asks: pa.Table, members: pa.Table) -> pa.Table:
        if not len(asks) or not len(members):
            return pa.Table.from_batches([], pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))
        query_ids, ids = np.asarray(asks.column("query_id").combine_chunks()), np.asarray(members.column("vec_id").combine_chunks())
        leaf = np.asarray(members.column("leaf").combine_chunks())
        first = int(leaf.min())
        open_leaf = np.zeros((len(asks), int(leaf.max()) - first + 1), bool)
        for j, leaves in enumerate(asks.column("leaves").to_pylist()):
            mine = np.array(leaves) - first
            open_leaf[j, mine[(mine >= 0) & (mine < open_leaf.shape[1])]] = True
        got = list(best(query_ids, matrix(asks.column("q")), ids, matrix(members.column("v")), k, open_leaf, leaf - first))
        return pa.Table.from_batches([_batch(np.concatenate([np.full(len(r), query_ids[j]) for j, r, _ in got]), np.concatenate([ids[r] for _, r, _ in got]), np.concatenate([s for *_, s in got]))])

    found = asks.groupBy(*unit).cogroup(rows.groupBy(*unit)).applyInArrow(score, "query_id long, vec_id long, score double")
    return _merge(found, k)


def _calibrate(index: DataFrame, tree: Tree, is_query: Column, k: int, calibration: int, recall: float, order: Column) -> int:
    """Leaves to visit until the mean recall of a bounded set of queries, against all vectors, reaches the target."""
    asked = index.where(is_query).orderBy(order, "vec_id").limit(calibration).toArrow()
    if not len(asked):
        return 1
    ids, q = np.asarray(asked.column("vec_id").combine_chunks()), matrix(asked.column("v"))
    truth = brute_force(index.select("vec_id", "v"), (ids, q), k)
    where: dict[int, list[int]] = {}
    for r in truth.join(index.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toLocalIterator():  # calibration x k rows
        where.setdefault(r.query_id, []).append(r.leaf)
    ranks, total = np.zeros(tree.n_leaves + 1), 0
    for i, v in zip(ids.tolist(), q):
        place = {leaf: n for n, leaf in enumerate(tree.visits(v, tree.n_leaves), 1)}
        for leaf in where.get(i, ()):
            ranks[place[leaf]] += 1
            total += 1
    if not total:
        return 1
    return int(np.searchsorted(np.cumsum(ranks), recall * total)) or 1
