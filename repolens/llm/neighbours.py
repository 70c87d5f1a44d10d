"""Approximate nearest neighbours by largest inner product (operator 9).

A hierarchical k-means tree is fitted on a bounded sample.  Every vector is
indexed: it goes down the tree to its leaf.  A query walks the tree best bin
first through a priority queue and is sent to the leaves that it visits; how
many these are is calibrated on queries with known answers, widening until
the target recall is reached.  Leaves are searched in blocks of bounded size,
and the blocks' best are merged.

The sample also gives each query a score that its k-th nearest must reach;
blocks return only rows that reach it.  Of equal vectors only the ``k + 1`` smallest ids can be among a query's
nearest, so the others are put aside first; a vector that a third of all rows
share costs no more than any other.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do those of another length than the
most frequent one (of equally frequent ones the largest), nor null ids.  Of
rows with one id the smallest vector stands for it.  Ties go to the smaller
id.  A query with fewer than ``k`` candidates gets them all; empty tables and
single vectors give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: Vectors in the fitted sample, and numbers in it (the bound on driver
#: memory); children of a node; indexed rows that a leaf should hold.
SAMPLE_ROWS, SAMPLE_NUMBERS, FANOUT, LEAF_ROWS = 20_000, 8_000_000, 16, 512
#: Queries with known answers that set the number of visits, and their recall.
CALIBRATION, TARGET_RECALL = 100, 0.95
#: Largest block of a leaf: vectors, queries.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024


class Tree:
    """centres[i] are the children of inner node i; kids[i] their numbers, an
    inner node's number if >= 0, else ~leaf."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.kids: list[list[int]] = []
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        self.leaf_size = max(leaf_size, 1)
        self.root = self._node(sample)

    def _node(self, x: np.ndarray) -> int:
        groups = self._split(x) if len(x) > self.leaf_size else []
        if len(groups) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.centres)
        self.centres.append(np.array([g.mean(axis=0) for g in groups]))
        self.kids.append([])
        self.kids[at] = [self._node(g) for g in groups]
        return at

    def _split(self, x: np.ndarray) -> list[np.ndarray]:
        k = min(FANOUT, max(2, -(-len(x) // self.leaf_size)))
        centres = x[self._rng.choice(len(x), k, replace=False)]
        near = np.zeros(len(x), np.int64)
        for _ in range(12):
            now = _nearest(x, centres)
            if np.array_equal(now, near) and _:
                break
            near = now
            centres = np.array([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        return [g for j in range(k) if len(g := x[near == j])]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, by nearest centre from the root down."""
        out = np.empty(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            near = _nearest(x[rows], self.centres[node])
            todo += [(kid, rows[near == j]) for j, kid in enumerate(self.kids[node]) if (near == j).any()]
        return out

    def visits(self, q: np.ndarray):
        """Leaves in best-bin-first order for one query."""
        queue = [(0.0, self.root)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield ~node
                continue
            for score, kid in zip(self.centres[node] @ q, self.kids[node]):
                heapq.heappush(queue, (-score, kid))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int,
          floor: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query, id, score) of each query's k best rows but its own, from its
    ``floor`` on.  Scores are correctly rounded sums, so equal vectors tie
    whatever block they are in."""
    out = []
    rough = q @ x.T
    slack = 1e-9 * (1 + np.abs(rough).max()) if rough.size else 0
    for i, qid in enumerate(q_ids):
        s = rough[i]
        edge = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else -np.inf
        if floor is not None:
            edge = max(edge, floor[i])
        some = np.flatnonzero((s >= edge - slack) & (ids != qid))
        exact = sorted((-math.fsum(q[i] * x[j]), ids[j]) for j in some)[:k]
        out += [(int(qid), int(j), -score) for score, j in exact]
    return out


_FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one finite, non-zero vector of the usual length per id."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(
        F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return rows
    return rows.where(F.size(v) == length["d"]).groupBy("id").agg(F.min("v").alias("v"))


def _merge(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_search(points: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded number of queries, held by every task."""
    shared = points.sparkSession.sparkContext.broadcast((queries, ids))

    def search(batches):
        q, q_ids = shared.value
        for b in batches:
            rows = _best(q, q_ids, _matrix(b.column("v").to_pylist()), b.column("id").to_numpy(), k) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                                             names=["query_id", "vec_id", "score"])
    return _merge(points.select("id", "v").mapInArrow(search, _FOUND), k)


def fit(points: DataFrame, leaf_rows: int = LEAF_ROWS) -> Tree:
    """The tree, from at most about SAMPLE_ROWS vectors drawn by hash."""
    n, d = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    share = min(1.0, SAMPLE_ROWS / max(n, 1), SAMPLE_NUMBERS / max(n * (d or 1), 1))
    drawn = points.where(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = drawn.orderBy("id").select("id", "v").collect()
    sample = _matrix([r["v"] for r in rows]) if rows else np.zeros((0, d or 1))
    # A leaf of the tree holds leaf_rows rows if the sample is like the rest.
    tree = Tree(sample if len(sample) else np.zeros((1, d or 1)), max(4, round(leaf_rows * share)))
    tree.sample, tree.sample_ids = sample, np.array([r["id"] for r in rows], np.int64)
    return tree


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           target_recall: float = TARGET_RECALL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the rows where ``is_query`` (a
    condition on ``id``) holds, against all rows."""
    spark = vectors.sparkSession
    every = write_table(usable(vectors, id_col, vector_col), "ann-vectors")
    copies = Window.partitionBy("v").orderBy("id")
    points = every.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n")
    points = write_table(points, "ann-points")
    tree = fit(points, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def leaf(v: pa.Array) -> pa.Array:
        return pa.array(shared.value.leaf_of(_matrix(v.to_pylist())) if len(v) else [], pa.int32())

    indexed = write_table(points.withColumn("leaf", leaf(F.col("v"))), "ann-index")
    held = dict(indexed.groupBy("leaf").count().collect())  # one number a leaf
    queries = every.where(is_query)

    # Calibration: how many leaves until the known neighbours are found.
    share = CALIBRATION / max(queries.count(), 1)
    known = queries.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy("id").collect()
    visits = 1
    if known:
        ids, q = np.array([r["id"] for r in known]), _matrix([r["v"] for r in known])
        true: dict[int, list[int]] = {}
        answers = exact_search(indexed, q, ids, k).select("query_id", F.col("vec_id").alias("id"))
        for qid, at in answers.join(indexed.select("id", "leaf"), "id").select("query_id", "leaf").collect():
            true.setdefault(qid, []).append(at)
        needed = []
        for qid, v in zip(ids, q):
            rank = {at: i + 1 for i, at in enumerate(x for x in tree.visits(v) if x in held)}
            needed += [rank[at] for at in true.get(int(qid), ())]
        while needed and visits < len(held) and sum(x <= visits for x in needed) < target_recall * len(needed):
            visits += 1

    plan = spark.sparkContext.broadcast((visits, held))

    @F.arrow_udf("double")
    def floor(ids: pa.Array, v: pa.Array) -> pa.Array:
        """A score that the k-th nearest reaches: that of the k-th nearest in
        the sample, which is part of the rows."""
        x, own, out = shared.value.sample, shared.value.sample_ids, []
        for i, q in zip(ids.to_pylist(), _matrix(v.to_pylist()) if len(v) else ()):
            s = (x @ q)[own != i]
            out.append(float(np.partition(s, -k)[-k]) if len(s) >= k else -math.inf)
        return pa.array(out, pa.float64())

    @F.arrow_udf("array<int>")
    def visited(v: pa.Array) -> pa.Array:
        most, sizes = plan.value
        out = []
        for q in _matrix(v.to_pylist()) if len(v) else ():
            seen, rows = [], 0
            for at in shared.value.visits(q):
                if at in sizes:
                    seen.append(at)
                    rows += sizes[at]
                    if len(seen) >= most and rows > 2 * k + 1:
                        break
            out.append(seen)
        return pa.array(out, pa.list_(pa.int32()))

    calls = write_table(queries.withColumn("floor", floor(F.col("id"), F.col("v"))).withColumn("leaf", F.explode(visited(F.col("v")))), "ann-queries")

    # Block numbers by leaf; a tree has at most SAMPLE_ROWS / 4 leaves, so the
    # two counts a leaf may be broadcast.
    blocks = (indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).alias("vbs"))
              .join(calls.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("qbs")), "leaf"))

    def dealt(df: DataFrame, own: str, other: str, *more: str):
        return (df.join(F.broadcast(blocks), "leaf").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}s")))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))
                .select("leaf", "vb", "qb", "id", "v", *more).groupBy("leaf", "vb", "qb"))

    left, right = dealt(indexed, "vb", "qb"), dealt(calls, "qb", "vb", "floor")

    def block(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = _best(_matrix(q["v"].tolist()), q["id"].to_numpy(), _matrix(x["v"].tolist()), x["id"].to_numpy(), k, q["floor"].to_numpy()) if len(x) and len(q) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.cogroup(right).applyInPandas(block, _FOUND)
    return _merge(found, k).select("query_id", "rank", "vec_id", "score")
