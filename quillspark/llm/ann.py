"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue per query.

Trees are fitted on a bounded sample and split at medians, so dense regions get more leaves; every vector is put in
one leaf of each tree. A query walks all trees through a shared queue ordered by the squared margins it would
have to cross, until the leaves it has opened hold the search budget. Rows of a leaf, in pieces of bounded size, meet the
queries that opened it as a stream; each piece scores its own vectors exactly and keeps each query's nearest, which
are merged over pieces.

Equal vectors are one entry with its smallest ids, so copies neither overfill a leaf nor meet in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import common

#: Vectors at most that the trees are fitted on, about, and of them the fewest in a leaf.
SAMPLE, LEAF_SAMPLE = 32_768, 16
#: Rows of a leaf that a task holds at once, about.
PIECE_ROWS = 20_000


class Forest:
    """Trees over directions; leaves of all trees are numbered through."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim, self.trees, self.leaves, self.weight = sample.shape[1], [], 0, []
        for _ in range(trees):
            nodes: list = []
            self._grow(sample, np.arange(len(sample)), depth, nodes, rng)
            self.trees.append(nodes)
        self.weight = np.array(self.weight) / max(len(sample), 1)

    def _grow(self, x: np.ndarray, rows: np.ndarray, depth: int, nodes: list, rng) -> int:
        me = len(nodes)
        nodes.append(None)
        way = None
        for _ in range(8 if depth and len(rows) > 8 else 0):
            a, b = x[rng.choice(rows, 2, replace=False)]
            gap = a - b
            if (size := np.linalg.norm(gap)) > 1e-9:
                at = x[rows] @ (gap / size)
                cut = float(np.median(at))
                if 0 < (at < cut).sum() < len(rows):
                    way = gap / size
                    break
        if way is None:
            nodes[me] = self.leaves
            self.leaves += 1
            self.weight.append(len(rows))
            return me
        low = self._grow(x, rows[at < cut], depth - 1, nodes, rng)
        high = self._grow(x, rows[at >= cut], depth - 1, nodes, rng)
        nodes[me] = (way, cut, low, high)
        return me

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.trees)), np.int64)
        for t, nodes in enumerate(self.trees):
            todo = [(0, np.arange(len(x)))]
            while todo:
                n, rows = todo.pop()
                if isinstance(nodes[n], int):
                    out[rows, t] = nodes[n]
                    continue
                way, cut, low, high = nodes[n]
                side = x[rows] @ way < cut
                todo += [(low, rows[side]), (high, rows[~side])]
        return out

    def open(self, q: np.ndarray, share: float) -> list[int]:
        """Leaves in the order of the shared queue until they hold this share of the rows.

        The share is estimated as if trees were independent: one less the product over trees of what each has left. It
        is one only when some tree is open altogether, so a share of one finds everything.
        """
        heap, found, left = [(0.0, t, 0) for t in range(len(self.trees))], [], np.ones(len(self.trees))
        while heap and left.prod() > 1 - share + 1e-9:
            crossed, t, n = heapq.heappop(heap)
            node = self.trees[t][n]
            while not isinstance(node, int):
                way, cut, low, high = node
                margin = float(q @ way) - cut
                near, far = (low, high) if margin < 0 else (high, low)
                heapq.heappush(heap, (crossed + margin * margin, t, far))
                node = self.trees[t][near]
            found.append(node)
            left[t] = max(0.0, left[t] - self.weight[node])
        return found


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed component by component, so equal vectors have equal sums wherever they are computed."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return in_order(a, b) / np.sqrt(in_order(a, a) * in_order(b, b))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_FOUND = pa.schema([("query", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])


def _nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, x: np.ndarray, keep: int) -> pa.RecordBatch:
    """Each query's nearest of some rows, which come by ascending id."""
    unit, k, parts = _unit(x), min(keep, len(x)), []
    for lo in range(0, len(q), 512):
        near = np.round(_unit(q[lo : lo + 512]) @ unit.T, 12)
        # the k largest, and what ties with the last of them; of these the smaller ids
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        a, b = np.nonzero(near >= least)
        order = np.lexsort((b, -near[a, b], a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        a, b = a[rank < k] + lo, b[rank < k]
        parts.append((qid[a], cid[b], cosines(q[a], x[b])))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts, strict=True)], schema=_FOUND)


def _meet(batches: Iterator[pa.RecordBatch], dim: int, keep: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (leaf, piece, asks, cid): a piece's rows are held, its queries pass by."""
    now, ids, rows = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        leaf, piece, cid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "piece", "cid"))
        asks, v = np.array(batch.column("asks").to_pylist(), bool), matrix(batch.column("v"), dim)
        edge = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(piece) != 0) | np.diff(asks)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(leaf)], strict=True):
            if now != (leaf[a], piece[a]):
                now, ids, rows = (leaf[a], piece[a]), [], []
            if not asks[a]:
                ids.append(cid[a:b])
                rows.append(v[a:b])
            elif rows:
                ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                yield _nearest(cid[a:b], v[a:b], ids[0], rows[0], keep)


def nearest(vectors: DataFrame, is_query, k: int = 5, trees: int = 8, leaf_rows: int = 800, search_share: float = 0.6, least_rows: int = 2000, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by cosine, ties to the smaller vec_id.

    vectors has (vec_id, embedding); is_query is a condition on vec_id. Every row but the query's own is a candidate.
    Rows take no part if vec_id is null or the vector is null, empty or zero, holds null or non-finite components, or has
    another dimension than most rows, as there is no cosine between them. A repeated row counts once; an empty table gives none. A query's
    budget is the share search_share of the different vectors, and least_rows of them more.
    """
    spark = vectors.sparkSession
    kind = "float" if "float" in dict(vectors.dtypes)["embedding"] else "double"
    v = F.transform("embedding", lambda x: x.cast(kind))
    good = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(good)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0][0]
    rows = rows.filter(F.size("v") == dim)
    # k + 1 smallest ids of each vector: enough for any query, its own id taken off
    first = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.withColumn("r", F.dense_rank().over(first)).filter(F.col("r") <= k + 1).distinct()
    classes = common.checkpointed(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "ids", "v"))
    n = classes.count()
    asked = common.checkpointed(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct())
    asked = common.checkpointed(common.joined(asked, classes.select("v", F.col("cid").alias("query")), "v").select("query_id", "query", "v"))
    some = classes.filter(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / max(n, 1)))).select("cid", "v").toPandas().sort_values("cid")["v"]
    points = _unit(np.stack(some.to_numpy()).astype(np.float64)) if len(some) else np.zeros((0, dim))
    depth = min(max(2, math.ceil(math.log2(max(n / leaf_rows, 1)))), int(math.log2(max(len(points) / LEAF_SAMPLE, 4))))
    forest = Forest(points, trees, depth)
    share = min(1.0, search_share + least_rows / max(n, 1))
    pieces = np.maximum(1, np.ceil(forest.weight * n / PIECE_ROWS)).astype(np.int64)
    ddl = f"leaf long, piece long, asks boolean, cid long, v array<{kind}>"

    def out(b: pa.RecordBatch, at: np.ndarray, leaf: np.ndarray, piece: np.ndarray, asks: bool) -> pa.RecordBatch:
        at = pa.array(at)
        return pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(piece), pa.array(np.full(len(leaf), asks)), b.column("cid").take(at), b.column("v").take(at)], ["leaf", "piece", "asks", "cid", "v"])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                leaf = forest.place(_unit(matrix(b.column("v"), dim)))
                at = np.repeat(np.arange(b.num_rows), leaf.shape[1])
                own = common.mixed(b.column("cid").to_numpy().view(np.uint64))[at]
                yield out(b, at, leaf.ravel(), (own % pieces[leaf.ravel()].view(np.uint64)).astype(np.int64), False)

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                leaves = [np.array(forest.open(q, share), np.int64) for q in _unit(matrix(b.column("v"), dim))]
                at, leaf = np.repeat(np.arange(b.num_rows), [pieces[x].sum() for x in leaves]), np.concatenate(leaves)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces[leaf]) - pieces[leaf], pieces[leaf])
                yield out(b, at, np.repeat(leaf, pieces[leaf]), piece, True)

    index = classes.select("cid", "v").mapInArrow(place, ddl)
    routed = asked.select(F.col("query").alias("cid"), "v").distinct().mapInArrow(route, ddl)
    met = index.unionByName(routed).repartition("leaf", "piece").sortWithinPartitions("leaf", "piece", "asks", "cid")
    found = met.mapInArrow(lambda it: _meet(it, dim, k + 1), "query long, cid long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    top = found.distinct().withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    top = common.checkpointed(top.join(classes.select("cid", "ids"), "cid").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near")))
    each = common.joined(asked.select("query_id", "query"), top, "query").select("query_id", F.explode("near").alias("c")).select("query_id", F.explode("c.ids").alias("vec_id"), F.col("c.score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: The same rows in DuckDB where the budget is the whole table: up to least_rows / (1 - search_share), 5,000 vectors. Beyond, recall is measured.
ORACLE = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
