"""Hard-negative mining: a vantage-point tree over norm-augmented vectors.

One more component, the square root of what a vector's squared norm lacks to the largest, gives all vectors the same norm; then
the distance of an anchor (whose further component is zero) falls exactly as its inner product grows, and a window of scores is
an annulus around the anchor. The tree is fitted on a bounded sample; every vector is put in one leaf, and for
either side of every node the least and largest distance to its vantage point are taken over all vectors, so bounds hold for all.

An anchor's leaves are opened nearest first from the inner radius on, in rounds that open ever more; a window is done when its
k-th row is at least as near as the next leaf can be, or the annulus ends. So the result is exact at any budget. Rows of a leaf, in
pieces of bounded size, meet the anchors that opened it as a stream.
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

#: Vectors at most that the tree is fitted on, about, and of them the fewest in a leaf.
SAMPLE, LEAF_SAMPLE = 32_768, 16
#: Rows of a leaf that a task holds at once, about; anchors whose scores are computed together.
PIECE_ROWS, TOGETHER = 20_000, 256
#: The squared norm up to which every score fits in a long.
MOST_NORM = 1 << 61
#: The bounds of a window that has none.
LEAST, MOST = -(1 << 62), 1 << 62


def augmented(x: np.ndarray, most: int) -> np.ndarray:
    """Integer vectors with the component that gives all of them the squared norm most."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(float(most) - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - v) ** 2).sum(axis=-1), 0))


class Tree:
    """Nodes (vantage point, radius, near child, far child) or leaf numbers, and the shells of their children once they are known."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 11):
        self.nodes: list = []
        self.leaves, self.points = 0, []
        self._grow(sample, np.arange(len(sample)), depth, np.random.default_rng(seed))
        self.points = np.array(self.points).reshape(-1, sample.shape[1])
        #: least and largest distance of the rows on the near and on the far side to the vantage point; without rows an empty shell
        self.shells = np.tile([math.inf, -math.inf], (len(self.nodes), 2, 1))
        self.rows = np.zeros(self.leaves, np.int64)

    def _grow(self, x: np.ndarray, rows: np.ndarray, depth: int, rng) -> int:
        """Splits at the median distance to the vantage point, of a few tried, whose distances spread most."""
        me, way = len(self.nodes), None
        self.nodes.append(None)
        if depth and len(rows) >= 2 * LEAF_SAMPLE:
            best = -1.0
            for c in rng.choice(rows, 5, replace=False):
                d = distances(x[rows], x[c])
                cut = float(np.median(d))
                if 0 < (d < cut).sum() < len(rows) and d.std() > best:
                    best, way, at = d.std(), (x[c], cut), d
        if way is None:
            self.nodes[me] = self.leaves
            self.leaves += 1
            return me
        place = len(self.points)
        self.points.append(way[0])
        near = self._grow(x, rows[at < way[1]], depth - 1, rng)
        far = self._grow(x, rows[at >= way[1]], depth - 1, rng)
        self.nodes[me] = (place, way[1], near, far)
        return me

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row, and the shells of these rows (as ``shells``)."""
        leaf, shells = np.empty(len(x), np.int64), np.tile([math.inf, -math.inf], (len(self.nodes), 2, 1))
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if isinstance(self.nodes[n], int):
                leaf[rows] = self.nodes[n]
                continue
            point, cut, near, far = self.nodes[n]
            d = distances(x[rows], self.points[point])
            for k, (child, side) in enumerate(((near, d < cut), (far, d >= cut))):
                if side.any():
                    shells[n, k] = d[side].min(), d[side].max()
                    todo.append((child, rows[side]))
        return leaf, shells

    def nearest_first(self, q: np.ndarray, inner: float, outer: float, slack: float) -> Iterator[tuple[float, int]]:
        """Leaves that may hold rows within the annulus, with the least distance of such a row, in its order."""
        to_point = distances(self.points, q) if len(self.points) else np.zeros(0)
        heap = [(inner, 0, 0.0, math.inf)]
        while heap:
            low, n, least, most = heapq.heappop(heap)
            node = self.nodes[n]
            if isinstance(node, int):
                if self.rows[node]:
                    yield low, node
                continue
            d = to_point[node[0]]
            for k in (0, 1):
                a, b = self.shells[n, k]
                if a > b:
                    continue
                lo, hi = max(least, a - d - slack, d - b - slack), min(most, d + b + slack)
                if lo <= outer and hi >= inner:
                    heapq.heappush(heap, (max(lo, inner), node[2 + k], lo, hi))


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(q: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Integer inner products: in floating point where that is exact."""
    if most < 1 << 52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


_FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("cid", pa.int64()), ("tag", pa.int64()), ("score", pa.int64())])


def _best(score: np.ndarray, may: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's keep largest scores among those that may, equal ones by column."""
    masked = np.where(may, score, LEAST)
    k = min(keep, score.shape[1])
    least = -np.partition(-masked, k - 1, axis=1)[:, k - 1 : k]
    a, b = np.nonzero(may & (masked >= least))
    order = np.lexsort((b, -masked[a, b], a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < keep], b[rank < keep]


def _meet(batches: Iterator[pa.RecordBatch], dim: int, most: int, keep: int, alike: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (leaf, piece, asks, cid, tag): a piece's rows are held, its anchors pass by."""
    now, held, whole = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        leaf, piece, cid, tag, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "piece", "cid", "tag", "kind"))
        asks, v = np.array(batch.column("asks").to_pylist(), bool), vectors_of(batch.column("v"), dim)
        edge = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(piece) != 0) | np.diff(asks)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(leaf)], strict=True):
            if now != (leaf[a], piece[a]):
                now, held, whole = (leaf[a], piece[a]), [], None
            if not asks[a]:
                held.append((cid[a:b], tag[a:b], kind[a:b], v[a:b]))
                continue
            if not held:
                continue
            ids, tags, kinds, rows = whole = whole or tuple(np.concatenate(x) for x in zip(*held, strict=True))
            windows = batch.column("windows").slice(a, b - a).to_pylist()
            for lo in range(0, b - a, TOGETHER):
                hi = min(lo + TOGETHER, b - a)
                scores = _products(v[a + lo : a + hi], rows, most)
                same = kind[a + lo : a + hi, None] == kinds[None, :]
                ask = [(i - lo, w["n"], w["low"], w["high"]) for i in range(lo, hi) for w in windows[i]]
                for at in range(0, len(ask), TOGETHER):
                    who, n, low, high = (np.array(x, np.int64) for x in zip(*ask[at : at + TOGETHER], strict=True))
                    s = scores[who]
                    i, j = _best(s, (same[who] == alike) & (s >= low[:, None]) & (s <= high[:, None]), keep)
                    yield pa.RecordBatch.from_arrays([pa.array(cid[a + lo : a + hi][who[i]]), pa.array(n[i].astype(np.int32)), pa.array(ids[j]), pa.array(tags[j]), pa.array(s[i, j])], schema=_FOUND)


class Index:
    """Classes of equal rows (cid, tag, kind, ids, v), each in its place of the tree, written once. (cid, tag) tells classes apart: their smallest id and a hash."""

    def __init__(self, rows: DataFrame, dim: int, keep: int, leaf_rows: int, sample: int):
        self.dim, self.spark = dim, rows.sparkSession
        # of equal rows the keep smallest ids: enough for any anchor, its own id taken off
        first = Window.partitionBy("kind", "v").orderBy("vec_id")
        ranked = rows.withColumn("r", F.dense_rank().over(first)).filter(F.col("r") <= keep).distinct()
        ids = F.sort_array(F.collect_list("vec_id"))
        classes = common.checkpointed(ranked.groupBy("kind", "v").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("cid"), F.xxhash64("kind", "v").alias("tag"), "kind", "ids", "v"))
        self.classes = classes
        squares = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
        n, self.most = classes.agg(F.count("*"), F.max(squares)).first()
        self.most = max(self.most or 0, 1)
        share = math.ceil((1 << 20) * min(1.0, sample / max(n, 1)))
        some = classes.filter(F.pmod("tag", F.lit(1 << 20)) < share).select("cid", "tag", "v").toArrow().sort_by([("cid", "ascending"), ("tag", "ascending")])
        points = augmented(vectors_of(some.column("v").combine_chunks(), dim), self.most) if len(some) else np.zeros((0, dim + 1))
        depth = min(max(0, math.ceil(math.log2(max(n / leaf_rows, 1)))), int(math.log2(max(len(points) / LEAF_SAMPLE, 1))))
        self.tree = tree = Tree(points, depth)
        most = self.most

        def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shells, rows = np.tile([math.inf, -math.inf], (len(tree.nodes), 2, 1)), np.zeros(tree.leaves, np.int64)
            for b in it:
                if b.num_rows:
                    leaf, s = tree.place(augmented(vectors_of(b.column("v"), dim), most))
                    rows += np.bincount(leaf, minlength=tree.leaves)
                    shells[..., 0], shells[..., 1] = np.minimum(shells[..., 0], s[..., 0]), np.maximum(shells[..., 1], s[..., 1])
            node, side = np.nonzero(shells[..., 0] <= shells[..., 1])
            full = np.flatnonzero(rows)
            far = np.full(len(full), np.nan)
            columns = [np.concatenate([node, full]), np.concatenate([side, np.full(len(full), 2)]), np.concatenate([shells[node, side, 0], far]), np.concatenate([shells[node, side, 1], far]), np.concatenate([np.zeros(len(node), np.int64), rows[full]])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "side", "low", "high", "n"])

        # one row a side of a node and one a leaf: as many as the tree has
        for r in classes.select("v").mapInArrow(measure, "node long, side long, low double, high double, n long").groupBy("node", "side").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
            if r.side == 2:
                tree.rows[r.node] = r.n
            else:
                tree.shells[r.node, r.side] = r.low, r.high
        self.pieces = pieces = np.maximum(1, -(-tree.rows // PIECE_ROWS))

        def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    leaf, _ = tree.place(augmented(vectors_of(b.column("v"), dim), most))
                    own = common.mixed(b.column("tag").to_numpy().view(np.uint64))
                    piece = (own % pieces[leaf].view(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(piece), *(b.column(c) for c in ("cid", "tag", "kind", "v"))], ["leaf", "piece", "cid", "tag", "kind", "v"])

        self.placed = common.checkpointed(classes.select("cid", "tag", "kind", "v").mapInArrow(place, "leaf long, piece long, cid long, tag long, kind int, v array<int>"))

    def search(self, asked: DataFrame, k: int, alike: bool, budget: int, growth: int = 8) -> DataFrame:
        """(anchor, window, score, tag, ids): rows of the k best classes of each window, exactly.

        asked has (anchor, kind, v, windows), windows of (n, low, high): scores from low to high, of rows of the anchor's kind
        (alike) or of any other. Every round opens the leaves that hold the next rows, budget of them and then growth times as many.
        """
        tree, dim, most, pieces, spark = self.tree, self.dim, self.most, self.pieces, self.spark
        ddl = "leaf long, piece long, asks boolean, cid long, tag long, kind int, v array<int>, windows array<struct<n:int,low:long,high:long>>"
        windows = "array<struct<n:int,low:long,high:long,worst:long,full:boolean>>"

        def route(begin: int, end: int):
            """Leaves that come next, between begin and end rows of a window's order, unless the window is done."""

            def routed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in it:
                    kinds, ids = b.column("kind"), b.column("anchor")
                    for i, (q, wins) in enumerate(zip(vectors_of(b.column("v"), dim), b.column("windows").to_pylist(), strict=True)):
                        point = np.concatenate([q.astype(np.float64), [0.0]])
                        both = float(point @ point) + float(most)
                        slack, least = 1e-9 * math.sqrt(both), 1e-12 * both
                        leaves: dict[int, list] = {}
                        for w in wins:
                            inner = 0.0 if w["high"] == MOST else math.sqrt(max(both - 2.0 * w["high"] - least, 0)) - slack
                            outer = math.inf if w["low"] == LEAST else math.sqrt(max(both - 2.0 * w["low"], 0) + least) + slack
                            if w["full"]:
                                outer = min(outer, math.sqrt(max(both - 2.0 * w["worst"], 0) + least) + slack)  # worse than the k-th found isn't asked for
                            seen = 0
                            for _, leaf in tree.nearest_first(point, max(inner, 0.0), outer, slack):
                                if seen >= end:
                                    break
                                if seen >= begin:
                                    leaves.setdefault(leaf, []).append({x: w[x] for x in ("n", "low", "high")})
                                seen += int(tree.rows[leaf])
                        if leaves:
                            into = np.array(list(leaves), np.int64)
                            at = np.repeat(np.arange(len(into)), pieces[into])
                            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces[into]) - pieces[into], pieces[into])
                            n, lists = len(at), list(leaves.values())
                            one = pa.array(np.full(n, i))
                            columns = [pa.array(into[at]), pa.array(piece), pa.array(np.ones(n, bool)), ids.take(one), pa.array(np.zeros(n, np.int64)), kinds.take(one), b.column("v").take(one)]
                            wanted = pa.array([lists[a] for a in at.tolist()], pa.list_(pa.struct([("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])))
                            yield pa.RecordBatch.from_arrays([*columns, wanted], ["leaf", "piece", "asks", "cid", "tag", "kind", "v", "windows"])

            return routed

        index = self.placed.select("leaf", "piece", F.lit(False).alias("asks"), "cid", "tag", "kind", "v", F.lit(None).cast("array<struct<n:int,low:long,high:long>>").alias("windows"))
        fill = F.transform("windows", lambda w: F.struct(w["n"].alias("n"), w["low"].alias("low"), w["high"].alias("high"), F.lit(0).cast("long").alias("worst"), F.lit(False).alias("full")))
        now = asked.select("anchor", "kind", "v", fill.cast(windows).alias("windows"))
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "cid", "tag")
        found, begin, end, total = spark.createDataFrame([], "anchor long, window int, cid long, tag long, score long"), 0, budget, int(tree.rows.sum())
        while True:
            asks = common.checkpointed(now.mapInArrow(route(begin, end), ddl))
            if asks.isEmpty():
                break
            opened = asks.select("leaf").distinct()
            met = index.join(F.broadcast(opened), "leaf", "left_semi").unionByName(asks).repartition("leaf", "piece").sortWithinPartitions("leaf", "piece", "asks", "cid", "tag")
            new = met.mapInArrow(lambda it: _meet(it, dim, most, k, alike), "anchor long, window int, cid long, tag long, score long")
            found = common.checkpointed(found.unionByName(new).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r"))
            if end >= total:
                break
            worst = found.groupBy("anchor", F.col("window").alias("n")).agg(F.min("score").alias("worst"), F.count("*").alias("c"))
            flat = now.select("anchor", F.explode("windows").alias("w")).select("anchor", "w.n", "w.low", "w.high")
            flat = flat.join(worst, ["anchor", "n"], "left").select("anchor", F.struct("n", "low", "high", F.coalesce("worst", F.lit(0)).alias("worst"), F.coalesce(F.col("c") >= k, F.lit(False)).alias("full")).alias("w"))
            now = common.checkpointed(asked.select("anchor", "kind", "v").join(flat.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).cast(windows).alias("windows")), "anchor"))
            begin, end = end, end * growth
        return found.join(self.classes.select("cid", "tag", "ids"), ["cid", "tag"]).select("anchor", "window", "score", "tag", "ids")


def mined(vectors: DataFrame, is_anchor, label=None, k: int = 5, positives: int = 5, low_percent: int = 80, leaf_rows: int = 2000, budget: int = 8000, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first positives the first k rows of other labels whose score is from low_percent of the positive's up to it.

    vectors has (vec_id, embedding, label); is_anchor is a condition on vec_id, label an expression for the label, by default the column. Components
    become floor(256 x); a score is an integer inner product; higher scores come first, ties by the smaller vec_id. Rows take no part if their vec_id or label is null,
    their vector null or empty, a component null or not finite, if they have another dimension than most rows (there is no inner product), or if scores with them may not
    fit in a long (a squared norm over 2**61). A row is told from others by vec_id, label and vector: what repeats all three counts once. An empty table gives none; other
    columns don't matter.
    """
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    scaled = F.transform("embedding", lambda x: 256 * x.cast("double"))
    rows = vectors.select("vec_id", (F.col("label") if label is None else label).alias("kind"), "embedding").filter("vec_id is not null and kind is not null and size(embedding) > 0")
    rows = rows.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.filter(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x) < float(MOST_NORM)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("kind").cast("int").alias("kind"), v.cast("array<int>").alias("v"))
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], empty)
    dim = sizes[0][0]
    rows = rows.filter(F.size("v") == dim)
    index = Index(rows, dim, max(k, positives) + 1, leaf_rows, sample)
    # anchors of one label and vector are looked up together
    anchors = common.checkpointed(rows.filter(is_anchor).distinct().select("vec_id", F.struct("kind", "v").alias("g")))
    askers = common.checkpointed(common.checkpointed(anchors.select("g").distinct()).select("g", F.monotonically_increasing_id().alias("anchor")))
    named = common.checkpointed(common.joined(anchors, askers, "g").select("anchor", "vec_id"))
    asked = askers.select("anchor", "g.kind", "g.v")
    whole = F.array(F.struct(F.lit(0).alias("n"), F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high")))
    # one class more than positives, as the anchor's own may hold no other id
    near = index.search(asked.withColumn("windows", whole), positives + 1, True, budget)
    near = near.join(askers.select("anchor", F.xxhash64("g.kind", "g.v").alias("own")), "anchor").groupBy("anchor").agg(F.collect_list(F.struct("score", (F.col("tag") == F.col("own")).alias("own"), "ids")).alias("near"))
    each = common.joined(named, common.checkpointed(near), "anchor").select("anchor", "vec_id", F.explode("near").alias("c")).select("anchor", "vec_id", "c.score", "c.own", F.explode("c.ids").alias("positive_id"))
    order = Window.partitionBy("anchor", "vec_id").orderBy(F.desc("score"), "positive_id")
    found = each.filter(~F.col("own") | (F.col("positive_id") != F.col("vec_id"))).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives)
    # 80 p <= 100 n <= 100 p holds for no n where p < 0
    found = common.checkpointed(found.filter("score >= 0").select(F.struct("anchor", "score").alias("span"), "vec_id", "positive_id"))
    low = F.ceil(F.col("span.score").cast("decimal(20,0)") * low_percent / 100).cast("long")
    spans = found.select("span").distinct().withColumn("n", F.row_number().over(Window.partitionBy("span.anchor").orderBy("span.score")).cast("int"))
    spans = common.checkpointed(spans.select("span", "n", low.alias("low")))
    wins = spans.groupBy(F.col("span.anchor").alias("anchor")).agg(F.sort_array(F.collect_list(F.struct("n", "low", F.col("span.score").alias("high")))).alias("windows"))
    far = index.search(common.checkpointed(asked.join(wins, "anchor")), k, False, budget)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "negative_id")
    best = far.select("anchor", "window", "score", F.explode("ids").alias("negative_id")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = best.groupBy("anchor", "window").agg(F.sort_array(F.collect_list(F.struct("rank", "negative_id", "score"))).alias("negatives"))
    best = common.checkpointed(spans.join(best, (F.col("span.anchor") == F.col("anchor")) & (F.col("n") == F.col("window"))).select("span", "negatives"))
    out = common.joined(found, best, "span").select("vec_id", "positive_id", "span.score", F.explode("negatives").alias("x"))
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "x.rank", "x.negative_id", F.col("score").alias("positive_score"), F.col("x.score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, moved)


#: The same rows in DuckDB.
ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
),
p AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS alike, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
),
s AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM p WHERE alike),
n AS (
  SELECT s.anchor_id, s.vec_id AS positive_id, p.vec_id AS negative_id, s.score AS positive_score, p.score AS negative_score,
    row_number() OVER (PARTITION BY s.anchor_id, s.vec_id ORDER BY p.score DESC, p.vec_id)::INT AS rank
  FROM s JOIN p ON s.r <= 5 AND NOT p.alike AND p.anchor_id = s.anchor_id AND 80 * s.score <= 100 * p.score AND 100 * p.score <= 100 * s.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
