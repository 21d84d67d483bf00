"""A vector index: a coarse quantiser, vectors stored by cell, searches that read the nearest cells only, exact scores.

Centres are fitted on a bounded sample; every vector lies in the folder of its nearest centre. A query opens cells in the order of
their centres' cosine until these hold the share of all vectors that it may look at, and scores what is in them exactly; with a share of one the
result is that of a scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import retrieval
from quillspark.operators.retrieval import RunningTop, by_length, unit_rows

#: Vectors at most that centres are fitted on, about; cells at most, so that centres stay small; files that a cell is dealt to.
SAMPLE, MOST_CELLS, SALTS = 32_768, 4096, 16


def centres_of(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centres of unit vectors by k-means with cosines; a centre that nothing is nearest to moves to what is worst off."""
    rng = np.random.default_rng(seed)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = x[np.argsort(near.max(axis=1))[: len(empty)]]
        centres = unit_rows(sums)
    return centres


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors cut or filled up to a length, as the index sees them; scores look at the whole vectors."""
    out = np.zeros((len(column), dim))
    for rows, x in by_length(column):
        n = min(dim, x.shape[1])
        out[rows, :n] = x[:, :n]
    return unit_rows(out)


def write_cells(chunks: DataFrame, path: str, key: str, cells: int | None = None, sample: int = SAMPLE) -> None:
    """The index of chunks (key, embedding) below path: vectors by cell, and the centres with their numbers of rows.

    By default there are as many cells as the root of the number of vectors, MOST_CELLS at most. Rows without a vector take no part. A cell is
    dealt to SALTS tasks, so that a common vector isn't one task's work.
    """
    spark = chunks.sparkSession
    rows = chunks.filter("embedding is not null").select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    cells = min(cells or math.ceil(math.sqrt(n)), MOST_CELLS)
    share = math.ceil((1 << 20) * min(1.0, sample / max(n, 1)))
    some = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share).orderBy(key).select("embedding").toArrow()
    points = _padded(some.column("embedding").combine_chunks(), dim) if len(some) else np.zeros((0, dim))
    centres = centres_of(points, max(cells, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _padded(b.column("embedding"), dim)
            own = np.concatenate([(x[lo : lo + 4096] @ centres.T).argmax(axis=1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("embedding"), pa.array(own.astype(np.int32))], [key, "embedding", "cell"])

    placed = rows.mapInArrow(place, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>, cell int")
    dealt = placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    dealt.sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    if n:
        sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").count().withColumnRenamed("count", "rows")
    else:
        sizes = spark.createDataFrame([], "cell int, rows long")
    listed = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    listed.join(sizes, "cell", "left").na.fill(0, ["rows"]).coalesce(1).write.parquet(f"{path}/centres")


def _order(q: np.ndarray, centres: np.ndarray, rows: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) of the cells that unit vectors open, nearest centres first: one is opened if those before it don't hold the share, so one at least."""
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1)
    at, place = np.nonzero((held - rows[order] < budget) & (rows[order] > 0))
    return at, order[at, place]


def _known(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Centres and numbers of rows; one row a cell."""
    known = sorted(spark.read.parquet(f"{path}/centres").collect())
    return np.array([r.centre for r in known]), np.array([r.rows for r in known])


def _with_vectors(queries: DataFrame) -> DataFrame:
    return queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def routed(spark: SparkSession, path: str, queries: DataFrame, share: float) -> DataFrame:
    """(cell, query_id): the cells that each query opens, nearest centres first, until they hold this share of all vectors."""
    centres, rows = _known(spark, path)
    budget = share * rows.sum()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _padded(b.column("embedding"), centres.shape[1])
            for lo in range(0, len(q), retrieval.QUERY_BLOCK):
                at, cell = _order(q[lo : lo + retrieval.QUERY_BLOCK], centres, rows, budget)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("query_id").take(pa.array(lo + at))], ["cell", "query_id"])

    return _with_vectors(queries).mapInArrow(route, "cell int, query_id long")


def _opened(spark: SparkSession, path: str, queries: DataFrame, share: float) -> DataFrame:
    """(query_id, embedding, opened): each query once, with a bit for each cell, set if the query opens it."""
    centres, rows = _known(spark, path)
    budget = share * rows.sum()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _padded(b.column("embedding"), centres.shape[1])
            for lo in range(0, len(q), retrieval.QUERY_BLOCK):
                own = q[lo : lo + retrieval.QUERY_BLOCK]
                mask = np.zeros((len(own), len(centres)), bool)
                mask[_order(own, centres, rows, budget)] = True
                bits = pa.array([x.tobytes() for x in np.packbits(mask, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("query_id").slice(lo, len(own)), b.column("embedding").slice(lo, len(own)), bits], ["query_id", "embedding", "opened"])

    return _with_vectors(queries).mapInArrow(route, "query_id long, embedding array<double>, opened binary")


def _passes(opened: DataFrame, k: int) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    """(ids, vectors, bits of cells) of as many queries at a time as retrieval.QUERY_BYTES and RESULT_ROWS allow; each query is sent once."""
    held, n = [], 0
    columns = lambda: (np.array([r[0] for r in held], np.int64), [r[1] for r in held], np.stack([np.frombuffer(r[2], np.uint8) for r in held]))
    for r in opened.toLocalIterator():
        held.append(r)
        n += 8 * (len(r.embedding) + 1) + len(r.opened)
        if n >= retrieval.QUERY_BYTES or len(held) * k >= retrieval.RESULT_ROWS:
            yield columns()
            held, n = [], 0
    if held:
        yield columns()


def cell_search(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str, share: float = 0.1) -> DataFrame:
    """(query_id, key, similarity, rank): the k nearest of what a query opens, for queries (query_id, embedding), ties to the smaller key.

    A pass sends queries along with tasks that read their cells alone; cells come in order, so hardly one is read twice. Every task keeps its k best.
    """
    vectors, found = None, None
    for ids, lists, bits in _passes(_opened(spark, path, queries, share), k):
        # the queries by length, as unit vectors, with their bits
        asked = [(ids[rows], unit_rows(q), bits[rows]) for rows, q in by_length(pa.array(lists, pa.list_(pa.float64())))]
        open_cells = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0))).tolist()
        if not open_cells:
            continue
        vectors = vectors or spark.read.parquet(f"{path}/vectors")
        kind = dict(vectors.dtypes)[key]

        def near(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            top, key_type = RunningTop(k, key, "similarity"), None
            for b in batches:
                key_type, keys, cell = b.schema.field(key).type, b.column(key).to_numpy(zero_copy_only=False), b.column("cell").to_numpy()
                for rows, x in by_length(b.column("embedding")):
                    for c in np.unique(cell[rows]):
                        mine = rows[cell[rows] == c]
                        mine = mine[np.argsort(keys[mine], kind="stable")]
                        unit = unit_rows(x[np.searchsorted(rows, mine)])
                        for ids, q, bits in asked:
                            m, own = min(q.shape[1], unit.shape[1]), np.flatnonzero(bits[:, c >> 3] >> (7 - (c & 7)) & 1)
                            for lo in range(0, len(own), retrieval.QUERY_BLOCK):
                                some = own[lo : lo + retrieval.QUERY_BLOCK]
                                s = np.round(q[some, :m] @ unit[:, :m].T, 6) + 0.0
                                at, best = retrieval._largest(s, k)
                                top.add(ids[some[at]], keys[mine[best]], s[at, best])
            yield from top.batch(key_type, pa.float64())

        part = vectors.filter(F.col("cell").isin(open_cells)).select(key, "embedding", "cell").mapInArrow(near, f"query_id long, {key} {kind}, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query_id long, {key} long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
