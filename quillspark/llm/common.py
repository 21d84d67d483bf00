"""What the operators share: shared storage, byte kernels over Arrow strings, prefix sums, components."""

from __future__ import annotations

import ctypes
import gc
import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.session import shared_base, shared_dir  # noqa: F401

#: ASCII white space 0x20 and 0x09-0x0D; every other byte belongs to a word.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a kernel looks at together; a longer document is looked at by itself.
SLICE_BYTES = 4 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there: it is computed once and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def trimmed() -> None:
    """Hands memory that Python and Arrow hold without use back to the system, as workers and the driver live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def released(spark, pause: float = 1.5) -> None:
    """What earlier rounds left on the driver goes: its garbage, and with it the shuffles and broadcasts that nothing refers to any more.

    What Python has dropped the JVM is told up to a second later, and Spark's listeners may hold the last query until they are told of another one, so without the
    pause and the small query in it the last shuffles stay on disk until the next call.
    """
    trimmed()
    if pause:
        spark.range(1).collect()
        time.sleep(pause)
    spark.sparkContext._jvm.System.gc()


def fresh(taken: list[str], *bases: str) -> list[str]:
    """Column names made of bases that none of taken has, in any case."""
    used = {t.lower() for t in taken}
    out = []
    for name in bases:
        name = f"_{name}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; sizes the number of groups, so that a group has the same size at any scale."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def groups_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def raw_strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings end to end, and the n + 1 offsets; null counts as empty. No copy where Arrow needs none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of about so many bytes, one document at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word, and words before each document (n + 1 of them). No word spans documents."""
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[:-1][at[:-1] < len(data)]
    first[edges] |= inside[edges]
    edges = edges[edges > 0]
    last[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Rabin-Karp polynomials modulo 2**64, over bytes and then over words."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self._up = self._down = np.zeros(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            both = []
            for b in (self.base, self.back):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
            self._up, self._down = both
        return self._up[:n], self._down[:n]

    def _spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
            lo = starts[i]
            out[i:j] = self._spans(self.letters[data[lo : ends[j - 1]]], starts[i:j] - lo, ends[i:j] - lo)
            i = j
        return mixed(out + (ends - starts).astype(np.uint64))

    def windows(self, words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
        """Hash of the width words from each index of first on."""
        return mixed(self._spans(words, first, first + width))


def window_starts(before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each window, and windows before each document."""
    each = np.maximum(np.diff(before) - width + 1, 0)
    upto = np.concatenate([[0], np.cumsum(each)])
    return np.arange(upto[-1]) + np.repeat(before[:-1] - upto[:-1], each), upto


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, after a byte that says how many."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = blob[at]
    return np.frombuffer(blob, f"<u{width}", n, at + 1), at + 1 + width * n


def joined(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """left with the row of right, which has one row a key, inner. Both are read several times: let them be tables or checkpoints.

    Keys that hold a thousandth of left or more, a thousand at most by count, go by broadcast; so no task gets all rows of a key.
    """
    least = math.ceil(left.count() / share)
    hot = left.groupBy(key).count().filter(F.col("count") >= max(least, 2)).select(key)
    hot = F.broadcast(hot)
    rare = left.join(hot, key, "left_anti").join(right, key)
    return left.join(F.broadcast(right.join(hot, key, "left_semi")), key).unionByName(rare)


def salted(left: DataFrame, right: DataFrame, key: str, other: str, salts: int = 16) -> DataFrame:
    """left joined with right, which has one row a key and is small; rows of a key are dealt to as many tasks as there are salts, by column other."""
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    return left.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(salts))).join(right.withColumn("_salt", salt), [key, "_salt"]).drop("_salt")


def _told(edges: DataFrame, least: DataFrame, salts: int = 16) -> DataFrame:
    """edges (a, b) with the m of least (a, m), which has one row a node; edges of a node are dealt to as many tasks as there are salts.

    A window and no join: Spark takes a join's size for the product of its sides' and a checkpoint hands that on, so that with joins the number gets four times the
    digits a round, millions of them after ten, and the driver does little else than multiply.
    """
    none, salt = F.lit(None).cast(dict(edges.dtypes)["b"]), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    rows = edges.select("a", "b", none.alias("m"), F.pmod(F.xxhash64("b"), F.lit(salts)).alias("_salt"))
    rows = rows.unionByName(least.select("a", none.alias("b"), "m", salt.alias("_salt")))
    return rows.withColumn("m", F.min("m").over(Window.partitionBy("a", "_salt"))).filter("b is not null").drop("_salt")


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Alternating large-star and small-star steps; every round is checkpointed, and what it left on the driver goes. Their number grows with the logarithm of the
    nodes, most_rounds only ends a run that would not. The edges of a node with very many neighbours are dealt to several tasks.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _told(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _told(large, least).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = checkpointed(small.filter("a <> b").distinct())
        signature = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same, before = signature == before, signature
        now = after
        released(edges.sparkSession, 0)
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct()
    return found.unionByName(roots.select("node", F.col("node").alias("component")))


def running_start(df: DataFrame, part: list[str], size: str, into: str) -> DataFrame:
    """Adds the sum of size over all rows of smaller part, where (part) is a coarse order key with few rows in all.

    One row a part goes through the single-task window, not one a document.
    """
    totals = df.groupBy(*part).agg(F.sum(size).alias("_t"))
    offsets = totals.select(*part, (F.sum("_t").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias(into))
    return df.join(offsets, part)
