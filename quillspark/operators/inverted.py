"""Inverted indexes: positions for cover-density ranking, and blocks with upper bounds that a search skips where they can't matter.

A positional index holds where each term stands in each chunk; minimal covers are found by one sweep over the merged
positions of a query's terms. A block index holds the postings in folders by block of chunks, sorted by term, and of each term and
block the largest count; a search opens the blocks with the highest bounds first and then only those whose bound
reaches the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.stem import stem, stemmed
from quillspark.operators.retrieval import SALTS, TERMS_SENT, term_runs, term_sums
from quillspark.session import checkpointed

#: Query terms that are pushed into a scan as conditions.
TERMS_PUSHED = 64
#: Folders of a block index.
FOLDERS = 512


def _positions(batches: Iterator[pa.RecordBatch], key: str, of) -> Iterator[pa.RecordBatch]:
    for b, terms, row, term, place, first in term_runs(batches, of):
        ends = pa.array(np.append(first, len(row)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [terms.take(pa.array(term[first])), b.column(key).take(pa.array(row[first])), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32)))], ["term", key, "positions"]
        )


def positions_index(chunks: DataFrame, key: str, tokens: str = "tokens", stems: bool = True) -> DataFrame:
    """(term, key, positions): where each (stemmed) term stands among a chunk's tokens, from 1; nothing is shuffled."""
    of = stem if stems else (lambda w: w)
    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, F.col(tokens).alias("_tokens")).mapInArrow(lambda it: _positions(it, key, of), f"term string, {key} {kind}, positions array<int>")


def asked_terms(queries: DataFrame, terms: str, stems: bool) -> DataFrame:
    """(query_id, term, t, m): each query's different (stemmed) terms, numbered by spelling from 1, and how many it has."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms)).alias("term"))
    if stems:
        asked = stemmed(asked, "term", "_stem").select("query_id", F.col("_stem").alias("term"))
    lists = asked.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("_terms"))
    return lists.select("query_id", F.size("_terms").alias("m"), F.posexplode("_terms").alias("t", "term")).withColumn("t", F.col("t") + 1)


def with_terms(index: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """index joined with a query's terms. Up to TERMS_SENT go to every task; more are dealt out by term and a salt of the chunk, so a common term is many keys."""
    if asked.count() <= TERMS_SENT:
        return index.join(F.broadcast(asked), "term")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return index.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS))).join(asked.withColumn("_salt", every), ["term", "_salt"])


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cover_sweep(events: Column, m: Column) -> Column:
    """Struct of covers and score of the events (p, t), sorted by place p, of terms 1 to m.

    The sweep remembers each term's last event. Where all terms have one, the cover from the earliest of these to the present event is
    minimal exactly if no cover before began there. A cover of n events over w words scores 0.1 / (1 + w - n): 0.1 less for every
    other word in between.
    """
    numbered = F.transform(events, lambda e, i: F.struct((i + 1).alias("i"), e["p"].alias("p"), e["t"].alias("t")))
    start = F.struct(F.array_repeat(F.lit(0), m).alias("last"), F.lit(0).alias("before"), F.lit(0).cast("long").alias("covers"), F.lit(0.0).alias("score"))

    def step(s: Column, e: Column) -> Column:
        def seen(last: Column) -> Column:
            begin = F.array_min(last)
            new = begin > s["before"]
            others = e["p"] - F.get(events, begin - 1)["p"] - (e["i"] - begin)
            return F.struct(
                last.alias("last"), F.when(new, begin).otherwise(s["before"]).alias("before"), (s["covers"] + new.cast("long")).alias("covers"), (s["score"] + F.when(new, F.lit(0.1) / (1 + others)).otherwise(F.lit(0.0))).alias("score")
            )

        return _let(F.transform(s["last"], lambda x, j: F.when(j + 1 == e["t"], e["i"]).otherwise(x)), seen)

    return F.aggregate(numbered, start, step, lambda s: F.struct(s["covers"].alias("covers"), s["score"].alias("score")))


def cover_density(index: DataFrame, queries: DataFrame, k: int, key: str, terms: str = "terms", stems: bool = True, need: str = "any") -> DataFrame:
    """(query_id, key, covers, score, rank): the k chunks of a positional index that score highest, for queries (query_id, terms).

    A chunk matches if it has ``any`` or ``all`` of a query's terms, and scores by its minimal covers: the shortest stretches that match by themselves.
    With any, every position of a term is one, without other words in it. Ties go to the smaller key; a query without terms finds nothing. No pair of query and chunk that
    shares no term is made, and positions are shuffled only where all terms are needed.
    """
    if need not in ("any", "all"):
        raise ValueError(f"a query needs any or all of its terms, not {need!r}")
    if need == "any":
        found = term_sums(index, F.size("positions"), queries, key, k, terms, stems).withColumnRenamed("matches", "covers").withColumn("score", F.round(F.lit(0.1) * F.col("covers"), 9))
    else:
        pairs = with_terms(index, checkpointed(asked_terms(queries, terms, stems)), key)
        lists = pairs.groupBy("query_id", key, "m").agg(F.collect_list(F.struct("t", "positions")).alias("_lists")).filter(F.size("_lists") == F.col("m"))
        events = F.array_sort(F.flatten(F.transform("_lists", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("p"), x["t"].alias("t"))))))
        swept = lists.withColumn("_events", events).withColumn("_s", cover_sweep(F.col("_events"), F.col("m")))
        found = swept.select("query_id", key, F.col("_s.covers").alias("covers"), F.round("_s.score", 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", key, "covers", "score", "rank")


def write_blocks(index: DataFrame, path: str, key: str, block: Column, row_group: int = 1 << 20) -> None:
    """A block index of (term, key, n) below path: the postings, in FOLDERS folders that blocks are dealt to, and the bounds (term, block, top).

    block is a number that depends on key alone. Up to FOLDERS blocks in a row have a folder each; with more, a folder has several. Files are sorted by term, in row groups of
    bounded size with Bloom filters of their terms.
    """
    sorted_, bloom = {"parquet.block.size": str(row_group)}, {"parquet.bloom.filter.enabled#term": "true"}
    posts = index.select("term", key, "n", block.cast("long").alias("block")).withColumn("folder", F.pmod("block", F.lit(FOLDERS)))
    posts.repartition("folder").sortWithinPartitions("folder", "term", "block", key).write.options(**sorted_, **bloom).partitionBy("folder").parquet(f"{path}/postings")
    tops = index.sparkSession.read.parquet(f"{path}/postings").groupBy("term", F.col("block").cast("long").alias("block")).agg(F.max("n").alias("top"))
    tops.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.options(**sorted_, **bloom).parquet(f"{path}/bounds")


def _of_terms(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Only rows of asked terms: up to TERMS_PUSHED as conditions that the scan looks up in statistics and Bloom filters."""
    some = [r[0] for r in asked.select("term").distinct().limit(TERMS_PUSHED + 1).collect()]
    return rows if len(some) > TERMS_PUSHED else rows.filter(reduce(Column.__or__, [F.col("term") == t for t in some], F.lit(False)))


def opened_blocks(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str, terms: str = "terms", stems: bool = True, first: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a search opens (query_id, block, bound, round), the bounds of all blocks that have a term, and the matches found (query_id, key, matches).

    Round 1 is each query's ``first`` blocks by bound; round 2 the others whose bound is no less than its k-th best count so far.
    """
    asked = checkpointed(asked_terms(queries, terms, stems))
    bounds = term_sums(_of_terms(spark.read.parquet(f"{path}/bounds"), asked), F.col("top"), queries, "block", None, terms, stems).withColumnRenamed("matches", "bound")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = checkpointed(bounds.withColumn("place", F.row_number().over(order)))
    postings = _of_terms(spark.read.parquet(f"{path}/postings"), asked)

    def matches(open_: DataFrame) -> DataFrame:
        # the condition on round is selective for Spark, so that the scan reads opened blocks' folders only
        blocks = open_.filter("round > 0").select(F.col("block").alias("_block")).distinct().withColumn("_folder", F.pmod("_block", F.lit(FOLDERS)))
        near = postings.join(F.broadcast(blocks), (F.col("folder") == F.col("_folder")) & (F.col("block") == F.col("_block")), "left_semi")
        # a block that one query opens is counted for all: what another finds there can't be among its best unless it opens the block
        return term_sums(near, F.col("n"), queries, key, k, terms, stems)

    one = checkpointed(bounds.filter(F.col("place") <= first).select("query_id", "block", "bound", F.lit(1).alias("round")))
    best = Window.partitionBy("query_id").orderBy(F.desc("matches"), key)
    found = checkpointed(matches(one).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k))
    worst = found.filter(F.col("r") == k).select("query_id", F.col("matches").alias("worst"))
    two = bounds.filter(F.col("place") > first).join(worst, "query_id", "left").filter(F.col("bound") >= F.coalesce("worst", F.lit(0)))
    two = checkpointed(two.select("query_id", "block", "bound", F.lit(2).alias("round")))
    return one.unionByName(two), bounds, found.drop("r").unionByName(matches(two)).distinct()


def block_search(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str, terms: str = "terms", stems: bool = True, first: int = 2) -> DataFrame:
    """(query_id, key, matches, rank): the rows of ``index_search``, without opening blocks whose bound is below a query's k-th best count."""
    found = opened_blocks(spark, path, queries, k, key, terms, stems, first)[2]
    w = Window.partitionBy("query_id").orderBy(F.desc("matches"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
