"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of words are hashed into slots; slot counts of the target (documents labelled good) and of all text give
two bag models. A document's log weight is the sum of the log ratios of all its n-grams, which is the log ratio of its
probabilities under the two models. Adding Gumbel noise drawn from doc_id and text and taking the k largest samples k
documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import common

SLOTS = 1 << 14
#: Target documents at most, about.
TARGET_DOCS = 20_000
#: Log weight of a text without words: it comes last, as no text of less than 10^10 n-grams weighs so little.
NO_WORDS = -1e11
#: Digits of the fixed-point keys are looked at so many bits at a time.
_DIGIT, _DIGITS, _SCALE, _ZERO = 15, 4, 1 << 20, 1 << 59


def slots(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, slots of all n-grams, n-grams before each row) of runs of texts: words, then pairs, row by row."""
    data, at = common.raw_strings(column)
    rolling = common.RollingHash(0x9E3779B97F4A7C15 & ~3 | 3)
    for i, j in common.slices(at):
        starts, ends, before = common.word_spans(data[at[i] : at[j]], at[i : j + 1] - at[i])
        w = rolling.words(data[at[i] : at[j]], starts, ends)
        first, upto = common.window_starts(before, 2)
        both = np.concatenate([w, rolling.windows(w, first, 2)])
        row = np.concatenate([np.repeat(np.arange(j - i), np.diff(before)), np.repeat(np.arange(j - i), np.diff(upto))])
        order = np.argsort(row, kind="stable")
        yield i, (both[order] >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), before + upto


def counts(docs: DataFrame) -> DataFrame:
    """(slot, n, target) over all texts of docs (text, is_target): a row for each task and slot before the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            good = np.array([bool(x) for x in b.column("is_target").to_pylist()])
            for i, s, before in slots(b.column("text")):
                of = np.repeat(good[i : i + len(before) - 1], np.diff(before))
                total[0] += np.bincount(s, minlength=SLOTS)
                total[1] += np.bincount(s[of], minlength=SLOTS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["slot", "n", "target"])

    parts = docs.select("text", "is_target").mapInArrow(run, "slot long, n long, target long")
    return parts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("target").alias("target"))


def log_ratios(table: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """Log of target probability over raw probability of each slot; SLOTS rows at most come to the driver."""
    n = np.full((2, SLOTS), smooth)
    for r in table.collect():
        n[:, r["slot"]] += (r["target"], r["n"])
    p = n / n.sum(axis=1, keepdims=True)
    return np.log(p[0] / p[1])


def weighted(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, own, n_ngrams, log_weight) of every row; own is a hash of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, weight = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, NO_WORDS)
            for i, s, before in slots(b.column("text")):
                k = np.diff(before)
                sums = np.concatenate([[0.0], np.cumsum(ratio[s])])
                n[i : i + len(k)] = k
                some = np.flatnonzero(k)
                weight[i + some] = (sums[before[1:]] - sums[before[:-1]])[some]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("own"), pa.array(n), pa.array(np.round(weight, 9))], ["doc_id", "own", "n_ngrams", "log_weight"])

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), "text").mapInArrow(run, "doc_id long, own long, n_ngrams long, log_weight double")


def largest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """rows with kept: true for the k rows of the largest key, ties by doc_id. Exact, without a sort of all rows.

    The k-th largest key is found digit by digit from counts, so the driver sees one histogram a digit.
    """
    at = F.greatest(F.lit(0), F.least(F.lit((1 << _DIGIT * _DIGITS) - 1), F.floor(F.col(key) * _SCALE).cast("long") + _ZERO))
    rows = rows.withColumn("_v", at)
    left, prefix = k, 0
    for d in reversed(range(_DIGITS)):
        now = rows.filter(F.shiftright("_v", _DIGIT * (d + 1)) == prefix).groupBy(F.shiftright("_v", _DIGIT * d).bitwiseAND((1 << _DIGIT) - 1).alias("d")).count()
        found = sorted(((r["d"], r["count"]) for r in now.collect()), reverse=True)
        digit = 0
        for digit, n in found:
            if n >= left:
                break
            left -= n
        prefix = prefix << _DIGIT | digit
    clear = rows.filter(F.col("_v") != prefix).withColumn("kept", F.col("_v") > prefix)
    # rows of the k-th key itself: equal ones are counted, numbered together, and as many of them kept as are left
    names = [c for c in rows.columns if c != "_v"]
    tie = rows.filter(F.col("_v") == prefix).groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_v").orderBy(F.desc(key), F.col("doc_id").asc_nulls_last(), *names).rowsBetween(Window.unboundedPreceding, 0))
    tie = tie.withColumn("_keep", F.lit(left) - upto + F.col("_n")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    return clear.drop("_v").unionByName(tie.select(*names, (F.col("_i") <= F.col("_keep")).alias("kept")))


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, kept) of every row of docs (doc_id, text); kept is the sample.

    The target is a bounded share of the documents labelled good (quality 1), drawn by a hash of doc_id; a doc_id labelled
    twice is good if all labels are. The sample has ``share`` of the rows, by default as many as are good among those
    labelled (all, without labels). Null and empty texts, and others without
    words, come last. Rows with equal doc_id and text are drawn alike; null doc_ids with different texts are not. An empty table stays empty.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    share = share if share is not None else good / n if n else 1.0
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, TARGET_DOCS / max(good, 1)))
    target = known.filter("quality = 1").filter(draw).select(F.col("doc_id").alias("_good"))
    marked = docs.select("doc_id", "text").join(F.broadcast(target), F.col("doc_id") == F.col("_good"), "left").select("text", F.col("_good").isNotNull().alias("is_target"))
    ratio = log_ratios(counts(marked))
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "own", F.lit("gumbel")), 11) + 0.5) / float(1 << 53)
    rows = common.checkpointed(weighted(docs, ratio).withColumn("sample_key", F.col("log_weight") - F.log(-F.log(u))))
    total = rows.count()
    k = round(share * total)
    if k <= 0 or k >= total:
        return rows.withColumn("kept", F.lit(k > 0)).drop("sample_key", "own")
    return largest(rows, "sample_key", k).drop("sample_key", "own")


def op3_quality(spark, sf_dir) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resampled(docs, labels)
