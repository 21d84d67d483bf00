"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source gets a demand of words (its target). Its weight schedule says how that demand spreads over
training time: the schedule is integrated, and the cumulative demand at which a copy of a document lies
within its source is inverted to a training position between 0 and 1. Range-sorting by position gives
the training order.

A source's stream is its documents in an order drawn from doc_id and text, again and again; the mix takes the copies
whose middle lies within the target. Sums before a document come from sums over hash ranges of a source,
so a source with a third of all rows is cut like many small ones; rows that repeat both doc_id and text are counted
before anything is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import common

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Schedules of the sources in the same order, repeating: (time, multiplier) knots joined by lines.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
#: Words of all sources that the mix takes, as a share of all sizes; times its size a source may reach.
SHARE, MOST = 1.5, 2


def position(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a source with schedule number kind has met this share of its demand."""
    found = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        areas = [(t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False)]
        whole, done, of = sum(areas), 0.0, F.lit(knots[-1][0])
        steps = []
        for area, (t0, m0), (t1, m1) in zip(areas, knots, knots[1:], strict=False):
            steps.append((done / whole, (done + area) / whole, t0, m0, (m1 - m0) / (t1 - t0)))
            done += area
        for low, high, t0, m0, slope in reversed(steps):
            part = F.greatest(share - F.lit(low), F.lit(0.0)) * F.lit(whole)
            root = F.sqrt(F.greatest(F.lit(m0 * m0) + F.lit(2 * slope) * part, F.lit(0.0)))
            at = F.lit(t0) + F.when(part > 0, F.lit(2.0) * part / (F.lit(m0) + root)).otherwise(F.lit(0.0))
            of = F.when(share <= F.lit(high), at).otherwise(of)
        found = F.when(kind == k, of).otherwise(found)
    return found


def targets(sizes: DataFrame, weights=WEIGHTS, kinds: int = len(SCHEDULES), share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, n, source_size, target, kind) from (source, n, source_size), one row a source.

    Sorted by most * size / weight, the sources before some row are held at most * size and the others share the
    rest by weight; the first row that does not exceed its own bound then fixes everyone's share.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    every = Window.partitionBy()
    s = sizes.withColumn("number", number).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    s = s.withColumn("bound", F.col("source_size") * F.lit(float(most))).withColumn("total", F.sum("source_size").over(every) * F.lit(share)).withColumn("weights", F.sum("weight").over(every))
    before = Window.orderBy(F.col("bound") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    s = s.withColumn("unit", rest / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.when(F.col("unit") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), "number", "unit"))
    s = s.withColumn("unit", F.min(fits).over(every)["unit"])
    return s.select("source", "n", "source_size", F.least("bound", F.col("unit") * F.col("weight")).alias("target"), (F.col("number") % kinds).alias("kind"))


def mixture(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, most: int = MOST, bucket_rows: int = 4_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, source, size, source_size, target, taken, positions, repeats) of every row of docs (doc_id, text, source).

    size counts words between ASCII white space (null text: 0). positions has one training position for each copy taken, and
    taken is size times their number. A null source is a source, the last one. Rows that repeat doc_id and text are
    documents of their own, one after the other; repeats says how many they are. Null and repeated doc_ids with different
    texts are drawn apart by their texts. keep names columns carried along, which must agree in rows that repeat doc_id and text.
    An empty table gives an empty table; a source of size 0 takes nothing but its first, empty copies.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)).cast("long")
    draw = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", *keep, "source", size.alias("size"), draw.alias("draw"))
    # equal rows are counted where they are read: however often a row is repeated, one task never meets it that often
    base = common.checkpointed(rows.groupBy(*rows.columns).agg(F.count("*").alias("repeats")))
    sizes = base.groupBy("source").agg(F.sum("repeats").alias("n"), F.sum(F.col("size") * F.col("repeats")).alias("source_size"))
    of = targets(sizes, weights, len(schedules), share, most).withColumnRenamed("source", "_s")
    # the first 32 bits of the draw, cut in as many ranges as the source has buckets
    high = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    d = base.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    d = d.withColumn("bucket", F.floor(high * F.ceil(F.col("n") / bucket_rows) / F.lit(1 << 32))).withColumn("whole", F.col("size") * F.col("repeats"))
    sums = d.groupBy("kind", "source", "bucket").agg(F.sum("whole").alias("_t"))
    line = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.sum("_t").over(line) - F.col("_t")).alias("before"))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    within = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("before", F.col("before") + F.sum("whole").over(within) - F.col("whole"))
    d = d.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    d = d.withColumn("middle", F.col("before") + F.col("nth") * F.col("size") - F.col("size") / 2)
    copies = F.array(*[F.col("middle") + F.lit(k) * F.col("source_size") for k in range(most)])
    d = d.withColumn("copies", F.filter(copies, lambda m: m <= F.col("target")))
    d = d.withColumn("positions", F.transform("copies", lambda m: position(F.when(F.col("target") > 0, m / F.col("target")).otherwise(F.lit(0.0)), F.col("kind"), schedules)))
    return d.select("doc_id", *keep, "source", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), "positions", "repeats")


def training_order(mixed: DataFrame, *ties: str) -> DataFrame:
    """A row for each copy, range-sorted by position; ties by doc_id and what else is named."""
    rows = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return rows.orderBy("position", "doc_id", *ties)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """docs (doc_id, text, source, ...) with a row for each copy that the mix takes, in training order; all columns stay.

    A row is known by doc_id, source and a hash of its text; of rows that repeat these one stands for all, as often as they are
    taken. Null doc_ids, texts and sources and empty texts are documents like others; an empty table stays empty. Columns may have any names.
    """
    names = docs.columns
    key, id_, k, s, at = common.fresh(names, "key", "id", "k", "s", "position")
    whole = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    taken = mixture(whole.select("doc_id", "text", "source", F.col(key).alias("key")), keep=("key",), **settings).select(F.col("doc_id").alias(id_), F.col("key").alias(k), F.col("source").alias(s), F.explode("positions").alias(at), "repeats")
    plan = common.checkpointed(taken)
    if not plan.filter("repeats > 1").isEmpty():
        whole = whole.dropDuplicates(["doc_id", "source", key])
    rows = whole.join(plan.drop("repeats"), F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(key) == F.col(k)))
    return rows.orderBy(at, "doc_id", key).select(*[F.col(f"`{n}`") for n in names])


def op7_mixing(spark, sf_dir) -> DataFrame:
    """Every document with the training positions of its first and second copy, in the order in which training first meets it."""
    mixed = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at = [F.round(F.get("positions", k), 9).alias(f"position_{k + 1}") for k in range(MOST)]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *at).orderBy(F.col("position_1").asc_nulls_last(), "doc_id")


def _position_sql(share: str) -> str:
    """The area under each schedule's knots inverted, as SQL; kind numbers the schedules."""
    kinds = []
    for k, knots in enumerate(SCHEDULES):
        lines = list(zip(knots, knots[1:], strict=False))
        whole = sum((t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in lines)
        done, steps = 0.0, []
        for (t0, m0), (t1, m1) in lines:
            part = f"greatest({share} - {done / whole!r}::DOUBLE, 0) * {whole!r}::DOUBLE"
            done += (t1 - t0) * (m0 + m1) / 2
            steps.append(f"WHEN {share} <= {done / whole!r}::DOUBLE THEN {t0!r}::DOUBLE + 2 * ({part}) / ({m0!r}::DOUBLE + sqrt(greatest({m0 * m0!r}::DOUBLE + {2 * (m1 - m0) / (t1 - t0)!r}::DOUBLE * ({part}), 0)))")
        kinds.append(f"WHEN kind = {k} THEN CASE {' '.join(steps)} ELSE {knots[-1][0]!r}::DOUBLE END")
    return f"CASE {' '.join(kinds)} END"


#: The same rows in DuckDB.
_POSITIONS = ", ".join(f"round(CASE WHEN m{k} > target THEN NULL ELSE {sql} END, 9) AS position_{k}" for k in (1, 2) for sql in [_position_sql(f"(CASE WHEN target > 0 THEN m{k} / target ELSE 0 END)")])
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][number % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS bound FROM s),
u AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(bound) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS unit FROM w
      WINDOW b AS (ORDER BY bound / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(unit, {{'q': bound / weight, 'n': number}}) AS unit FROM u WHERE unit * weight <= bound),
t AS (SELECT u.source, source_size, number % 3 AS kind, least(bound, f.unit * weight)::DOUBLE AS target FROM u, f),
m AS (SELECT doc_id, size, source_size, kind, target, sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS m1, m1 + source_size AS m2 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * ((m1 <= target)::INT + (m2 <= target)::INT))::BIGINT AS taken, {_POSITIONS} FROM m
"""
