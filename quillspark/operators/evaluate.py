"""Summaries of retrieval runs and calibration of routed decisions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import metrics as M
from quillspark.session import checkpointed

KS = (1, 3, 5, 10)


def case_metrics(results: DataFrame, ks=KS) -> DataFrame:
    """results (id, retrieved, relevant, top_score) with hit_k, recall_k, rr and answerable."""
    r, rel = F.col("retrieved"), F.col("relevant")
    return results.withColumns({f"hit_{k}": M.hit(r, rel, k) for k in ks} | {f"recall_{k}": M.recall(r, rel, k) for k in ks} | {"rr": M.reciprocal_rank(r, rel), "answerable": F.size(rel) > 0})


def summary(results: DataFrame, ks=KS) -> DataFrame:
    """One row: means over answerable cases only; the separation is of the rounded means, null unless both halves exist."""
    d = case_metrics(results, ks)
    of = lambda c, yes=True: F.round(F.avg(F.when(F.col("answerable") == yes, F.col(c))), 3)
    s = d.agg(
        F.count("*").alias("cases"),
        F.count_if("answerable").alias("answerable"),
        F.count_if(~F.col("answerable")).alias("unanswerable"),
        *[of(f"{m}_{k}").alias(f"{m}_{k}") for k in ks for m in ("hit", "recall")],
        of("rr").alias("mrr"),
        of("top_score").alias("top_answerable"),
        of("top_score", False).alias("top_unanswerable"),
    )
    return s.withColumn("separation", F.round(F.col("top_answerable") - F.col("top_unanswerable"), 3))


def floor_percentile(values: Column, p: float) -> Column:
    """The value at index floor(p * n) of the sorted array, the last at most; 0.0 of none."""
    n = F.size(values)
    at = F.least(n, F.floor(F.lit(p) * n).cast("int") + 1)
    return F.when(n > 0, F.element_at(F.array_sort(values), at)).otherwise(0.0)


#: States of a selection up to which they go to every task; with more, rows are dealt out by group and salt.
STATES_SENT, SALTS = 100_000, 16


def order_key(value: Column, kind: str) -> Column:
    """A long that sorts as the value does: whole numbers as they are, others by the bits of their double, those below zero turned round."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("long")
    if kind not in ("float", "double"):
        raise ValueError(f"no order key for values of type {kind}")
    # adding zero makes the negative zero positive
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _near(rows: DataFrame, states: DataFrame) -> DataFrame:
    """rows joined with the states of their group: by broadcast up to STATES_SENT, else with a group's rows dealt to SALTS tasks."""
    if states.count() <= STATES_SENT:
        return rows.join(F.broadcast(states), "_g")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS))).join(states.withColumn("_salt", every), ["_g", "_salt"]).drop("_salt")


#: Rows of a group up to which it is sorted; larger ones go through the radix selection.
SORTED_ROWS = 1 << 16


def selected(df: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, n, low, high, name...): for each name the value at an index of the group's sorted values, a function of their number n, counted from 0.

    Groups of at most SORTED_ROWS rows are sorted, all in one shuffle; larger ones, of which there are few, go through ``_radix_selected``, so that no large group is
    sorted or met by one task. Null values take no part; a null group is a group.
    """
    kind = dict(df.dtypes)[value]
    order_key(F.col(value), kind)  # refuses other kinds
    # adding zero makes the negative zero positive
    own = F.col(value) + F.lit(0.0).cast(kind) if kind in ("float", "double") else F.col(value)
    rows = checkpointed(df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), own.alias("_v")))
    large = checkpointed(rows.groupBy("g").count().filter(F.col("count") > SORTED_ROWS).select(F.col("g").alias("_large")))
    some, large = not large.isEmpty(), F.broadcast(large)
    same = F.col("g").eqNullSafe(F.col("_large"))
    small = rows.join(large, same, "left_anti") if some else rows
    every = Window.partitionBy("g")
    small = small.withColumn("_k", F.row_number().over(every.orderBy("_v")) - 1).withColumn("n", F.count("*").over(every))
    at = {name: place(F.col("n")).cast("long") for name, place in places.items()}
    ends = [F.col("_k") == 0, F.col("_k") == F.col("n") - 1]
    small = small.filter(functools.reduce(Column.__or__, [*ends, *(F.col("_k") == k for k in at.values())]))
    picked = {"low": ends[0], "high": ends[1]} | {name: F.col("_k") == k for name, k in at.items()}
    found = checkpointed(small.groupBy("g").agg(F.min("n").alias("n"), *[F.min(F.when(at, F.col("_v"))).alias(name) for name, at in picked.items()]))
    if some:
        found = found.unionByName(_radix_selected(rows.join(large, same, "left_semi"), kind, places))
    return found.select(F.col("g").alias(group), "n", "low", "high", *places)


def _radix_selected(rows: DataFrame, kind: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """What ``selected`` gives for rows (g, _v) of large groups, by multi-group radix selection.

    Equal values are counted, and four rounds find the value's 64 sortable bits, sixteen at a time, from a histogram of the
    digits that come next. So no group is sorted or met by one task, however large; a round's windows see 65,536 digits at most.
    """
    counts = rows.groupBy(F.struct("g").alias("_g"), "_v").agg(F.count("*").alias("_c"))
    counts = checkpointed(counts.withColumn("_key", order_key(F.col("_v"), kind)))
    sizes = checkpointed(counts.groupBy("_g").agg(F.sum("_c").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")))
    targets = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), places[name](F.col("n")).cast("long").alias("rank")) for name in places])).alias("t")
    states = sizes.select("_g", targets).select("_g", "t.name", "t.rank", F.lit(0).cast("long").alias("_prefix"))
    whole = Window.partitionBy("_g", "name").orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0)
    for shift in (48, 32, 16, 0):
        near = _near(counts, states)
        if shift < 48:
            near = near.filter(F.shiftright("_key", shift + 16) == F.col("_prefix"))
        histogram = near.groupBy("_g", "name", "rank", F.shiftright("_key", shift).alias("_digits")).agg(F.sum("_c").alias("_c"))
        upto = histogram.withColumn("_upto", F.sum("_c").over(whole)).filter((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_c") <= F.col("rank")))
        states = checkpointed(upto.select("_g", "name", (F.col("rank") - F.col("_upto") + F.col("_c")).alias("rank"), F.col("_digits").alias("_prefix")))
    values = _near(counts, states).filter(F.col("_key") == F.col("_prefix")).groupBy("_g").agg(*[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in places])
    return sizes.join(values, "_g").select("_g.g", "n", "low", "high", *places)


def floor_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, name...) with the value at index floor(share * n) of each group's sorted values, the last at most."""
    at = lambda p: lambda n: F.least(F.floor(F.lit(p) * n), n - 1)
    return selected(df, group, value, {name: at(p) for name, p in shares.items()}).select(group, *shares)


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, low, median, high): the median is the value at index n // 2 of the sorted values."""
    return selected(df, group, value, {"median": lambda n: F.floor(n / 2)}).select(group, "n", "low", "median", "high")


def most_common(df: DataFrame, column: str, order: str, limit: int) -> DataFrame:
    """(column, n): the commonest values, of equal ones the first seen by order."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("_at"))
    return counts.orderBy(F.desc("n"), "_at").limit(limit).drop("_at")


def component_summary(runs: DataFrame, retrieval: float = 0.67, span: float = 0.18, divisor: float = 0.05, share: float = 0.6) -> DataFrame:
    """One row about what holds confidence down, from runs (top_score, margin) that reached the judge.

    Least, middle (at index n // 2) and greatest of both components, how often the margin was the lower one, and whether in more than
    ``share`` of the runs, so that confidence is little else than the margin.
    """
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    top, margin = F.coalesce("top_score", F.lit(0.0)), F.coalesce("margin", F.lit(0.0))
    d = runs.select(F.lit(1).alias("_g"), part((top - retrieval) / span).alias("r"), part(margin / divisor).alias("m"))
    both = None
    for name in ("r", "m"):
        m = upper_median(d, "_g", name).select("_g", *[F.round(c, 6).alias(f"{'retrieval' if name == 'r' else 'margin'}_{c}") for c in ("low", "median", "high")])
        both = m if both is None else both.join(m, "_g")
    bound = d.groupBy("_g").agg(F.count("*").alias("judged"), F.count_if(F.col("m") < F.col("r")).alias("margin_binds"))
    return bound.join(both, "_g").withColumn("margin_dominates", F.col("margin_binds") > F.col("judged") * share).drop("_g")


def threshold_sweep(decisions: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, filed, filed_exact, held_exact) from decisions (confidence, exact): one pass for all thresholds."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    d = decisions.select("confidence", "exact", t)
    above = F.col("confidence") >= F.col("threshold")
    return d.groupBy("threshold").agg(F.count_if(above).alias("filed"), F.count_if(above & F.col("exact")).alias("filed_exact"), F.count_if(~above & F.col("exact")).alias("held_exact"))


def route_calibration(decisions: DataFrame) -> DataFrame:
    """decisions (route, got, want)."""
    got, want = F.col("got"), F.col("want")
    d = decisions.select("route", M.decision_precision(got, want).alias("p"), M.decision_recall(got, want).alias("r"), M.exact(got, want).alias("e"))
    return d.groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("p"), 3).alias("precision"), F.round(F.avg("r"), 3).alias("recall"), F.count_if("e").alias("exact"))
