"""Idempotent writes and statistics over document tables, as DataFrame transformations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from quillspark.session import checkpointed

#: The tables that the library keeps; keys are what ``latest_wins``, ``first_wins`` and ``replace_children`` hold unique.
TABLES = {
    "source_documents": "source string, external_id string, title string, doc_type string, published_on date, html_url string, pdf_url string, abstract string, agencies array<string>, content_hash string, first_seen_at timestamp",
    "document_sections": "document string, ref string, heading string, body string, level int, ordinal int, parent_ordinal int, char_count int, extracted_from string",
    "chunks": "corpus string, ref string, context string, body string, text string, part int, of_parts int, document string, embedding array<float>, indexed_at timestamp",
    "agent_runs": "obligation string, obligation_hash string, route string, confidence double, reason string, top_score double, margin double, model_calls long, affected array<string>, analysis string, retrieval_mode string, ran_at timestamp",
}
KEYS = {"source_documents": ("content_hash",), "document_sections": ("document", "ordinal"), "chunks": ("corpus", "ref", "part"), "agent_runs": ("obligation_hash",)}


def _files(spark: SparkSession, base: str):
    """Hadoop's file system of a path, and a function that makes paths below it."""
    jvm = spark.sparkContext._jvm
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([base.rstrip("/"), *parts]))
    return path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, base: str) -> int:
    """The last committed version of a table, 0 before the first."""
    fs, path = _files(spark, base)
    marks = fs.listStatus(path("_committed")) if fs.exists(path("_committed")) else []
    return max((int(m.getPath().getName()) for m in marks), default=0)


def commit_version(df: DataFrame, base: str) -> int:
    """Writes df as the next version of a table and commits it; the version's number.

    Readers see a version only once its mark exists, which is created in one step and by one writer: a second one that built on
    the same version fails, and whatever a failed writer left is never read. The old version stays for readers that have it open.
    """
    spark = df.sparkSession
    fs, path = _files(spark, base)
    n = current_version(spark, base) + 1
    where = f"v={n}-{uuid.uuid4().hex}"
    df.write.parquet(f"{base.rstrip('/')}/{where}")
    mark = path("_committed", str(n))
    try:
        out = fs.create(mark, False)
    except Exception as e:
        raise RuntimeError(f"version {n} of {base} was committed by another writer") from e
    out.write(bytearray(where.encode()))
    out.close()
    return n


def read_current(spark: SparkSession, base: str, ddl: str | None = None) -> DataFrame:
    """The last committed version; an empty table of ddl before the first."""
    n = current_version(spark, base)
    if not n:
        if ddl is None:
            raise ValueError(f"{base} has no version yet")
        return spark.createDataFrame([], ddl)
    where = spark.read.text(f"{base.rstrip('/')}/_committed/{n}").first()[0]
    return spark.read.parquet(f"{base.rstrip('/')}/{where}")


def init_tables(spark: SparkSession, base: str) -> None:
    """An empty first version of each of TABLES that has none; others stay as they are."""
    for name, ddl in TABLES.items():
        if not current_version(spark, f"{base}/{name}"):
            commit_version(spark.createDataFrame([], ddl), f"{base}/{name}")


def obligation_key(text: Column) -> Column:
    return F.sha2(text, 256)


def upsert_runs(now: DataFrame, new: DataFrame, stamp: str = "ran_at") -> DataFrame:
    """Decisions with the new ones: one row an obligation, by the hash of its text, the latest."""
    keyed = [d.withColumn("obligation_hash", obligation_key(F.col("obligation"))) for d in (now, new)]
    return latest_wins(*keyed, ["obligation_hash"], stamp)


def content_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key. row_number() = 1 becomes a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _first(df, keys, *[F.col(c).asc_nulls_last() for c in order])


def latest_wins(now: DataFrame, new: DataFrame, keys: list[str], stamp: str, *tie: str) -> DataFrame:
    """Upsert: of both tables the latest row of each key; rows whose key holds a null never conflict and all stay."""
    both = now.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    null = F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x)
    known = _first(both.filter(~null), keys, F.col(stamp).desc_nulls_last(), F.desc("_new"), *[F.desc(t) for t in tie])
    return known.unionByName(both.filter(null)).drop("_new")


def insert_new(incoming: DataFrame, store: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of incoming to add: one of each key that store doesn't have."""
    return first_wins(incoming, [key], *order).join(store.select(key), key, "left_anti")


def replace_children(now: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of a parent give way to its new ones."""
    return now.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def pending(parents: DataFrame, children: DataFrame, key: str, limit: int, *order: Column) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(key), key, "left_anti").orderBy(*order).limit(limit)


def section_stats(sections: DataFrame, parent: str, size: str, level: str) -> DataFrame:
    return sections.agg(
        F.count_distinct(parent).alias("documents"),
        F.count("*").alias("sections"),
        F.coalesce(F.round(F.avg(size)), F.lit(0.0)).alias("avg_chars"),
        F.coalesce(F.max(level), F.lit(0)).cast("long").alias("max_level"),
    )


def chunk_stats(chunks: DataFrame, corpus: str, text: str, parts: Column, missing: Column) -> DataFrame:
    return chunks.groupBy(corpus).agg(
        F.count("*").alias("chunks"),
        F.count_if(parts > 1).alias("split"),
        F.round(F.avg(F.length(text))).alias("avg_chars"),
        F.max(F.length(text)).cast("long").alias("max_chars"),
        F.count_if(missing).alias("unembedded"),
    )


def decision_stats(runs: DataFrame) -> DataFrame:
    """runs (route, confidence, model_calls)."""
    return runs.agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("route") == "auto_filed").alias("auto_filed"),
        F.count_if(F.col("route") == "human_review").alias("human_review"),
        F.coalesce(F.sum("model_calls"), F.lit(0)).alias("model_calls"),
        F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("avg_confidence"),
    )


def first_per_group(df: DataFrame, group: str, score: str, tie: str, limit: int) -> DataFrame:
    """The best row of each group, then the best of those."""
    return _first(df, [group], F.desc(score), F.asc(tie)).orderBy(F.desc(score), group, tie).limit(limit)


def readiness(chunks: DataFrame | None, embedding: str = "embedding") -> DataFrame:
    """(ready, message) with the number of embedded chunks; reads that one column, of which Parquet holds the lists' own levels. None stands for a table that isn't there."""
    if chunks is None:
        return _missing_answer()
    n = chunks.agg(F.count(embedding).alias("n"))
    return n.select((F.col("n") > 0).alias("ready"), F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" embedded chunks"))).otherwise("no embedded chunks").alias("message"))


def _missing_answer() -> DataFrame:
    return SparkSession.active().createDataFrame([(False, "no table of chunks")], "ready boolean, message string")


def chunks_at(spark: SparkSession, where: str) -> DataFrame | None:
    """The chunks in a folder or of a catalogue table; None if there is neither."""
    if "/" in where:
        fs, path = _files(spark, where)
        return spark.read.parquet(where) if fs.exists(path()) else None
    return spark.table(where) if spark.catalog.tableExists(where) else None


def in_bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """df as a table that ``merge_buckets`` and ``replace_in_buckets`` can change: one folder for each bucket of the keys' hash."""
    df.withColumn("bucket", in_bucket(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def _rewritten(spark: SparkSession, path: str, new: DataFrame, keys: list[str], buckets: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Rewrites the buckets that new has rows of; how many those are. Others keep their files."""
    new = checkpointed(new.withColumn("bucket", in_bucket(keys, buckets)))
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    schema = StructType([*new.drop("bucket").schema.fields, StructField("bucket", IntegerType())])
    now = spark.read.schema(schema).parquet(path).filter(F.col("bucket").isin(touched))
    # the rows are computed before their folders give way
    after = checkpointed(change(now.drop("bucket"), new.drop("bucket")).withColumn("bucket", in_bucket(keys, buckets)))
    left = {r[0] for r in after.select("bucket").distinct().collect()}
    after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    fs, at = _files(spark, path)
    for b in touched:
        if b not in left:  # nothing is left of it
            fs.delete(at(f"bucket={b}"), True)
    return len(touched)


def merge_buckets(spark: SparkSession, path: str, new: DataFrame, keys: list[str], buckets: int, stamp: str, *tie: str) -> int:
    """``latest_wins`` into a table of ``write_buckets``: only buckets that new rows fall into are read and written; how many those were. One writer a table."""
    return _rewritten(spark, path, new, keys, buckets, lambda now, own: latest_wins(now, own, keys, stamp, *tie))


def replace_in_buckets(spark: SparkSession, path: str, new: DataFrame, parent: str, buckets: int) -> int:
    """``replace_children`` in a table of ``write_buckets`` by parent: only buckets of the parents in new are read and written; how many those were. One writer a table."""
    return _rewritten(spark, path, new, [parent], buckets, lambda now, own: replace_children(now, own, parent))
