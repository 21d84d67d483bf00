"""Readers and writers: landed API payloads, policy files, case files with metadata rows, run reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions import metrics as M
from quillspark.functions import text as T
from quillspark.operators import evaluate, structure
from quillspark.operators.store import content_hash, first_wins
from quillspark.session import shared_dir

ITEM_DDL = "document_number string, title string, type string, abstract string, publication_date string, html_url string, pdf_url string, agencies array<struct<name: string, id: long>>"
CASE_DDL = "id string, query string, relevant array<string>, note string, verified boolean"


def from_payload(raw: DataFrame, source: str, payload: str = "value") -> DataFrame:
    """Source documents from one JSON item a row; rows without a document number go, unknown dates are null."""
    d = raw.withColumn("i", F.from_json(payload, ITEM_DDL)).filter("i.document_number is not null")
    d = d.select(
        *[c for c in raw.columns if c != payload],
        F.lit(source).alias("source"),
        F.col("i.document_number").alias("external_id"),
        F.coalesce(F.nullif(F.col("i.title"), F.lit("")), F.lit("(untitled)")).alias("title"),
        F.col("i.type").alias("doc_type"),
        F.col("i.abstract").alias("abstract"),
        T.strict_date(F.col("i.publication_date")).alias("published_on"),
        F.col("i.html_url").alias("html_url"),
        F.col("i.pdf_url").alias("pdf_url"),
        F.coalesce(F.filter(F.transform("i.agencies", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), F.array().cast("array<string>")).alias("agencies"),
    )
    return d.withColumn("content_hash", content_hash("source", "external_id", "title"))


def fetched(payloads: DataFrame, source: str) -> DataFrame:
    """Documents of a fetch over several terms, payloads (term_ix, pos, value): the first appearance of each external_id stays."""
    return first_wins(from_payload(payloads, source), ["external_id"], "term_ix", "pos")


def term_source(terms: list[str], get: Callable[[str], list[str]]) -> type[DataSource]:
    """A data source of (term_ix, pos, value, error): a partition a term, what get returns for it in order; a term that fails or finds nothing is one row without a value."""

    class Terms(DataSource):
        @classmethod
        def name(cls) -> str:
            return "terms"

        def schema(self) -> str:
            return "term_ix int, pos int, value string, error string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition((ix, term)) for ix, term in enumerate(terms)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            ix, term = partition.value
            try:
                found = [(ix, pos, value, None) for pos, value in enumerate(get(term))]
            except Exception as e:
                found = [(ix, -1, None, f"{type(e).__name__}: {e}")]
            yield from found or [(ix, -1, None, None)]

    return Terms


def fetch(spark: SparkSession, terms: list[str], get: Callable[[str], list[str]]) -> DataFrame:
    """(term_ix, pos, value) of the items that get returns for each term. A term may fail; if all do, the first error is raised.

    Every term is a partition of a data source, whose rows go from the executors to a landing table in the shared folder: they are fetched once, however
    often they are read, and none passes through the driver.
    """
    if not terms:
        return spark.createDataFrame([], "term_ix int, pos int, value string")
    spark.dataSource.register(term_source(terms, get))
    path = shared_dir(spark, "fetched")
    spark.read.format("terms").load().write.parquet(path)
    landed = spark.read.parquet(path)
    failed = landed.filter("error is not null")
    if failed.count() == len(terms):
        raise RuntimeError(f"all {len(terms)} terms failed, first: {failed.orderBy('term_ix').first()['error']}")
    return landed.filter("pos >= 0").select("term_ix", "pos", "value")


def policies(spark: SparkSession, path: str) -> DataFrame:
    """Clauses of all policy files, in the order of policy and clause number.

    A file without front matter, or without id, title, owner or domain in it, is an error, and so is a repeated clause id.
    """
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    problems = structure.policy_problems(files).limit(5).collect()
    if problems:
        raise ValueError("; ".join(f"{r['path']}: {r['problem']}" for r in problems))
    clauses = structure.policy_clauses(files)
    twice = clauses.groupBy("clause_id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated clause ids: {[r['clause_id'] for r in twice]}")
    return clauses.orderBy("policy_id", structure.clause_order(F.col("ref")))


def is_metadata(line: Column) -> Column:
    """Whether a JSON object has only keys that begin with an underscore (or none)."""
    keys = F.json_object_keys(line)
    return F.forall(keys, lambda k: F.startswith(k, F.lit("_")))


def cases(lines: DataFrame, value: str = "value") -> DataFrame:
    """Cases from JSON lines; blank lines and metadata rows are skipped."""
    rows = lines.filter(T.strip(F.col(value)) != "").filter(~F.coalesce(is_metadata(F.col(value)), F.lit(False)))
    d = rows.select(F.from_json(value, CASE_DDL).alias("c")).select("c.*")
    return d.withColumns({"note": F.coalesce("note", F.lit("")), "verified": F.coalesce("verified", F.lit(False))})


def exported(drafts: DataFrame) -> DataFrame:
    """Labelled rows for a golden set: judged and verified ones, without their candidates.

    drafts has (id, query, relevant, verified, modality, obliged_party, source_ref, source_document); the note is built from the last four.
    """
    note = F.format_string("%s obligation on %s, %s of %s", "modality", "obliged_party", "source_ref", "source_document")
    return drafts.filter("relevant is not null and verified").select("id", "query", "relevant", note.alias("note"), "verified")


def merged(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Both sets with where each row came from."""
    return left.withColumn("provenance", F.lit(names[0])).unionByName(right.withColumn("provenance", F.lit(names[1])))


def merged_lines(left: DataFrame, right: DataFrame, names: tuple[str, str], about: dict[str, str]) -> DataFrame:
    """(place, value): a case file as JSON lines, one metadata row on top, then left and right, each by id."""
    head = left.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit("").alias("id"), F.to_json(F.struct(*[F.lit(v).alias(f"_{k}") for k, v in about.items()])).alias("value"))
    both = merged(left, right, names)
    line = F.to_json(F.struct(*both.columns))
    rows = both.select(F.when(F.col("provenance") == names[0], 1).otherwise(2).alias("place"), "id", line.alias("value"))
    return head.unionByName(rows).orderBy("place", "id").select("place", "value")


def with_drafts(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Drafts so far and new ones whose key isn't among them, as external_id, so that no document is drafted again; columns that one side lacks are null."""
    return existing.unionByName(new.join(existing.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def report(results: DataFrame, label: str, run_at: str, config: dict[str, str] | None = None) -> DataFrame:
    """(place, value): a scored run as JSON lines: one row about the run with its summary, then one a case, by id.

    results has (id, retrieved, relevant, top_score, verified). A case states its ten best, its first hit, what was missed, and rounded scores.
    """
    retrieved, relevant = F.col("retrieved"), F.col("relevant")
    summary = evaluate.summary(results)
    settings = F.to_json(F.create_map(*[F.lit(x) for pair in sorted((config or {}).items()) for x in pair])) if config else F.lit("{}")
    about = F.struct(F.lit(label).alias("label"), F.lit(run_at).alias("run_at"), settings.alias("config"), F.struct(*summary.columns).alias("summary"))
    head = summary.select(F.lit(0).alias("place"), F.lit("").alias("id"), F.to_json(about).alias("value"))
    case = F.struct(
        "id", "verified", "relevant", F.slice(retrieved, 1, 10).alias("retrieved"), M.first_hit_rank(retrieved, relevant).alias("first_hit_rank"),
        M.missed(retrieved, relevant).alias("missed"), F.round("top_score", 3).alias("top_score"), F.round(M.recall(retrieved, relevant, 10), 3).alias("recall_10"),
    )
    rows = results.select(F.lit(1).alias("place"), F.col("id").cast("string").alias("id"), F.to_json(case).alias("value"))
    return head.unionByName(rows).orderBy("place", "id").select("place", "value")
