"""A training-corpus pipeline over ``documents``: filter, deduplicate, decontaminate, mix and write tokens.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import common, decontaminate, mixing, simhash, token_output, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the model is fitted on labelled documents that aren't held out.

    Null and empty texts are scored as texts without any sign; repeated rows stay or go together; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 0.8 of five-word shingles), that of the smallest doc_id, null last.

    Null and empty texts are one group; of rows that repeat one another one stays; an empty table stays empty.
    """
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none; repeated rows stay or go together; an empty table stays empty."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order.

    Null texts have no words and null sources are one source; rows that repeat one another share their copies; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, size and checksum of each document in the token files, which keep the training order in which docs was written.

    Null and empty texts are the end id alone, repeated rows are written each, an empty table gives no document. Workers
    remember fewer words than for the query alone, as they have run four stages.
    """
    return token_output.encoded(docs, order=token_output.written_order(), remembered=100_000)


STAGES = [("toxicity", toxic), ("simhash_dedup", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("token_output", tokens)]

#: The CRF, the fingerprints' XXH64 and the tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
