"""Idempotent streaming ingest: what was seen before is never added again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def first_in_batch(key: str, order: tuple[str, ...]):
    """Of each Arrow batch the first row of every key, so that a common key is few rows by the time it is dealt out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(list(order), kind="stable", na_position="last").drop_duplicates(key) if order else pdf.drop_duplicates(key)

    return run


def first_of_new(key: str, order: tuple[str, ...], columns: list[str]):
    """The first row of a key that the state doesn't know; a known key gives none."""

    def run(_, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for pdf in pdfs:
            best = pdf if best is None else pd.concat([best, pdf], ignore_index=True)
            best = (best.sort_values(list(order), kind="stable", na_position="last") if order else best).head(1)
        state.update((True,))
        if best is not None:
            yield best[columns]

    return run


def new_keys(stream: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a stream whose key wasn't seen before; of several in a micro-batch the first by order. Rows without a key go.

    Keyed state remembers what was seen, so a micro-batch costs what its own rows cost, however much has been added before.
    """
    schema = StructType(stream.schema.fields)
    some = stream.filter(F.col(key).isNotNull()).mapInPandas(first_in_batch(key, order), schema)
    return some.groupBy(key).applyInPandasWithState(first_of_new(key, order, schema.names), schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def ingest_new(spark: SparkSession, stream: DataFrame, store: str, checkpoint: str, key: str, *order: str) -> None:
    """Appends rows with a new key to the parquet store and returns when the stream's input is used up.

    One writer a store, which belongs to its checkpoint: the state there knows the keys, and the file sink commits a micro-batch once, so one that is
    replayed after a failure adds nothing.
    """
    q = new_keys(stream, key, *order).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def first_arrivals(stream: DataFrame, key: list[str], stamp: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; state older than the delay is dropped."""
    return stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay).dropDuplicatesWithinWatermark(key)
