"""Providers of what only a model can give, with deterministic offline defaults, call budgets and backoff."""

from __future__ import annotations

import difflib
import inspect
import math
import random
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.validate import RATE_LIMIT, TRANSIENT
from quillspark.session import checkpointed, shared_dir


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors of signed hashed words; the same text always has the same vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


class Budget:
    """Calls that one task may make, over all its retries."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0

    def spend(self) -> None:
        if self.used >= self.limit:
            raise RuntimeError(f"call budget of {self.limit} is spent")
        self.used += 1


def delays(attempts: int, base: float = 1.0, cap: float = 60.0, seed: int = 0) -> list[float]:
    """Waiting times: doubling, up to a cap, with up to a quarter of jitter."""
    rng = random.Random(seed)
    return [min(cap, base * 2**k) * (1 + rng.random() / 4) for k in range(attempts)]


def call(fn: Callable[[], object], budget: Budget, attempts: int = 3, rate_limit_is_fatal: bool = True, wait: Callable[[float], None] = time.sleep, base: float = 1.0):
    """fn() with backoff. A permanent failure is raised at once. Where a rate limit isn't fatal it is waited out, up to four times the attempts."""
    tried = limited = 0
    pauses = delays(attempts * 5, base)
    while True:
        budget.spend()
        try:
            return fn()
        except Exception as e:
            said = f"{type(e).__name__} {e}".lower()
            if any(m in said for m in RATE_LIMIT):
                limited += 1
                if rate_limit_is_fatal or limited > 4 * attempts:
                    raise
            elif any(m in said for m in TRANSIENT):
                tried += 1
                if tried >= attempts:
                    raise
            else:
                raise
            wait(pauses[min(tried + limited, len(pauses)) - 1])


def embedded(df: DataFrame, text: str, embed: Callable | None = None, batch: int = 20, calls: int | None = None, partitions: int = 1, task_attempts: int = 1, per_minute: int | None = None, task: str = "document", wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with embedding: array<float>, embedded in batches of bounded size; embed takes texts, and the task if it asks for one.

    per_minute bounds the texts that a task sends in a minute; calls bounds the calls of all tasks together, dealt out over ``partitions`` and the
    ``task_attempts`` that a task may have. Write the result before reading it twice: a recomputed task would call again.
    """
    if task not in ("document", "query"):
        raise ValueError(f"unknown task {task!r}")
    embed = embed or hashing_embedder()
    ask = (lambda texts: embed(texts, task)) if len(inspect.signature(embed).parameters) > 1 else embed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget, sent = task_budget(calls, partitions, task_attempts), 0
        for pdf in batches:
            vectors: list = []
            for lo in range(0, len(pdf), batch):
                part = pdf[text].iloc[lo : lo + batch].tolist()
                if per_minute and sent and (sent + len(part) > per_minute):
                    wait(60.0)
                    sent = 0
                got = call(lambda part=part: ask(part), budget, rate_limit_is_fatal=False)
                sent += len(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                vectors += got
            yield pdf.assign(embedding=vectors)

    ddl = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return (df if calls is None else df.repartition(partitions)).mapInPandas(run, f"{ddl}, embedding array<float>")


def index_in_batches(chunks: DataFrame, path: str, keys: tuple[str, ...] = ("ref", "part"), rows: int = 10_000, **settings) -> int:
    """Embeds the chunks that the index at path doesn't have yet and appends them, ``rows`` or so at a time; how many batches that took.

    What is pending is found once and written in batches; each batch then reads its own folder alone. Every batch is committed before the next
    begins, so a failure loses one batch, and the next call goes on after the last commit.
    """
    spark = chunks.sparkSession
    ddl = f"{', '.join(f'`{n}` {t}' for n, t in chunks.dtypes)}, embedding array<float>"
    spark.createDataFrame([], ddl).write.mode("append").parquet(path)
    pending = checkpointed(chunks.join(spark.read.schema(ddl).parquet(path).select(*keys), list(keys), "left_anti").select(*chunks.columns))
    n = math.ceil(pending.count() / rows)
    if not n:
        return 0
    work = shared_dir(spark, "pending")
    batch = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    pending.withColumn("_batch", batch).repartition("_batch").write.partitionBy("_batch").parquet(work)
    waiting = spark.read.parquet(work)
    for k in range(n):
        embedded(waiting.filter(F.col("_batch") == k).select(*chunks.columns), "text", **settings).write.mode("append").parquet(path)
    return n


def index_stream(chunks: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("ref", "part"), **settings) -> None:
    """Embeds a stream of chunks into the index at path and returns when its input is used up.

    The stream's state remembers the keys that are embedded, and the file sink commits each micro-batch once: every chunk is read once, neither the
    index nor old chunks are read again, and a restart does at most one micro-batch over. How large that is, the source decides
    (maxFilesPerTrigger or maxBytesPerTrigger).
    """
    new = embedded(chunks.dropDuplicates(list(keys)), "text", **settings)
    q = new.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def word_diff(old: str | None, new: str | None) -> str:
    """[-removed-] [+added+] and kept words, in order."""
    a, b = (old or "").split(), (new or "").split()
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
        if op == "equal":
            out += a[i:j]
        else:
            out += [f"[-{' '.join(a[i:j])}-]"] * (j > i) + [f"[+{' '.join(b[k:m])}+]"] * (m > k)
    return " ".join(out)


def call_share(limit: int, partitions: int, number: int = 0, attempt: int = 0, attempts: int = 1) -> int:
    """Calls that one attempt of a partition may make under a cap on all of them.

    The shares of all partitions and attempts add up to the cap, so it holds whatever is retried; a partition may have no share, and an attempt
    beyond those planned for has none.
    """
    slots = max(partitions, 1) * max(attempts, 1)
    place = attempt * max(partitions, 1) + number
    return limit // slots + (place < limit % slots) if attempt < attempts and number < partitions else 0


def task_budget(limit: int | None, partitions: int, attempts: int = 1) -> Budget:
    """The budget of the running task: its attempt's share of a cap on the calls of a stage of so many partitions, no cap if limit is None.

    A stage that is computed anew has its calls anew: write what it gave before reading it twice.
    """
    from pyspark import TaskContext

    if limit is None:
        return Budget(1 << 62)
    task = TaskContext.get()
    return Budget(call_share(limit, partitions, task.partitionId(), task.attemptNumber(), attempts))
