"""Bounded chunks of long texts; every piece repeats its context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillspark.functions.batches import parts
from quillspark.functions.text import SENTENCE_END

TARGET, MAXIMUM, SCRAP = 1200, 2000, 120
#: Bytes of text that are cut together.
PART_BYTES = 4 << 20
_END = re.compile(SENTENCE_END)


def _parts(pattern: str | re.Pattern, text: str) -> list[str]:
    return [p.strip() for p in re.split(pattern, text) if p.strip()]


def _packed(parts: list[str], glue: str, target: int) -> list[str]:
    """Greedy: a part starts a new piece when the open one would pass the target."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(glue) + len(p) <= target:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def pieces(text: str, target: int = TARGET, maximum: int = MAXIMUM, scrap: int = SCRAP) -> list[str]:
    """Pieces of a text that never cut a sentence. Only a single sentence may be longer than the maximum."""
    text = text.strip()
    if len(text) <= maximum:
        return [text] if text else []
    blocks = _parts(r"\n\s*\n", text)
    blocks = blocks if len(blocks) > 1 else _parts(_END, text)
    done, open_ = [], ""
    for block in blocks:
        if len(block) > maximum:
            if open_:
                done.append(open_)
            *full, open_ = _packed(_parts(_END, block), " ", target)
            done += full
        elif open_ and len(open_) + 2 + len(block) > target:
            done.append(open_)
            open_ = block
        else:
            open_ = f"{open_}\n\n{block}" if open_ else block
    if open_:
        done.append(open_)
    if len(done) > 1 and len(done[-1]) < scrap:
        tail = done.pop()
        done[-1] += "\n\n" + tail
    return done


def chunks(df: DataFrame, text: str = "text", context: str | None = None, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """df with text, body, context, part and of_parts for each piece; rows with empty text have none."""

    kept = df.drop(text)
    added = [StructField(n, StringType()) for n in ("text", "body", "context")] + [StructField(n, IntegerType()) for n in ("part", "of_parts")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "_cut_text", PART_BYTES):
            rows, bodies, contexts, numbers, counts = [], [], [], [], []
            for k, (t, c) in enumerate(zip(b.column("_cut_text"), b.column("_cut_context"), strict=True)):
                own = pieces(t.as_py() or "", target, maximum)
                rows += [k] * len(own)
                bodies += own
                contexts += [c.as_py()] * len(own)
                numbers += range(len(own))
                counts += [len(own)] * len(own)
            whole = [f"{c}\n{x}" if c else x for c, x in zip(contexts, bodies, strict=True)]
            at = pa.array(rows, pa.int64())
            columns = [b.column(k).take(at) for k in range(b.num_columns - 2)]
            columns += [pa.array(x, pa.string()) for x in (whole, bodies, contexts)] + [pa.array(x, pa.int32()) for x in (numbers, counts)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-2], *(f.name for f in added)])

    shown = F.col(context) if context else F.lit("")
    d = df.select(*[F.col(f"`{n}`") for n in kept.columns], F.col(text).alias("_cut_text"), F.coalesce(shown, F.lit("")).alias("_cut_context"))
    return d.mapInArrow(cut, StructType([*kept.schema.fields, *added]))


def section_context(title: str, ref: str, heading: str):
    """Title (90 characters), reference and heading, those that aren't empty."""
    return F.concat_ws(" — ", F.nullif(F.substring(title, 1, 90), F.lit("")), F.nullif(F.col(ref), F.lit("")), F.nullif(F.col(heading), F.lit("")))


def section_chunks(sections: DataFrame, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """(ref, document, text, body, context, part, of_parts) of sections (document, ordinal, title, ref, heading, body).

    A chunk's reference is document:ordinal:reference (x without one): stable when a document is parsed again, and no two
    documents share one.
    """
    d = sections.withColumn("_context", section_context("title", "ref", "heading"))
    d = d.select("document", F.concat_ws(":", F.col("document").cast("string"), F.col("ordinal").cast("string"), F.coalesce(F.nullif("ref", F.lit("")), F.lit("x"))).alias("ref"), "body", "_context")
    return chunks(d.withColumnRenamed("body", "_text"), "_text", "_context", target, maximum).select("ref", "document", "text", "body", "context", "part", "of_parts")


def clause_chunks(clauses: DataFrame) -> DataFrame:
    """One chunk of each clause (clause_id, policy_title, section, heading, text, retrieval_text), however long: what is cited is one unit."""
    context = F.concat_ws(" — ", "policy_title", F.coalesce("section", F.lit("")), F.coalesce("heading", F.lit("")))
    return clauses.select(F.col("clause_id").alias("ref"), F.col("retrieval_text").alias("text"), F.col("text").alias("body"), context.alias("context"), F.lit(0).alias("part"), F.lit(1).alias("of_parts"))
