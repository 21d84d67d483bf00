"""Retrieval for many queries in one job: exact vector top-k, keyword rank, rank fusion, diversity reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.functions import vector
from quillspark.functions.batches import parts
from quillspark.functions.stem import stem

RRF_K = 60
#: Bytes of query vectors that go along with a pass over the chunks, and queries that are scored together.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 512
#: Rows of results that a task holds in a pass over the chunks: queries times k.
RESULT_ROWS = 1 << 19
#: Positions of terms that are looked at together, and distinct words whose stems a task remembers.
PART_TERMS, WORDS_KEPT = 1 << 18, 500_000
#: Query terms that are sent to every task, in a pass or in a join; with more, both sides of a join are dealt out by term and salt.
TERMS_SENT, SALTS = 200_000, 16


def vector_topk(chunks: DataFrame, query: list[float], k: int, key: str = "ref", condition: Column | None = None) -> DataFrame:
    """(key, similarity) of the k nearest to one vector; rows without a vector take no part."""
    rows = chunks.filter("embedding is not null")
    rows = rows if condition is None else rows.filter(condition)
    q = F.lit([float(x) for x in query])
    return rows.select(key, F.round(vector.cosine(F.col("embedding"), q), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def _passes(queries: DataFrame, k: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(ids, vectors) of as many queries at a time as QUERY_BYTES hold, and RESULT_ROWS hold k rows of."""
    held, n = [], 0
    for r in queries.toLocalIterator():
        held.append(r)
        n += 8 * (len(r[1]) + 1)
        if n >= QUERY_BYTES or len(held) * k >= RESULT_ROWS:
            yield np.array([x[0] for x in held]), [np.array(x[1], float) for x in held]
            held, n = [], 0
    if held:
        yield np.array([x[0] for x in held]), [np.array(x[1], float) for x in held]


def _largest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, ties to the smaller column, without a sort of the rows."""
    k = min(k, scores.shape[1])
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    row, column = np.nonzero(scores >= least)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


class RunningTop:
    """The k best rows of each query over all batches of a task, ties to the smaller key; so k rows a query leave the task at most."""

    def __init__(self, k: int, key: str, score: str):
        self.k, self.names, self.parts, self.held, self.least = k, ("query_id", key, score), [], 0, 0

    def add(self, query: np.ndarray, keys: list | np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.parts.append(pd.DataFrame(dict(zip(self.names, (query, keys, score), strict=True))))
            self.held += len(query)
        if self.held > max(2 * self.least, 1 << 18):
            self._shrink()

    def _shrink(self) -> None:
        query, key, score = self.names
        best = pd.concat(self.parts, ignore_index=True).sort_values([query, score, key], ascending=[True, False, True], kind="stable")
        best = best[best.groupby(query).cumcount() < self.k]
        self.parts, self.held, self.least = [best], len(best), len(best)

    def batch(self, key_type: pa.DataType, score_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._shrink()
            best = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(best[n], t) for n, t in zip(self.names, (pa.int64(), key_type, score_type), strict=True)], list(self.names))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a column of vectors for each length that occurs; components that are null or no number count as nothing."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)]


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def vector_topk_many(chunks: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(query_id, key, similarity, rank) for queries (query_id, embedding) against chunks (key, embedding).

    Query vectors go along with the tasks, QUERY_BYTES of them a pass over the chunks; every task keeps its k best for
    each query over all its batches, which are merged by a window. Of vectors of unequal length the product is over the shorter length and the norms
    are of the whole vectors; null components count as nothing.
    """
    found, kind = None, dict(chunks.dtypes)[key]
    for ids, vectors in _passes(queries.select("query_id", "embedding").filter("embedding is not null"), k):
        lists = pa.array(vectors, pa.list_(pa.float64()))
        asked = [(ids[rows], unit_rows(q)) for rows, q in by_length(lists)]

        def near(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            top, key_type = RunningTop(k, key, "similarity"), None
            for b in batches:
                key_type, keys = b.schema.field(key).type, b.column(key).to_numpy(zero_copy_only=False)
                for rows, x in by_length(b.column("embedding")):
                    rows = rows[np.argsort(keys[rows], kind="stable")] if len(rows) < b.num_rows else np.argsort(keys, kind="stable")
                    x = unit_rows(x if len(rows) < b.num_rows else x[rows])
                    for own, q in asked:
                        n = min(q.shape[1], x.shape[1])
                        for lo in range(0, len(own), QUERY_BLOCK):
                            s = np.round(q[lo : lo + QUERY_BLOCK, :n] @ x[:, :n].T, 6) + 0.0
                            row, best = _largest(s, k)
                            top.add(own[lo + row], keys[rows[best]], s[row, best])
            yield from top.batch(key_type, pa.float64())

        part = chunks.filter("embedding is not null").select(key, "embedding").mapInArrow(near, f"query_id long, {key} {kind}, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], f"query_id long, {key} {kind}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def term_runs(batches: Iterator[pa.RecordBatch], of: Callable[[str], str]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of parts of batches with _tokens: the part, its different (stemmed) terms, and sorted by row, term and place each position's; and where a row's term begins."""
    known: dict[str, str] = {}
    for b in parts(batches, "_tokens", PART_TERMS):
        lists = b.column("_tokens")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if not sizes.sum():
            continue
        row = np.repeat(np.arange(b.num_rows), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        words = lists.flatten().dictionary_encode()
        if len(known) > WORDS_KEPT:
            known.clear()
        stems = pa.array([known[w] if w in known else known.setdefault(w, of(w)) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
        term = stems.indices.to_numpy()[words.indices.to_numpy()]
        # a stable sort keeps the order of places
        order = np.argsort(row * len(stems.dictionary) + term, kind="stable")
        row, term, place = row[order], term[order], place[order]
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
        yield b, stems.dictionary, row, term, place, first


def token_index(chunks: DataFrame, key: str, tokens: str = "tokens", stems: bool = True) -> DataFrame:
    """(key, term, n): an inverted index to write once and search often; n positions of the chunk have the (stemmed) term.

    A chunk's terms are counted where it lies, and a word is stemmed once by a task; only the counts are shuffled, to add up those of
    rows that share a key. Null tokens are no terms.
    """
    of, kind = stem if stems else (lambda w: w), dict(chunks.dtypes)[key]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, terms, row, term, _, first in term_runs(batches, of):
            n = np.diff(np.append(first, len(row)))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row[first])), terms.take(pa.array(term[first])), pa.array(n)], [key, "term", "n"])

    own = chunks.select(key, F.array_compact(tokens).alias("_tokens")).mapInArrow(counted, f"{key} {kind}, term string, n long")
    return own.groupBy(key, "term").agg(F.sum("n").alias("n"))


def index_search(index: DataFrame, queries: DataFrame, k: int, key: str, terms: str = "terms", stems: bool = True) -> DataFrame:
    """(query_id, key, matches, rank): chunks of a token index by the number of positions that match any term, for queries (query_id, terms).

    Nothing is compared that shares no term, and no pair of query and chunk is shuffled (``term_sums``).
    """
    found = term_sums(index, F.col("n"), queries, key, k, terms, stems)
    w = Window.partitionBy("query_id").orderBy(F.desc("matches"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _asked(queries: DataFrame, terms: str) -> Iterator[tuple[list, list[list[str]]]]:
    """(ids, terms) of as many queries at a time as have TERMS_SENT terms."""
    ids, words, n = [], [], 0
    for r in queries.select("query_id", F.array_distinct(terms)).filter(F.size(terms) > 0).toLocalIterator():
        ids.append(r[0])
        words.append(r[1])
        n += len(r[1])
        if n >= TERMS_SENT:
            yield ids, words
            ids, words, n = [], [], 0
    if ids:
        yield ids, words


class _Stems(dict):
    """Number of the query term that each word stands for, -1 for none; of bounded size."""

    def __init__(self, vocabulary: dict[str, int], of: Callable[[str], str], most: int = 500_000):
        super().__init__()
        self.vocabulary, self.of, self.most = vocabulary, of, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        number = self[word] = self.vocabulary.get(self.of(word), -1)
        return number


def _query_lists(words: list[list[str]], of: Callable[[str], str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Numbers of the (stemmed) terms of some queries, and the queries that have each term: in lists from first on."""
    vocabulary: dict[str, int] = {}
    numbers = [sorted({vocabulary.setdefault(of(w), len(vocabulary)) for w in own}) for own in words]
    own = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
    flat = np.array([t for n in numbers for t in n], np.int64)
    return vocabulary, np.searchsorted(np.sort(flat), np.arange(len(vocabulary) + 1)), own[np.argsort(flat, kind="stable")]


def _matches(row: np.ndarray, term: np.ndarray, n: np.ndarray, first: np.ndarray, lists: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, sum) of all pairs that share a term, from n of each row (in order) and term, and the queries of each term (lists from first on)."""
    pairs = np.stack([row, term])
    fan = first[pairs[1] + 1] - first[pairs[1]]
    upto, i = np.cumsum(fan), 0
    while i < len(n):
        # whole rows, of so many pairs with queries
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        j = len(n) if j >= len(n) else max(int(np.searchsorted(pairs[0], pairs[0, j])), int(np.searchsorted(pairs[0], pairs[0, i], "right")))
        each = fan[i:j]
        at = np.repeat(first[pairs[1, i:j]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        query, r, times = lists[at], np.repeat(pairs[0, i:j], each), np.repeat(n[i:j], each)
        order = np.lexsort((r, query))
        query, r, times = query[order], r[order], times[order]
        new = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(r, prepend=-1) != 0))
        if len(new):
            yield query[new], r[new], np.add.reduceat(times, new)
        i = j


def _best(q: np.ndarray, r: np.ndarray, n: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each query of the largest n, ties to the row that stands first."""
    order = np.lexsort((place[r], -n, q))
    q, r, n = q[order], r[order], n[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], r[best], n[best]


def term_sums(index: DataFrame, n: Column, queries: DataFrame, key: str, k: int | None = None, terms: str = "terms", stems: bool = True) -> DataFrame:
    """(query_id, key, matches): n of an index's rows (term, key) summed over each query's terms, for the keys that have any; with k the k largest of each task.

    Query terms go along with the tasks, TERMS_SENT of them a pass. What is shuffled is numbers of asked terms by key, so a key with all its terms
    comes to one task, which looks up the queries that have them: no pair of query and key is shuffled before its sum is known.
    """
    of = stem if stems else (lambda w: w)
    found, kind, spark = None, dict(index.dtypes)[key], index.sparkSession
    for ids, words in _asked(queries, terms):
        vocabulary, first, lists = _query_lists(words, of)
        numbers = spark.createDataFrame(list(vocabulary.items()), "term string, _t int")
        own = index.select("term", key, n.cast("long").alias("_n")).join(F.broadcast(numbers), "term").groupBy(key).agg(F.collect_list(F.struct("_t", "_n")).alias("_terms"))

        def near(batches: Iterator[pa.RecordBatch], ids=np.array(ids), first=first, lists=lists) -> Iterator[pa.RecordBatch]:
            top, key_type = RunningTop(k or 0, key, "matches"), None
            for b in parts(batches, "_terms", PART_TERMS):
                key_type, found = b.schema.field(key).type, b.column("_terms")
                row = np.repeat(np.arange(b.num_rows), found.value_lengths().to_numpy(zero_copy_only=False))
                term, each = (c.to_numpy(zero_copy_only=False) for c in found.flatten().flatten())
                keys = b.column(key).to_numpy(zero_copy_only=False)
                place = np.empty(b.num_rows, np.int64)
                place[np.argsort(keys, kind="stable")] = np.arange(b.num_rows)
                for q, r, total in _matches(row, term.astype(np.int64), each, first, lists):
                    if k is None:
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), b.column(key).take(pa.array(r)), pa.array(total, pa.int64())], ["query_id", key, "matches"])
                    else:
                        q, r, total = _best(q, r, total, place, k)
                        top.add(ids[q], keys[r], total)
            yield from top.batch(key_type, pa.int64())

        part = own.mapInArrow(near, f"query_id long, {key} {kind}, matches long")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], f"query_id long, {key} {kind}, matches long") if found is None else found


def keyword_rank(chunks: DataFrame, queries: DataFrame, k: int, key: str, tokens: str = "tokens", terms: str = "terms", stems: bool = True) -> DataFrame:
    """(query_id, key, matches, rank): chunks (key, tokens) by the number of positions that match any (stemmed) term of queries (query_id, terms).

    The same rows as ``index_search`` in a ``token_index``, for a search without one: query terms go along with the tasks,
    TERMS_SENT of them a pass; a task counts the terms of its chunks, looks up which queries have them and keeps
    its k best for each query over all its batches. So no pair of chunk and query is shuffled, however common a term is, and none is looked at that shares no term.
    """
    of = stem if stems else (lambda w: w)
    found = None
    kind = dict(chunks.dtypes)[key]
    for ids, words in _asked(queries, terms):
        vocabulary, first, lists = _query_lists(words, of)

        def near(batches: Iterator[pa.RecordBatch], ids=np.array(ids), vocabulary=vocabulary, first=first, lists=lists) -> Iterator[pa.RecordBatch]:
            known, top, key_type = _Stems(vocabulary, of), RunningTop(k, key, "matches"), None
            for b in parts(batches, "_tokens", PART_TERMS):
                key_type, keys = b.schema.field(key).type, b.column(key).to_numpy(zero_copy_only=False)
                words = b.column("_tokens")
                row = np.repeat(np.arange(b.num_rows), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                encoded = words.flatten().dictionary_encode()
                if not len(row):
                    continue
                place = np.empty(b.num_rows, np.int64)
                place[np.argsort(keys, kind="stable")] = np.arange(b.num_rows)
                term = np.array([known[w] for w in encoded.dictionary.to_pylist()], np.int64)[encoded.indices.to_numpy()]
                pair, times = np.unique(row[term >= 0] * len(vocabulary) + term[term >= 0], return_counts=True)
                for q, r, n in _matches(*np.divmod(pair, len(vocabulary)), times, first, lists):
                    q, r, n = _best(q, r, n, place, k)
                    top.add(ids[q], keys[r], n)
            yield from top.batch(key_type, pa.int64())

        part = chunks.select(key, F.col(tokens).alias("_tokens")).filter(F.size("_tokens") > 0).mapInArrow(near, f"query_id long, {key} {kind}, matches long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], f"query_id long, {key} {kind}, matches long")
    w = Window.partitionBy("query_id").orderBy(F.desc("matches"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def search_view(found: DataFrame, snippet: int = 160) -> DataFrame:
    """(rank, ref, similarity, part_label, snippet) of ranked chunks (rank, ref, similarity, part, of_parts, body), best first."""
    label = F.when(F.col("of_parts") > 1, F.concat(F.lit("part "), F.col("part") + 1, F.lit(" of "), F.col("of_parts"))).otherwise("")
    flat = T.collapsed(F.col("body"))
    shown = F.when(F.length(flat) > snippet, F.concat(F.substring(flat, 1, snippet), F.lit("..."))).otherwise(flat)
    return found.select("rank", "ref", F.round("similarity", 3).alias("similarity"), label.alias("part_label"), shown.alias("snippet")).orderBy("rank", "ref")


def reciprocal_rank_fusion(rankings: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(query_id, key, fused_score) from rows (query_id, key, rank) of any number of rankers; a null key scores nothing but holds its rank."""
    return rankings.filter(F.col(key).isNotNull()).groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("fused_score"))


def hybrid(vectors: DataFrame, keywords: DataFrame, key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Both rankings fused: (query_id, key, similarity, fused_score, rank). Ties keep vector rows first, in their order."""
    both = vectors.select("query_id", key, "rank", "similarity", F.lit(0).alias("source")).unionByName(keywords.select("query_id", key, "rank", F.lit(None).cast("double").alias("similarity"), F.lit(1).alias("source")))
    fused = both.groupBy("query_id", key).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("fused_score"), F.max("similarity").alias("similarity"), F.min(F.struct("source", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "first.source", "first.rank")
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit).select("query_id", key, "similarity", "fused_score", "rank")


def mmr_order(relevance: np.ndarray, vectors: list, limit: int, lam: float = 0.7) -> list[int]:
    """Indexes in the order of maximal marginal relevance; the earliest candidate wins ties, one without vector is never redundant."""
    n = len(relevance)
    unit = []
    for v in vectors:
        v = None if v is None or not len(v) else np.asarray(v, float)
        size = 0.0 if v is None else float(np.linalg.norm(v))
        unit.append(None if v is None else v / size if size else v * 0)
    worst = np.full(n, -np.inf)
    left, chosen = list(range(n)), []
    while left and len(chosen) < limit:
        gain = [lam * relevance[i] - (1 - lam) * (0.0 if unit[i] is None or worst[i] == -np.inf else worst[i]) for i in left]
        at = left.pop(int(np.argmax(gain)))
        chosen.append(at)
        if unit[at] is not None:
            for i in left:
                if unit[i] is not None:
                    n = min(len(unit[i]), len(unit[at]))
                    worst[i] = max(worst[i], float(unit[i][:n] @ unit[at][:n]))
    return chosen


def mmr(candidates: DataFrame, key: str, limit: int, lam: float = 0.7) -> DataFrame:
    """candidates (query_id, key, relevance, embedding, rank) rerank to (query_id, key, relevance, rank). A query's pool is small by construction.

    Embeddings may be vectors or their text ("[0.1, 2]").
    """
    if dict(candidates.dtypes)["embedding"] == "string":
        candidates = candidates.withColumn("embedding", vector.as_vector(F.col("embedding")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        order = mmr_order(pdf["relevance"].fillna(0).to_numpy(), pdf["embedding"].tolist(), limit, lam)
        return pdf.loc[order, ["query_id", key, "relevance"]].assign(rank=np.arange(1, len(order) + 1))

    kind = dict(candidates.dtypes)[key]
    return candidates.groupBy("query_id").applyInPandas(one, f"query_id long, {key} {kind}, relevance double, rank long")


def retrieve(mode: str, vectors: DataFrame, keywords: DataFrame, embeddings: DataFrame, key: str, limit: int = 10, pool: int = 30, lam: float = 0.7) -> DataFrame:
    """vector, hybrid or rerank over rankings of ``pool`` rows; an unknown mode is refused before anything runs."""
    if mode not in ("vector", "hybrid", "rerank"):
        raise ValueError(f"unknown retrieval mode {mode!r}")
    if mode == "vector":
        return vectors.filter(F.col("rank") <= limit)
    if mode == "hybrid":
        return hybrid(vectors, keywords, key, limit)
    fused = hybrid(vectors, keywords, key, pool)
    top = F.max("fused_score").over(Window.partitionBy("query_id"))
    scaled = fused.withColumn("relevance", F.when(top > 0, F.col("fused_score") / top).otherwise(1.0))
    return mmr(scaled.join(embeddings, key, "left").select("query_id", key, "relevance", "embedding", "rank"), key, limit, lam)
