"""The library's query catalogue: name -> query, name -> SQL for the same rows.

A query builds its rows through the operators; the SQL says the same plainly. Where SQL cannot say it (parsers, packing,
greedy reranking, diffs, retries), the tests hold the query against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import metrics as M
from quillspark.functions import text as T
from quillspark.functions import vector
from quillspark.functions.stem import stem_sql, stemmed
from quillspark.operators import cells, chunking, decide, evaluate, inverted, providers, retrieval, review, store, structure, validate
from quillspark.session import shared_dir, table
from quillspark.sources import documents as docs_io
from quillspark.streaming import ingest

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(oracle: str | None = None):
    def add(f):
        _FOUND[f.__name__] = (f, oracle)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _FOUND.items() if sql}


# --- vectors -----------------------------------------------------------------

_COSINE = "round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def _vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    r = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(r[0]) if r else []


@_query(f"SELECT c.vec_id, {_COSINE} AS similarity FROM embeddings c, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE c.embedding IS NOT NULL ORDER BY similarity DESC, c.vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return retrieval.vector_topk(table(spark, sf_dir, "embeddings"), _vector_of(spark, sf_dir, 0), 10, "vec_id")


@_query(f"SELECT c.vec_id, {_COSINE} AS similarity FROM embeddings c, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE c.embedding IS NOT NULL AND c.label = 3 ORDER BY similarity DESC, c.vec_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return retrieval.vector_topk(table(spark, sf_dir, "embeddings"), _vector_of(spark, sf_dir, 0), 10, "vec_id", F.col("label") == 3)


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_TOPK = f"""
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_COSINE} AS similarity FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 30)
"""


@_query(f"WITH {_TOPK} SELECT query_id, vec_id, similarity, rank FROM v WHERE rank <= 10")
def vector_topk_multi(spark, sf_dir):
    return retrieval.vector_topk_many(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 10)


@_query(f"WITH {_TOPK} SELECT query_id, vec_id, similarity, rank FROM v WHERE rank <= 10")
def vector_cells(spark, sf_dir):
    """Nearest vectors from an index by cells, all of which are opened, so that the rows are those of a scan; tests measure smaller shares."""
    path = shared_dir(spark, "cells")
    cells.write_cells(table(spark, sf_dir, "embeddings"), path, "vec_id")
    return cells.cell_search(spark, path, _asked(spark, sf_dir), 10, "vec_id", share=1.0)


# --- state -------------------------------------------------------------------


def _hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))


@_query("SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents GROUP BY 2")
def content_hash_dedup(spark, sf_dir):
    return store.first_wins(_hashed(spark, sf_dir).select("doc_id", "content_hash"), ["content_hash"], "doc_id")


@_query("""
WITH h AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS content_hash FROM documents)
SELECT min(doc_id) AS doc_id, content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE source = 'src0') GROUP BY content_hash""")
def insert_if_new(spark, sf_dir):
    h = _hashed(spark, sf_dir).select("doc_id", "source", "content_hash")
    return store.insert_new(h.drop("source"), h.filter("source = 'src0'"), "content_hash", "doc_id")


@_query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def first_seen_wins(spark, sf_dir):
    return store.first_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@_query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50")
def pending_work(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return store.pending(d, table(spark, sf_dir, "labels"), "doc_id", 50, F.col("n_chars").desc_nulls_last(), F.col("doc_id"))


@_query("""
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return store.latest_wins(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@_query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2 FROM lineitem WHERE l_returnflag = 'R'""")
def replace_partition(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    new = li.filter("l_returnflag = 'R'").withColumn("l_quantity", F.col("l_quantity") * 2)
    return store.replace_children(li.drop("l_returnflag"), new.drop("l_returnflag"), "l_orderkey")


_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, len(regexp_extract_all(line, '[;:]')) AS level FROM documents)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


@_query(f"WITH {_LINES} SELECT count(DISTINCT doc_id) AS documents, count(*) AS sections, coalesce(round(avg(length(line))), 0) AS avg_chars, coalesce(max(level), 0)::BIGINT AS max_level FROM l")
def section_stats(spark, sf_dir):
    """Lines as sections, marks inside them as their levels."""
    s = _lines(spark, sf_dir).select("doc_id", F.length("line").alias("chars"), F.regexp_count("line", F.lit("[;:]")).alias("level"))
    return store.section_stats(s, "doc_id", "chars", "level")


@_query("""
SELECT lang, count(*) AS chunks, count(*) FILTER (length(text) > 2000) AS split, round(avg(length(text))) AS avg_chars, max(length(text))::BIGINT AS max_chars, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unembedded
FROM documents GROUP BY lang""")
def chunk_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l")).distinct(), F.col("doc_id") == F.col("l"), "left")
    return store.chunk_stats(d, "lang", "text", F.when(F.length("text") > 2000, 2).otherwise(1), F.col("l").isNull())


def _runs(spark, sf_dir):
    c = F.round(F.col("value") / 100, 3)
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(c >= 0.6, "auto_filed").otherwise("human_review").alias("route"), c.alias("confidence"), (F.col("event_id") % 4).alias("model_calls"))


@_query("""
WITH r AS (SELECT round(value / 100, 3) AS c, event_id % 4 AS k FROM events)
SELECT count(*) AS runs, count(*) FILTER (c >= 0.6) AS auto_filed, count(*) FILTER (c < 0.6) AS human_review, coalesce(sum(k), 0)::BIGINT AS model_calls, coalesce(round(avg(c), 3), 0) AS avg_confidence FROM r""")
def decision_stats(spark, sf_dir):
    return store.decision_stats(_runs(spark, sf_dir))


@_query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@_query(f"""
WITH {_LINES}, d AS (SELECT doc_id, line, length(line) - length(replace(lower(line), 'the', '')) AS density FROM l WHERE length(line) BETWEEN 30 AND 4000),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY density DESC, line) AS rn FROM d)
SELECT doc_id, line, density::BIGINT AS density FROM b WHERE rn = 1 ORDER BY density DESC, doc_id, line LIMIT 40""")
def distinct_on_density(spark, sf_dir):
    d = _lines(spark, sf_dir).filter(F.length("line").between(30, 4000)).select("doc_id", "line", T.term_density(F.col("line"), "the").cast("long").alias("density"))
    return store.first_per_group(d, "doc_id", "density", "line", 40)


@_query("""
SELECT c_custkey, count(o_orderkey) AS orders, count(*) FILTER (o_totalprice > 100000) AS large, count(*) FILTER (o_orderstatus = 'F') AS closed
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def document_inventory(spark, sf_dir):
    j = table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, min(event_id) LIMIT 3")
def most_common(spark, sf_dir):
    return evaluate.most_common(table(spark, sf_dir, "events"), "event_type", "event_id", 3)


@_query("SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS low, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS median, max(o_totalprice) AS high FROM orders GROUP BY o_orderstatus")
def upper_median(spark, sf_dir):
    return evaluate.upper_median(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")


# --- text and keyword retrieval ----------------------------------------------

_NOISE_SQL = ", ".join(f"'{w}'" for w in T.NOISE)
_TERMS_SQL = f"""
w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}'), 1) AS i FROM benchmark),
f AS (SELECT item_id, w, min(i) AS i FROM w WHERE w NOT IN ({_NOISE_SQL}) GROUP BY ALL),
t AS (SELECT item_id, w, i, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM f QUALIFY k <= 40)
"""


@_query(f"WITH {_TERMS_SQL} SELECT b.item_id, coalesce(string_agg(w, ' | ' ORDER BY i), '') AS query FROM benchmark b LEFT JOIN t USING (item_id) GROUP BY b.item_id")
def or_query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.or_terms(F.col("text")), " | ").alias("query"))


@_query(f"SELECT w AS word, stem FROM {stem_sql("(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')) AS w FROM documents)", 'w')}")
def porter_stems(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return stemmed(words, "word", "stem")


def _keyword(spark, sf_dir, k):
    chunks = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.or_terms(F.col("text")).alias("terms"))
    return retrieval.keyword_rank(chunks, asked, k, "doc_id")


_KEYWORD = f"""
{_TERMS_SQL},
x0 AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}')) AS w FROM documents) GROUP BY ALL),
sw AS (SELECT w, stem FROM {stem_sql('(SELECT w FROM x0 UNION SELECT w FROM t)', 'w')}),
x AS (SELECT doc_id, stem, sum(n) AS n FROM x0 JOIN sw USING (w) GROUP BY ALL),
ts AS (SELECT DISTINCT item_id, stem FROM t JOIN sw USING (w)),
m AS (SELECT item_id AS query_id, doc_id, sum(n)::BIGINT AS matches FROM x JOIN ts USING (stem) GROUP BY ALL),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, doc_id) AS rank FROM m QUALIFY rank <= 30)
"""


@_query(f"WITH {_KEYWORD} SELECT doc_id, stem AS term, n::BIGINT AS n FROM x")
def token_index(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return retrieval.token_index(chunks, "doc_id")


@_query(f"WITH {_KEYWORD} SELECT query_id, doc_id, matches, rank FROM kw")
def keyword_rank(spark, sf_dir):
    return _keyword(spark, sf_dir, 30)


@_query(f"WITH {_KEYWORD} SELECT query_id, doc_id, matches, rank FROM kw WHERE rank <= 10")
def block_search(spark, sf_dir):
    """The ten best by matching positions from an index of blocks of 64 documents, without the blocks whose bounds are too low."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    path = shared_dir(spark, "blocks")
    inverted.write_blocks(retrieval.token_index(chunks, "doc_id"), path, "doc_id", F.expr("doc_id div 64"))
    return inverted.block_search(spark, path, _benchmark_terms(spark, sf_dir), 10, "doc_id")


def _benchmark_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.or_terms(F.col("text")).alias("terms"))


def _positions(spark, sf_dir):
    return inverted.positions_index(table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens")), "doc_id")


_POSITIONS = f"""
{_KEYWORD},
pw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}'), 1) AS i FROM documents),
ps AS (SELECT doc_id, i, stem FROM pw JOIN sw USING (w))
"""


@_query(f"WITH {_POSITIONS} SELECT doc_id, stem AS term, count(*) AS n, min(i)::BIGINT AS first, max(i)::BIGINT AS last, sum(i)::BIGINT AS total FROM ps GROUP BY ALL")
def position_index(spark, sf_dir):
    """Where stems stand, told by their number, first, last and sum."""
    at = F.col("positions")
    total = F.aggregate(at, F.lit(0).cast("long"), lambda s, x: s + x)
    return _positions(spark, sf_dir).select("doc_id", "term", F.size(at).cast("long").alias("n"), F.element_at(at, 1).cast("long").alias("first"), F.element_at(at, -1).cast("long").alias("last"), total.alias("total"))


@_query(f"WITH {_KEYWORD} SELECT query_id, doc_id, matches AS covers, round(0.1::DOUBLE * matches, 9) AS score, rank FROM kw WHERE rank <= 10")
def cover_density(spark, sf_dir):
    """Any term is enough: every position is a cover."""
    return inverted.cover_density(_positions(spark, sf_dir), _benchmark_terms(spark, sf_dir), 10, "doc_id")


# a cover ends at each event and begins at the earliest of the terms' last events; it is minimal if none before began there
@_query(f"""
WITH {_POSITIONS},
a AS (SELECT DISTINCT item_id AS query_id, stem FROM t JOIN sw USING (w) WHERE t.k <= 3),
e AS (SELECT query_id, doc_id, i, stem FROM ps JOIN a USING (stem)),
am AS (SELECT query_id, count(*) AS m FROM a GROUP BY ALL),
en AS (SELECT query_id, doc_id, count(DISTINCT stem) AS n FROM e GROUP BY ALL),
fd AS (SELECT en.query_id, doc_id FROM en JOIN am ON am.query_id = en.query_id AND n = m),
ev AS (SELECT e.*, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY i) AS x FROM e JOIN fd USING (query_id, doc_id)),
l AS (SELECT ev.query_id, doc_id, i, x, max(CASE WHEN ev.stem = a.stem THEN i END) OVER (PARTITION BY ev.query_id, doc_id, a.stem ORDER BY x) AS last_i,
  max(CASE WHEN ev.stem = a.stem THEN x END) OVER (PARTITION BY ev.query_id, doc_id, a.stem ORDER BY x) AS last_x FROM ev JOIN a ON a.query_id = ev.query_id),
b AS (SELECT query_id, doc_id, i, x, min(last_i) AS b, min(last_x) AS bx FROM l GROUP BY ALL HAVING count(last_x) = count(*)),
c AS (SELECT *, lag(bx) OVER (PARTITION BY query_id, doc_id ORDER BY x) AS earlier FROM b),
s AS (SELECT query_id, doc_id, count(*) AS covers, round(sum(0.1::DOUBLE / (1 + (i - b) - (x - bx))), 9) AS score FROM c WHERE earlier IS NULL OR bx > earlier GROUP BY ALL)
SELECT query_id, doc_id, covers, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def cover_density_all(spark, sf_dir):
    """All of an item's first three terms are needed: the shortest stretches with all of them, the denser the better."""
    asked = _benchmark_terms(spark, sf_dir).withColumn("terms", F.slice("terms", 1, 3))
    return inverted.cover_density(_positions(spark, sf_dir), asked, 10, "doc_id", need="all")


# vectors and keywords over the same keys: vec_id stands for the document of that number
def _both(spark, sf_dir):
    v = retrieval.vector_topk_many(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 30).withColumn("query_id", F.col("query_id").cast("long") / 100).withColumn("query_id", F.col("query_id").cast("long"))
    k = _keyword(spark, sf_dir, 30).withColumnRenamed("doc_id", "vec_id")
    return v, k


_RANKINGS = f"""
{_TOPK}, {_KEYWORD},
both_ AS (SELECT query_id // 100 AS query_id, vec_id, rank, similarity, 0 AS src FROM v UNION ALL SELECT query_id, doc_id, rank, NULL, 1 FROM kw)
"""


@_query(f"WITH {_RANKINGS} SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused_score FROM both_ GROUP BY ALL")
def rrf_fusion(spark, sf_dir):
    v, k = _both(spark, sf_dir)
    both = v.select("query_id", "vec_id", "rank").unionByName(k.select("query_id", "vec_id", "rank"))
    return retrieval.reciprocal_rank_fusion(both, "vec_id").withColumn("fused_score", F.round("fused_score", 9))


@_query(f"""
WITH {_RANKINGS},
g AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused_score, max(similarity) AS similarity, min((src, rank)) AS first FROM both_ GROUP BY ALL)
SELECT query_id, vec_id, similarity, fused_score, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, first) AS rank FROM g QUALIFY rank <= 10""")
def hybrid_search(spark, sf_dir):
    return retrieval.retrieve("hybrid", *_both(spark, sf_dir), table(spark, sf_dir, "embeddings"), "vec_id")


@_query(f"""
WITH {_RANKINGS},
g AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min((src, rank)) AS first FROM both_ GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first) AS rank FROM g QUALIFY rank <= 30),
p AS (SELECT query_id, p.vec_id, p.rank, fused / max(fused) OVER (PARTITION BY query_id) AS rel, e.embedding::DOUBLE[] AS v FROM pool p LEFT JOIN embeddings e ON e.vec_id = p.vec_id),
one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) = 1),
c2 AS (SELECT p.*, coalesce(list_cosine_similarity(p.v, o.v), 0.0) AS worst, p.v IS NOT NULL AND o.v IS NOT NULL AS compared FROM p JOIN one o USING (query_id) WHERE p.vec_id <> o.vec_id),
two AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * rel - (1 - 0.7::DOUBLE) * worst, 12) DESC, rank) = 1),
c3 AS (SELECT c.*, CASE WHEN c.v IS NULL THEN 0.0 WHEN t.v IS NULL THEN c.worst WHEN c.compared THEN greatest(c.worst, list_cosine_similarity(c.v, t.v)) ELSE list_cosine_similarity(c.v, t.v) END AS worse FROM c2 c JOIN two t USING (query_id) WHERE c.vec_id <> t.vec_id),
three AS (SELECT * FROM c3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * rel - (1 - 0.7::DOUBLE) * worse, 12) DESC, rank) = 1)
SELECT query_id, vec_id, round(rel, 9) AS relevance, 1::BIGINT AS rank FROM one UNION ALL SELECT query_id, vec_id, round(rel, 9), 2 FROM two UNION ALL SELECT query_id, vec_id, round(rel, 9), 3 FROM three""")
def mmr_rerank(spark, sf_dir):
    """The three of a pool of thirty that are relevant and unlike one another."""
    found = retrieval.retrieve("rerank", *_both(spark, sf_dir), table(spark, sf_dir, "embeddings"), "vec_id", limit=3)
    return found.withColumn("relevance", F.round("relevance", 9))


@_query(rf"""
SELECT row_number() OVER (ORDER BY round(s, 6) DESC, vec_id)::BIGINT AS rank, vec_id AS ref, round(s, 3) AS similarity, CASE WHEN length(text) > 2000 THEN 'part 1 of 2' ELSE '' END AS part_label,
CASE WHEN length(flat) > 160 THEN flat[1:160] || '...' ELSE flat END AS snippet
FROM (SELECT c.vec_id, {_COSINE} AS s, text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM embeddings c JOIN (SELECT * FROM embeddings WHERE vec_id = 0) q ON true JOIN documents d ON d.doc_id = c.vec_id ORDER BY s DESC, c.vec_id LIMIT 10)""")
def search_view(spark, sf_dir):
    """The ten documents nearest to one, as a person reads them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), "text")
    near = retrieval.vector_topk(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "ref").join(d.select("ref"), "ref"), _vector_of(spark, sf_dir, 0), 10, "ref").join(d, "ref")
    from pyspark.sql.window import Window

    ranked = near.select(F.row_number().over(Window.orderBy(F.desc("similarity"), "ref")).cast("long").alias("rank"), "ref", "similarity", F.lit(0).alias("part"), F.when(F.length("text") > 2000, 2).otherwise(1).alias("of_parts"), F.coalesce("text", F.lit("")).alias("body"))
    return retrieval.search_view(ranked)


# --- evaluation --------------------------------------------------------------


def _results(spark, sf_dir):
    """A case a query vector: its ten nearest; relevant are all rows of its label and of its hundred of ids (none for label 0)."""
    e = table(spark, sf_dir, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 100))
    near = retrieval.vector_topk_many(e, _asked(spark, sf_dir), 10).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "similarity"))).alias("r"))
    rel = e.filter("label > 0").groupBy("label", "block").agg(F.array_sort(F.collect_list("vec_id")).alias("relevant"))
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", "block").join(rel, ["label", "block"], "left")
    return q.join(near, "query_id").select(F.col("query_id").alias("id"), F.transform("r", lambda x: x["vec_id"]).alias("retrieved"), F.coalesce("relevant", F.array().cast("array<bigint>")).alias("relevant"), F.element_at("r", 1)["similarity"].alias("top_score"))


_RESULTS = f"""
{_TOPK},
near AS (SELECT query_id, list(vec_id ORDER BY rank) AS retrieved, max(similarity) AS top_score FROM v WHERE rank <= 10 GROUP BY 1),
rel AS (SELECT label, vec_id // 100 AS block, list(vec_id ORDER BY vec_id) AS relevant FROM embeddings WHERE label > 0 GROUP BY 1, 2),
res AS (SELECT e.vec_id AS id, retrieved, coalesce(relevant, []::BIGINT[]) AS relevant, top_score FROM embeddings e LEFT JOIN rel ON rel.label = e.label AND rel.block = e.vec_id // 100 JOIN near ON query_id = e.vec_id WHERE e.vec_id % 100 = 0)
"""
_METRICS = ", ".join(f"CASE WHEN list_has_any(retrieved[1:{k}], relevant) THEN 1.0::DOUBLE ELSE 0.0 END AS hit_{k}, CASE WHEN len(relevant) > 0 THEN len(list_intersect(retrieved[1:{k}], relevant))::DOUBLE / len(relevant) ELSE 0.0 END AS recall_{k}" for k in evaluate.KS)
_RR = "coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(relevant, lambda r: list_position(retrieved, r)), lambda p: p > 0)), 0.0)"


@_query(f"WITH {_RESULTS} SELECT id, {_METRICS}, {_RR} AS rr FROM res")
def hit_recall_mrr(spark, sf_dir):
    return evaluate.case_metrics(_results(spark, sf_dir)).select("id", *[f"{m}_{k}" for k in evaluate.KS for m in ("hit", "recall")], "rr")


@_query(f"""
WITH {_RESULTS}, m AS (SELECT *, len(relevant) > 0 AS a, {_METRICS}, {_RR} AS rr FROM res),
means AS (SELECT count(*) AS cases, count(*) FILTER (a) AS answerable, count(*) FILTER (NOT a) AS unanswerable,
{", ".join(f"round(avg({x}_{k}) FILTER (a), 3) AS {x}_{k}" for k in evaluate.KS for x in ("hit", "recall"))},
round(avg(rr) FILTER (a), 3) AS mrr, round(avg(top_score) FILTER (a), 3) AS top_answerable, round(avg(top_score) FILTER (NOT a), 3) AS top_unanswerable FROM m)
SELECT *, round(top_answerable - top_unanswerable, 3) AS separation FROM means""")
def score_summary(spark, sf_dir):
    return evaluate.summary(_results(spark, sf_dir))


@_query(f"WITH {_RESULTS} SELECT id, array_to_string(list_filter(relevant, lambda r: NOT list_contains(retrieved, r)), ',') AS missed FROM res")
def missed_refs(spark, sf_dir):
    return _results(spark, sf_dir).select("id", F.array_join(F.transform(M.missed(F.col("retrieved"), F.col("relevant")), lambda x: x.cast("string")), ",").alias("missed"))


@_query(f"WITH {_RESULTS} SELECT id, array_to_string(list_filter(relevant, lambda r: NOT list_contains(retrieved, r)), ',') AS failures, list_has_all(retrieved, relevant) AS valid FROM res")
def citation_check(spark, sf_dir):
    bad = validate.fabricated(F.col("relevant"), F.col("retrieved"))
    return _results(spark, sf_dir).select("id", F.array_join(F.transform(bad, lambda x: x.cast("string")), ",").alias("failures"), (F.size(bad) == 0).alias("valid"))


@_query("""
WITH r AS (SELECT round(value / 100, 3) AS c, event_type = 'purchase' AS e FROM events)
SELECT t AS threshold, count(*) FILTER (c >= t) AS filed, count(*) FILTER (c >= t AND e) AS filed_exact, count(*) FILTER (c < t AND e) AS held_exact
FROM r, (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS t) GROUP BY t""")
def threshold_sweep(spark, sf_dir):
    d = _runs(spark, sf_dir).select("confidence", (F.col("event_type") == "purchase").alias("exact"))
    return evaluate.threshold_sweep(d, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])


@_query("""
WITH d AS (SELECT CASE WHEN round(value / 100, 3) >= 0.6 THEN 'auto_filed' ELSE 'human_review' END AS route,
  list_filter([event_id % 3, event_id % 5 + 1], lambda x: x > 0) AS got, list_filter([event_id % 4, event_id % 2 + 1], lambda x: x > 1) AS want FROM events),
m AS (SELECT route, len(list_intersect(got, want)) AS b, len(list_distinct(got)) AS g, len(list_distinct(want)) AS w, list_sort(list_distinct(got)) = list_sort(list_distinct(want)) AS e FROM d)
SELECT route, count(*) AS n, round(avg(CASE WHEN g > 0 THEN b::DOUBLE / g WHEN w = 0 THEN 1.0 ELSE 0.0 END), 3) AS precision, round(avg(CASE WHEN w > 0 THEN b::DOUBLE / w ELSE 1.0 END), 3) AS recall, count(*) FILTER (e) AS exact FROM m GROUP BY route""")
def route_calibration(spark, sf_dir):
    i = F.col("event_id")
    got = F.filter(F.array(i % 3, i % 5 + 1), lambda x: x > 0)
    want = F.filter(F.array(i % 4, i % 2 + 1), lambda x: x > 1)
    return evaluate.route_calibration(_runs(spark, sf_dir).select("route", got.alias("got"), want.alias("want")))


@_query("""
WITH g AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY o_custkey)
SELECT o_custkey, v[least(len(v), floor(0.5 * len(v))::INT + 1)] AS p50, v[least(len(v), floor(0.9 * len(v))::INT + 1)] AS p90 FROM g""")
def floor_percentiles(spark, sf_dir):
    return evaluate.floor_percentiles(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", {"p50": 0.5, "p90": 0.9})


@_query(f"""
WITH {_RESULTS}
SELECT 0 AS place, '' AS id, NULL::BIGINT AS cases, NULL::BIGINT AS n_retrieved, NULL::BIGINT AS n_missed, NULL::BIGINT AS first_hit_rank, NULL::DOUBLE AS top_score WHERE false
UNION ALL SELECT 0, '', count(*), NULL, NULL, NULL, NULL FROM res
UNION ALL SELECT 1, id::VARCHAR, NULL, len(retrieved[1:10]), len(list_filter(relevant, lambda r: NOT list_contains(retrieved, r))), list_min(list_filter(list_transform(relevant, lambda r: list_position(retrieved, r)), lambda p: p > 0)), round(top_score, 3) FROM res""")
def run_report(spark, sf_dir):
    """The JSON lines of a scored run, read back."""
    lines = docs_io.report(_results(spark, sf_dir).withColumn("verified", F.lit(True)), "catalogue", "2026-01-01T00:00:00+00:00", {"mode": "vector"})
    ddl = "id string, retrieved array<string>, missed array<string>, first_hit_rank long, top_score double, summary struct<cases: long>"
    r = lines.select("place", F.from_json("value", ddl).alias("j"))
    size = lambda c: F.when(F.col("place") > 0, F.size(c).cast("long"))
    return r.select("place", F.coalesce("j.id", F.lit("")).alias("id"), F.col("j.summary.cases").alias("cases"), size("j.retrieved").alias("n_retrieved"), size("j.missed").alias("n_missed"), F.col("j.first_hit_rank").alias("first_hit_rank"), F.col("j.top_score").alias("top_score"))


# --- decisions ---------------------------------------------------------------

_LOW = decide.Thresholds(retrieval=0.3)


def _tops(spark, sf_dir):
    near = retrieval.vector_topk_many(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 9).filter("vec_id <> query_id")
    return near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "similarity"))), lambda x: x["similarity"]).alias("s"))


_TOPS = f"""{_TOPK}, t0 AS (SELECT query_id, list(similarity ORDER BY rank) AS s FROM v WHERE rank <= 9 AND vec_id <> query_id GROUP BY 1), tops AS (SELECT query_id, s[1] AS top, s[1] - coalesce(s[2], 0) AS margin, len(s) AS n, s FROM t0)"""


@_query(f"WITH {_TOPS} SELECT query_id, round(top, 6) AS top_score, round(margin, 6) AS margin, CASE WHEN top < 0.3 THEN 'no candidate above the threshold' END AS reason FROM tops")
def retrieval_gate(spark, sf_dir):
    top, margin = decide.top_and_margin(F.col("s"))
    return _tops(spark, sf_dir).select("query_id", F.round(top, 6).alias("top_score"), F.round(margin, 6).alias("margin"), decide.gate(top, F.size("s"), _LOW).alias("reason"))


@_query(f"""
WITH {_TOPS}, c AS (SELECT query_id, round(least(greatest(0.0, least(1.0, (top - 0.3) / 0.18)), greatest(0.0, least(1.0, margin / 0.05)), CASE WHEN query_id % 500 = 0 THEN 0.4 ELSE 1.0 END), 3)::DOUBLE AS confidence FROM tops)
SELECT query_id, confidence, CASE WHEN confidence >= 0.6 THEN 'auto_filed' ELSE 'human_review' END AS route FROM c""")
def confidence_route(spark, sf_dir):
    top, margin = decide.top_and_margin(F.col("s"))
    c = decide.confidence(top, margin, F.lit(0), F.when(F.col("query_id") % 500 == 0, 1).otherwise(0), F.lit(""), _LOW)
    return _tops(spark, sf_dir).select("query_id", c.alias("confidence"), decide.route(c, _LOW).alias("route"))


_SIGNALS = f"""{_TOPS}, sig AS (SELECT query_id, top, margin, greatest(0.0, least(1.0, (top - 0.3) / 0.18)) AS r, greatest(0.0, least(1.0, margin / 0.05)) AS m, len(list_filter(s[2:], lambda x: s[1] - x < 0.001)) AS amb FROM tops)"""
_WHY = "format('retrieval {:.2f} (top {:.3f}), margin {:.2f} ({:.3f}), integrity {:.2f}', r, top, m, margin, i)"


@_query(f"""
WITH {_SIGNALS}, e AS (SELECT *, query_id % 3 AS bad, query_id % 700 = 0 AS note, CASE WHEN query_id % 3 > 0 THEN 0.0 WHEN amb > 0 OR query_id % 700 = 0 THEN 0.4 ELSE 1.0 END::DOUBLE AS i FROM sig)
SELECT query_id, {_WHY} || CASE WHEN bad + amb > 0 OR note THEN ' — ' ELSE '' END || array_to_string(list_filter([CASE WHEN bad > 0 THEN bad || ' fabricated citation(s)' END, CASE WHEN amb > 0 THEN amb || ' clause(s) marked ambiguous' END, CASE WHEN note THEN 'obligation itself is ambiguous' END], lambda x: x IS NOT NULL), '; ') AS why FROM e""")
def confidence_explained(spark, sf_dir):
    top, margin = decide.top_and_margin(F.col("s"))
    close = F.size(F.filter(F.slice("s", 2, 9), lambda x: F.element_at("s", 1) - x < 0.001))
    why = decide.explanation(top, margin, (F.col("query_id") % 3).cast("int"), close, F.when(F.col("query_id") % 700 == 0, "unclear"), _LOW)
    return _tops(spark, sf_dir).select("query_id", why.alias("why"))


@_query(f"""
WITH {_SIGNALS}, c AS (SELECT *, CASE WHEN amb > 0 THEN 0.4 ELSE 1.0 END::DOUBLE AS i, top < 0.3 AS gated FROM sig)
SELECT query_id AS item, CASE WHEN gated THEN 0.0 ELSE round(least(r, m, i), 3) END::DOUBLE AS confidence, CASE WHEN gated THEN 'human_review' WHEN round(least(r, m, i), 3) >= 0.6 THEN 'auto_filed' ELSE 'human_review' END AS route,
  CASE WHEN gated THEN 'no candidate above the threshold' ELSE {_WHY} || CASE WHEN amb > 0 THEN ' — ' || amb || ' clause(s) marked ambiguous' ELSE '' END END AS reason,
  CASE WHEN gated THEN NULL ELSE (SELECT min_by(vec_id, rank)::VARCHAR FROM v WHERE v.query_id = c.query_id AND rank <= 9 AND v.vec_id <> v.query_id) END AS affected, CASE WHEN gated THEN 0 ELSE amb END::BIGINT AS n_ambiguous, CASE WHEN gated THEN 0 ELSE 1 END::BIGINT AS model_calls FROM c""")
def agent_pipeline(spark, sf_dir):
    """Retrieve, gate, judge offline, derive, route: candidates of gated items stay outside Python."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("context"), F.col("text").alias("body"))
    near = retrieval.vector_topk_many(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 9).filter("vec_id <> query_id").join(d, "vec_id", "left")
    one = F.struct("rank", F.col("vec_id").cast("string").alias("ref"), "context", "body", "similarity")
    items = near.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("r"))
    candidates = F.transform("r", lambda x: F.struct(x["ref"].alias("ref"), x["context"].alias("context"), x["body"].alias("body"), x["similarity"].alias("similarity")))
    out = decide.decided(items.select(F.col("query_id").alias("item"), F.col("query_id").cast("string").alias("query"), candidates.alias("candidates")), t=_LOW)
    return out.select("item", "confidence", "route", "reason", F.get("affected", 0).alias("affected"), F.size("ambiguous").cast("long").alias("n_ambiguous"), "model_calls")


@_query(f"""
WITH {_SIGNALS}, q AS (SELECT count(*) AS n, list_sort(list(round(r, 6))) AS rs, list_sort(list(round(m, 6))) AS ms, count(*) FILTER (m < r) AS k FROM sig)
SELECT n AS judged, k AS margin_binds, rs[1] AS retrieval_low, rs[n // 2 + 1] AS retrieval_median, rs[n] AS retrieval_high, ms[1] AS margin_low, ms[n // 2 + 1] AS margin_median, ms[n] AS margin_high, k > n * 0.6 AS margin_dominates FROM q WHERE n > 0""")
def component_summary(spark, sf_dir):
    top, margin = decide.top_and_margin(F.col("s"))
    return evaluate.component_summary(_tops(spark, sf_dir).select(top.alias("top_score"), margin.alias("margin")), retrieval=0.3)


# --- validation --------------------------------------------------------------


@_query(r"""
WITH f AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM benchmark),
s AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id FROM f JOIN s ON contains(t, q) WHERE q <> ''""")
def grounding_check(spark, sf_dir):
    return validate.grounding(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


_MARKED = "trim(regexp_replace(lower(replace(text, ', ', ' - ')), '\\s+', ' ', 'g'))"


@_query(f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({_MARKED.replace('text', 'd.text')}, {_MARKED.replace('text', 'b.text')}) WHERE {_MARKED.replace('text', 'b.text')} <> ''")
def grounding_marks(spark, sf_dir):
    """Quotes with plain marks in sources whose commas are dashes of several kinds between curly quotation marks and spaces that don't break."""
    d = table(spark, sf_dir, "documents")
    dash = F.element_at(F.array(*map(F.lit, " \u2013 | \u2014 |\u00a0\u2011\u00a0".split("|"))), (F.col("doc_id") % 3 + 1).cast("int"))
    marked = d.select("doc_id", F.concat(F.lit("\u201c"), F.replace("text", F.lit(", "), dash), F.lit("\u201d")).alias("text"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit(", "), F.lit(" - ")).alias("text"))
    return validate.grounding(b, marked, "item_id", "doc_id")


_PARTY = "CASE WHEN role = 'user' THEN 'provider' WHEN role = 'assistant' THEN 'member_state' ELSE role END"
_STRIPPED = r"trim(coalesce(text, ''), e' \t\n\r') AS t"


@_query(rf"""
WITH c AS (SELECT conv_id, turn, {_STRIPPED}, {_PARTY} AS party, ['mandatory', 'permitted', 'must', NULL][turn % 4 + 1] AS modality FROM conversations),
w AS (SELECT *, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS n FROM c)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(t) < 25 THEN 'quote_short' END, CASE WHEN t = '' THEN 'action_blank' END, CASE WHEN n > 15 THEN 'action_long' END,
  CASE WHEN party IS NULL OR party NOT IN ('provider', 'member_state') THEN 'party_unknown' END, CASE WHEN modality IS NULL OR modality = 'must' THEN 'modality_unknown' END], lambda x: x IS NOT NULL), ',') AS violations FROM w""")
def field_rule_violations(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    modality = F.element_at(F.array(F.lit("mandatory"), F.lit("permitted"), F.lit("must"), F.lit(None)), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(validate.obligation_violations(t, t, F.expr(_PARTY), modality), ",").alias("violations"))


@_query(rf"""
WITH c AS (SELECT conv_id, turn, role, {_STRIPPED} FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 3 = 2 THEN 'verdict_unknown' END, CASE WHEN turn % 5 = 4 THEN 'severity_unknown' END, CASE WHEN length(t) < 30 THEN 'reasoning_short' END], lambda x: x IS NOT NULL), ',') AS violations FROM c""")
def assessment_rules(spark, sf_dir):
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("turn") % n + 1).cast("int"))
    v = validate.assessment_violations(pick(3, "affected", "ambiguous", "maybe"), pick(5, "high", "medium", None, "none", "grave"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(v, ",").alias("violations"))


@_query("""
WITH r AS (SELECT l_orderkey, l_suppkey % 20 AS ref FROM lineitem),
d AS (SELECT l_orderkey, ref, count(*) AS n FROM r GROUP BY ALL)
SELECT l_orderkey, array_to_string(list_sort(list(ref) FILTER (n > 1)), ',') AS repeated, array_to_string(list_filter([CASE WHEN max(n) > 1 THEN 'refs_repeated' END, CASE WHEN l_orderkey % 10 = 0 THEN 'says_none_but_has_some' END], lambda x: x IS NOT NULL), ',') AS violations FROM d GROUP BY l_orderkey""")
def result_rules(spark, sf_dir):
    """Lines of an order as its obligations, some of which cite the same; every tenth order says that it has none."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_suppkey") % 20).alias("source_ref"))).alias("obligations"))
    refs = validate.repeated(F.transform("obligations", lambda x: x["source_ref"]))
    v = validate.result_violations(F.col("obligations"), F.col("l_orderkey") % 10 == 0)
    return o.select("l_orderkey", F.nullif(F.array_join(F.transform(refs, lambda x: x.cast("string")), ","), F.lit("")).alias("repeated"), F.array_join(v, ",").alias("violations"))


_ERROR = """CASE event_id % 6 WHEN 0 THEN concat('ServerError ', 500 + event_id % 5, ' ', event_type) WHEN 1 THEN concat('ResourceExhausted: retry in ', event_id % 90, '.5 s') WHEN 2 THEN concat('ValueError in ', event_type)
  WHEN 3 THEN concat('ClientError code: 429 retryDelay: ', chr(39), user_id % 60, 's', chr(39)) WHEN 4 THEN concat('NotFound: use models/m-', user_id, ' instead') ELSE concat('answer timeout of user ', user_id) END"""


@_query("""
SELECT event_id, CASE WHEN event_id % 6 IN (1, 3) THEN 'rate_limit' WHEN event_id % 6 = 5 OR (event_id % 6 = 0 AND event_id % 5 <> 1) THEN 'transient' WHEN event_id % 6 = 0 THEN 'transient' ELSE 'permanent' END AS kind,
CASE event_id % 6 WHEN 1 THEN event_id % 90 + 0.5::DOUBLE WHEN 3 THEN (user_id % 60)::DOUBLE END AS wait, CASE WHEN event_id % 6 = 4 THEN 'm-' || user_id END AS replacement FROM events""")
def failure_classifier(spark, sf_dir):
    e = F.expr(_ERROR)
    return table(spark, sf_dir, "events").select("event_id", validate.failure_kind(e).alias("kind"), validate.retry_after(e).alias("wait"), validate.replacement_model(e).alias("replacement"))


@_query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS valid FROM events")
def json_props_gate(spark, sf_dir):
    parsed, valid = validate.schema_gate(F.col("props"), "k bigint", ["k"])
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), valid.alias("valid"))


@_query("""
SELECT o_orderkey, (2000 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) > 24 AS stale FROM orders""")
def stale_months(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.months_stale(F.col("o_orderdate"), F.to_date(F.lit("2000-06-15"))).alias("stale"))


@_query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN (doc_id % 9 + 1) * 365.0 WHEN 1 THEN 30 + (doc_id % 40) * 1.4 WHEN 2 THEN 0 WHEN 3 THEN (doc_id % 50) * 30.0 + 1.0 / 24 ELSE 0 END::DOUBLE AS days FROM documents""")
def duration_days(spark, sf_dir):
    """Sentences about keeping each document, with spelled and written numbers."""
    said = F.expr("""CASE doc_id % 5
      WHEN 0 THEN concat('Kept for not less than ', element_at(array('one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'), cast(doc_id % 9 + 1 AS INT)), ' (', doc_id % 9 + 1, ') years by ', source)
      WHEN 1 THEN concat('Sent within thirty days to ', source, ', or for a period of ', doc_id % 40, ' business days')
      WHEN 2 THEN 'No later than umpteen hours' WHEN 3 THEN concat('For ', doc_id % 50, ' months; minimum of one hour') ELSE concat('Nothing stated about ', source) END""")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(said, F.lit("")).alias("said"))
    return d.select("doc_id", F.aggregate(T.durations(F.col("said")), F.lit(0.0), lambda s, d: s + d["days"]).alias("days"))


@_query("""
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN (doc_id % 7 + 1) || '.' || doc_id WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN 'IV.B' WHEN 3 THEN 'ix' WHEN 4 THEN doc_id || 'a' WHEN 5 THEN '164.' || doc_id END AS ref FROM documents""")
def heading_refs(spark, sf_dir):
    """A heading for every document, numbered in one of several ways or not at all."""
    heading = F.expr("""CASE doc_id % 8 WHEN 0 THEN concat(doc_id % 7 + 1, '.', doc_id, ' Scope') WHEN 1 THEN concat(doc_id, ') Terms of ', lang) WHEN 2 THEN 'IV.B Effects' WHEN 3 THEN '(ix) also'
      WHEN 4 THEN concat('Article ', doc_id, 'a — Duties') WHEN 5 THEN concat('§§ 164.', doc_id, ' Safeguards') WHEN 6 THEN concat(doc_id, ' Annual Report') ELSE 'Summary' END""")
    return table(spark, sf_dir, "documents").select("doc_id", T.heading_reference(heading).alias("ref"))


# --- sets, sources -----------------------------------------------------------


@_query("SELECT provenance, id, length(text) AS chars FROM (SELECT 'documents' AS provenance, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)")
def provenance_union(spark, sf_dir):
    d, b = (table(spark, sf_dir, t).select(F.col(k).alias("id"), "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    return docs_io.merged(d, b, ("documents", "benchmark")).select("provenance", "id", F.length("text").cast("long").alias("chars"))


@_query("""
SELECT 0 AS place, '{"_about":"two sets"}' AS value UNION ALL
SELECT 1, to_json({'id': lpad(item_id::VARCHAR, 6, '0'), 'n': length(text), 'provenance': 'written'})::VARCHAR FROM benchmark UNION ALL
SELECT 2, to_json({'id': lpad(doc_id::VARCHAR, 6, '0'), 'n': quality + toxic, 'provenance': 'found'})::VARCHAR FROM labels""")
def merged_case_file(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 6, "0").alias("id"), F.length("text").alias("n"))
    d = table(spark, sf_dir, "labels").select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("id"), (F.col("quality") + F.col("toxic")).alias("n"))
    return docs_io.merged_lines(b, d, ("written", "found"), {"about": "two sets"})


@_query("""
SELECT doc_id::VARCHAR AS id, 'mandatory obligation on provider, ' || doc_id || ' of set ' || toxic AS note FROM labels WHERE quality = 1""")
def exported_cases(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("query"), F.when(F.col("quality") == 1, F.array(F.lit("r"))).alias("relevant"), F.lit(True).alias("verified"),
        F.lit("mandatory").alias("modality"), F.lit("provider").alias("obliged_party"), F.col("doc_id").cast("string").alias("source_ref"), F.concat(F.lit("set "), "toxic").alias("source_document"),
    )
    return docs_io.exported(d).select("id", "note")


@_query("""
SELECT event_type || ' of user ' || user_id AS obligation, sha256(event_type || ' of user ' || user_id) AS obligation_hash, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def run_upsert(spark, sf_dir):
    """Decisions about the same obligation, of which the latest stays."""
    e = table(spark, sf_dir, "events").select(F.concat(F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string")).alias("obligation"), "event_id", F.struct("ts", "event_id").alias("ran_at"))
    return store.upsert_runs(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")).drop("ran_at")


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version FROM orders")
def bucket_merge(spark, sf_dir):
    """Closed orders priced anew in a table of buckets."""
    path = shared_dir(spark, "buckets")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("version"), "o_orderstatus")
    store.write_buckets(o.drop("o_orderstatus"), path, ["o_orderkey"], 8)
    new = o.filter("o_orderstatus = 'F'").withColumns({"o_totalprice": F.col("o_totalprice") * 2, "version": F.lit(2)})
    store.merge_buckets(spark, path, new.drop("o_orderstatus"), ["o_orderkey"], 8, "version")
    return spark.read.parquet(path).drop("bucket")


@_query("SELECT DISTINCT event_type || ' of user ' || user_id AS obligation FROM events")
def tables_kept(spark, sf_dir):
    """The library's tables are made where they are missing and left alone where they hold rows."""
    base = shared_dir(spark, "tables")
    store.init_tables(spark, base)
    runs = store.read_current(spark, f"{base}/agent_runs")
    e = table(spark, sf_dir, "events").select(F.concat(F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string")).alias("obligation"), F.col("ts").cast("timestamp").alias("ran_at"))
    store.commit_version(store.upsert_runs(runs, spark.createDataFrame([], runs.schema).unionByName(e, allowMissingColumns=True)), f"{base}/agent_runs")
    store.init_tables(spark, base)
    return store.read_current(spark, f"{base}/agent_runs").select("obligation")


@_query("SELECT 'D' || doc_id AS external_id, quality::BIGINT AS quality, NULL::BIGINT AS chars FROM labels UNION ALL SELECT 'D' || doc_id, NULL, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def draft_additions(spark, sf_dir):
    """Labelled documents as drafts, to which those without a label are added."""
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("external_id")
    old = table(spark, sf_dir, "labels").select(name, F.col("quality").cast("long").alias("quality"))
    return docs_io.with_drafts(old, table(spark, sf_dir, "documents").select(name, F.col("n_chars").alias("chars")), "external_id")


@_query("""
SELECT conv_id, md5(string_agg('[' || n || '] ' || ref || chr(10) || '    ' || context || chr(10) || '    ' || body, chr(10) || chr(10) ORDER BY n)) AS prompt
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, 'T' || turn AS ref, coalesce(role, '') AS context, coalesce(text, '') AS body FROM conversations) GROUP BY conv_id""")
def candidate_prompts(spark, sf_dir):
    """Turns as the candidates of their conversation, listed for a judge."""
    c = table(spark, sf_dir, "conversations")
    one = F.struct("turn", "role", "text", F.concat(F.lit("T"), F.col("turn").cast("string")).alias("ref"), F.coalesce("role", F.lit("")).alias("context"), F.coalesce("text", F.lit("")).alias("body"))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return lists.select("conv_id", F.md5(decide.prompt_candidates(F.col("c"))).alias("prompt"))


@_query("SELECT r_regionkey, r_name, 2 AS version FROM region")
def versioned_table(spark, sf_dir):
    """A table that is committed twice; readers see the second version."""
    base = shared_dir(spark, "versions")
    r = table(spark, sf_dir, "region")
    store.commit_version(r.limit(0), base)
    n = store.commit_version(r, base)
    return store.read_current(spark, base).withColumn("version", F.lit(n))


@_query("SELECT event_id::VARCHAR AS id, event_type AS query, '' AS note, event_id % 2 = 0 AS verified FROM events WHERE event_id % 3 > 0")
def metadata_skip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    row = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("query"), F.array(F.lit("r")).alias("relevant"), F.when(F.col("event_id") % 2 == 0, True).alias("verified")))
    meta = F.to_json(F.struct(F.col("event_id").alias("_row"), F.lit("about the file").alias("_note")))
    return docs_io.cases(e.select(F.when(F.col("event_id") % 3 > 0, row).otherwise(meta).alias("value"))).drop("relevant")


@_query("""
SELECT 'P' || page_id AS external_id, CASE WHEN page_id % 4 = 0 THEN '(untitled)' ELSE url END AS title, sha256('web|P' || page_id || '|' || CASE WHEN page_id % 4 = 0 THEN '(untitled)' ELSE url END) AS content_hash,
CASE WHEN page_id % 2 = 0 THEN DATE '2026-09-02' END AS published_on FROM pages WHERE page_id % 5 > 0""")
def payload_documents(spark, sf_dir):
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    item = F.to_json(F.struct(F.when(i % 5 > 0, F.concat(F.lit("P"), i)).alias("document_number"), F.when(i % 4 == 0, "").otherwise(F.col("url")).alias("title"), F.when(i % 2 == 0, "2026-9-2").otherwise("soon").alias("publication_date")))
    raw = p.select((i % 3).alias("term_ix"), i.alias("pos"), item.alias("value"))
    return docs_io.fetched(raw.unionByName(raw.withColumn("term_ix", F.lit(7).cast("long"))), "web").select("external_id", "title", "content_hash", "published_on")


# --- structure ---------------------------------------------------------------


# the pages have one article, of one heading and paragraphs that may be left open
@_query(r"""
WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS t FROM pages),
p AS (SELECT page_id, list_filter(list_transform(string_split_regex(t, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM a)
SELECT page_id, 0 AS ordinal, 0 AS level, b[1] AS heading, array_to_string(b[2:], chr(10) || chr(10)) AS body FROM p WHERE len(b) > 0""")
def html_sections(spark, sf_dir):
    return structure.sections(table(spark, sf_dir, "pages"), "page_id", "html")


@_query("""
WITH s AS (SELECT doc_id, i - 1 AS ordinal, (length(string_split(text, chr(10))[i]) * 7 + i) % 23 AS level FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT a.doc_id, a.ordinal::BIGINT AS ordinal, a.level::BIGINT AS level, (SELECT max(b.ordinal) FROM s b WHERE b.doc_id = a.doc_id AND b.ordinal < a.ordinal AND b.level < a.level)::BIGINT AS parent_ordinal FROM s a""")
def section_parents(spark, sf_dir):
    s = _lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("ordinal"), ((F.length("line") * 7 + F.col("line_no") + 1) % 23).alias("level"))
    return structure.with_parents(s, "doc_id").select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("ordinal", "level", "parent_ordinal")])


@_query(r"SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def tag_frequency(spark, sf_dir):
    return structure.tag_frequency(table(spark, sf_dir, "pages"), "html")


# texts of up to 2,000 characters are whole; others are packed sentence by sentence to 1,200, and a last scrap goes to the piece before
_PIECES = r"""
d AS (SELECT doc_id, coalesce(source, '') AS source, trim(coalesce(text, ''), e' \t\n\r') AS t FROM documents),
c AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.;:])\s+([A-Z(])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: trim(x, e' \t\n\r')), lambda x: x <> '') AS s FROM d WHERE t <> ''),
f AS (SELECT doc_id, source, CASE WHEN length(t) <= 2000 THEN [t] ELSE string_split(list_reduce(s, lambda a, x: CASE WHEN length(string_split(a, chr(30))[-1]) + 2 + length(x) > 1200 THEN a || chr(30) || x ELSE a || chr(10) || chr(10) || x END), chr(30)) END AS p FROM c),
g AS (SELECT doc_id, source, CASE WHEN len(p) > 1 AND length(p[-1]) < 120 THEN list_append(p[:-3], p[-2] || chr(10) || chr(10) || p[-1]) ELSE p END AS p FROM f)
"""


@_query(f"WITH {_PIECES} SELECT doc_id, unnest(range(len(p)))::INT AS part, len(p)::INT AS of_parts, CASE WHEN source <> '' THEN source || chr(10) ELSE '' END || unnest(p) AS text FROM g")
def chunk_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return chunking.chunks(d, context="source").select("doc_id", "part", "of_parts", "text")


@_query(f"WITH {_PIECES} SELECT doc_id, len(p) AS chunks, list_max(list_transform(p, lambda x: length(x))) AS longest FROM g")
def chunk_sizes(spark, sf_dir):
    c = chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("body")).cast("long").alias("longest"))


_TURN_PIECES = _PIECES.replace("doc_id, coalesce(source, '') AS source", "conv_id, turn, role").replace("FROM documents", "FROM conversations").replace("doc_id, source", "conv_id, turn, role")


@_query(f"""
WITH {_TURN_PIECES}
SELECT conv_id || ':' || turn || ':' || CASE WHEN turn % 2 = 0 THEN 'x' ELSE role END AS ref, conv_id AS document, array_to_string(list_filter(['Conversation ' || conv_id, CASE WHEN turn % 2 = 1 THEN role END, CASE WHEN turn % 3 = 0 THEN 'turn ' || turn END], lambda x: x IS NOT NULL), ' — ') AS context,
unnest(range(len(p)))::INT AS part, len(p)::INT AS of_parts, md5(unnest(p)) AS body FROM g""")
def section_chunks(spark, sf_dir):
    """Turns as sections of their conversations, long ones in several parts."""
    c = table(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("document"), F.col("turn").alias("ordinal"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("ref"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("heading"), F.col("text").alias("body"))
    return chunking.section_chunks(s).select("ref", "document", "context", "part", "of_parts", F.md5("body").alias("body"))


def _policy_files(spark, sf_dir):
    """Every conversation as a policy file: a section a role, a clause a turn."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    line = F.concat(F.lit("### "), F.col("turn") + 1, F.lit(" Turn "), F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^\s*#+", ""))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    head = F.concat(F.lit("---\nid: C-"), F.col("conv_id").cast("string"), F.lit("\ntitle: Conversation "), F.col("conv_id").cast("string"), F.lit("\nowner: us\ndomain: d"), (F.col("conv_id") % 3).cast("string"), F.lit("\nlast_reviewed: 2025-1-"), F.col("conv_id") % 28 + 1, F.lit("\n---\nlost\n## 1. Talk\nlost too\n"))
    return files.select(F.col("conv_id").cast("string").alias("path"), F.concat(head, "t").alias("value"))


_CLAUSE_SQL = r"""
cl AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^\s*#+', '', 'g'), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}]+', ' ', 'g')) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
"""


@_query(rf"""
WITH {_CLAUSE_SQL}
SELECT 'C-' || conv_id || ' §' || (turn + 1) AS clause_id, 'Talk' AS section, 'd' || conv_id % 3 AS domain, (DATE '2025-01-01' + (conv_id % 28)::INT)::DATE AS last_reviewed, md5(t) AS text,
md5('Conversation ' || conv_id || ' — Talk — Turn ' || turn || chr(10) || t) AS retrieval_text FROM cl WHERE t <> ''""")
def policy_clauses(spark, sf_dir):
    c = structure.policy_clauses(_policy_files(spark, sf_dir))
    return c.select("clause_id", "section", "domain", "last_reviewed", F.md5("text").alias("text"), F.md5("retrieval_text").alias("retrieval_text"))


@_query(rf"""
WITH {_CLAUSE_SQL} SELECT 'C-' || conv_id || ' §' || (turn + 1) AS ref, 'Conversation ' || conv_id || ' — Talk — Turn ' || turn AS context, md5('Conversation ' || conv_id || ' — Talk — Turn ' || turn || chr(10) || t) AS text, 0 AS part, 1 AS of_parts FROM cl WHERE t <> ''""")
def clause_chunks(spark, sf_dir):
    """However long, a clause is one chunk."""
    return chunking.clause_chunks(structure.policy_clauses(_policy_files(spark, sf_dir))).select("ref", "context", F.md5("text").alias("text"), "part", "of_parts")


@_query(rf"""
WITH {_CLAUSE_SQL}, g AS (SELECT length(t) AS n, unnest([('all', ''), ('domain', 'd' || conv_id % 3), ('policy', 'C-' || conv_id)]) AS g FROM cl WHERE t <> '')
SELECT g[1] AS "by", g[2] AS name, count(*) AS clauses, min(n)::INT AS low, list_sort(list(n))[count(*) // 2 + 1]::INT AS median, max(n)::INT AS high FROM g GROUP BY g""")
def corpus_shape(spark, sf_dir):
    return review.corpus_shape(structure.policy_clauses(_policy_files(spark, sf_dir)))


def _xml(spark, sf_dir):
    """Every order as XML: a section a line, with headings that carry attributes."""
    li = table(spark, sf_dir, "lineitem")
    one = F.concat(F.lit("<SECTION><SECTNO>"), "l_linenumber", F.lit('</SECTNO><HD SOURCE="HD'), F.col("l_linenumber") % 3 + 1, F.lit('"'), F.when(F.col("l_returnflag") == "R", ' RETURNED="y"').otherwise(""), F.lit(">"), "l_shipdate", F.lit("</HD><P>"), "l_quantity", F.lit(" of <E>"), "l_partkey", F.lit("</E></P></SECTION>"))
    return li.groupBy("l_orderkey").agg(F.concat(F.lit("<RULE>"), F.array_join(F.array_sort(F.collect_list(one)), ""), F.lit("</RULE>")).alias("xml"))


@_query("""
SELECT unnest(['RULE', 'SECTION', 'SECTNO', 'HD', 'P', 'E']) AS tag, unnest([0, 1, 2, 2, 2, 3]) AS depth, unnest([o, n, n, n, n, n])::BIGINT AS n FROM (SELECT count(DISTINCT l_orderkey) AS o, count(*) AS n FROM lineitem)""")
def xml_depths(spark, sf_dir):
    e = structure.xml_elements(_xml(spark, sf_dir), "l_orderkey", "xml")
    return e.groupBy("tag", "depth").agg(F.count("*").alias("n"))


@_query("""
SELECT CASE WHEN l_returnflag = 'R' THEN '{"RETURNED":"y",' ELSE '{' END || '"SOURCE":"HD' || (l_linenumber % 3 + 1) || '"}' AS attributes, count(*) AS n FROM lineitem GROUP BY 1""")
def xml_heading_attributes(spark, sf_dir):
    return structure.heading_attributes(structure.xml_elements(_xml(spark, sf_dir), "l_orderkey", "xml"))


@_query(r"""
WITH s AS (SELECT doc_id, i - 1 AS ordinal, (i - 1) % 4 AS level, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
f AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS body FROM s)
SELECT doc_id, ordinal::BIGINT AS ordinal, repeat('  ', level) || CASE WHEN ordinal < 1000 THEN lpad(ordinal::VARCHAR, 3, ' ') ELSE left(ordinal::VARCHAR, 3) END || ' L' || level || ' [section ' || ordinal || ']' || CASE WHEN body <> '' THEN chr(10) || repeat('  ', level) || '      ' || left(body, 70) || CASE WHEN length(line) > 70 THEN '...' ELSE '' END ELSE '' END AS line FROM f""")
def tree_render(spark, sf_dir):
    s = _lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("ordinal"), (F.col("line_no") % 4).alias("level"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("heading"), F.col("line").alias("body"))
    return structure.rendered_tree(s, "doc_id").withColumn("ordinal", F.col("ordinal").cast("long"))


@_query()
def word_diff(spark, sf_dir):
    from pyspark.sql.window import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    diff = F.pandas_udf(lambda a, b: a.combine(b, providers.word_diff), "string")
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("_before"))
    return d.select("conv_id", "turn", diff(F.coalesce("_before", F.lit("")), F.coalesce("text", F.lit(""))).alias("diff"))


@_query()
def embed_documents(spark, sf_dir):
    return providers.embedded(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text").drop("text")


# --- streaming ---------------------------------------------------------------


@_query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    """Arrivals in a file stream, inserted if new; the store then holds each key once."""
    base = shared_dir(spark, "stream")
    path = f"{sf_dir}/events.parquet"
    # a pattern, as the table may be one file or a folder
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    rows = e.select("user_id", "event_type", "event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"))
    ingest.ingest_new(spark, rows, f"{base}/store", f"{base}/checkpoint", "key", "event_id")
    return spark.read.parquet(f"{base}/store").select("user_id", "event_type")


@_query("SELECT doc_id AS ref, 0 AS part, 64 AS n FROM documents")
def stream_index(spark, sf_dir):
    """Documents as chunks in a file stream, each embedded once; the index then holds each of them."""
    base = shared_dir(spark, "index")
    path = f"{sf_dir}/documents.parquet"
    d = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    providers.index_stream(d.select(F.col("doc_id").alias("ref"), F.lit(0).alias("part"), "text"), f"{base}/index", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/index").select("ref", "part", F.size("embedding").alias("n"))


# --- review ------------------------------------------------------------------


@_query(f"""
WITH l AS (SELECT doc_id, i - 1 AS ordinal, string_split(text, chr(10))[i] AS body, CASE WHEN i % 5 > 0 THEN body[1:30] END AS heading FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
c AS (SELECT doc_id, ordinal, body, length(body) - length(replace(lower(body), 'the', '')) AS density FROM l WHERE length(body) BETWEEN 100 AND 2000 AND regexp_matches(body, '\\b(?:that|with)\\b', 'i') AND heading IS NOT NULL AND NOT regexp_matches(heading, 'was|per', 'i')),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY density DESC, ordinal) AS rn FROM c)
SELECT doc_id, ordinal::BIGINT AS ordinal, density::BIGINT AS density FROM b WHERE rn = 1 ORDER BY density DESC, doc_id, ordinal LIMIT 25""")
def candidate_mining(spark, sf_dir):
    """Lines as sections whose beginnings are their headings; every fifth has none."""
    s = _lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("ordinal"), F.col("line").alias("body"), F.when((F.col("line_no") + 1) % 5 > 0, F.substring("line", 1, 30)).alias("heading"))
    found = review.candidates(s, table(spark, sf_dir, "documents"), "doc_id", "that|with", "was|per", 25, "the", 100, 2000)
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("density").cast("long").alias("density"))


@_query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, regexp_matches(body, '(^|[^\pL\pN_])(that|die|que)($|[^\pL\pN_])', 'i') AS d, regexp_matches(body, '(^|[^\pL\pN_])the($|[^\pL\pN_])', 'i') AS t FROM l)
SELECT d.doc_id, count(m.doc_id) AS sections, count(*) FILTER (d) AS domain_sections, count(*) FILTER (d AND t) AS usable FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id""")
def section_inventory(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("body"))
    return review.inventory(s, table(spark, sf_dir, "documents"), "doc_id", "that|die|que", "the")


@_query("SELECT l.doc_id, md5(coalesce(d.text, '')) AS original FROM (SELECT doc_id + 1 AS doc_id FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def clause_lookup(spark, sf_dir):
    """The text that each labelled row's neighbour stands for, empty where there is none."""
    a = table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("ref"))
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").alias("ordinal"))
    return review.with_original(a, c).select(F.col("ref").alias("doc_id"), F.md5("original").alias("original"))


@_query("""
SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'c' || (quality + 1) ELSE 'old' END AS relevant, doc_id % 4 < 2 AS verified FROM labels""")
def label_edits(spark, sf_dir):
    """Drafts whose first and second clause were picked by number, some of them in vain, some overruled by a later edit."""
    d = table(spark, sf_dir, "labels")
    cases = d.select(F.col("doc_id").alias("id"), F.array(F.lit("c1"), F.lit("c2")).alias("candidates"), F.array(F.lit("old")).alias("relevant"), F.lit(False).alias("verified"))
    pick = F.col("quality").cast("long") + 1
    edits = d.filter("doc_id % 4 = 1").select(F.col("doc_id").alias("id"), F.array(pick, F.lit(9).cast("long"), pick).alias("picks"), F.lit(2).alias("at"))
    early = d.filter("doc_id % 4 < 2").select(F.col("doc_id").alias("id"), F.array().cast("array<bigint>").alias("picks"), F.lit(1).alias("at"))
    return review.with_edits(cases, edits.unionByName(early)).select("id", F.array_join("relevant", ",").alias("relevant"), "verified")


@_query("SELECT l_orderkey AS ref, l_linenumber AS part FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem i WHERE i.l_orderkey = lineitem.l_orderkey AND i.l_linenumber = lineitem.l_linenumber AND i.l_returnflag = 'A')")
def index_pending(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("part"), "l_returnflag")
    index = li.withColumn("embedding", F.when(F.col("l_returnflag") == "A", F.array(F.lit(1.0))))
    return review.unindexed(li.drop("l_returnflag"), index)


def _dated_clauses(spark, sf_dir):
    """Events as clauses about logs, notices and other things, with durations and review dates."""
    said = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('Audit logs are kept for at least ', value_days, ' days.') WHEN 1 THEN concat('Notify ', event_type, ' within ', value_days, ' hours, as set out in the contract.')
      WHEN 2 THEN concat('Nothing here about ', event_type, '; governed by law.') ELSE concat('Records are retained for ', value_days, ' months.') END""")
    e = table(spark, sf_dir, "events").withColumn("value_days", F.col("event_id") % 97 + 1)
    return e.select(F.concat(F.lit("E "), F.col("event_id").cast("string")).alias("clause_id"), F.when(F.col("event_id") % 4 == 0, "Log keeping").otherwise("Duty").alias("heading"), said.alias("text"), F.to_date("ts").alias("last_reviewed"))


@_query("""
SELECT 'E ' || event_id AS clause_id, CASE event_id % 4 WHEN 0 THEN 'audit log' WHEN 1 THEN 'notif' ELSE 'retain' END AS topic, round(CASE event_id % 4 WHEN 0 THEN event_id % 97 + 1 WHEN 1 THEN (event_id % 97 + 1) / 24.0::DOUBLE ELSE (event_id % 97 + 1) * 30.0 END, 6)::DOUBLE AS days,
event_id % 4 = 1 AS defers, (2026 - year(ts)) * 12 + 9 - month(ts) > 24 AS stale FROM events WHERE event_id % 4 <> 2""")
def policy_review(spark, sf_dir):
    c = _dated_clauses(spark, sf_dir)
    marks = c.select("clause_id", review.defers(F.col("text")).alias("defers"), T.months_stale(F.col("last_reviewed"), F.to_date(F.lit("2026-09-10"))).alias("stale"))
    return review.topic_durations(c).join(marks, "clause_id").select("clause_id", "topic", F.round("days", 6).alias("days"), "defers", "stale")


@_query("""
SELECT event_id % 97 + 1.0::DOUBLE AS days, (event_id % 97 + 1) || ' days' AS phrase, 'E ' || event_id AS clause_id FROM events WHERE event_id % 4 = 0""")
def log_retention(spark, sf_dir):
    return review.log_retention(_dated_clauses(spark, sf_dir)).drop("heading")


@_query("""
WITH t AS (SELECT trim(regexp_replace(event_type || ' ' || user_id % 50, '\\s+', ' ', 'g')) AS k, arg_max(value, event_id) AS want FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT event_id, value AS got, want FROM events JOIN t ON event_type || ' ' || user_id = k WHERE event_id % 2 = 1""")
def decision_truth(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    truth = e.filter("event_id % 2 = 0").select(F.concat(F.lit(" "), F.col("event_type"), F.lit(" \n\t"), F.col("user_id") % 50).alias("query"), F.col("event_id").alias("at"), F.col("value").alias("want"))
    return review.with_truth(e.filter("event_id % 2 = 1").select("event_id", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("query"), F.col("value").alias("got")), truth).drop("query")


@_query("SELECT doc_id AS id, r AS ref, r IN (SELECT doc_id FROM documents) AS known FROM (SELECT doc_id, unnest([doc_id * 2, doc_id % 7]) AS r FROM labels)")
def broken_labels(spark, sf_dir):
    """Labelled documents that point to others, some of which there aren't."""
    cases = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.array(F.col("doc_id") * 2, F.col("doc_id") % 7).alias("relevant"))
    return review.broken_labels(cases, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref")))


@_query("SELECT user_id, event_id, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS starts FROM events")
def header_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("part"), "event_id", "event_type")
    return review.header_changes(e, "event_type", "event_id").select(F.col("part").alias("user_id"), "event_id", "starts")


# --- further structure and state ---------------------------------------------


@_query("SELECT count(embedding) > 0 AS ready, CASE WHEN count(embedding) > 0 THEN count(embedding) || ' embedded chunks' ELSE 'no embedded chunks' END AS message FROM embeddings")
def readiness(spark, sf_dir):
    return store.readiness(table(spark, sf_dir, "embeddings"))


@_query("SELECT DISTINCT 'U' || user_id % 40 AS policy_id, event_type AS policy_title, ts::DATE AS last_reviewed FROM events WHERE (2026 - year(ts)) * 12 + 9 - month(ts) > 20")
def stale_policies(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id") % 40).alias("policy_id"), F.col("event_type").alias("policy_title"), F.to_date("ts").alias("last_reviewed"))
    return review.stale_policies(e, F.to_date(F.lit("2026-09-10")), 20)


@_query("""
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag) AS l_linenumber, 10 + 4 * (l_quantity::INT % 3) AS size, l_returnflag = 'R' AS bold, 'line ' || l_partkey AS text FROM lineitem),
b AS (SELECT l_orderkey, size AS body FROM (SELECT l_orderkey, size, count(*) AS n, min(l_linenumber) AS seen FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen) = 1),
h AS (SELECT l.*, size >= body * 1.15 OR (bold AND size >= body) AS heading FROM l JOIN b USING (l_orderkey)),
r AS (SELECT l_orderkey, size, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY size DESC) - 1 AS level FROM h WHERE heading),
s AS (SELECT h.*, sum(heading::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS section FROM h),
p AS (SELECT s.l_orderkey, section, max(r.level) FILTER (heading) AS level, max(text) FILTER (heading) AS heading, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY l_linenumber) FILTER (NOT heading), '') AS body
      FROM s LEFT JOIN (SELECT DISTINCT * FROM r) r ON r.l_orderkey = s.l_orderkey AND r.size = s.size GROUP BY ALL)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY section) - 1)::INT AS ordinal, coalesce(level, 0)::INT AS level, heading, body FROM p""")
def line_sections(spark, sf_dir):
    """Lines of an order as lines of a page, of three sizes and some of them bold."""
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", number.alias("line_no"), F.concat(F.lit("line "), "l_partkey").alias("text"), (10 + 4 * (F.col("l_quantity").cast("int") % 3)).cast("double").alias("size"), (F.col("l_returnflag") == "R").alias("bold"))
    return structure.line_sections(lines, "l_orderkey")


_SECTION_ROWS = """
x AS (SELECT l_orderkey, l_linenumber % 3 + 1 AS hd, l_shipdate::VARCHAR AS heading, l_quantity || ' of ' || l_partkey AS body, l_linenumber || '|' || hd || '|' || (l_returnflag <> 'R') || '|' || heading || '|' || body AS place FROM lineitem)
"""


@_query(f"WITH {_SECTION_ROWS} SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY place) - 1)::INT AS ordinal, (hd - min(hd) OVER (PARTITION BY l_orderkey))::INT AS level, heading, body FROM x")
def xml_sections(spark, sf_dir):
    return structure.sections(_xml(spark, sf_dir), "l_orderkey", "xml", structure.xml_sections)


@_query("SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'xml' ELSE 'html' END AS extracted_from, CASE WHEN l_orderkey % 2 = 0 THEN count(*) ELSE 1 END AS sections FROM lineitem GROUP BY l_orderkey")
def format_fallback(spark, sf_dir):
    """Every other order's XML is broken; its HTML stands in."""
    d = _xml(spark, sf_dir).select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, F.col("xml")).otherwise("<RULE").alias("xml"), F.concat(F.lit("<h1>Order</h1><p>"), "l_orderkey").alias("html"))
    found = structure.with_fallback(d, "l_orderkey", {"xml": ("xml", structure.xml_sections), "html": ("html", structure.html_sections)})
    return found.groupBy("l_orderkey", "extracted_from").agg(F.count("*").alias("sections"))


@_query("SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE embedding IS NOT NULL")
def vector_coercion(spark, sf_dir):
    """Vectors written as text and read back."""
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", "), F.lit("]"))
    v = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", vector.as_vector(text).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@_query("""
SELECT event_type || '.json' AS file, event_type AS label, format('{:.3f}', round(avg(value) / 1000, 3)) AS recall_1, CASE WHEN event_type = 'error' THEN 'n/a' ELSE format('{:.3f}', round(min(value) / 1000, 3)) END AS mrr, format('{:.3f}', round(max(value) / 1000, 3)) AS separation FROM events GROUP BY event_type""")
def runs_compared(spark, sf_dir):
    part = lambda f: F.round(f("value") / 1000, 3)
    runs = table(spark, sf_dir, "events").groupBy("event_type").agg(part(F.avg).alias("recall_1"), part(F.min).alias("mrr"), part(F.max).alias("separation"))
    runs = runs.select(F.concat("event_type", F.lit(".json")).alias("file"), F.col("event_type").alias("label"), "recall_1", F.when(F.col("event_type") != "error", F.col("mrr")).alias("mrr"), "separation")
    return review.runs_compared(runs)


@_query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id || '. ' || lang WHEN 1 THEN doc_id || ' ' || lang WHEN 2 THEN lang ELSE '[section ' || doc_id || ']' END AS label FROM documents""")
def section_labels(spark, sf_dir):
    i = F.col("doc_id")
    heading = F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit(". "), F.col("lang"))).when(i % 4 < 3, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", structure.label(heading, F.when(i % 4 < 2, i.cast("string")), i).alias("label"))
