import html
import re
import zlib

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())


def test_queries_without_sql_match_plain_python(spark, sf):
    """The parser, the diff and the embedder, whose results are held against plain code row by row."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"word_diff", "embed_documents"}
    got = {}
    for r in catalog.html_sections(spark, sf).collect():
        got.setdefault(r.page_id, []).append((r.ordinal, r.level, r.heading, r.body))
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        # the pages have one article, whose blocks begin at their tags and end where a block or a container ends
        article = re.search(r"(?s)<article>(.*)</article>", re.sub(r"(?s)<!--.*?-->|<(script|style|footer|nav|aside|header)\b.*?</\1>", "", page.html))[1]
        blocks, open_ = [], []
        for tag, text in re.findall(r"(<[^>]*>)|([^<]+)", article):
            name = re.match(r"</?(\w+)", tag)[1] if tag else None
            if tag.startswith("</") and name in open_names(open_):
                while open_.pop()[0] != name:
                    pass
            elif tag and not tag.startswith("</"):
                if name in ("p", "h1") and "p" in open_names(open_):
                    while open_.pop()[0] != "p":
                        pass
                if name == "br":
                    text = " "
                else:
                    open_.append((name, []))
                    if name in ("p", "li", "h1"):
                        blocks.append(open_[-1])
            if text:
                for name, own in reversed(open_):
                    if name in ("p", "li", "h1"):
                        own.append(html.unescape(text))
                        break
        shown = [(n, " ".join("".join(t).split())) for n, t in blocks]
        heading = next(t for n, t in shown if n == "h1")
        body = "\n\n".join(t for n, t in shown if n != "h1" and t)
        assert got[page.page_id] == [(0, 0, heading, body)]
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    for r in catalog.word_diff(spark, sf).collect():
        before = max((k for k in turns if k[0] == r.conv_id and k[1] < r.turn), default=None)
        old, new = (turns[before] or "").split() if before else [], (turns[r.conv_id, r.turn] or "").split()
        marks = re.sub(r"\[\+(.*?)\+\]", r"\1", re.sub(r"\[-.*?-\]", "", r["diff"], flags=re.S), flags=re.S).split()
        kept = re.sub(r"\[-(.*?)-\]", r"\1", re.sub(r"\[\+.*?\+\]", "", r["diff"], flags=re.S), flags=re.S).split()
        assert marks == new and kept == old
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for r in catalog.embed_documents(spark, sf).collect():
        v = [0.0] * 64
        for w in texts[r.item_id].lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 16 & 1 else -1
        n = sum(x * x for x in v) ** 0.5
        assert r.embedding == pytest.approx([x / n for x in v], abs=1e-6)


def open_names(open_):
    return [n for n, _ in open_]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_prune_and_push(spark, sf):
    plan = catalog.queries()["vector_topk_filtered"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan
    plan = catalog.queries()["content_hash_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "lang" not in plan
