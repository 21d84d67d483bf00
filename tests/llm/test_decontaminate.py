import random

import pyarrow as pa

from quillspark.llm import decontaminate as dc


def edits(pattern, text):
    """Fewest edits of pattern against any substring of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        now = [i + 1]
        for j, t in enumerate(text):
            now.append(min(row[j] + (t != p), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def parts(text):
    """Windows of 86 characters at every 43rd, the last one at the end, with the edits that each may have."""
    last = max(len(text) - 86, 0)
    out = [text[a : a + 86] for a in sorted({*range(0, last, 43), last})] if text else []
    return [(x, min(len(x) * 7 // 100, len(x) // 10 - 1)) for x in out]


def holds(item, text):
    item, text = dc.plain_text(item), dc.plain_text(text)
    if len(item) < 10:
        return bool(item) and b" " + item + b" " in b" " + text + b" "
    return any(edits(part, text) <= most for part, most in parts(item))


def brute(docs, items):
    return sorted({(d, i) for d, text in docs for i, item in items if holds(item, text)}, key=str)


def noisy(text, n, rng):
    x = list(text)
    for _ in range(n):
        at = rng.randrange(len(x))
        x[at : at + 1] = rng.choice([[], ["q"], [x[at], "z"]])
    return "".join(x)


def test_finds_all_within_budget(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rng.randrange(3, 50)).capitalize() + ".") for k in range(12)] + [(12, "Été à l'École " * 9), (13, None), (14, "short"), (15, ""), (16, "...")]
    docs = []
    for k in range(90):
        body = noisy(items[k % 13][1], k % 16, rng)
        docs.append((k, prose(20) + "\n" + (body.upper() if k % 5 == 0 else body.replace(" ", ", ")) + " " + prose(20)))
    docs += [(90, None), (91, ""), (92, prose(3000)), (93, items[0][1]), (93, items[0][1]), (None, items[1][1]), (94, prose(4000) + items[2][1]), (95, "a short, one"), (96, "shorter Short"), (97, "short"), (98, "shorts")]
    df = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, edits string")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = dc.leaks(df, bench)
    assert sorted({(r.doc_id, r.item_id) for r in got.collect()}, key=str) == brute(docs, [i for i in items if i[1]])
    whole = [r for r in got.collect() if r.doc_id == 94 and r.item_id == 2][0]
    assert docs[-1][1][whole.first : whole.end].strip() in items[2][1] and whole.end - whole.first >= len(items[2][1]) - 2
    left = dc.without_leaks(df, bench)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in docs if d not in {r.doc_id for r in got.collect()}), key=str)
    assert dc.leaks(df.limit(0), bench).count() == 0 and dc.leaks(df, bench.limit(0)).count() == 0
    assert dc.without_leaks(df, bench.limit(0)).count() == len(docs)


def test_query_finds_planted_passages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bench = [(r.item_id, dc.plain_text(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {(d.doc_id, i) for d in docs for i, t in bench if t in dc.plain_text(d.text)}
    got = {(r.doc_id, r.item_id) for r in dc.op8_decontamination(spark, sf).collect()}
    assert whole and whole <= got


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 60)
    items = [(k, chr(97 + k) * 3 + " some passage of text number " + "xyz"[k] * 20) for k in range(3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(dc.blocks(bench))) == 3
    df = spark.createDataFrame([(k, "intro " + t + " outro") for k, t in items] + [(9, "nothing")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(df, bench).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert [r.doc_id for r in dc.without_leaks(df, bench).collect()] == [9]


def test_items_of_every_length_are_found(spark):
    rng = random.Random(5)
    items = [(n, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))) for n in range(1, 100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(n, f"0123 {t} 4567") for n, t in items], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(df, bench).collect()) == sorted(brute([(n, f"0123 {t} 4567") for n, t in items], items))
    assert not dc.without_leaks(df, bench).count()
    # as many edits as the length allows, spread evenly, by the items alone
    most = {n: min(int(0.07 * n), n // 10 - 1) for n in range(10, 100)}
    worn = [(n, "".join("#" if any(c == n * (k + 1) // (most[n] + 1) for k in range(most[n])) else x for c, x in enumerate(t))) for n, t in items if n >= 10]
    df = spark.createDataFrame(worn, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(df, bench).collect()) == [(n, n) for n in range(10, 100)]


def test_quotes_of_a_part_of_an_item(spark):
    """Any stretch of SEGMENT + STRIDE characters is found, wherever it begins."""
    rng = random.Random(9)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(70))
    n = dc.SEGMENT + dc.STRIDE
    rows = [(a, f"{'xyz ' * 30}{item[a : a + n]}{' zyx' * 30}") for a in range(0, len(item) - n, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in dc.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {a for a, _ in rows}


def test_repetitive_texts_are_tallied_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(dc, "HITS", 500)
    items = [(1, "ab " * 60), (2, "the same words again and again " * 4)]
    docs = [(1, "ab " * 400), (2, "xy " + "the same words again and again " * 9), (3, "ba " * 20 + "abab" * 30)]
    got = dc._found(pa.array([t for _, t in docs]), dc.Index([x for i, t in items for x in dc.segments(i, dc.plain_text(t))]))
    assert sorted((docs[row][0], i) for row, found in got for i in found) == brute(docs, items)
