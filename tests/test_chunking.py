from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import chunking as C

SENTENCE = "The records shall be kept for a period of six years after the event."


def test_short_text_is_whole_and_empty_has_none():
    assert C.pieces(" short ") == ["short"] and C.pieces(" \n ") == []


def test_wall_of_text_is_cut_between_sentences():
    got = C.pieces(" ".join([SENTENCE] * 90))
    assert len(got) > 1 and all(p.endswith(".") and p.startswith("The") for p in got) and max(map(len, got)) <= C.MAXIMUM


def test_scrap_joins_its_predecessor():
    assert C.pieces("\n\n".join([SENTENCE * 17] * 2 + ["Tail."]))[-1].endswith("Tail.")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.sampled_from(["\n\n", " "]))
def test_nothing_is_lost(sizes, glue):
    text = glue.join(" ".join([SENTENCE] * n) for n in sizes)
    assert " ".join(" ".join(C.pieces(text)).split()) == " ".join(text.split())


def test_context_is_repeated(spark):
    long = " ".join([SENTENCE] * 60)
    df = spark.createDataFrame([(1, "ctx", long), (2, "", "x"), (3, None, None)], "id long, c string, text string")
    got = C.chunks(df, context="c").orderBy("id", "part").collect()
    assert all(r.text.startswith("ctx\n") and r.of_parts == len(got) - 1 for r in got if r.id == 1)
    assert [r.text for r in got if r.id == 2] == ["x"] and not [r for r in got if r.id == 3]
    assert [r.part for r in got if r.id == 1] == list(range(len(got) - 1))


def test_sections_and_clauses(spark):
    s = spark.createDataFrame([(7, 0, "T" * 100, "1.2", "Scope", "short body"), (7, 1, "", None, "", "A sentence here. " * 200), (8, 0, "T", "1.2", None, " ")], "document long, ordinal int, title string, ref string, heading string, body string")
    got = {(r.ref, r.part): r for r in C.section_chunks(s).collect()}
    assert got["7:0:1.2", 0].text == "T" * 90 + " — 1.2 — Scope\nshort body" and got["7:0:1.2", 0].of_parts == 1
    assert got["7:1:x", 0].context == "" and got["7:1:x", 0].of_parts == len(got) - 1 > 1 and all(k[0] != "8:0:1.2" for k in got)
    c = spark.createDataFrame([("P §1", "T", "S", "H", "x" * 5000, "T — S — H\nx")], "clause_id string, policy_title string, section string, heading string, text string, retrieval_text string")
    assert tuple(C.clause_chunks(c).first()) == ("P §1", "T — S — H\nx", "x" * 5000, "T — S — H", 0, 1)


def test_long_batches_are_cut_in_parts(spark, monkeypatch):
    """A part of a batch at a time, with the other columns beside each piece; no row is lost at the borders."""
    monkeypatch.setattr(C, "PART_BYTES", 50)
    rows = [(k, "x" * (k % 7) * 20 if k % 5 else None, f"s{k}" if k % 3 else None) for k in range(60)]
    got = C.chunks(spark.createDataFrame(rows, "k long, text string, source string"), context="source")
    assert got.columns == ["k", "source", "text", "body", "context", "part", "of_parts"]
    want = sorted((k, s, f"{s}\n{t}" if s else t, t, s or "", 0, 1) for k, t, s in rows if t)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
