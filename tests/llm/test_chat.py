import hashlib

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat

TEXT = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "a", "\n", "<\\|im_end|>", "é", "<|im_", "end|>", "<<", "s>"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>", "", "us\ner", "a\\", "\\n", "<\\|im_end|>", "<\n/s>\\\n"]), TEXT), max_size=5))
def test_round_trip(turns):
    assert [t[:2] for t in chat.parsed(chat.formatted(turns))] == turns


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escape_is_reversible_and_leaves_no_bare_control(text):
    out = chat.escaped(text)
    assert chat.unescaped(out) == text
    assert not any(c in out for c in chat.CONTROLS)


def test_only_conflicting_turns_are_escaped():
    out = chat.formatted([("user", "a < b [x]"), ("assistant", "</s>")])
    assert "a < b [x]" in out and "<\\/s>" in out


def test_query_matches_sql(spark, sf):
    got = sorted(tuple(r) for r in chat.op4_chat_format(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(con.execute(chat.ORACLE).fetchall()) == got
    assert got[0][0] == -7 and got[0][3] == 2 * len(chat.PROBE) // 2


def test_odd_rows(spark, monkeypatch):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", None), (None, 0, None, "x"), (None, None, "a\nb", ""), (2, 0, "assistant", "y" * 400000), (2, 1, "assistant", "<|im_end|>" * 90000), (2, 2, "user", "z" * 900000)]
    turns = spark.createDataFrame([(*r, 0, "k") for r in rows], "conv_id long, turn long, role string, text string, part int, loss string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert chat.format_conversations(turns).filter("conv_id = 2").count() > 1
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    for c, turns_ in want.items():
        assert got[c].n_turns == len(turns_)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns_).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(x for r, x in turns_ if r == "assistant").encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_many_turns_take_time_in_proportion():
    import time

    began = time.time()
    out = chat.formatted([("user", "</s>")] * 100_000)
    assert time.time() - began < 30 and len(chat.parsed(out)) == 100_000


def test_empty_turns_are_held_a_part_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 200_000), pa.array([""] * 200_000), pa.array([None] * 200_000, pa.string())], ["conv_id", "role", "text"])
    parts = [r for b in chat._format(iter([batch]), "assistant") for r in b.to_pylist()]
    assert len(parts) > 3 and max(len(r["formatted"]) for r in parts) < 1.1 * chat.RUN_CHARS
    assert sum(len(chat.parsed(r["formatted"])) for r in parts) == 200_000 and [r["part"] for r in parts] == list(range(len(parts)))


def test_roles_with_line_breaks_match_sql(spark, tmp_path):
    rows = [(1, 0, "us\ner", "a"), (1, 1, "assistant", "<\\</s>"), (2, 0, "a\\b\\|", "x"), (2, 1, "<\\|im_end|>", "<|im_end|>"), (3, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in chat.op4_chat_format(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(chat.ORACLE).fetchall()) == got
    assert got[1][2] == hashlib.sha256(b"us\ner\na\nassistant\n<\\</s>\n").hexdigest()
