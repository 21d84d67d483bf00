import pyarrow as pa

from quillspark.functions.batches import parts


def test_parts_are_bounded_and_whole():
    text = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c", "d"]), pa.array(range(5))], ["t", "k"])
    own = list(parts(iter([text, text.slice(0, 0)]), "t", 20))
    assert [b.column("k").to_pylist() for b in own] == [[0, 1], [2], [3, 4]]
    lists = pa.RecordBatch.from_arrays([pa.array([["x"] * 3, [], None, ["y"] * 9, ["z"]])], ["t"])
    assert [b.num_rows for b in parts(iter([lists]), "t", 4)] == [3, 1, 1]
