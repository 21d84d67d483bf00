import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import token_output as out

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = out.PieceEncoder(out.vocabulary_text(PATH), 4)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abÉ 's\n\t\r \x1c.,!1 \n"), max_size=30), max_size=4))
def test_pieces_encode_as_whole_texts(texts):
    texts = [*texts, "a  <|endoftext|> b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER(texts)] == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_ordinary_prose_takes_the_fast_way(sf):
    import duckdb

    texts = [t for (t,) in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER(texts)] == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def hashed(text):
    """Spark's xxhash64, signed; a null hashes to the seed."""
    return 42 if text is None else np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64).item()


def expected(rows):
    return in_order(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed(r[1]))))


def in_order(rows):
    done, at = [], 0
    for d, t in rows:
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2]
        done.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return done


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [tuple(r) for r in out.op10_token_output(spark, sf).collect()]
    assert sorted(got) == sorted(expected([(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 1), (2, "x y", 1), (2, "x y", 1), (2, None, 1), (None, "last", 1), (-5, "word " * 50000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value int")
    assert sorted((tuple(r)[:4] for r in out.encoded(docs).collect()), key=str) == sorted(expected([r[:2] for r in rows]), key=str)
    assert out.encoded(docs.limit(0)).count() == 0


def test_frames_stand_alone_and_are_checked():
    build = out.FileBuilder(2, 8, 3)
    docs = [[1, 2, 3], [4], [], [5, 6, 7, 8, 9], [10]]
    for k, d in enumerate(docs):
        build.add(k, np.array(d, "<u2").tobytes())
    content = build.content(0, 0) + out.TAIL
    file = out.SeekableFile.of(content)
    assert [file.tokens(k).tolist() for k in (4, 0, 2, 3, 1)] == [docs[k] for k in (4, 0, 2, 3, 1)]
    plain = b"".join(file.frame(k) for k in range(len(file.seek)))
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(content).startswith(plain[:20])
    broken = bytearray(content)
    broken[file.offsets[1] + 6] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        out.SeekableFile.of(bytes(broken)).frame(1)


def test_a_special_string_and_other_white_space_inside_texts():
    texts = ["a <|endoftext|> b, c", "x\u00a0 y\u2003\n z\u3000 w", "\u4f60\u597d \u4e16\u754c, don't stop.Now", " ", "\n\n", "", "don't,' 'x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER(texts)] == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_files_keep_the_order_in_which_rows_were_written(spark, tmp_path):
    rows = [(k * 37 % 101, f"text {k}") for k in range(101)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(5, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(f"{tmp_path}/all")
    docs = spark.read.parquet(f"{tmp_path}/all")
    got = [tuple(r)[:4] for r in out.encoded(docs, order=out.written_order(), text_bytes_each=100).orderBy("start").collect()]
    assert got == in_order(sorted(rows, reverse=True))


def test_readers_fetch_only_what_they_need(spark, tmp_path):
    """And the writer's line end is the format's magic number: the files are as the format says, byte by byte."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(300))) for k in range(300)]
    path = f"{tmp_path}/tokens"
    out.encoded(spark.createDataFrame(rows, "doc_id long, text string"), path=path, frame_bytes=4096).collect()
    files = sorted(p for p in (tmp_path / "tokens").iterdir() if p.name.startswith("part-"))
    whole = files[0].read_bytes()
    assert whole.endswith(out.TAIL) and len(out.SeekableFile.of(whole).seek) > 20
    fetched = []

    class Counting(out.SeekableFile):
        def __init__(self, read, size):
            super().__init__(lambda at, n: fetched.append(n) or read(at, n), size)

    file = Counting.at(spark, str(files[0]))
    k = len(file.doc_ids) // 2
    want = TOKENIZER.encode(dict(rows)[file.doc_ids[k]], add_special_tokens=False).ids
    assert file.tokens(k).tolist() == [*want, 2] and sum(fetched) < len(whole) / 5
    with pytest.raises(ValueError):
        out.SeekableFile.of(b"short")


def test_special_strings_take_time_in_proportion():
    """Texts that hold a special token's string are marked in one pass: twice as many take about twice the time."""
    vocabulary = out.vocabulary_text(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, library = out.PieceEncoder(vocabulary, 2), Tokenizer.from_str(vocabulary)
    took = []
    for n in (5_000, 10_000):
        texts = [f"a few words <|endoftext|> and others {k % 50}" if k % 3 else "" for k in range(n)]
        raw = [t.encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        encoder._forget()
        began = time.thread_time()
        ids, upto = encoder.encoded(np.frombuffer(b"".join(raw), np.uint8), at)
        took.append(time.thread_time() - began)
    assert took[1] < 4 * took[0] + 0.2
    for k in (1, 2, 3, n - 1):
        assert ids[upto[k] : upto[k + 1]].tolist() == library.encode(texts[k], add_special_tokens=False).ids
