"""Cross-tokenizer alignment against plain Python over the whole texts."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import align

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

ODD = [
    None, "", " ", "a", "\n", "  two  spaces ", "tab\there\nand  lines\n\n", "x▁y", "a ▁ b", "it's <|endoftext|> and </s>[INST] <0x41> <s>", "über — naïve 日本語 text 👩‍👩‍👧 ﬁ①é", "no break   space", "a\x00b",
    "́ combining", "w" * 5000, "so " * 4000, " lead and trail \t ", "1234567 99.5% (x) [y] {z} a_b", "\x1c \x1d x", "\r\n\r\n y", "same text here", "same text here", "ȩ́ o",
]


def plain(texts):
    """Rows in the order of texts, from whole texts without pieces, label strings or Arrow."""
    letters = align.byte_of_letter()
    entry = {v: bytes(letters[c] for c in k) if k != "<|endoftext|>" else k.encode() for k, v in A.get_vocab().items()}
    cut = []
    for t in texts:
        want = (" " + (t or "")).encode()
        a, b = A.encode(" " + (t or ""), add_special_tokens=False).ids, B.encode(t or "")
        spelt = []
        for k in b:
            p = B.id_to_piece(k)
            spelt.append(bytes([int(p[3:5], 16)]) if B.is_byte(k) else p.replace("▁", " ").encode())
        if not t or b"".join(entry[k] for k in a) != want or b"".join(spelt) != want:
            cut.append(None)
            continue
        ends = [[], []]
        for side, sizes in enumerate(([len(entry[k]) for k in a], [len(x) for x in spelt])):
            at = 0
            for n in sizes:
                at += n
                ends[side].append(at)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in both:
            m, n = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append((a[i:m], b[j:n]))
            i, j = m, n
        cut.append((len(a), len(b), groups))
    pairs = Counter((g[0][-1], g[1][-1]) for c in cut if c for g in c[2])
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for c in cut:
        if c is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in c[2]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in c[2])
        out.append((c[0], c[1], len(c[2]), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_query_against_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").toPandas()
    assert rows(align.op11_alignment(spark, sf)) == plain([None if t is None else str(t) for t in docs["text"]])


def test_odd_texts(spark):
    """Null, empty, mixed white space, special strings, texts one side doesn't spell, long words, repeats."""
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(ODD)], "doc_id long, text string, pairs string").repartition(3)
    table = align.aligned(docs, remembered=5)
    pairs = align.pair_counts(table, B.get_piece_size())
    want = plain(ODD)
    assert rows(align.scored(table, pairs)) == want
    assert rows(align.scored(table, pairs, most_pairs=0)) == want  # by the join
    assert want[0] == want[1] == want[7] == (0, 0, 0, 0, 0, 0, "") and want[2][:3] == (2, 1, 1)


def test_slices_and_sums(spark, monkeypatch):
    """A long text in several slices, and sums given out early, change nothing."""
    monkeypatch.setattr(align, "HELD", 50)
    texts = ["some words of a longer text, " * 3000, "others  and\tmore"] * 2
    aligner = align.Aligner(align.vocabulary_text(public_tokenizers.path("byte_bpe_50k.json")), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read(), 100)
    data = "".join(" " + t for t in texts).encode()
    import numpy as np

    at = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for t in texts])])
    whole = [(*r[:4], r[4].tolist(), r[5].tolist()) for r in aligner.documents(np.frombuffer(data, np.uint8), at)]
    monkeypatch.setattr(align, "SLICE_BYTES", 1000)
    assert [(*r[:4], r[4].tolist(), r[5].tolist()) for r in aligner.documents(np.frombuffer(data, np.uint8), at)] == whole
    assert [r[0] for r in whole] == [p[0] for p in plain(texts)]
    import pyarrow as pa

    from quillspark.llm import common

    blobs = [common.packed(np.array(r[4])) + common.packed(np.array(r[5])) for r in whole]
    batch = pa.RecordBatch.from_arrays([pa.array([len(r[4]) for r in whole]), pa.array(blobs)], ["n_pairs", "pairs"])
    total = Counter()
    for out in align._counted(iter([batch] * 20)):
        for k, n in zip(out.column("pair").to_pylist(), out.column("n").to_pylist(), strict=True):
            total[k] += n
    want = Counter()
    for r in whole:
        for k, n in zip(r[4], r[5], strict=True):
            want[k] += 20 * n
    assert total == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    table = align.aligned(docs)
    assert align.scored(table, align.pair_counts(table, 32000)).collect() == []
