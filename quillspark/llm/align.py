"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often which pair does.

Every byte of a text gets a label: no token ends here, one of A does, one of B, or both. A regular expression scans the
labels for spans up to each "both"; the labels in a span say how many tokens of either side form that group. As
no token of either vocabulary goes on from a character that isn't white space to a space, texts are cut there, and each
distinct piece is encoded, labelled and scanned once.

Pair counts are summed per task before they are shuffled. They go back to the documents by broadcast where their number is
checked to be small, and by a join on the pair beyond.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.token_output import PieceEncoder, vocabulary_text

#: Distinct pieces that a worker remembers, and bytes of text that are looked at together.
REMEMBERED, SLICE_BYTES = 500_000, 4 << 20
#: Pairs of ids that go to all tasks at once, at most; twelve bytes each.
MOST_PAIRS = 1 << 21
#: Entries of pairs that a task holds before it sums them.
HELD = 1 << 21

#: Labels of a byte: no end, A's end, B's end, both.
LABELS = np.frombuffer(b".AB=", np.uint8)
SPAN = re.compile(rb"[^=]*=")

_INK = np.zeros(256, bool)
_INK[33:127] = True


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def entries_a(vocabulary: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    letters, known = byte_of_letter(), Tokenizer.from_str(vocabulary).get_vocab()
    out = [b""] * (max(known.values()) + 1)
    for entry, k in known.items():
        out[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return out


def entries_b(pieces: list[str]) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    hexed = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
    return [bytes([int(m[1], 16)]) if (m := hexed(p)) else p.replace("▁", " ").encode() for p in pieces]


def space_starts(data: np.ndarray) -> np.ndarray:
    """Places of spaces after a character that isn't white space."""
    space, before = data[1:] == 0x20, data[:-1]
    cut = space & _INK[before]
    for k in np.flatnonzero(space & (before >= 0x80)).tolist():  # the character before has several bytes
        last = data[max(0, k - 3) : k + 1].tobytes().decode(errors="ignore")[-1:]
        cut[k] = last not in ("", "▁") and not last.isspace()
    return np.flatnonzero(cut) + 1


class Aligner:
    """Groups and links of pieces of text, each distinct piece looked at once."""

    def __init__(self, vocabulary: str, model: bytes, remembered: int = REMEMBERED):
        import sentencepiece

        # literal: strings of special tokens inside texts are plain text
        self.a, self.b, self.remembered = PieceEncoder(vocabulary, 4, 0, literal=True), sentencepiece.SentencePieceProcessor(model_proto=model), remembered
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_a, self.bytes_b = entries_a(vocabulary), entries_b(pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # ids as text with the mark that follows them
        self.marked = [b"%d%c" % (k, mark) for side, marks in ((self.bytes_a, b",|"), (self.bytes_b, b",;")) for mark in marks for k in range(len(side))]
        self.marked_size = np.array([len(x) for x in self.marked], np.int64)
        self.space = self.b.piece_to_id("▁")
        self.cuts = self.a.cuts and not any(re.search("[^▁]▁", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.counts, self.links, self.ends = np.zeros((1 << 14, 3), np.int32), np.zeros(1 << 16, np.int64), np.zeros((1 << 14) + 1, np.int64)

    def _whole(self, ids: np.ndarray, upto: np.ndarray, entries: list[bytes], data: bytes, at: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes are those of the piece, a piece."""
        if b"".join(map(entries.__getitem__, ids.tolist())) == data:
            return np.ones(len(at) - 1, bool)
        return np.array([b"".join(map(entries.__getitem__, ids[i:j].tolist())) == data[x:y] for i, j, x, y in zip(upto, upto[1:], at, at[1:], strict=False)], bool)

    def _learn(self, pieces: list[bytes]) -> None:
        data, at = b"".join(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        ids_a, upto_a = self.a.encoded(np.frombuffer(data, np.uint8), at)
        # B adds the piece's first space itself, but not to nothing
        found = [x if x else [self.space] for x in self.b.encode([p[1:].decode() for p in pieces], num_threads=1)]
        upto_b = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        ids_b = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(upto_b[-1]))
        good = self._whole(ids_a, upto_a, self.bytes_a, data, at) & self._whole(ids_b, upto_b, self.bytes_b, data, at)
        if not good.all():  # pieces without tokens leave nothing behind
            keep_a, keep_b = np.repeat(good, np.diff(upto_a)), np.repeat(good, np.diff(upto_b))
            ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
        sizes = np.where(good, np.diff(at), 0)
        label = np.zeros(int(sizes.sum()), np.uint8)
        label[np.cumsum(self.size_a[ids_a]) - 1] |= 1
        label[np.cumsum(self.size_b[ids_b]) - 1] |= 2
        spans = pa.array(SPAN.findall(LABELS[label].tobytes()), pa.binary()).dictionary_encode()
        kinds = np.array([(len(s), s.count(b"A") + 1, s.count(b"B") + 1) for s in spans.dictionary.to_pylist()], np.int64).reshape(-1, 3)
        upto = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(kinds[spans.indices.to_numpy()], axis=0)])  # bytes, tokens of A and of B before each group
        until, tokens_a, tokens_b = upto.T
        links = ids_a[tokens_a[1:] - 1].astype(np.int64) * len(self.bytes_b) + ids_b[tokens_b[1:] - 1]
        # the groups' text: A's tokens of a group come before B's, and a group's last token is followed by another mark
        words = np.empty(len(ids_a) + len(ids_b), np.int64)
        of_a, of_b = np.repeat(np.arange(len(links)), np.diff(tokens_a)), np.repeat(np.arange(len(links)), np.diff(tokens_b))
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[tokens_a[1:] - 1], last_b[tokens_b[1:] - 1] = True, True
        words[np.arange(len(ids_a)) + tokens_b[of_a]] = ids_a + last_a * len(self.bytes_a)
        words[np.arange(len(ids_b)) + tokens_a[of_b + 1]] = ids_b + last_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        text = b"".join(map(self.marked.__getitem__, words.tolist()))
        letters = np.concatenate([[0], np.cumsum(self.marked_size[words])])
        n, held = len(self.texts), int(self.ends[len(self.texts)])
        each = np.searchsorted(until[1:], np.cumsum(sizes), "right")
        counts = np.stack([np.where(good, np.diff(upto_a), -1), np.diff(upto_b), np.diff(each, prepend=0)], axis=1)
        while len(self.counts) < n + len(pieces):
            self.counts, self.ends = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.links) < held + len(links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.counts[n : n + len(pieces)], self.links[held : held + len(links)] = counts, links
        self.ends[n + 1 : n + len(pieces) + 1] = held + each
        ends = letters[tokens_a[each] + tokens_b[each]].tolist()
        self.texts += [text[x : y - 1] if y > x else b"" for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        self.slots.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def slots_of(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Place in memory of each piece between edges."""
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(data)]).dictionary_encode()
        kinds = pieces.dictionary.to_pylist()
        if len(self.slots) > self.remembered:
            self._forget()
        found = list(map(self.slots.get, kinds))
        unseen = [p for p, k in zip(kinds, found, strict=True) if k is None] if None in found else []
        for lo in range(0, len(unseen), 1 << 15):
            self._learn(unseen[lo : lo + (1 << 15)])
        if unseen:
            found = [self.slots[p] if k is None else k for p, k in zip(kinds, found, strict=True)]
        return np.array(found, np.int64)[pieces.indices.to_numpy()]

    def documents(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, bytes, np.ndarray, np.ndarray]]:
        """For each text, given with a space before it: tokens of A, of B, groups, hex digest of the groups, its different links and their counts."""
        whole = np.zeros(len(data) + 1, bool)
        whole[at] = True
        if self.cuts:
            whole[space_starts(data)] = True
        edges = np.flatnonzero(whole)
        of = np.searchsorted(edges, at)
        run = (-1, np.zeros(0, np.int64), 0)  # edges [from, to) whose slots are known
        for k in range(len(at) - 1):
            lo, hi = int(of[k]), int(of[k + 1])
            if at[k + 1] - at[k] == 1:  # an empty text
                yield 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            sums, digest, seen, first, good = np.zeros(3, np.int64), hashlib.sha256(), [], True, True
            while lo < hi and good:
                if not run[0] <= lo < run[2]:
                    end = max(lo + 1, int(np.searchsorted(edges, edges[lo] + SLICE_BYTES, "right")) - 1)
                    run = (lo, self.slots_of(data, edges[lo : end + 1]), end)
                upto = min(hi, run[2])
                slots = run[1][lo - run[0] : upto - run[0]]
                counts = self.counts[slots]
                good = bool((counts[:, 0] >= 0).all())
                sums += counts.sum(axis=0, dtype=np.int64)
                digest.update((b"" if first else b";") + b";".join(map(self.texts.__getitem__, slots.tolist())))
                begin, size = self.ends[slots], counts[:, 2].astype(np.int64)
                before = np.cumsum(size) - size
                seen.append(np.unique(self.links[np.repeat(begin - before, size) + np.arange(int(size.sum()))], return_counts=True))
                lo, first = upto, False
            if not good:
                yield 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            links, n = seen[0] if len(seen) == 1 else summed(np.concatenate([s[0] for s in seen]), np.concatenate([s[1] for s in seen]))
            yield int(sums[0]), int(sums[1]), int(sums[2]), digest.hexdigest().encode(), links, n


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of n of each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


#: A worker's aligner, which lives as long as the worker.
_ALIGNERS: dict[tuple[str, bytes, int], Aligner] = {}


def aligner_for(vocabulary: str, model: bytes, remembered: int) -> Aligner:
    key = (vocabulary, model, remembered)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


_OUT = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "n_pairs": pa.int64(), "pairs": pa.binary()}


def _align(batches: Iterator[pa.RecordBatch], vocabulary: str, model: bytes, remembered: int) -> Iterator[pa.RecordBatch]:
    aligner = aligner_for(vocabulary, model, remembered)
    for batch in batches:
        large = lambda s: pa.scalar(s, pa.large_string())
        text = pc.binary_join_element_wise(large(" "), pc.fill_null(batch.column("text").cast(pa.large_string()), ""), large(""))
        data, at = common.raw_strings(text)
        for i, j in common.slices(at, SLICE_BYTES):
            rows = list(aligner.documents(data[at[i] : at[j]], at[i : j + 1] - at[i]))
            n_a, n_b, groups, digests, links, counts = zip(*rows, strict=True)
            blobs = [common.packed(x) + common.packed(n) for x, n in zip(links, counts, strict=True)]
            columns = [batch.column("doc_id").slice(i, j - i).cast(pa.int64()), n_a, n_b, groups, [d.decode() for d in digests], [len(x) for x in links], blobs]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _OUT.values(), strict=True)], list(_OUT))
    common.trimmed()


def _pairs(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    links, at = common.unpacked(blob, 0, n)
    counts, _ = common.unpacked(blob, at, n)
    return links.astype(np.int64), counts.astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pairs over the documents of a task, given out whenever there are many different ones."""
    kept, held = [], 0

    def given(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    def shrunk() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in kept]), np.concatenate([n for _, n in kept]))

    for batch in batches:
        for n, blob in zip(batch.column("n_pairs").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            if n:
                kept.append(_pairs(blob, n))
                held += n
            if held > HELD:
                one = shrunk()
                if len(one[0]) > HELD // 2:
                    yield given(*one)
                    kept, held = [], 0
                else:
                    kept, held = [one], len(one[0])
    if kept:
        yield given(*shrunk())


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, count, best): how many links hold a pair of ids, and whether no other pair of that B id has more."""
    counts = common.checkpointed(aligned.filter("n_pairs > 0").select("n_pairs", "pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count")))
    counts = counts.select("pair", F.expr(f"pair div {size_b}").alias("a"), (F.col("pair") % size_b).alias("b"), "count")
    # one row a B id: as many as the vocabulary has
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))
    return counts.join(F.broadcast(most) if size_b <= 1 << 20 else most, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def _scored(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    pairs, count, best = known.value
    for batch in batches:
        n_best, total, n_links = [], [], []
        for n, blob in zip(batch.column("n_pairs").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            links, times = _pairs(blob, n) if n else (np.zeros(0, np.int64),) * 2
            place = np.searchsorted(pairs, links)
            n_best.append(int(times[best[place]].sum()))
            total.append(int((times * count[place]).sum()))
            n_links.append(int(times.sum()))
        columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")] + [pa.array(x, pa.int64()) for x in (n_links, n_best, total)] + [batch.column("groups_sha256")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rid, n, blob in zip(batch.column("rid").to_pylist(), batch.column("n_pairs").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            if n:
                links, times = _pairs(blob, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rid)), pa.array(links), pa.array(times)], ["rid", "pair", "times"])


def aligned(docs: DataFrame, vocabulary_path: str | None = None, model_path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, n_pairs, pairs) for each row of docs (doc_id, text), written to the shared folder.

    pairs are the document's different links, packed. Texts that are null, empty or not spelt by the tokens of both sides have no
    tokens: zeros and no digest. Very long texts are looked at in slices, repeated rows one by one; other columns of docs don't matter.
    """
    import public_tokenizers

    spark = docs.sparkSession
    vocabulary = vocabulary_text(vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"))
    if not json.loads(vocabulary).get("pre_tokenizer"):
        raise ValueError("side A is no byte-level vocabulary")
    with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read(64 << 20)
    ddl = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_pairs long, pairs binary"
    path = common.shared_dir(spark, "aligned")
    docs.select("doc_id", "text").mapInArrow(lambda it: _align(it, vocabulary, model, remembered), ddl).write.parquet(path)
    return spark.read.parquet(path)


def scored(table: DataFrame, pairs: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Documents of ``aligned`` with n_links, n_best and count_sum from ``pair_counts``; up to most_pairs pairs go by broadcast, more by a join."""
    spark, names = table.sparkSession, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    pairs = common.checkpointed(pairs)
    if pairs.limit(most_pairs + 1).count() <= most_pairs:
        known = pairs.select("pair", "count", "best").toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(known.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")))
        return table.mapInArrow(lambda it: _scored(it, sent), ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))
    rows = table.withColumn("rid", F.monotonically_increasing_id())
    rows = common.checkpointed(rows)
    links = common.checkpointed(rows.select("rid", "n_pairs", "pairs").mapInArrow(_exploded, "rid long, pair long, times long"))
    each = common.joined(links, pairs, "pair").groupBy("rid").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return rows.join(each, "rid", "left").na.fill(0, ["n_links", "n_best", "count_sum"]).select(*names)


def op11_alignment(spark, sf_dir) -> DataFrame:
    import sentencepiece

    import public_tokenizers

    table = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size_b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()
    return scored(table, pair_counts(table, size_b))
