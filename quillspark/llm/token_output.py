"""Token-ID output: files of independent zstandard frames with a trailing seek table.

A file holds consecutive documents: token frames (the ids of whole documents end to end, little-endian,
two bytes each where the vocabulary allows), one index frame (which document lies where) and last a seek
table in a skippable frame: each frame's compressed and plain size and the low 32 bits of the XXH64 of its
plain bytes, then the number of frames, a flag byte and a magic number. Any zstandard tool decompresses the
whole; ``SeekableFile`` decompresses only the frames that hold the requested documents and checks them.

Spark's text writer puts down one file per row and commits it, so a lost executor leaves no partial file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import common

# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: The last bytes of every file; the writer adds them as the end of its only "line".
TAIL = struct.pack("<I", SEEKABLE_MAGIC)
#: Pieces whose ids a worker remembers, and bytes of text that are encoded together.
REMEMBERED, SLICE_BYTES = 1_200_000, 4 << 20

# Kinds of bytes: what may begin a piece after a character that isn't white space, what may begin one after a letter, letters.
_GAP, _MARK, _LETTER = (np.zeros(256, bool) for _ in range(3))
_GAP[[0x20, 0x0A]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[33:127] = True
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), ord("'")]] = False
_INK = np.zeros(256, bool)
_INK[33:127] = True


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Places where a new piece begins: a space or line feed after a character that isn't white space, and a mark after an ASCII letter."""
    here, before = data[1:], data[:-1]
    mark = _MARK[here] & _LETTER[before]
    gap = _GAP[here] & _INK[before]
    for k in np.flatnonzero(_GAP[here] & (before >= 0x80)).tolist():  # the character before has several bytes
        last = data[max(0, k - 3) : k + 1].tobytes().decode(errors="ignore")[-1:]
        gap[k] = last != "" and not last.isspace()
    return np.flatnonzero(mark | gap) + 1


class PieceEncoder:
    """Ids of texts as the tokenizers library gives them, each distinct piece encoded by it once.

    The byte-level pattern never joins a character that isn't white space with white space after it, nor a letter with a mark
    after it (an apostrophe apart), so texts may be cut there and the pieces' ids put end to end. Pieces are told apart
    by Arrow, many texts at once; a text that holds a special token's string is one piece, unless those are plain text (literal).
    Other vocabularies get whole texts.
    """

    def __init__(self, vocabulary: str, width: int, remembered: int = REMEMBERED, literal: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.remembered = Tokenizer.from_str(vocabulary), f"<u{width}", remembered
        self.tokenizer.encode_special_tokens = literal
        self.special = [] if literal else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        how = json.loads(vocabulary)
        before = how.get("pre_tokenizer") or {}
        self.cuts = how.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.feed = self._ids(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, self.kind), np.zeros((1 << 14) + 1, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, held = len(self.slots), int(self.ends[len(self.slots)])
        while len(self.ids) < held + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ends) < n + len(pieces) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[held : held + len(ids)] = ids
        self.ends[n + 1 : n + len(pieces) + 1] = held + np.cumsum(sizes)
        self.slots.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _learn(self, pieces: list[bytes]) -> None:
        """A space and a word go to the library many at a time, with line feeds between, which no token crosses; others each by itself."""
        # the first byte after the space and the last byte are no white space, and there is no line feed
        likely = re.compile(rb" [!-~\xc3][^\n]*(?<=[!-~])").fullmatch if self.cuts and len(self.feed) == 1 else lambda p: None
        plain, other = [], []
        for p in pieces:
            (plain if likely(p) else other).append(p)
        if any(s in b"\n".join(plain) for s in self.special):
            plain, other = [], pieces
        for lo in range(0, len(plain), 256):
            part = plain[lo : lo + 256]
            ids = self._ids([b"\n".join(part).decode()])[0]
            cut = np.flatnonzero(ids == self.feed[0])
            if len(cut) != len(part) - 1:
                raise RuntimeError("the vocabulary joins line feeds with words")
            self._add(part, np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
        for lo in range(0, len(other), 256):
            part = other[lo : lo + 256]
            ids = self._ids([p.decode() for p in part])
            self._add(part, np.concatenate(ids), np.array([len(x) for x in ids]))

    def encoded(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (UTF-8 bytes end to end, n + 1 offsets) end to end, and the ids before each text."""
        whole = np.zeros(len(data) + 1, bool)
        whole[at] = True
        if self.cuts and len(data):
            starts = piece_starts(data)
            if self.special:  # no piece begins inside a text with a special token
                places = [m.start() for m in re.finditer(b"|".join(map(re.escape, self.special)), data.tobytes())]
                special = np.zeros(len(at), bool)
                special[np.searchsorted(at, places, "right") - 1] = True
                starts = starts[~special[np.searchsorted(at, starts, "right") - 1]]
            whole[starts] = True
        edges = np.flatnonzero(whole)
        if len(edges) < 2:
            return np.zeros(0, self.kind), np.zeros(len(at), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        kinds = pieces.dictionary.to_pylist()
        if len(self.slots) > self.remembered:
            self._forget()
        found = list(map(self.slots.get, kinds))
        unseen = [p for p, k in zip(kinds, found, strict=True) if k is None] if None in found else []
        if unseen:
            self._learn(unseen)
            found = [self.slots[p] if k is None else k for p, k in zip(kinds, found, strict=True)]
        slot = np.array(found, np.int64)[pieces.indices.to_numpy()]
        first, size = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        upto = np.concatenate([[0], np.cumsum(size)])
        out = self.ids[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
        if any(len(p) > 1000 for p in unseen):  # whole texts aren't remembered
            self._forget()
        return out, upto[np.searchsorted(edges, at)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        data, at = common.raw_strings(pa.array(texts, pa.large_string()))
        ids, upto = self.encoded(data, at)
        return [ids[a:b].tobytes() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


#: A worker's encoders, which live as long as the worker.
_ENCODERS: dict[tuple[str, int, int], PieceEncoder] = {}


def encoder_for(vocabulary: str, width: int, remembered: int) -> PieceEncoder:
    key = (vocabulary, width, remembered)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


class FileBuilder:
    """Bytes of one file, documents added in order."""

    def __init__(self, width: int, frame_bytes: int, level: int):
        self.width, self.frame_bytes, self.press = width, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.seek, self.plain = bytearray(), [], bytearray()
        self.ids, self.counts, self.frames = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.width)
        self.frames.append(len(self.seek))
        self.plain += ids
        if len(self.plain) >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        plain, self.plain = bytes(self.plain), bytearray()
        frame = self.press.compress(plain)
        self.out += frame
        self.seek.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def content(self, partition: int, number: int) -> bytes:
        """All but the tail."""
        if self.plain:
            self._frame()
        known = np.array([i is not None for i in self.ids], np.uint8)
        self.plain += struct.pack("<IIIQ", self.width, partition, number, len(self.ids)) + known.tobytes()
        self.plain += np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.frames, "<u4").tobytes()
        self._frame()
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IB", len(self.seek), CHECKSUM_FLAG)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(TAIL)) + table


class SeekableFile:
    """Reads documents out of a file frame by frame, given read(first byte, number of bytes) and the file's size.

    Only the seek table, the index frame and the frames that hold the requested documents are read.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        tail = read(max(0, size - 9), min(size, 9))
        count, flag, magic = struct.unpack("<IBI", tail) if len(tail) == 9 else (0, 0, 0)
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end")
        self.read = read
        self.seek = np.frombuffer(read(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        index = self.frame(count - 1)
        self.width, self.partition, self.number, n = struct.unpack("<IIIQ", index[:20])
        known = np.frombuffer(index, np.uint8, n, 20)
        self.doc_ids = [i if k else None for i, k in zip(np.frombuffer(index, "<i8", n, 20 + n).tolist(), known, strict=True)]
        self.counts = np.frombuffer(index, "<u8", n, 20 + 9 * n).astype(np.int64)
        self.frames = np.frombuffer(index, "<u4", n, 20 + 17 * n).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        first = np.searchsorted(self.frames, self.frames)
        self.within = self.starts - (self.starts[first] if n else 0)
        self._last: tuple[int, bytes] = (-1, b"")

    @classmethod
    def of(cls, content: bytes) -> SeekableFile:
        return cls(lambda at, n: content[at : at + n], len(content))

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> SeekableFile:
        """A file in any storage that Spark reads, by ranges, on the driver."""
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stream = fs.open(where)

        def read(at: int, n: int) -> bytes:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

        return cls(read, fs.getFileStatus(where).getLen())

    def frame(self, k: int) -> bytes:
        size, plain, check = (int(x) for x in self.seek[k])
        out = zstandard.ZstdDecompressor().decompress(self.read(int(self.offsets[k]), size), max_output_size=max(plain, 1))
        if len(out) != plain or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return out

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        f = int(self.frames[k])
        if self._last[0] != f:
            self._last = (f, self.frame(f))
        return np.frombuffer(self._last[1], f"<u{self.width}", int(self.counts[k]), int(self.within[k]) * self.width)


def _write(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, width: int, frame_bytes: int, file_bytes: int, level: int, remembered: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder, tail = encoder_for(vocabulary, width, remembered), np.array([end], f"<u{width}").tobytes()
    partition, number = TaskContext.get().partitionId(), 0
    build = FileBuilder(width, frame_bytes, level)
    done = lambda: pa.RecordBatch.from_arrays([pa.array([build.content(partition, number)], pa.binary())], ["value"])
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        data, at = common.raw_strings(batch.column("text"))
        for i, j in common.slices(at, SLICE_BYTES):
            ids, upto = encoder.encoded(data[at[i] : at[j]], at[i : j + 1] - at[i])
            for k in range(i, j):
                build.add(doc_ids[k], ids[upto[k - i] : upto[k - i + 1]].tobytes() + tail)
                if len(build.out) >= file_bytes:
                    yield done()
                    build, number = FileBuilder(width, frame_bytes, level), number + 1
    if build.ids:
        yield done()
    common.trimmed()


def id_order() -> list[Column]:
    """Ascending doc_id, null last. Of equal doc_ids by a hash of the text; rows that repeat both are dealt out as they were read."""
    return [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]


def written_order() -> list[Column]:
    """The order in which the rows of a folder of parquet files were written."""
    name = F.col("_metadata.file_name")
    number = lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0).cast("long"))
    return [number(r"part-(\d+)"), number(r"\.c(\d+)"), F.col("_metadata.row_index")]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int, vocabulary_size: int, order: list[Column] | None = None, text_bytes_each: int = 16 << 20, frame_bytes: int = 256 << 10, file_bytes: int = 64 << 20, level: int = 1, remembered: int = REMEMBERED) -> None:
    """Files of docs (doc_id, text) below path, documents in ascending order of some columns, null last, by default those of ``id_order``.

    Null and empty texts are the end id alone. Repeated rows are written each. An empty table writes no document.
    """
    width = 2 if max(vocabulary_size, end + 1) <= 1 << 16 else 4
    n = common.groups_for(common.text_bytes(docs), text_bytes_each)
    keys = [f"o{k}" for k in range(len(order or id_order()))]
    whole = docs.select("doc_id", "text", *[o.alias(k) for o, k in zip(order or id_order(), keys, strict=True)])
    by = [F.col(k).asc_nulls_last() for k in keys]
    dealt = whole.repartitionByRange(n, *by).sortWithinPartitions(*by).select("doc_id", "text")
    rows = dealt.mapInArrow(lambda it: _write(it, vocabulary, end, width, frame_bytes, file_bytes, level, remembered), "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", TAIL.decode("latin-1")).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"partition": pa.int64(), "number": pa.int64(), "place": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    for batch in batches:
        for content in batch.column("content"):
            file = SeekableFile.of(content.as_buffer().to_pybytes())
            n = len(file.doc_ids)
            crc = [zlib.crc32(file.tokens(k).astype("<u4").tobytes()) for k in range(n)]
            columns = [[file.partition] * n, [file.number] * n, range(n), file.doc_ids, file.counts, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, read back from the files: doc_id, start, n_tokens, ids_crc32 and its place (partition, number, place)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    rows = common.checkpointed(files.mapInArrow(_read, "partition long, number long, place long, doc_id long, n_tokens long, ids_crc32 long"))
    rows = common.running_start(rows, ["partition", "number"], "n_tokens", "before")
    within = Window.partitionBy("partition", "number").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32", "partition", "number", "place")


def vocabulary_text(path: str, most: int = 64 << 20) -> str:
    """A tokenizer file, which goes to the executors with the tasks; its size is checked."""
    with open(path, encoding="utf-8") as f:
        text = f.read(most + 1)
    if len(text) > most:
        raise ValueError("the tokenizer file is too large to send with the tasks")
    return text


def encoded(docs: DataFrame, tokenizer_path: str | None = None, end: int = 2, path: str | None = None, order: list[Column] | None = None, **settings) -> DataFrame:
    """Writes docs and reads the files back."""
    import public_tokenizers
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    text = vocabulary_text(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
    path = path or common.shared_dir(spark, "tokens")
    write_tokens(docs, path, text, end, Tokenizer.from_str(text).get_vocab_size(), order, **settings)
    return read_index(spark, path)


def op10_token_output(spark, sf_dir) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "n_tokens", "ids_crc32")
