"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts are compared in a plain form: A-Z and capital Latin-1 letters lower-cased, everything in ASCII that is neither
letter nor digit a single space. A benchmark item is cut into overlapping segments. A place in a document that holds a segment of
s characters with at most e edits shares at least s + 1 - q (e + 1) of its q-grams, all on diagonals within e of one
another (the q-gram lemma). So (1) places whose neighbourhood has fewer q-grams of any segment are dropped; (2) what is
left is tallied by segment and overlapping band of diagonals, and bands below the bound are dropped; (3) the rest is
aligned within the band, and counts if the alignment stays within the budget. Items shorter than a q-gram have no
q-grams; they are found where they stand as whole words.

The benchmark is read in blocks of bounded size. A block's segments go along with the tasks; every worker builds the
index of them for itself and keeps it from task to task.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

Q = 10
#: Edits allowed per character of a segment, as far as the bound stays positive; times Q it must stay below 1.
EDIT_RATE = 0.07
#: Characters of a segment and from one to the next; a shorter item is one segment. A verbatim quote of SEGMENT + STRIDE holds a whole one.
SEGMENT, STRIDE = 86, 43
#: Characters of segments in a block; its index takes some fifty bytes for each. More are searched in further blocks.
BLOCK_CHARS = 2_000_000
#: Shared q-grams that are tallied together, and bytes of text that are looked at together.
HITS, SLICE_BYTES = 1 << 21, 1 << 20

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_PLAIN_SPACE = np.array([b < 128 and not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123) for b in range(256)])


def plain(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain form of all documents end to end, its offsets, and the byte of the input that each character stands for.

    A Latin-1 letter of two bytes is one character (its second byte); other characters count by bytes.
    """
    space = _PLAIN_SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    first = at[:-1][at[:-1] < len(data)]
    keep[first[space[first]]] = False
    lead = np.flatnonzero(data == 0xC3)
    keep[lead] = False
    out = np.where(space, np.uint8(32), _LETTER[data])
    high = lead[lead + 1 < len(data)] + 1
    capital = high[(out[high] >= 0x80) & (out[high] <= 0x9E) & (out[high] != 0x97)]
    out[capital] += 0x20
    where = np.flatnonzero(keep)
    return out[where], np.searchsorted(where, at), where


def plain_text(text: str | None) -> bytes:
    """Plain form of one text, without a space at its end."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return plain(data, np.array([0, len(data)]))[0].tobytes().rstrip(b" ")


def banded(pattern: bytes, text: bytes, most: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of pattern in text among alignments that start on diagonals low..high, within the budget.

    A diagonal is text position less pattern position; alignments may wander ``most`` diagonals further.
    """
    for d in range(max(low, 0), high + 1):
        if text[d : d + len(pattern)] == pattern:
            return 0, d, d + len(pattern)
    lo, hi, big = low - most, high + most, len(pattern) + len(text) + 1
    width = hi - lo + 1
    cost = [0 if 0 <= lo + k <= len(text) and low <= lo + k <= high else big for k in range(width)]
    start = [lo + k for k in range(width)]
    for i, p in enumerate(pattern):
        now, from_ = [big] * width, [0] * width
        for k in range(width):
            j = i + lo + k  # text position consumed before this character
            best, s = big, 0
            if 0 <= j < len(text) and cost[k] < big:
                best, s = cost[k] + (text[j] != p), start[k]
            if k + 1 < width and cost[k + 1] + 1 < best:
                best, s = cost[k + 1] + 1, start[k + 1]
            if k and 0 <= j < len(text) and now[k - 1] + 1 < best:
                best, s = now[k - 1] + 1, from_[k - 1]
            now[k], from_[k] = best, s
        cost, start = now, from_
        if min(cost) > most:
            return None
    k = min(range(width), key=lambda k: (cost[k], k))
    return (cost[k], start[k], len(pattern) + lo + k) if cost[k] <= most else None


def segments(item: int | None, text: bytes) -> list[tuple[int | None, bytes, int]]:
    """(item, segment, segments of the item) of an item in plain form; none of an empty one."""
    last = max(len(text) - SEGMENT, 0)
    starts = [*range(0, last, STRIDE), last] if text else []
    return [(item, text[a : a + SEGMENT], len(starts)) for a in starts]


class Index:
    """Segments with their q-grams, by hash, and a table of hashed q-grams for the first pass."""

    def __init__(self, parts: list[tuple[int | None, bytes, int]]):
        self.segments: list[tuple[int | None, bytes, int, int]] = []
        self.short: dict[bytes, list[int]] = defaultdict(list)
        for item, part, _ in parts:
            if len(part) < Q:
                self.short[part].append(len(self.segments))
                self.segments.append((item, part, 0, 1))
            else:
                edits = min(math.floor(EDIT_RATE * len(part)), len(part) // Q - 1)  # the bound is 1 at least
                self.segments.append((item, part, edits, len(part) + 1 - Q * (edits + 1)))
        long = [k for k, s in enumerate(self.segments) if len(s[1]) >= Q]
        sizes = np.array([len(self.segments[k][1]) - Q + 1 for k in long], np.int64)
        joined = np.frombuffer(b"".join(self.segments[k][1] for k in long), np.uint8)
        first = np.cumsum(sizes + Q - 1) - (sizes + Q - 1)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grams = self.mixed(joined)[np.repeat(first, sizes) + place] if long else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.of, self.place = grams[order], np.repeat(np.array(long, np.int32), sizes)[order], place[order].astype(np.int32)
        self.width = np.array([s[2] + 1 for s in self.segments], np.int64)
        self.bits = max(16, len(grams).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[grams >> np.uint64(64 - self.bits)] = True
        self.least = min((self.segments[k][3] for k in long), default=1)
        self.reach = max((len(self.segments[k][1]) + self.segments[k][2] for k in long), default=0)

    @staticmethod
    def mixed(text: np.ndarray) -> np.ndarray:
        """Hash of the q-gram that begins at each place."""
        n = len(text) - Q + 1
        words = np.ndarray((len(text) - 7,), np.uint64, np.ascontiguousarray(text), strides=(1,)).copy()
        return common.mixed(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ words[Q - 8 : Q - 8 + n] * np.uint64(0xD1342543DE82EF95))

    def regions(self, text: np.ndarray) -> list[tuple[int, int]]:
        """Stretches in which some window as long as the longest segment has enough q-grams of the index."""
        if len(text) < Q or not len(self.grams):
            return []
        known = self.table[self.mixed(text) >> np.uint64(64 - self.bits)]
        upto = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])
        end = np.minimum(np.arange(len(known)) + self.reach, len(known))
        rich = known & (upto[end] - upto[:-1] >= self.least)
        found = np.flatnonzero(rich)
        if not len(found):
            return []
        cut = np.flatnonzero(np.diff(found) > self.reach) + 1
        return [(int(g[0]), int(min(g[-1] + self.reach + Q, len(text)))) for g in np.split(found, cut)]

    def bands(self, text: bytes, low: int, high: int) -> list[tuple[int, int]]:
        """(segment, band) with as many shared q-grams in text[low:high] as the lemma asks for; a band is two widths of diagonals, every second half shared."""
        h = self.mixed(np.frombuffer(text, np.uint8)[low:high])
        left, right = np.searchsorted(self.grams, h, "left"), np.searchsorted(self.grams, h, "right")
        some = np.flatnonzero(right > left)
        count = (right - left)[some]
        keys, tally = np.zeros(0, np.int64), np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(some):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + HITS, "right")) - 1)
            n = count[a:b]
            at = np.repeat(left[some[a:b]] - (upto[a:b] - upto[a]), n) + np.arange(n.sum())
            k = self.of[at].astype(np.int64)
            band = (np.repeat(some[a:b] + low, n) - self.place[at]) // self.width[k]
            both = np.concatenate([(k << 32) + (band + (1 << 30)), (k << 32) + (band - 1 + (1 << 30))])
            new, times = np.unique(both, return_counts=True)
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            tally = np.bincount(where, np.concatenate([tally, times]), len(keys)).astype(np.int64)
            a = b
        least = np.array([s[3] for s in self.segments], np.int64)
        keys = keys[tally >= least[keys >> 32]]
        return list(zip((keys >> 32).tolist(), ((keys & 0xFFFFFFFF) - (1 << 30)).tolist(), strict=True))

    def search(self, text: bytes, low: int, high: int) -> dict[int, list[tuple[int, int, int, int]]]:
        """Of text[low:high]: (edits, start, end, segment) of every segment found, by item; the best place of each."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for k, band in self.bands(text, low, high):
            _, part, edits, _ = self.segments[k]
            if k in best and best[k][0] == 0:
                continue
            d = band * (edits + 1)
            origin = max(0, d - edits)
            piece = text[origin : max(0, d + 2 * (edits + 1) + len(part) + edits)]
            if hit := banded(part, piece, edits, d - origin, d + 2 * (edits + 1) - 1 - origin):
                one = (hit[0], origin + hit[1], origin + hit[2], k)
                if k not in best or one < best[k]:
                    best[k] = one
        out = defaultdict(list)
        for k, one in best.items():
            out[self.segments[k][0]].append(one)
        return out

    def words(self, text: np.ndarray, upto: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, segment, start, end) of the first place in each row where a short segment stands as whole words."""
        if not self.short or not len(text):
            return
        space = np.concatenate([text == 32, np.ones(Q, bool)])
        begins = np.concatenate([[True], text[:-1] == 32])
        begins[upto[:-1][upto[:-1] < len(text)]] = True
        begins &= text != 32
        ends = space.copy()
        ends[upto[1:]] = True
        raw = text.tobytes()
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.ndarray((len(text),), np.uint64, padded, strides=(1,)).copy()
        for n in sorted({len(x) for x in self.short}):
            known = {int.from_bytes(x[:8], "little") for x in self.short if len(x) == n}
            at = np.flatnonzero(begins & ends[n : n + len(text)])
            at = at[np.isin(words[at] & np.uint64((1 << 8 * min(n, 8)) - 1), np.array(sorted(known), np.uint64))]
            row = np.searchsorted(upto, at, "right") - 1
            seen = set()
            for p, r in zip(at.tolist(), row.tolist(), strict=True):
                part = raw[p : p + n]
                if p + n <= upto[r + 1] and part in self.short and (r, part) not in seen:
                    seen.add((r, part))
                    for k in self.short[part]:
                        yield r, k, p - int(upto[r]), p + n - int(upto[r])


def _found(column: pa.Array, index: Index) -> Iterator[tuple[int, dict[int, list]]]:
    """(row, item -> (edits, first byte, byte past the end, segment)) of each text with a hit."""
    data, at = common.raw_strings(column)
    for i, j in common.slices(at, SLICE_BYTES):
        raw, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
        text, upto, where = plain(raw, own)
        hits: dict[int, dict] = {}

        def add(row: int, e: int, s: int, t: int, k: int) -> None:
            into = hits.setdefault(row, {}).setdefault(index.segments[k][0], {})  # noqa: B023
            one = (e, int(where[upto[row] + s] - own[row]), int(where[upto[row] + t - 1] + 1 - own[row]), k)  # noqa: B023
            into[k] = min(into.get(k, one), one)

        for row, k, s, t in index.words(text, upto):
            add(row, 0, s, t, k)
        for low, high in index.regions(text):
            first, last = np.searchsorted(upto, low, "right") - 1, np.searchsorted(upto, high - 1, "right") - 1
            for row in range(int(first), int(last) + 1):
                a, b = int(upto[row]), int(upto[row + 1])
                lo, hi = max(low, a) - a, min(high, b) - a
                if hi - lo < Q:
                    continue
                for found in index.search(text[a:b].tobytes(), max(0, lo - index.reach), min(b - a, hi + index.reach)).values():
                    for e, s, t, k in found:
                        add(row, e, s, t, k)
        for row in sorted(hits):
            yield i + row, {item: sorted(x.values(), key=lambda h: h[3]) for item, x in hits[row].items()}


Block = list[tuple[int | None, bytes, int]]


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """Segments of the items in blocks. Null items and those that are empty in plain form have none.

    Only an item of more than BLOCK_CHARS lies in several blocks, each of which reports what it holds of it.
    """
    held, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").distinct().toLocalIterator():
        own = segments(r["item_id"], plain_text(r["text"]))
        chars = sum(len(x[1]) for x in own)
        if held and size + chars > BLOCK_CHARS:
            yield held
            held, size = [], 0
        for part in own:
            if size >= BLOCK_CHARS:
                yield held
                held, size = [], 0
            held.append(part)
            size += len(part[1])
    if held:
        yield held


#: A worker's last index, which lives as long as the worker.
_INDEXES: dict[bytes, Index] = {}


def index_of(block: Block) -> Index:
    key = hashlib.sha256(repr(block).encode()).digest()
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(block)
    return _INDEXES[key]


HIT_DDL = "doc_id long, item_id long, edits int, segments int, of_segments int, first int, end int"
_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("segments", pa.int32()), ("of_segments", pa.int32()), ("first", pa.int32()), ("end", pa.int32())])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, segments, of_segments, first, end): a row for each document row and item of which it holds a segment.

    edits sums over the segments found; first and end delimit, in characters, what they cover in the text. Null and empty texts
    hold nothing. Repeated rows of docs are reported each, and so are items with the same text under different item_ids;
    benchmark rows that repeat both are one item. An empty benchmark finds nothing.
    """
    def scan(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(block)
            for b in batches:
                rows = []
                for row, items in _found(b.column("text"), index):
                    raw, doc = b.column("text")[row].as_py().encode(), b.column("doc_id")[row].as_py()
                    for item, hits in items.items():
                        first, end = min(h[1] for h in hits), max(h[2] for h in hits)
                        rows.append((doc, item, sum(h[0] for h in hits), len(hits), block[hits[0][3]][2], len(raw[:first].decode(errors="ignore")), len(raw[:end].decode(errors="ignore"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _HIT, strict=True)], schema=_HIT)

        return run

    found = docs.sparkSession.createDataFrame([], HIT_DDL)
    for block in blocks(benchmark):
        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(scan(block), HIT_DDL))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs (with a text column) that hold no segment of any item; all columns stay, whatever their names.

    Null and empty texts hold nothing and stay, as do rows that repeat one another and everything if the benchmark is empty.
    """
    def keep(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(block)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[row for row, _ in _found(b.column("text"), index)]] = False
                yield b.filter(pa.array(clean))
            common.trimmed()

        return run

    for block in blocks(benchmark):
        docs = docs.mapInArrow(keep(block), docs.schema)
    return docs


def op8_decontamination(spark, sf_dir) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
