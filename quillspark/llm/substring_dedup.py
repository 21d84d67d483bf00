"""Exact substring dedup over fixed windows of words.

Every window gets a Rabin-Karp hash over its words' hashes. A group of documents (by hash of doc_id, of about
``group_bytes`` of text) sends each of its different windows once, with its first place in the group, packed in one blob per hash
bucket; a bucket counts the hashes over all groups and answers each group with the places that have an earlier
copy elsewhere, and with the place of the first. The group merges what is repeated into maximal removal intervals. So a
passage in a third of all documents is one entry a group, and rows that are repeated whole are counted before they are sent.

Hashes only propose. Inside a group repeated windows are compared word by word. Between groups, runs of windows that
repeat a run of another document are claims: the claim's words, as a BLAKE2 digest, go to the group that holds the other
document and are compared with the words there. If any claim fails, everything is counted again under other hash functions.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

#: A row that stands for more copies is put out several times, so that no array of copies is longer.
COPIES = 1 << 16
#: Bytes of text, and windows, that are looked at together.
SLICE, WINDOWS = 1 << 20, 1 << 17
_SPACE = b" \t\n\x0b\x0c\r"


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed; of rows in a batch that repeat doc_id and text one, with their number."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, at = common.raw_strings(batch.column("text"))
        raw, times = data.tobytes(), {}
        for k, row in enumerate(zip(batch.column("grp").to_pylist(), batch.column("id").to_pylist(), batch.column("late").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):
            own = (*row[:3], raw[row[3] : row[4]])
            times[own] = times.get(own, 0) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in times], pa.int64()), pa.array([k[1] for k in times], pa.int64()), pa.array([k[2] for k in times], pa.bool_()),
            pa.array(list(times.values()), pa.int64()), pa.array([press.compress(k[3]) for k in times], pa.binary()),
        ], ["grp", "id", "late", "copies", "small"])


def word_digests(words: list[bytes], seed: int) -> np.ndarray:
    """Two independent 64-bit hashes of each word."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, seed) for w in words]), "<u8").reshape(-1, 2)


def _cuts(data: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of about SLICE bytes that begin at white space, so that no word spans two."""
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and not common.SEPARATOR[data[end]]:
            gap = np.flatnonzero(common.SEPARATOR[data[end : end + SLICE]])
            end = end + int(gap[0]) if len(gap) else min(end + SLICE, len(data))
        out.append((at, min(end, len(data))))
        at = end
    return out


class Texts:
    """The different documents of a group by (id, text), those without a doc_id last, with the places of their words.

    Everything about words is kept in four bytes and made a stretch at a time: a very long document is a group of its own.
    """

    def __init__(self, table: pa.Table):
        open_ = zstandard.ZstdDecompressor()
        rows: dict[tuple[bool, int, bytes], int] = {}
        for late, i, small, n in zip(*(table.column(c).to_pylist() for c in ("late", "id", "small", "copies")), strict=True):
            own = (late, i, open_.decompress(small))
            rows[own] = rows.get(own, 0) + n
        order = sorted(rows)
        self.late, self.ids = np.array([r[0] for r in order], bool), np.array([r[1] for r in order], np.int64)
        self.copies = np.array([rows[r] for r in order], np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(r[2]) for r in order], dtype=np.int64)])
        self.raw = b"".join([r[2] for r in order])
        del rows, order
        self.data = np.frombuffer(self.raw, np.uint8)
        starts, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for a, b in _cuts(self.data):
            edges = self.at[np.searchsorted(self.at, a, "right") : np.searchsorted(self.at, b, "left")]
            own = np.concatenate([[a], edges, [b]]) - a
            first, last, _ = common.word_spans(self.data[a:b], own)
            starts.append((first + a).astype(np.int32))
            ends.append((last + a).astype(np.int32))
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.before = np.searchsorted(self.starts, self.at)
        # rows that repeat an id number their words on, whole copies too
        self.number = np.concatenate([[0], np.cumsum(np.diff(self.before) * self.copies)])[:-1]
        known = int((~self.late).sum())
        self.parts = {False: (0, self.ids[:known]), True: (known, self.ids[known:])}

    def lead(self) -> np.ndarray:
        """The number of each row's first word within its id."""
        out = np.zeros(len(self.ids), np.int64)
        for low, ids in self.parts.values():
            out[low : low + len(ids)] = self.number[low + np.searchsorted(ids, ids)]
        return self.number - out

    def word(self, late: bool, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index among all words) of the words of these numbers in these ids."""
        low, own = self.parts[late]
        place = self.number[low + np.searchsorted(own, ids)] + starts
        row = np.searchsorted(self.number, place, "right") - 1
        # rows without words have the number of the row after them
        return row, self.before[row] + place - self.number[row]

    def joined(self, stretches: list[tuple[int, int]]) -> Iterator[bytes]:
        """Words of stretches (first, past the last), a space between all of them, in pieces."""
        space = b""
        for first, end in stretches:
            for a in range(first, end, 1 << 15):
                b = min(end, a + (1 << 15))
                yield space + b" ".join([self.raw[x:y] for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)])
                space = b" "

    def digest(self, first: int, n: int) -> bytes:
        out = hashlib.blake2b(digest_size=16)
        for part in self.joined([(first, first + n)]):
            out.update(part)
        return out.digest()


class Group(Texts):
    """And with their windows."""

    def __init__(self, table: pa.Table, width: int, seed: int):
        super().__init__(table)
        self.width = width
        kinds: dict[bytes, int] = {}
        codes = [np.zeros(0, np.int32)]
        for a, b in _cuts(self.data):
            i, j = np.searchsorted(self.starts, (a, b))
            if i < j:
                # a piece is a word and the white space after it
                edges = np.concatenate([self.starts[i:j], [b]]).astype(np.int64)
                pieces = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(edges), pa.py_buffer(self.data)]).dictionary_encode()
                own = np.array([kinds.setdefault(p.rstrip(_SPACE), len(kinds)) for p in pieces.dictionary.to_pylist()], np.int32)
                codes.append(own[pieces.indices.to_numpy()])
        self.codes = np.concatenate(codes)
        self.digests = word_digests(list(kinds), seed)
        del kinds, codes
        each = np.maximum(np.diff(self.before) - width + 1, 0)
        self.upto = np.concatenate([[0], np.cumsum(each)])
        self.hash = np.empty(self.upto[-1], np.uint64)
        for a in range(0, len(self.hash), WINDOWS):
            own = np.arange(a, min(a + WINDOWS, len(self.hash)))
            self.hash[own] = self._hashed(own, 0, 0x9E3779B97F4A7C15 & ~3 | 3)
        order = np.argsort(self.hash, kind="stable")
        h = self.hash[order]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        later = np.flatnonzero(same)
        leader = np.flatnonzero(~same)[np.cumsum(~same, dtype=np.int32)[later] - 1]
        later, leader, values = order[later], order[leader], h[later]
        del order, h, same
        alike = np.ones(len(later), bool)
        one, two = self.start(later), self.start(leader)
        for j in range(width):
            alike &= self.codes[one + j] == self.codes[two + j]
        #: windows that repeat an earlier one of this group, word by word
        self.again = np.zeros(len(self.hash), bool)
        self.again[later[alike]] = True
        for value in np.unique(values[~alike]):  # different windows with the same hash
            seen = set()
            for k in np.flatnonzero(self.hash == value).tolist():
                at = int(self.start(np.array([k]))[0])
                own = self.codes[at : at + width].tobytes()
                self.again[k] = own in seen
                seen.add(own)

    def start(self, windows: np.ndarray) -> np.ndarray:
        """Index among all words of the first word of some windows."""
        row = np.searchsorted(self.upto, windows, "right") - 1
        return windows - self.upto[row] + self.before[row]

    def _hashed(self, windows: np.ndarray, which: int, base: int) -> np.ndarray:
        """Rabin-Karp hashes of windows in ascending order, over one of the words' two hashes."""
        first = self.start(windows)
        low = int(first[0])
        return common.RollingHash(base).windows(self.digests[:, which][self.codes[low : int(first[-1]) + self.width]], first - low, self.width)

    def bucket(self, windows: np.ndarray, buckets: int) -> np.ndarray:
        """Buckets of windows in ascending order, by a hash that knows nothing of the other."""
        out = np.empty(len(windows), np.int32)
        for a in range(0, len(windows), WINDOWS):
            out[a : a + WINDOWS] = self._hashed(windows[a : a + WINDOWS], 1, 0xD1342543DE82EF93) % np.uint64(buckets)
        return out


def _pack(ids: np.ndarray, starts: np.ndarray, *rest: np.ndarray) -> bytes:
    """Entries sorted by (id, start), with further columns."""
    edge = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])
    own = ids[edge]
    counts = np.diff(np.concatenate([edge, [len(ids)]]))
    step = np.diff(own.view(np.uint64), prepend=own[:1].view(np.uint64))
    columns = [step, counts, starts, *(r.view(np.uint64) if r.dtype.itemsize == 8 else r for r in rest)]
    return struct.pack("<QQq", len(own), len(ids), own[0]) + b"".join(map(common.packed, columns))


def _unpack(blob: bytes, rest: int) -> list[np.ndarray]:
    docs, n, first = struct.unpack("<QQq", blob[:24])
    step, at = common.unpacked(blob, 24, docs)
    counts, at = common.unpacked(blob, at, docs)
    starts, at = common.unpacked(blob, at, n)
    own = (np.cumsum(step.astype(np.uint64)) + np.uint64(first & (1 << 64) - 1)).view(np.int64)
    out = [np.repeat(own, counts.astype(np.int64)), starts.astype(np.int64)]
    for _ in range(rest):
        column, at = common.unpacked(blob, at, n)
        out.append(column.astype(np.uint64))
    return out


def _runs(*keys: np.ndarray) -> list[slice]:
    """Runs of rows that agree in all keys."""
    if not len(keys[0]):
        return []
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), len(new)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _windows(table: pa.Table, width: int, buckets: int, seed: int) -> pa.Table:
    group = Group(table, width, seed)
    keep = np.flatnonzero(~group.again)
    first_late = group.upto[group.parts[True][0]]
    key = 2 * group.bucket(keep, buckets).astype(np.int64) + (keep >= first_late)
    order = np.argsort(key, kind="stable")
    key, lead, out = key[order], group.lead(), []
    for c in _runs(key):
        own = keep[order[c]]
        row = np.searchsorted(group.upto, own, "right") - 1
        out.append((int(key[c.start]) >> 1, bool(key[c.start] & 1), _pack(group.ids[row], own - group.upto[row] + lead[row], group.hash[own])))
    grp = table.column("grp")[0].as_py()
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.table({"bucket": pa.array(columns[0], pa.int64()), "grp": pa.array([grp] * len(out), pa.int64()), "late": pa.array(columns[1], pa.bool_()), "blob": pa.array(columns[2], pa.binary())})


def _count(table: pa.Table) -> pa.Table:
    """Of a bucket: for each group the places whose hash has an earlier place elsewhere, and the first place."""
    parts = [_unpack(b, 1) for b in table.column("blob").to_pylist()]
    ids, starts, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = [len(p[0]) for p in parts]
    grp, late = np.repeat(table.column("grp").to_numpy(), size), np.repeat(np.array(table.column("late").to_pylist(), bool), size)
    order = np.argsort(hashes)
    h = hashes[order]
    same = h[1:] == h[:-1]
    some = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    some = some[np.lexsort((starts[some], ids[some], late[some], hashes[some]))]
    later = np.concatenate([[False], hashes[some][1:] == hashes[some][:-1]]) if len(some) else np.zeros(0, bool)
    first = some[np.maximum.accumulate(np.where(later, 0, np.arange(len(some))))] if len(some) else some
    some, first = some[later], first[later]
    by = np.lexsort((starts[some], ids[some], late[some], grp[some]))
    some, first = some[by], first[by]
    cut = _runs(grp[some], late[some])
    blobs = [_pack(ids[some[c]], starts[some[c]], grp[first[c]], late[first[c]].astype(np.uint8), ids[first[c]], starts[first[c]]) for c in cut]
    return pa.table({"grp": pa.array([int(grp[some[c.start]]) for c in cut], pa.int64()), "late": pa.array([bool(late[some[c.start]]) for c in cut], pa.bool_()), "blob": pa.array(blobs, pa.binary())})


_CLAIM = pa.struct([("late", pa.bool_()), ("id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
_OUT = pa.schema([
    ("to", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
    ("kept_text", pa.string()), ("copies", pa.int64()), ("claim", _CLAIM), ("failed", pa.bool_()),
])
_DDL = "to long, doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first: int, last: int>>, kept_text string, copies long, claim struct<late: boolean, id: long, first: long, n: long, digest: binary>, failed boolean"


def _remove(docs: pa.Table, found: pa.Table, width: int, with_text: bool, seed: int) -> pa.Table:
    if not docs.num_rows:
        return _OUT.empty_table()
    group = Group(docs, width, seed)
    grp = docs.column("grp")[0].as_py()
    repeated, rows = group.again.copy(), []
    parts = []
    for late, blob in zip(found.column("late").to_pylist(), found.column("blob").to_pylist(), strict=True):
        ids, starts, *first = _unpack(blob, 4)
        row, word = group.word(late, ids, starts)
        repeated[group.upto[row] + word - group.before[row]] = True
        parts.append((word, *(x.view(np.int64) for x in first)))
    if parts:
        word, to, late0, id0, start0 = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word)
        word, to, late0, id0, start0 = (x[order] for x in (word, to, late0, id0, start0))
        step = np.arange(len(word))
        claims = set()
        for c in _runs(word - step, to, late0, id0, start0 - step):
            n = c.stop - c.start + width - 1
            claims.add((int(to[c.start]), bool(late0[c.start]), int(id0[c.start]), int(start0[c.start]), n, group.digest(int(word[c.start]), n)))
        rows += [{"to": c[0], "claim": dict(zip(("late", "id", "first", "n", "digest"), c[1:], strict=True))} for c in sorted(claims)]
    cover = np.zeros(len(group.starts) + 1, np.int32)
    hit = group.start(np.flatnonzero(repeated))
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
    for k in range(len(group.ids)):
        a, b = int(group.before[k]), int(group.before[k + 1])
        own = {"to": grp, "doc_id": None if group.late[k] else int(group.ids[k]), "n_words": b - a}
        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).reshape(-1, 2).tolist()
        edges = [a, *(a + x for t in turn for x in t), b]
        left = [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if x < y]
        rows.append(own | _kept(group.joined(left), with_text) | {"n_removed": sum(y - x for x, y in turn), "removed": [{"first": x, "last": y - 1} for x, y in turn], "copies": 1})
        more = int(group.copies[k]) - 1
        while more > 0:  # whole copies: all their windows come earlier
            all_ = b - a >= width
            kept = _kept(group.joined([] if all_ or a == b else [(a, b)]), with_text)
            rows.append(own | kept | {"n_removed": b - a if all_ else 0, "removed": [{"first": 0, "last": b - a - 1}] if all_ else [], "copies": min(more, COPIES)})
            more -= COPIES
    return pa.Table.from_pylist(rows, schema=_OUT)


def _kept(parts: Iterator[bytes], with_text: bool) -> dict:
    sha, held = hashlib.sha256(), []
    for part in parts:
        sha.update(part)
        held += [part] * with_text
    return {"kept_sha256": sha.hexdigest(), "kept_text": b"".join(held).decode("utf-8", "replace") if with_text else None}


def _verify(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Results as they are, and of the claims those whose words aren't in the place they name."""
    done = found.filter(found.column("claim").is_null())
    claims = [c for c in found.column("claim").to_pylist() if c is not None]
    if not claims:
        return done
    texts, failed = Texts(docs), []
    for c in claims:
        _, word = texts.word(c["late"], np.array([c["id"]]), np.array([c["first"]]))
        if texts.digest(int(word[0]), c["n"]) != c["digest"]:
            failed.append({"claim": c, "failed": True})
    return pa.concat_tables([done, pa.Table.from_pylist(failed[:1], schema=_OUT)])


def repeated_windows(docs: DataFrame, width: int = 20, with_text: bool = False, group_bytes: int | None = None, bucket_bytes: int | None = None, tries: int = 8) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed, kept_text) of every row of docs (doc_id, text).

    A word goes if a window of ``width`` words that covers it has a copy that starts earlier: in a smaller doc_id or
    before it in the same document, judged on the input. ``removed`` lists the maximal intervals of word numbers.
    Null texts have no words. Rows that repeat a doc_id are ordered by text and number their words on; no window
    spans two rows. Rows without doc_id come last, by a hash of their texts. kept_text is given only on request. Extra
    columns are ignored. Groups and buckets have 8 MB of text, with a table over 32 GB up to 64 MB: their number
    grows with the root of the table's size, so that a blob holds many windows.
    """
    total = common.text_bytes(docs)
    piece = int(min(max(math.sqrt(2000 * total), 8 << 20), 64 << 20))
    groups, buckets = common.groups_for(total, group_bytes or piece), common.groups_for(total, bucket_bytes or piece * 3 // 4)
    # rows without a doc_id are known by their texts, so they are dealt out like others
    id_ = F.coalesce("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = docs.select(F.pmod(F.xxhash64(id_), F.lit(groups)).alias("grp"), id_.alias("id"), F.col("doc_id").isNull().alias("late"), "text")
    small = rows.mapInArrow(_press, "grp long, id long, late boolean, copies long, small binary").repartition(groups, "grp")
    for seed in range(tries):
        out = common.checkpointed(_counted(small, groups, buckets, width, with_text, seed))
        if out.filter("failed").isEmpty():
            return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text")
    raise RuntimeError(f"different windows had equal hashes under {tries} hash functions")


def _counted(small: DataFrame, groups: int, buckets: int, width: int, with_text: bool, seed: int) -> DataFrame:
    """Results and failed claims under one pair of hash functions."""
    sent = small.groupBy("grp").applyInArrow(lambda t: _windows(t, width, buckets, seed), "bucket long, grp long, late boolean, blob binary")
    found = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count, "grp long, late boolean, blob binary")
    out = small.groupBy("grp").cogroup(found.repartition(groups, "grp").groupBy("grp")).applyInArrow(lambda a, b: _remove(a, b, width, with_text, seed), _DDL)
    return small.groupBy("grp").cogroup(out.repartition(groups, "to").groupBy("to")).applyInArrow(_verify, _DDL)


def op6_substring_dedup(spark, sf_dir) -> DataFrame:
    return repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
v AS (SELECT doc_id, i AS s, string_agg(word, ' ') OVER f AS x, count(*) OVER f AS n FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM v WHERE n = 20),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE k > 1),
j AS (SELECT t.doc_id, t.i, word, g.i IS NOT NULL AS gone FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.i = g.i)
SELECT d.doc_id, count(j.i)::BIGINT AS n_words, count(j.i) FILTER (gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j.i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""
