"""SimHash near-dedup: 64-bit fingerprints linked through a byte-position inverted index with count filtering.

Two fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share four
positional bytes at least (the guaranteed minimum). Tallying pairs in the lists of single positional bytes, 2,048 of them
in all, would grow with the square of the table; so a posting is a set of four byte positions with the bytes a fingerprint has
there, all seventy sets of it. A pair meets in as many lists as its tally of shared positional bytes says, in one at
least if and only if the tally reaches the minimum. Where it meets the tally is taken, the list of its first four shared
positions alone reports it, and its differing bits are verified.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

#: Bytes of text hashed together: every shingle of them takes some hundred bytes for a moment.
SLICE_BYTES = 1 << 20
#: Lists up to this length are compared by shifting; longer ones are flooded from pivots.
SHORT_LIST = 16


#: What sets the further 64 bits of a wide fingerprint apart from the first.
_LANES = (0, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)


def fingerprints(batches: Iterator[pa.RecordBatch], words: int, carried: tuple[str, ...] = (), lanes: int = 1, sketched: bool = False) -> Iterator[pa.RecordBatch]:
    """doc_id, carried and fp of every row; with more lanes also fp1, fp2..., of hashes made from each shingle's hash; sketched adds size, the number of different shingles, and their ``sketch``."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    digest = xxhash.xxh64_intdigest
    names = ["fp", *(f"fp{k}" for k in range(1, lanes))]
    for batch in batches:
        data, at = common.raw_strings(batch.column("text"))
        found = np.zeros((lanes, batch.num_rows), np.uint64)
        size, marks = np.zeros(batch.num_rows, np.int32), [b""] * batch.num_rows
        for i, j in common.slices(at, SLICE_BYTES):
            piece, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
            starts, ends, before = common.word_spans(piece, own)
            if not len(starts):
                continue
            keep = ~common.SEPARATOR[piece]
            gaps = ends[ends < len(piece)]
            keep[gaps[common.SEPARATOR[piece[gaps]]]] = True
            moved = np.cumsum(keep) - 1
            text = np.where(common.SEPARATOR[piece], np.uint8(32), lower[piece])[keep].tobytes()
            s, e = moved[starts], moved[ends - 1] + 1
            count = np.diff(before)
            full = np.maximum(np.minimum(count, 1), count - words + 1)
            upto = np.concatenate([[0], np.cumsum(full)])
            first = np.arange(upto[-1]) + np.repeat(before[:-1] - upto[:-1], full)
            last = np.minimum(first + words, np.repeat(before[1:], full)) - 1
            h = np.fromiter((digest(text[a:b], 42) for a, b in zip(s[first].tolist(), e[last].tolist(), strict=True)), np.uint64, len(first))
            some = np.flatnonzero(full)
            for lane in range(lanes):
                own_h = common.mixed(h ^ np.uint64(_LANES[lane])) if lane else h
                bits = np.unpackbits(own_h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, upto[some], axis=0, dtype=np.int32)
                found[lane, i + some] = np.packbits(2 * ones > full[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            for k in some.tolist() if sketched else ():
                own = np.unique(h[upto[k] : upto[k + 1]])
                size[i + k], marks[i + k] = len(own), sketch(own)
        more = {"size": pa.array(size), "sketch": pa.array(marks, pa.binary())} if sketched else {}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in carried), *(pa.array(x.view(np.int64)) for x in found), *more.values()], ["doc_id", *carried, *names, *more])
    common.trimmed()


def position_sets() -> list[tuple[int, ...]]:
    """All sets of four of the eight byte positions."""
    return list(combinations(range(8), 4))


#: For each set of shared positions (as bits) the number of the position set that its first four make; 255 below the minimum.
_FIRST_SET = np.full(256, 255, np.uint8)
for _mask in range(256):
    _shared = tuple(k for k in range(8) if _mask >> k & 1)
    if len(_shared) >= 4:
        _FIRST_SET[_mask] = position_sets().index(_shared[:4])


def shared_positions(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Positions of equal bytes, as the bits of a number."""
    same = (a ^ b).view(np.uint8).reshape(-1, 8) == 0
    return np.packbits(same, axis=1, bitorder="little")[:, 0]


def close(a: np.ndarray, b: np.ndarray | np.uint64, bits: int) -> np.ndarray:
    """Tally of shared positional bytes first, then the differing bits."""
    near = np.bitwise_count(shared_positions(a, b)) >= 8 - bits
    near[near] = np.bitwise_count((a ^ b)[near]) <= bits
    return near


#: Whether rows of fingerprints (one column a lane) lie close to others, row by row or all to one.
Close = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _flood(fp: np.ndarray, near: Close) -> tuple[list, list]:
    """Links that connect what is linked in a long list, a tree of each component.

    Lists are long where many fingerprints lie close together, so that the first pivots take most of the list. Those
    nearest to the list's majority of bits come first: the centre of a group is the pivot in most lists in which it meets, so that
    its lists give the same links over and over and not others each time.
    """
    ones = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1).sum(axis=0)
    middle = np.packbits(2 * ones > len(fp)).view(np.uint64)
    rest, left, right = np.argsort(np.bitwise_count(fp ^ middle).sum(axis=1), kind="stable"), [], []
    while len(rest):
        pivots, rest = [rest[0]], rest[1:]
        while pivots and len(rest):
            p = pivots.pop()
            hit = near(fp[rest], fp[p : p + 1])
            found, rest = rest[hit], rest[~hit]
            left += [np.full(len(found), p)]
            right += [found]
            pivots += found.tolist()
    return left, right


def _neighbours(fp: np.ndarray, turn: int, near: Close) -> tuple[np.ndarray, np.ndarray]:
    """Links of close fingerprints of a long list that stand next to each other in the order of some lane from some bit on, which turn chooses.

    A tree links a fingerprint to a pivot alone, and that one's text may turn out unlike; very close ones are mostly neighbours in some list's order.
    """
    lane, by = fp[:, turn % fp.shape[1]], np.uint64(turn * 13 % 64)
    order = np.argsort((lane << by) | (lane >> ((np.uint64(64) - by) % np.uint64(64))), kind="stable")
    hit = near(fp[order[:-1]], fp[order[1:]])
    return order[:-1][hit], order[1:][hit]


def links(batches: Iterator[pa.RecordBatch], near: Close, lanes: tuple[str, ...] = ("fp",), name: str = "fp", label: str = "fp", once: bool = True, nearest: Close | None = None) -> Iterator[pa.RecordBatch]:
    """Links of nodes within runs of equal keys (number of the position set, then its bytes); rows come sorted by key.

    once: the keys are those of ``position_sets``, and a pair of a short list is reported by its first list alone.
    nearest: neighbours in long lists that are so close are linked too.
    Nodes that agree in label are known to be connected: links between them are left out.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(key: np.ndarray, node: np.ndarray, known: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        size = end - begin
        left, right = [], []
        within = np.repeat(end, size)
        within[np.repeat(size > SHORT_LIST, size)] = 0
        index = np.arange(len(key))
        for d in range(1, min(SHORT_LIST, int(size.max())) if len(size) else 0):
            i = index[index + d < within]
            i = i[near(fp[i], fp[i + d])]
            # a pair is reported by the first of the lists in which it meets
            if once:
                i = i[_FIRST_SET[shared_positions(fp[i, 0], fp[i + d, 0])] == key[i] >> 32]
            left.append(i)
            right.append(i + d)
        for k in np.flatnonzero(size > SHORT_LIST):
            own = fp[begin[k] : end[k]]
            a, b = _flood(own, near)
            if nearest is not None:
                x, y = _neighbours(own, int(key[begin[k]] >> 20), nearest)
                a, b = [*a, x], [*b, y]
            left += [x + begin[k] for x in a]
            right += [x + begin[k] for x in b]
        a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
        new = known[a] != known[b]
        a, b = node[a[new]], node[b[new]]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", name, label))
        held.append((key, node, known, np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in lanes], axis=1)))
        if key[0] == key[-1] and held[0][0][0] == key[0]:
            continue
        key, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(key, key[-1]))
        yield of(key[:cut], *(x[:cut] for x in rest))
        held = [(key[cut:], *(x[cut:] for x in rest))]
    if held:
        yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carried, fp, fingerprint, component, component_id) of every row of docs (doc_id, text).

    Texts are lower-cased in A-Z and cut at ASCII white space; a shorter text is one shingle, an empty or null
    one has fingerprint zero and links like any other. component_id is the smallest doc_id reachable over
    fingerprints that differ in at most ``bits`` bits. Rows with null doc_id keep their row, get their
    fingerprint and the component's smallest doc_id that isn't null (null if none). Repeated rows stay.
    Equal fingerprints are one node, so copies cost nothing in the index and are never paired. component is the component's smallest
    fingerprint. carried names columns of longs that are passed through.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees pairs up to four differing bits")
    marks = common.checkpointed(docs.select("doc_id", *carried, "text").mapInArrow(lambda it: fingerprints(it, words, carried), ", ".join(f"{c} long" for c in ("doc_id", *carried, "fp"))))
    nodes = common.checkpointed(marks.groupBy("fp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(0xFF) for k in range(8)]
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(byte[a], 24)).bitwiseOR(F.shiftleft(byte[b], 16)).bitwiseOR(F.shiftleft(byte[c], 8)).bitwiseOR(byte[d]) for k, (a, b, c, d) in enumerate(position_sets())]
    lists = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = lists.repartition("key").sortWithinPartitions("key")
    edges = lists.mapInArrow(lambda it: links(it, lambda a, b: close(a[:, 0], b[:, 0], bits)), "a long, b long")
    reach = common.components(edges)
    # a component is named by its smallest fingerprint until the documents' ids are known; what has no link names itself
    linked = common.checkpointed(nodes.join(reach, nodes.fp == reach.node).select("fp", "component", "component_id"))
    named = linked.groupBy("component").agg(F.min("component_id").alias("component_id"))
    of = common.salted(linked.drop("component_id"), named, "component", "fp").select(F.col("fp").alias("node"), "component", F.col("component_id").alias("least"))
    by_fp = nodes.join(of, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("node").isNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    found = common.joined(marks, by_fp, "fp")
    return found.select("doc_id", *carried, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component", "component_id")


# --- near copies by similarity ---------------------------------------------------

#: Bits of the first 64 of a wide fingerprint that may differ, and of all 256. At a similarity of 0.8 some 10 and 39 do, with
#: deviations of 3 and 6; of unlike texts 32 and 128. Neighbours in a long list are looked at up to NEAR_BITS, about a similarity of 0.9.
WIDE_BITS, ALL_BITS, NEAR_BITS = 20, 56, 24
#: Position sets of the wide index, of two of 32 positional bytes and half of a third, and those that are searched first.
WIDE_SETS, FIRST_SETS = 128, 16


def wide_sets() -> list[tuple[int, int, int, int]]:
    """Two byte positions, a third, and which half of that one (0 or 4 bits up); every position is in about as many."""
    rng, out = np.random.default_rng(5), []
    while len(out) < WIDE_SETS:
        order = rng.permutation(32)
        out += [(*sorted(order[k : k + 2].tolist()), int(order[k + 2]), 4 * int(rng.integers(0, 2))) for k in range(0, 30, 3)]
    return out[:WIDE_SETS]


def close_wide(a: np.ndarray, b: np.ndarray, bits: int = ALL_BITS) -> np.ndarray:
    """The first 64 bits first, then all of them."""
    near = np.bitwise_count(a[:, 0] ^ b[:, 0]) <= WIDE_BITS
    near[near] = np.bitwise_count(a[near] ^ (b[near] if len(b) == len(a) else b)).sum(axis=1) <= bits
    return near


#: Bits of a sketch: a power of two, as many as there are shingles or more, between these.
LEAST_BITS, MOST_BITS = 64, 1 << 16


def sketch(hashes: np.ndarray) -> bytes:
    """For each value of the hashes' low bits whether an odd number of these different hashes has it.

    A hash that only one of two sets has changes one bit, so the sketches of two sets differ in at most as many bits as there are such hashes.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Shingles that only one of two texts has, by their sketches: that many at least. The longer one is folded to the shorter one's bits."""
    if len(x) < len(y):
        x, y = y, x
    n, width = int.from_bytes(x, "little"), 4 * len(x)
    while width >= 8 * len(y) and y:
        n, width = n >> width ^ n & (1 << width) - 1, width // 2
    return (n ^ int.from_bytes(y, "little")).bit_count()


def _roomy(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, m, n, x, y) of nodes with their sizes and sketches those that can be similar: exact, as sets of similarity t differ in (1 - t) / (1 + t) of both sizes at most."""
    most = (1 - similarity) / (1 + similarity)
    for batch in batches:
        room = most * (batch.column("m").to_numpy() + batch.column("n").to_numpy()) + 1e-6
        keep = [apart(x, y) <= r for x, y, r in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), room.tolist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


_CASE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, words: int) -> set[bytes]:
    """Different shingles of a text, lower-cased in A-Z; the whole of a shorter one; none of an empty one."""
    w = re.findall(common.WORD.encode(), (text or "").encode().translate(_CASE))
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def _similar(batches: Iterator[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, x, y) of nodes with their texts those whose shingles are similar; two texts without any are."""
    now, own = None, set()
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        x, y = batch.column("x"), batch.column("y")
        for k, a in enumerate(batch.column("a").to_pylist()):
            if a != now:
                now, own = a, shingles(x[k].as_py(), words)
            other = shingles(y[k].as_py(), words)
            both = len(own & other)
            keep[k] = both >= similarity * (len(own) + len(other) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))
    del own
    common.trimmed()


# --- what the index over fingerprints can't promise ------------------------------

#: Texts that common shingles are looked for in, about (or this share of all, so that what is common in them doesn't grow with the table), how many of these
#: have one that is common, and common shingles that are remembered at most.
COMMON_DOCS, COMMON_SHARE, COMMON_IN, COMMON_KEPT = 4000, 1 / 8, 3, 1 << 18
#: Pairs of a list that are looked at together.
PAIRS_BLOCK = 1 << 22


def _hashed_shingles(text: str, words: int) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles(text, words)), np.uint64))


def common_shingles(texts: DataFrame, nodes: int, words: int) -> np.ndarray:
    """Hashes of shingles that several of a sample of texts (key, text) have, the commonest last and a bounded number. They only order shingles: any order is exact."""
    share = math.ceil((1 << 20) * min(1.0, max(COMMON_SHARE, COMMON_DOCS / max(nodes, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(_hashed_shingles(text.as_py() or "", words).view(np.int64))], ["token"])

    some = texts.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share)
    counts = some.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_IN)
    found = counts.orderBy(F.desc("n"), "token").limit(COMMON_KEPT).toArrow()
    return found.column("token").to_numpy()[::-1].view(np.uint64)


def prefixes(batches: Iterator[pa.RecordBatch], words: int, similarity: float, late: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, key, label, size, place): of texts (key, label, text) the shingles that come first in one order of all shingles, as many as two similar texts must share one of.

    Sets of Jaccard similarity t share t * n of the n shingles of either at least, so the first n - ceil(t * n) + 1 of both have a shingle in common. The order puts
    common shingles last; any order is exact. A text without shingles has token zero and size zero.
    """
    by_hash = np.argsort(late, kind="stable")
    known = late[by_hash]
    for b in batches:
        for i, j in common.slices(common.raw_strings(b.column("text"))[1], SLICE_BYTES):
            out = []
            for k in range(i, j):
                h = _hashed_shingles(b.column("text")[k].as_py() or "", words)
                n = len(h)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, by_hash[at] + 1, 0)
                    h = h[np.argsort(rank, kind="stable")]
                first = h[: n - math.ceil(similarity * n - 1e-9) + 1] if n else np.zeros(1, np.uint64)
                out.append((first, np.full(len(first), k), np.full(len(first), n), np.arange(len(first))))
            token, row, size, place = (np.concatenate(x) for x in zip(*out, strict=True))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), b.column("key").take(row), b.column("label").take(row), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))], ["token", "key", "label", "size", "place"])


def _list_pairs(label: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unequal labels in one list whose sizes and places leave room for enough shared shingles.

    What has the list's commonest label is compared with the others alone, so a group that is known to be one costs as much as what isn't of it.
    """
    kinds, own, n = np.unique(label, return_inverse=True, return_counts=True)
    if len(kinds) == 1:
        return
    odd = np.flatnonzero(own != n.argmax())
    step = max(1, PAIRS_BLOCK // len(label))
    index, rest = np.arange(len(label)), size - place
    for lo in range(0, len(odd), step):
        i = odd[lo : lo + step, None]
        both = size[i] + size[None]
        # a pair of two odd ones is met from either side, and taken from one
        fits = (own[i] != own[None]) & ((own[None] == n.argmax()) | (index[None] < i))
        fits &= np.minimum(rest[i], rest[None]) * (1 + similarity) >= similarity * both - 1e-6
        x, y = np.nonzero(fits)
        yield i[x, 0], y


def unlinked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of nodes of unequal labels that meet in a list (rows sorted by token) and may be similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(token, key, label, size, place) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.diff(token)) + 1
        begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(token)]])
        for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
            if hi - lo < 2:
                continue
            if size[lo] == 0 == size[hi - 1] and token[lo] == 0:
                # texts without shingles are alike
                pairs = [(np.arange(lo, hi - 1), np.arange(lo + 1, hi))]
            else:
                pairs = ((i + lo, j + lo) for i, j in _list_pairs(label[lo:hi], size[lo:hi], place[lo:hi], similarity))
            for i, j in pairs:
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(key[i], key[j])), pa.array(np.minimum(key[i], key[j]))], schema=schema)

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "key", "label", "size", "place")))
        if held[-1][0][-1] == held[0][0][0]:
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        yield from of(*(x[:cut] for x in columns))
        held = [tuple(x[cut:] for x in columns)]
    if held:
        yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))


def similar_texts(nodes: DataFrame, texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): links of nodes (key, fp, fp1, fp2, fp3, size, sketch) whose texts (key, text) have that Jaccard similarity of their shingles.

    Links connect what is connected: of pairs that lie close in all of the fingerprint a tree for each posting list, verified on the
    texts. Texts are sent only for pairs that can be similar by their sketches. A few position sets come first; what their links connect, and pairs that they have compared, aren't compared again under
    the others, so a large group of near copies is verified over a few links a text and not over as many as there are sets. Those others also propose
    the closest neighbours in long lists, for texts whose pivot was unlike. Last, what isn't connected yet meets by ``prefixes``, which no similar pair
    escapes: in the worst case, many texts that share common shingles and are no copies, that compares all of them.
    """
    lanes = ("fp", "fp1", "fp2", "fp3")
    octets = F.array(*[F.shiftrightunsigned(lane, 8 * k).bitwiseAND(0xFF) for lane in lanes for k in range(8)])
    # a set is one number, so that the plan stays as short as for one set
    packed = [k << 24 | p << 18 | q << 12 | r << 6 | up for k, (p, q, r, up) in enumerate(wide_sets())]

    def candidates(labelled: DataFrame, sets: list[int], nearest: Close | None = None) -> DataFrame:
        part = lambda up: F.shiftright("set", up).bitwiseAND(0x3F)
        byte = lambda up: F.get("octets", part(up))
        two = F.shiftleft(F.shiftleft(F.shiftright("set", 24).cast("long"), 8).bitwiseOR(byte(18)), 8).bitwiseOR(byte(12))
        half = F.when(part(0) == 4, F.shiftright(byte(6), 4)).otherwise(byte(6)).bitwiseAND(0xF)
        lists = labelled.select(F.col("key").alias("node"), "label", *lanes, octets.alias("octets")).select("*", F.explode(F.lit(sets)).alias("set"))
        lists = lists.select("node", "label", *lanes, F.shiftleft(two, 4).bitwiseOR(half).alias("key"))
        lists = lists.repartition("key").sortWithinPartitions("key", "node")
        return common.checkpointed(lists.mapInArrow(lambda it: links(it, close_wide, lanes, "node", "label", False, nearest), "a long, b long").distinct())

    def verified(edges: DataFrame) -> DataFrame:
        marks = nodes.select("key", "size", "sketch")
        pairs = edges.join(marks.toDF("a", "m", "x"), "a").join(marks.toDF("b", "n", "y"), "b")
        edges = common.checkpointed(pairs.mapInArrow(lambda it: _roomy(it, similarity), "a long, b long"))
        ends = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        known = common.checkpointed(texts.join(ends, "key", "left_semi").groupBy("key").agg(F.any_value("text").alias("text")))
        common.released(spark)
        pairs = edges.join(known.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(known.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
        return common.checkpointed(pairs.sortWithinPartitions("a").mapInArrow(lambda it: _similar(it, words, similarity), "a long, b long"))

    spark = nodes.sparkSession
    common.released(spark)
    early = candidates(nodes.select("key", *lanes, F.col("key").alias("label")), packed[:FIRST_SETS])
    common.released(spark)
    first = verified(early)
    common.released(spark)
    reach = common.components(first).select(F.col("node").alias("key"), F.col("component").alias("label"))
    labelled = common.checkpointed(nodes.select("key", *lanes).join(reach, "key", "left").withColumn("label", F.coalesce("label", "key")))
    common.released(spark)
    late = candidates(labelled, packed[FIRST_SETS:], lambda a, b: close_wide(a, b, NEAR_BITS)).join(early, ["a", "b"], "left_anti")
    late = common.checkpointed(late)
    common.released(spark)
    second = verified(late)
    common.released(spark)
    found = first.unionByName(second)
    # what the fingerprints miss: exact candidates between texts that aren't connected yet
    reach = common.components(found).select(F.col("node").alias("key"), F.col("component").alias("label"))
    one = texts.groupBy("key").agg(F.any_value("text").alias("text")).join(reach, "key", "left").withColumn("label", F.coalesce("label", "key"))
    common_last = common_shingles(texts, nodes.count(), words)
    common.released(spark)
    lists = one.mapInArrow(lambda it: prefixes(it, words, similarity, common_last), "token long, key long, label long, size int, place int")
    lists = lists.repartition("token").sortWithinPartitions("token")
    left = common.checkpointed(lists.mapInArrow(lambda it: unlinked(it, similarity), "a long, b long").distinct())
    common.released(spark)
    third = verified(left.join(early.unionByName(late), ["a", "b"], "left_anti"))
    common.released(spark)
    return found.unionByName(third)


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs (doc_id, text, ...) of each group of near copies, that of the smallest doc_id; all columns stay, whatever their names.

    Near copies have shingles of five words whose Jaccard similarity is 0.8 or more; groups are what such links connect. Candidates
    come from an index over 256-bit fingerprints, in which a posting has two and a half of 32 positional bytes; pairs that share as many and
    differ in few bits are verified on the texts, so no other texts are linked; what that index misses is found by prefixes of the texts' shingles.

    Null doc_ids come last; of equal doc_ids the smallest hash of the text stays, and of rows that repeat both any one. Null and
    empty texts are one group. An empty table stays empty.
    """
    names = docs.columns
    key, id_, k = common.fresh(names, "key", "id", "k")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", hashed.alias("key"), "text")
    marks = rows.mapInArrow(lambda it: fingerprints(it, words, ("key",), 4, True), "doc_id long, key long, fp long, fp1 long, fp2 long, fp3 long, size int, sketch binary")
    lanes = ("fp", "fp1", "fp2", "fp3", "size", "sketch")
    own = marks.groupBy("key", "doc_id").agg(*[F.min(c).alias(c) for c in lanes], F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("i"))).alias("first")
    nodes = common.checkpointed(own.groupBy("key").agg(*[F.min(c).alias(c) for c in lanes], least, F.max("n").alias("n")))
    reach = common.components(similar_texts(nodes.select("key", *lanes), rows.select("key", "text"), words, similarity))
    first = F.min(F.struct("first.late", "first.i", F.col("key").alias("k"))).alias("first")
    groups = nodes.join(reach, nodes.key == reach.node, "left").groupBy(F.coalesce("component", "key").alias("component")).agg(first)
    kept = common.checkpointed(groups.select(F.col("first.i").alias(id_), F.col("first.k").alias(k)))
    whole = docs.withColumn(key, hashed)
    left = whole.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(k)), "left_semi")
    if not nodes.filter("n > 1").isEmpty():  # rows that repeat doc_id and text
        left = left.dropDuplicates(["doc_id", key])
    return left.select(*[F.col(f"`{n}`") for n in names])


def op9_simhash(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
