"""Toxicity: a linear-chain conditional random field over words with two tags, toxic (T) and other (O).

Labels are given for documents, so the token labels are derived first: a word or word beginning that occurs in far more
toxic documents than chance allows, and hardly in others, labels its occurrences in toxic documents T; all other
tokens are O. The field is fitted on those tokens by gradient ascent. Forward-backward marginals tag each word of a
text; they aggregate to a document score, calibrated on the labelled documents, and to offending offsets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

#: Labelled documents that the model is fitted on at most, about, and the characters of the longest of them.
SAMPLE_DOCS, DOC_CHARS = 4000, 30_000
#: Words whose emission a task remembers.
REMEMBERED = 200_000
#: Words of a chain that are scanned together; a longer text is cut, its parts joined exactly.
SEGMENT = 256
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_STARTS = (3, 4, 5, 6, 7)
_WORD = re.compile(r"\S+")


def core(word: str) -> str:
    return word.strip(_EDGE).lower()


def features(word: str) -> list[str]:
    """Names of a word's features: itself, its beginnings and endings, its shape."""
    w = core(word)
    n = len(w)
    names = ["bias", "w=" + w, f"n={min(n, 9)}"]
    names += ["p=" + w[:k] for k in _STARTS if n > k]
    names += ["s=" + w[-k:] for k in (2, 3) if n > k]
    if not w.isalpha() and any(c.isdigit() for c in w):
        names.append("digit")
    return names


def _marginals(e: np.ndarray, lengths: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of T at each place, from emission odds e (places, chains), longest chain first, and also forward and backward odds.

    way holds exp(OO, OT, TO, TT). A chain is a column; forward and backward odds are T's over O's.
    """
    oo, ot, to, tt = way
    most, n = e.shape
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(most)]  # chains longer than t
    fore, back = np.ones_like(e), np.ones_like(e)
    r = e[0].copy()
    fore[0] = r
    for t in range(1, most):
        a = active[t]
        r = r[:a]
        r = e[t, :a] * (r * tt + ot) / (r * to + oo)
        fore[t, :a] = r
    for t in range(most - 2, -1, -1):
        a = active[t + 1]
        s = e[t + 1, :a] * back[t + 1, :a]
        back[t, :a] = (tt * s + to) / (ot * s + oo)
    return fore * back, fore, back


def _chains(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of all chains end to end as (places, chains), longest first; and where each value went."""
    order = np.argsort(-lengths, kind="stable")
    column = np.empty(len(lengths), np.int64)
    column[order] = np.arange(len(lengths))
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    col = np.repeat(column, lengths)
    grid = np.ones((int(lengths.max()), len(lengths)))
    grid[place, col] = values
    return grid, lengths[order], place, col


def _after(m: tuple, r: np.ndarray) -> np.ndarray:
    """The odds that a map makes of odds r."""
    a, b, c, d = m
    return (a * r + b) / (c * r + d)


def long_marginals(e: np.ndarray, lengths: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Odds of T at each place of chains end to end, as _marginals gives them.

    Chains are cut in segments that are scanned side by side. What a segment does to the odds that come in from its
    left or right is one fractional linear map, so the maps of a chain's segments carry the odds across exactly.
    """
    oo, ot, to, tt = way
    parts = -(-lengths // SEGMENT)
    chain = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(SEGMENT, lengths[chain] - number * SEGMENT)
    grid = np.ones((int(size.max()), len(chain)))
    col = np.repeat(np.arange(len(chain)), size)
    place = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
    grid[place, col] = e
    first, last = number == 0, number == parts[chain] - 1
    full, rows = np.flatnonzero(~last), len(grid)
    one, zero = np.ones(len(chain)), np.zeros(len(chain))

    # forward: the map of every segment that another follows, then the odds before each segment
    a, b, c, d = one, zero, zero, one
    for t in range(rows if len(full) else 0):
        x = grid[t]
        a, b, c, d = x * (tt * a + ot * c), x * (tt * b + ot * d), to * a + oo * c, to * b + oo * d
        if t == 0:
            a, b, c, d = np.where(first, 0.0, a), np.where(first, x, b), np.where(first, 0.0, c), np.where(first, 1.0, d)
        scale = 1 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    before = np.ones(len(chain))
    for k in range(int(parts.max()) - 1):
        at = full[number[full] == k]
        before[at + 1] = _after((a[at], b[at], c[at], d[at]), before[at])
    fore = np.empty_like(grid)
    r = before
    for t in range(rows):
        r = grid[t] * (r * tt + ot) / (r * to + oo) if t else np.where(first, grid[0], grid[0] * (r * tt + ot) / (r * to + oo))
        fore[t] = r

    # backward: the same from the right; a step counts where the place to its right is inside the segment
    a, b, c, d = one, zero, zero, one
    for t in range(rows - 2, -1, -1) if len(full) else ():
        x, inside = grid[t + 1], t + 1 < size
        m = tt * x * a + to * c, tt * x * b + to * d, ot * x * a + oo * c, ot * x * b + oo * d
        scale = 1 / (m[0] + m[1] + m[2] + m[3])
        a, b, c, d = (np.where(inside, n * scale, o) for n, o in zip(m, (a, b, c, d), strict=True))
    after = np.ones(len(chain))
    for k in range(int(parts.max()) - 1, 0, -1):
        at = np.flatnonzero(number == k)
        y = grid[0, at] * _after((a[at], b[at], c[at], d[at]), after[at])
        after[at - 1] = (tt * y + to) / (ot * y + oo)
    back = np.empty_like(grid)
    q = after
    back[rows - 1] = q
    for t in range(rows - 2, -1, -1):
        y = grid[t + 1] * q
        q = np.where(t + 1 < size, (tt * y + to) / (ot * y + oo), q)
        back[t] = q
    return fore[place, col] * back[place, col]


@dataclass
class Tagger:
    weights: dict[str, float]  # of a feature: T less O
    way: np.ndarray  # log weights of OO, OT, TO, TT
    calibration: tuple[float, float, float]
    base: float

    def emission(self, word: str) -> float:
        of = self.weights.get
        return math.exp(min(30.0, max(-30.0, sum([of(n, 0.0) for n in features(word)]))))

    def tagged(self, chains: list) -> list[np.ndarray]:
        """Probability of T of every token of some texts, given emission odds."""
        lengths = np.array([len(c) for c in chains])
        some = np.flatnonzero(lengths)
        out = [np.zeros(0)] * len(chains)
        if len(some):
            odds = long_marginals(np.concatenate([np.asarray(chains[k], np.float64) for k in some]), lengths[some], np.exp(self.way))
            for k, p in zip(some, np.split(odds / (1 + odds), np.cumsum(lengths[some])[:-1]), strict=True):
                out[k] = p
        return out

    def score(self, p: np.ndarray) -> float:
        """Document score from its tokens' marginals; an empty text has the base rate of a text without a sign."""
        a, b, c = self.calibration
        top, mass = signs(p)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * top + c * mass))))


def signs(p: np.ndarray) -> tuple[float, float]:
    """Log odds of the most toxic token, and of any token being toxic, both bounded."""
    if not len(p):
        return -12.0, -12.0
    top = float(np.clip(p.max(), 6e-6, 1 - 6e-6))
    none = float(np.log1p(-np.clip(p, 0, 1 - 1e-9)).sum())
    some = float(np.clip(-np.expm1(none), 6e-6, 1 - 6e-6))
    return math.log(top / (1 - top)), math.log(some / (1 - some))


def seeds(texts: Callable[[], Iterable[set[str]]], toxic: np.ndarray) -> set[str]:
    """Words and beginnings (``lowe~``) that mark toxic documents; by a log-likelihood ratio against chance."""
    rate = toxic.mean()
    own, all_ = Counter(), Counter()
    for words, y in zip(texts(), toxic, strict=True):
        if y:
            own.update(words | {w[:k] + "~" for w in words for k in _STARTS[1:] if len(w) > k})
    own = {name: k for name, k in own.items() if k > 2 and len(name) > 2}
    for words in texts():
        names = words | {w[:k] + "~" for w in words for k in _STARTS[1:] if len(w) > k}
        all_.update(names & own.keys())
    found = set()
    for name, k in own.items():
        n = all_[name]
        p = (k - 0.5) / n
        if p >= 0.4 and k * math.log(p / rate) + ((n - k) * math.log((1 - p) / (1 - rate)) if n > k else 0.0) >= 12:
            found.add(name)
    return found


def _is_seed(word: str, marks: set[str]) -> bool:
    return word in marks or any(word[:k] + "~" in marks for k in _STARTS[1:] if len(word) > k)


def fit(texts: list[str], toxic: list[int], rounds: int = 60, l2: float = 1e-3) -> Tagger:
    y = np.array(toxic, bool)
    rate = float((y.sum() + 0.5) / (len(y) + 1))
    flat = (math.log(rate / (1 - rate)), 0.0, 0.0)
    nothing = Tagger({}, np.zeros(4), flat, rate)
    if not y.any() or y.all():
        return nothing
    # a document is an array of numbers of its words' spellings
    kinds: dict[str, int] = {}
    words = [np.array([kinds.setdefault(w, len(kinds)) for w in t.split()], np.int32) for t in texts]
    cores = np.array([core(w) for w in kinds], object)
    marks = seeds(lambda: (set(cores[np.unique(ws)]) - {""} for ws in words), y)
    if not marks:
        return nothing
    begin = {m.rstrip("~")[:4] for m in marks}
    seed = np.array([_is_seed(c, marks) for c in cores])
    near = np.array([c[:4] in begin for c in cores])
    # training chains: around seeds in toxic documents; of others a steady sample, and around words that begin like seeds
    chains, labels = [], []
    for ws, t in zip(words, y, strict=True):
        at = np.flatnonzero(seed[ws] if t else near[ws])[:40].tolist()
        spans = [(max(0, k - 6), k + 7) for k in at] + [(k, k + 24) for k in range(0, len(ws), max(24, len(ws) // 3 or 1))][:3]
        last = 0
        for lo, hi in sorted(spans):
            lo, hi = max(lo, last), min(hi, len(ws))
            if hi > lo:
                chains.append(ws[lo:hi])
                labels.append(seed[ws[lo:hi]] & t)
                last = hi
    seen, token = np.unique(np.concatenate(chains), return_inverse=True)
    spelled = list(kinds)
    names: dict[str, int] = {}
    slots = [[names.setdefault(n, len(names)) for n in features(spelled[k])] for k in seen]
    owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    slot = np.concatenate([np.array(s) for s in slots])
    gold = np.concatenate(labels).astype(float)
    lengths = np.array([len(c) for c in chains])
    _, held, place, col = _chains(gold, lengths)
    shape = (int(lengths.max()), len(lengths))
    inside = np.ones(len(gold), bool)
    inside[np.cumsum(lengths) - 1] = False
    now = np.flatnonzero(inside)
    pairs = np.bincount((2 * gold[now] + gold[now + 1]).astype(int), minlength=4)
    w, way = np.zeros(len(names)), np.zeros(4)
    m = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    for step in range(1, rounds + 1):
        emission = np.bincount(owner, w[slot], len(slots))
        grid = np.ones(shape)
        grid[place, col] = np.exp(np.clip(emission[token], -30, 30))
        both, fore, back = _marginals(grid, held, np.exp(way))
        odds = both[place, col]
        p = odds / (1 + odds)
        f, nxt = fore[place[now], col[now]], (grid * back)[place[now + 1], col[now + 1]]
        joint = np.stack([np.ones(len(now)) * np.exp(way[0]), nxt * np.exp(way[1]), f * np.exp(way[2]), f * nxt * np.exp(way[3])])
        joint /= joint.sum(axis=0)
        up = np.concatenate([np.bincount(slot, np.bincount(token, gold - p, len(slots))[owner], len(names)), pairs - joint.sum(axis=1)])
        up = up / len(gold) * 100 - l2 * np.concatenate([w, way])
        m[0] = 0.9 * m[0] + 0.1 * up
        m[1] = 0.99 * m[1] + 0.01 * up * up
        change = 0.3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
        w, way = w + change[:-4], way + change[-4:]
    tagger = Tagger({n: float(x) for n, x in zip(names, w, strict=True) if abs(x) > 1e-3}, way - way[0], flat, rate)
    emission = np.array([tagger.emission(w) for w in spelled])
    x = np.array([signs(p) for lo in range(0, len(words), 500) for p in tagger.tagged([emission[ws] for ws in words[lo : lo + 500]])])
    tagger.calibration = _calibrated(x, y.astype(float))
    return tagger


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a light penalty, by Newton's method; slopes can't be negative."""
    a = np.column_stack([np.ones(len(x)), x.sum(axis=1)])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-1])
        w = w + np.linalg.solve(h, a.T @ (y - p) - np.array([1e-2, 1e-1]) * w)
    slope = max(float(w[1]), 0.0)
    return float(w[0]), slope, slope


class _Emissions(dict):
    """Emission odds of words, each computed when first asked for."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger = tagger

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = self.tagger.emission(word)
        return value


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
SPANS_DDL = "array<struct<first: int, end: int, p: double>>"


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Offsets in characters of runs of words tagged T."""
    out: list[dict] = []
    if not len(p) or p.max() < least:
        return out
    before = -2
    for k, m in enumerate(_WORD.finditer(text)):
        if p[k] >= least:
            if before == k - 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[k]))}
            else:
                out.append({"first": m.start(), "end": m.end(), "p": float(p[k])})
            before = k
    return out


def scored_texts(column: pa.Array, tagger: Tagger, emit: _Emissions, part_chars: int = 2_000_000) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Texts in runs of bounded size with their marginals."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= part_chars:
            yield texts, tagger.tagged([list(map(emit.__getitem__, t.split())) for t in texts])
            texts, size = [], 0
    if texts:
        yield texts, tagger.tagged([list(map(emit.__getitem__, t.split())) for t in texts])


def trained(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> Tagger:
    """A tagger fitted on a bounded sample of docs (doc_id, text) with labels (doc_id, toxic).

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out. A doc_id labelled twice is toxic if any label is; null
    labels don't count. The sample is drawn by a hash of doc_id; of rows that repeat a doc_id one stands for all, so its
    size is bounded by SAMPLE_DOCS texts of DOC_CHARS. Null doc_ids have no label. Without labels of both kinds the tagger knows nothing.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out:
        known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, SAMPLE_DOCS / max(known.count(), 1))))
    own = docs.select("doc_id", "text").filter(F.length("text") <= DOC_CHARS).join(F.broadcast(picked), "doc_id")
    rows = own.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).toPandas().sort_values("doc_id")
    tagger = fit(rows["text"].tolist(), rows["toxic"].tolist())
    del rows
    common.trimmed()
    return tagger


def tag(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, score, spans) of every row of docs; null and empty texts are scored as texts without any sign."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = _Emissions(tagger)
        for b in batches:
            score, found = [], []
            for texts, marginals in scored_texts(b.column("text"), tagger, emit):
                score += [tagger.score(p) for p in marginals]
                found += [spans(t, p) for t, p in zip(texts, marginals, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array(found, _SPANS)], ["doc_id", "score", "spans"])
        del emit
        common.trimmed()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, spans {SPANS_DDL}")


def without_toxic(docs: DataFrame, tagger: Tagger, least: float = 0.3) -> DataFrame:
    """Rows of docs that score below ``least``; all columns stay, whatever their names.

    Null and empty texts are scored as texts without any sign; repeated rows stay or go together; an empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = _Emissions(tagger)
        for b in batches:
            keep = [tagger.score(p) < least for _, marginals in scored_texts(b.column("text"), tagger, emit) for p in marginals]
            yield b.filter(pa.array(keep, pa.bool_()))
        del emit
        common.trimmed()

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = tag(docs, trained(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
