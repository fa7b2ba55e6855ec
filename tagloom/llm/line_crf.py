"""Document quality by a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). A line's potential is linear in features of
the line and of its neighbours; neighbouring labels are tied by a transition
matrix. The model learns from document labels, given to all lines of a
document, on a bounded sample. A document's quality is the mean over its lines,
weighted by length, of the forward-backward marginal of good; a monotone
logistic curve, fitted on the same sample, makes it a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tagloom.llm.tables import bounded_batches, held_out
from tagloom.llm.textblocks import blocks, codepoints, lookup, mix, through, utf8

#: Kinds of characters: 0 other, 1 lower letter, 2 upper letter, 3 digit, 4 white space, 5 sentence mark, 6 bar or slash, 7 exclamation, 8 symbol.
_SYMBOLS, _MARKS, _BARS = set("#$%&*@^~+=<>_{}[]\\"), set(".,;:?'\"()-¿¡"), set("|/")


def _kind(c: str) -> int:
    if c.isalpha():
        return 2 if c.isupper() else 1
    if c.isdigit():
        return 3
    if c.isspace():
        return 4
    return 5 if c in _MARKS else 6 if c in _BARS else 7 if c == "!" else 8 if c in _SYMBOLS else 0


KIND = lookup(_kind, np.uint8)
_FOLD = lookup(lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c), np.uint32)
_WEIGHT = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OWN = ["length", "words", "lower", "upper", "digit", "mark", "bar", "bang", "symbol", "other", "word_length", "long_word", "odd_words", "distinct", "doubled", "repeated_line", "opens_upper", "closes", "accents", "single"]


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length of each line, row of each line) for the lines that hold
    something besides white space. A text without one has no line."""
    points, at = codepoints(raw, offsets)
    n = len(points)
    if not n:
        return np.zeros((0, len(OWN)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = through(KIND, points)
    edge = np.zeros(n + 1, bool)
    edge[at] = edge[0] = True
    edge[1:][points == 10] = True
    start = np.flatnonzero(edge[:-1])
    row = np.searchsorted(at, start, "right") - 1
    size = np.diff(np.append(start, n))
    per = np.stack([np.add.reduceat((kind == k).astype(np.int32), start) for k in range(9)], axis=1).astype(np.float64)
    accents = np.add.reduceat(((points > 127) & (kind <= 2)).astype(np.int32), start)
    ink = size - per[:, 4]
    # Words: runs without white space, within a line.
    dark = kind != 4
    first = np.flatnonzero(dark & (edge[:-1] | np.concatenate(([True], ~dark[:-1]))))
    last = np.flatnonzero(dark & (np.concatenate((edge[1:-1], [True])) | np.concatenate((~dark[1:], [True]))))
    length = last - first + 1
    line = np.searchsorted(start, first, "right") - 1
    lines = len(start)
    words = np.bincount(line, minlength=lines)
    # A word's hash: the sums of its folded characters under weights by place, up to 64.
    place = np.zeros(n, np.int64)
    if len(first):
        place[first[0] :] = np.arange(first[0], n) - np.repeat(first, np.diff(np.append(first, n)))
    value = np.where(dark & (kind != 5) & (kind != 7) & (kind != 8), mix(through(_FOLD, points).astype(np.uint64)) * _WEIGHT[np.minimum(place, 63)], np.uint64(0))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    hashes = sums[last + 1] - sums[first]
    order = np.lexsort((hashes, line))
    fresh = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1]))) if len(order) else np.zeros(0, bool)
    distinct = np.bincount(line[order][fresh], minlength=lines)
    twice = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))) if len(hashes) else np.zeros(0, bool)
    doubled = np.bincount(line[twice], minlength=lines)
    # Words with a symbol after letters, and words longer than any usual one.
    odd = np.add.reduceat(np.append((kind == 8) | (kind == 7) | (kind == 6), False).astype(np.int32), first)[: len(first)] > 0 if len(first) else np.zeros(0, bool)
    odd_words = np.bincount(line[odd], minlength=lines)
    long_word = np.bincount(line[length > 24], minlength=lines)
    whole = np.zeros(lines, np.uint64)
    np.add.at(whole, line, mix(hashes + (np.arange(len(line)) - np.searchsorted(line, line)).astype(np.uint64)))
    order = np.lexsort((whole, row))
    new = np.concatenate(([True], (whole[order][1:] != whole[order][:-1]) | (row[order][1:] != row[order][:-1])))
    group = np.cumsum(new) - 1
    copies = np.zeros(lines)
    copies[order] = np.bincount(group)[group]
    letters = np.maximum(1, per[:, 1] + per[:, 2])
    full = np.maximum(1, ink)
    w = np.maximum(1, words)
    opens = np.zeros(lines)
    closes = np.zeros(lines)
    if len(first):
        some = np.flatnonzero(words)
        f, e = np.searchsorted(line, some, "left"), np.searchsorted(line, some, "right") - 1
        opens[some] = kind[first[f]] == 2
        closes[some] = kind[last[e]] == 5
    own = np.stack([
        np.log1p(ink) / 5, np.log1p(words) / 4, per[:, 1] / full, per[:, 2] / letters, per[:, 3] / full, per[:, 5] / full, per[:, 6] / full * 5, per[:, 7] / full * 5, per[:, 8] / full * 5, per[:, 0] / full * 5,
        ink / w / 10, long_word / w, odd_words / w, distinct / w, doubled / w, (copies > 1).astype(float), opens, closes, accents / letters, (words <= 2).astype(float),
    ], axis=1).astype(np.float32)
    keep = ink > 0
    return own[keep], ink[keep].astype(np.int64), row[keep]


def with_neighbours(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Features of each line, of the lines before and after it in its text (zero
    at the ends), whether there are such, and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = (row[1:] == row[:-1])[:, None] if len(row) else np.zeros((0, 1), bool)
    before[1:] = own[:-1] * same
    after[:-1] = own[1:] * same
    has = np.zeros((len(row), 2), np.float32)
    has[1:, :1], has[:-1, 1:] = same, same
    return np.concatenate([own, before, after, has, np.ones((len(row), 1), np.float32)], axis=1)


@dataclass
class LineCrf:
    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    curve: tuple[float, float]
    empty: float

    def marginals(self, emit: np.ndarray, row: np.ndarray) -> np.ndarray:
        """P(good) of each line, forward-backward in all texts side by side."""
        return _forward_backward(emit, row, self.transition, self.start)[0]


def _forward_backward(emit: np.ndarray, row: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """(P(good) of each line, expected transitions less those of a text's end,
    P(good) of first lines). emit: log-odds of good from the line alone.

    Two labels, so a message is one log-odds number: passing message x through
    the transitions gives log((e^t01 + e^(x+t11)) / (e^t00 + e^(x+t10)))."""
    count = np.bincount(row) if len(row) else np.zeros(0, np.int64)
    texts = np.flatnonzero(count)
    count = count[texts]
    first = np.concatenate(([0], np.cumsum(count)))[:-1].astype(np.int64)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    t = transition
    fwd, bwd = np.zeros(len(emit)), np.zeros(len(emit))  # messages that come into a line from before and after
    steps = int(count.max()) if len(count) else 0
    alive = np.searchsorted(-count, -np.arange(steps), "left") if steps else []  # texts with more lines than step
    if steps:
        fwd[first] = start[1] - start[0]
    for s in range(1, steps):
        here = first[: alive[s]] + s
        x = fwd[here - 1] + emit[here - 1]
        fwd[here] = np.logaddexp(t[0, 1], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[1, 0])
    for s in range(steps - 2, -1, -1):
        here = first[: alive[s + 1]] + s
        x = bwd[here + 1] + emit[here + 1]
        bwd[here] = np.logaddexp(t[1, 0], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[0, 1])
    good = 1 / (1 + np.exp(-np.clip(fwd + emit + bwd, -60, 60)))
    pair = np.zeros((2, 2))
    inner = np.ones(len(emit), bool)
    inner[first] = False
    k = np.flatnonzero(inner)
    if len(k):
        x, y = fwd[k - 1] + emit[k - 1], bwd[k] + emit[k]
        log = np.stack([np.full(len(k), t[0, 0]), y + t[0, 1], x + t[1, 0], x + y + t[1, 1]], axis=1)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        pair = (p / p.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)
    return good, pair, good[first]


def _mean(good: np.ndarray, size: np.ndarray, row: np.ndarray, texts: int) -> np.ndarray:
    """Length-weighted mean by text; nan where a text has no line."""
    with np.errstate(invalid="ignore"):
        return np.bincount(row, weights=good * size, minlength=texts) / np.bincount(row, weights=size, minlength=texts)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, size: np.ndarray, row: np.ndarray, label: np.ndarray, rounds: int = 250, decay: float = 1e-3, sway: float = 2.0) -> LineCrf:
    """Maximum likelihood by Adam. row: dense text numbers; label: by text.
    Texts weigh the same whatever their length. `sway` bounds the transitions."""
    texts = len(label)
    if not texts or not len(row):
        return LineCrf(np.zeros(features.shape[1]), np.zeros((2, 2)), np.zeros(2), (1.0, 0.0), float(label.mean()) if texts else 0.5)
    y = label[row].astype(float)
    rare = np.where(label == 1, 0.5 / max(1e-9, label.mean()), 0.5 / max(1e-9, 1 - label.mean()))  # both labels weigh the same
    weight = size / np.bincount(row, weights=size, minlength=texts)[row] * rare[row]
    theta = np.zeros(features.shape[1] + 1)  # emissions; pull of equal neighbours
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    x = features.astype(np.float64)
    inner = np.concatenate(([False], row[1:] == row[:-1]))
    seen = float(inner.sum())
    for k in range(1, rounds + 1):
        pull = theta[-1]
        t = np.array([[pull, 0.0], [0.0, pull]])
        good, pair, _ = _forward_backward(x @ theta[:-1], row, t, np.zeros(2))
        slope = np.append(x.T @ (weight * (y - good)) / texts - decay * theta[:-1], (seen - pair[0, 0] - pair[1, 1]) / max(1.0, seen) - decay * theta[-1])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        theta[-1] = np.clip(theta[-1], 0, sway)
    t = np.array([[theta[-1], 0.0], [0.0, theta[-1]]])
    model = LineCrf(theta[:-1].copy(), t, np.zeros(2), (1.0, 0.0), 0.0)
    z = _logit(_mean(model.marginals(x @ model.emission, row), size, row, texts))
    some = ~np.isnan(z)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps of a two-parameter logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * z[some] + b, -50, 50)))
        g = np.array([((label[some] - p) * z[some]).sum() - 1e-2 * a, (label[some] - p).sum() - 1e-2 * b])
        w = p * (1 - p)
        h = np.array([[(w * z[some] ** 2).sum() + 1e-2, (w * z[some]).sum()], [(w * z[some]).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.curve = (max(float(a), 1e-3), float(b))
    blank = label[~some]
    model.empty = float((blank.sum() + 0.2) / (len(blank) + 1))
    return model


def score_texts(model: LineCrf, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    own, size, row = line_features(raw, offsets)
    texts = len(offsets) - 1
    good = model.marginals(with_neighbours(own, row).astype(np.float64) @ model.emission, row)
    z = model.curve[0] * _logit(_mean(good, size, row, texts)) + model.curve[1]
    return np.where(np.isnan(z), model.empty, 1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8(batch.column("text"))
        y = np.asarray(batch.column("label").cast(pa.int64()))
        for i, j in blocks(off):
            own, size, row = line_features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            cut = np.searchsorted(row, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(y[i:j]), pa.array([own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([size[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["label", "own", "size"],
            )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6000, sample_chars: int = 60_000) -> LineCrf:
    """Fits on at most `sample_rows` labelled documents, those of lowest id hash,
    without held-out ids, null labels and texts over `sample_chars` characters, and
    one text an id, the first in order; that bounds what the driver holds. Scoring
    has no such bound."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").where(F.coalesce(F.length("text"), F.lit(0)) <= sample_chars).groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label")
    sample = rows.mapInArrow(_featurize, "label long, own binary, size binary").toArrow()
    label = np.asarray(sample.column("label"))
    own = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, len(OWN)) for x in sample.column("own")]
    size = [np.frombuffer(x.as_buffer(), np.int64) for x in sample.column("size")]
    # One order whatever the partitions were.
    order = sorted(range(len(label)), key=lambda k: (label[k], zlib.crc32(own[k].tobytes()), len(size[k])))
    own, size, label = [own[k] for k in order], [size[k] for k in order], label[order] if len(order) else label
    row = np.repeat(np.arange(len(label)), [len(s) for s in size]).astype(np.int64)
    own_all = np.concatenate([np.zeros((0, len(OWN)), np.float32), *own])
    return fit(with_neighbours(own_all, row), np.concatenate([np.zeros(0, np.int64), *size]), row, label)


def score(docs: DataFrame, model: LineCrf, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a double column `score_col`: the probability that the whole
    text is of good quality. Null, empty and blank texts get the share of good
    among such texts of the sample, smoothed. The column replaces one of its name."""
    keep = [c for c in docs.columns if c != score_col]
    # Columns go to the workers under plain names: a name may hold a dot.
    plain = [f"c{k}" for k in range(len(keep))]
    at = plain[keep.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(at))
            parts = [np.zeros(0), *(score_texts(model, raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(np.concatenate(parts))], names=[*plain, "score"])

    rows = bounded_batches(docs).select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, plain, strict=True)))
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("score", DoubleType())])).toDF(*keep, score_col)


def score_slim(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) only, so that texts don't travel back from the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            parts = [np.zeros(0), *(score_texts(model, raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(parts))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: LineCrf, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns, whatever their names."""
    own = "_quality"
    while own in docs.columns:
        own += "_"
    return score(docs, model, text_col, own).where(F.col(own) >= threshold).drop(own)
