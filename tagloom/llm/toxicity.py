"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams of 3 to 6 signs, with its edges
marked, and of the whole word; each n-gram has a vector in a hashed table. The
mean of a word's n-gram vectors stands for the word, and the mean of the words
of a short window for the window; a linear softmax tells toxic windows from
others. A text is as toxic as its most toxic window, so that one insult in a very
long text counts as much as in a short one. Vectors and softmax are trained
together in numpy, on whole documents, with n-grams left out at random, so that a
misspelt or unseen word that shares some n-grams with known ones is near them.
A logistic curve, fitted on the same sample, makes the score a probability.

Null and blank texts, and those without a letter or digit, have no window and score
as the softmax's bias does. Rows, with null ids too, are scored each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.tables import bounded_batches
from tagloom.llm.textblocks import blocks, codepoints, lookup, mix, through, utf8

_FOLD = lookup(lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c), np.uint32)
#: 0 white space, 1 letter or digit, 2 another sign.
_SORT = lookup(lambda c: 0 if c.isspace() else 1 if c.isalnum() else 2, np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Code points that mark a word's edges; no text holds them.
_OPEN, _CLOSE = 0x110000, 0x110001
SIZES = (3, 4, 5, 6)


def words_of(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the words of texts given as code points with offsets `at`:
    runs without white space, from the first letter or digit to the last."""
    kind = through(_SORT, points)
    n = len(points)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    dark = kind > 0
    first = np.flatnonzero(dark & (edge[:-1] | np.concatenate(([True], ~dark[:-1]))))
    last = np.flatnonzero(dark & (np.concatenate((~dark[1:], [True])) | edge[1:])) + 1
    sure = np.flatnonzero(kind == 1)
    lo, hi = np.searchsorted(sure, first), np.searchsorted(sure, last)
    some = hi > lo
    start, end = sure[lo[some]], sure[hi[some] - 1] + 1
    return np.searchsorted(at, start, "right") - 1, start, end


def subwords(points: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets by word): the hashed n-grams of each word and the word itself."""
    size = end - start + 2
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    if not total:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    begin = stop - size
    padded = np.empty(total, np.uint64)
    inside = np.ones(total, bool)
    inside[begin] = inside[stop - 1] = False
    padded[begin], padded[stop - 1] = _OPEN, _CLOSE
    take = np.repeat(start - begin - 1, size) + np.arange(total)
    padded[inside] = through(_FOLD, points[take[inside]])
    up = np.full(total, _BASE)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(total, _BACK)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(padded + np.uint64(1)) * up, dtype=np.uint64)))
    word = np.repeat(np.arange(len(size)), size)
    left = stop[word] - np.arange(total)  # signs from here to the word's end
    shift = np.uint64(64 - bits)
    parts, owner = [], []
    for n in SIZES:
        i = np.flatnonzero((left >= n) & (size[word] != n))
        parts.append((mix((sums[i + n] - sums[i]) * down[i] + np.uint64(n)) >> shift).astype(np.int32))
        owner.append(word[i])
    parts.append((mix((sums[stop] - sums[begin]) * down[begin] + np.uint64(1)) >> shift).astype(np.int32))
    owner.append(np.arange(len(size)))
    owned = np.concatenate(owner)
    order = np.argsort(owned, kind="stable")
    return np.concatenate(parts)[order], np.concatenate(([0], np.cumsum(np.bincount(owned, minlength=len(size)))))


@dataclass
class SubwordModel:
    """Vectors of n-gram buckets, the softmax over (other, toxic), the curve of a text's probability."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    curve: tuple[float, float]
    window: int
    bits: int

    def slopes(self) -> np.ndarray:
        """What each bucket adds to the log-odds of toxic where it is the whole mean."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32)

    def word_vector(self, word: str) -> np.ndarray:
        points = np.array([ord(c) for c in word], np.uint32)
        grams, _ = subwords(points, np.array([0]), np.array([len(points)]), self.bits)
        return self.vectors[grams].mean(axis=0)

    def log_odds(self, raw: np.ndarray, offsets: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-odds of each text, code points at which its most toxic window starts and ends)."""
        points, at = codepoints(raw, offsets)
        row, start, end = words_of(points, at)
        texts = len(offsets) - 1
        bias = float(self.bias[1] - self.bias[0])
        odds, lo, hi = np.full(texts, bias), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        if len(row):
            grams, cut = subwords(points, start, end, self.bits)
            word = np.add.reduceat(slopes[grams], cut[:-1]) / np.diff(cut)
            head, per = windows(row, self.window)
            mean = np.add.reduceat(word.astype(np.float64), head) / per
            of = row[head]
            order = np.lexsort((np.arange(len(of)), -mean, of))
            best = order[np.concatenate(([True], of[order][1:] != of[order][:-1]))]
            t = of[best]
            odds[t] = mean[best] + bias
            lo[t], hi[t] = start[head[best]] - at[t], end[head[best] + per[best] - 1] - at[t]
        return odds, lo, hi


def windows(row: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of each window: at most `most` words of one text that follow each other."""
    place = np.arange(len(row)) - np.searchsorted(row, row)
    head = np.flatnonzero(place % most == 0)
    return head, np.diff(np.append(head, len(row)))


def misspelt(word: bytes, rng: np.random.Generator) -> bytes:
    """A word of code points (four bytes each) with one sign lost, doubled, masked or changed for a
    digit, or two exchanged; words under four signs stay."""
    n = len(word) // 4
    if n < 4:
        return word
    at, kind = 4 * int(rng.integers(1, n - 1)), int(rng.integers(0, 5))
    left, one, right = word[:at], word[at : at + 4], word[at + 4 :]
    if kind == 0:
        return left + right
    if kind == 1:
        return left + one + one + right
    if kind == 2:
        return left + right[:4] + one + right[4:]
    return left + int(ord("*") if kind == 3 else rng.integers(48, 58)).to_bytes(4, "little") + right


def fit(texts: list[str], label: np.ndarray, toxic_share: float | None = None, window: int = 4, bits: int = 18, width: int = 8, steps: int = 700, batch: int = 64, left_out: float = 0.6, unseen: float = 0.4, wrong: float = 0.5, forms: int = 2, apart: int = 10, rate: float = 0.25, ease: float = 1e-6, seed: int = 11) -> SubwordModel:
    """Vectors and softmax by AdaGrad on the cross-entropy of whole texts; both labels weigh the same. The
    curve is for texts of which `toxic_share` are toxic; without it, for those given.

    In each step, at random, a share `left_out` of the n-grams is ignored, a share `wrong` of the texts
    is read with its words misspelt, and a share `unseen` of the windows of toxic texts may not speak for them,
    so that neither a word's common spelling nor a text's plainest insult is all that is learnt."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (1 << bits, width)).astype(np.float32)
    weights = np.stack([-np.ones(width), np.ones(width)]) * rng.choice([-1.0, 1.0], width) * 0.5
    model = SubwordModel(vectors, weights, np.zeros(2), (1.0, 0.0), window, bits)
    if not len(texts) or label.min() == label.max():
        share = (float(label.sum()) + 0.2) / (len(label) + 1)
        model.vectors[:] = 0
        model.curve = (1.0, float(np.log(share / (1 - share))))
        return model
    # Words of all texts by number, so that a word's n-grams are held once.
    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    known: dict[str, int] = {}
    per_text = []
    for k in range(len(texts)):
        points, at = codepoints(raw[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
        folded = through(_FOLD, points).tobytes()
        _, start, end = words_of(points, at)
        per_text.append(np.array([known.setdefault(folded[4 * a : 4 * b], len(known)) for a, b in zip(start, end, strict=True)], np.int32))
    # Misspelt forms follow, so that word w is misspelt as w + half, w + 2 half and so on.
    half = len(known)
    plain = list(known)
    del raw, known
    found, counts = [], [np.zeros(1, np.int64)]
    for form in range(forms + 1):
        for a in range(0, half, 20_000):  # n-grams of a bounded number of words at once
            some = plain[a : a + 20_000] if not form else [misspelt(w, rng) for w in plain[a : a + 20_000]]
            ends = np.cumsum([len(w) // 4 for w in some])
            part, own = subwords(np.frombuffer(b"".join(some), np.uint32), np.concatenate(([0], ends[:-1])), ends, bits)
            found.append(part)
            counts.append(np.diff(own))
    grams, cut = np.concatenate(found), np.cumsum(np.concatenate(counts))
    del plain, found, counts
    held = np.array([k for k in range(len(texts)) if len(per_text[k])])
    # Of either label one text in `apart` is for the curve alone, where there are as many.
    order = np.concatenate([held[label[held] == v] for v in (0, 1)])
    place = np.concatenate([np.arange((label[held] == v).sum()) for v in (0, 1)])
    tried = order[place % apart == apart - 1]
    some = np.setdiff1d(held, tried)
    rare = np.where(label == 1, 0.5 / max(1e-9, label[some].mean()), 0.5 / max(1e-9, 1 - label[some].mean()))
    seen_v, seen_w, seen_b = np.full(len(vectors), ease, np.float32), np.full(weights.shape, 1e-6), np.full(2, 1e-6)

    def forward(ks: np.ndarray, kept: float) -> tuple:
        words = np.concatenate([per_text[k].astype(np.int64) + half * int(kept < 1 and rng.random() < wrong and rng.integers(1, forms + 1)) for k in ks])
        row = np.repeat(np.arange(len(ks)), [len(per_text[k]) for k in ks])
        count = np.diff(cut)[words]
        head_of = np.concatenate(([0], np.cumsum(count)))
        flat = grams[np.repeat(cut[words] - head_of[:-1], count) + np.arange(head_of[-1])]
        on = np.ones(len(flat), np.float32) if kept >= 1 else (rng.random(len(flat), np.float32) < kept).astype(np.float32)
        slopes = model.slopes()
        parts = np.maximum(1, np.add.reduceat(on, head_of[:-1]))
        word = np.add.reduceat(slopes[flat] * on, head_of[:-1]) / parts
        head, per = windows(row, window)
        mean = np.add.reduceat(word.astype(np.float64), head) / per
        of = row[head]
        seen = mean if kept >= 1 else np.where((label[ks][of] == 1) & (rng.random(len(of)) < unseen), mean - 1e3, mean)
        order = np.lexsort((np.arange(len(of)), -seen, of))
        best = order[np.concatenate(([True], of[order][1:] != of[order][:-1]))]
        return mean[best] + model.bias[1] - model.bias[0], best, head, per, head_of, flat, on, parts

    done = 0
    while done < steps:
        deal = rng.permutation(some)
        for a in range(0, len(deal), batch):
            ks, done = deal[a : a + batch], done + 1
            z, best, head, per, head_of, flat, on, parts = forward(ks, 1 - left_out)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            d = (p - label[ks]) * rare[ks] / len(ks)
            # Only the windows that spoke for their texts learn.
            chosen = np.concatenate([np.arange(head[b], head[b] + per[b]) for b in best])
            owner = np.repeat(np.arange(len(ks)), per[best])
            count = np.diff(head_of)[chosen]
            skip = np.concatenate(([0], np.cumsum(count)))
            where = np.repeat(head_of[chosen] - skip[:-1], count) + np.arange(skip[-1])
            share = on[where] / np.repeat(parts[chosen] * per[best][owner], count)
            text = np.repeat(owner, count)
            g, pull = flat[where], d[text] * share
            means = np.zeros((len(ks), width))
            np.add.at(means, text, model.vectors[g] * share[:, None])
            slope_w = np.stack([-(d[:, None] * means).sum(axis=0), (d[:, None] * means).sum(axis=0)])
            # Several signs of one step that share a bucket are one step of it.
            distinct, back = np.unique(g, return_inverse=True)
            by_bucket = np.bincount(back, weights=pull)
            direction = model.weights[1] - model.weights[0]
            seen_v[distinct] += (by_bucket**2 * (direction**2).mean()).astype(np.float32)
            model.vectors[distinct] -= (rate * by_bucket / np.sqrt(seen_v[distinct]))[:, None].astype(np.float32) * direction.astype(np.float32)
            seen_w += slope_w**2
            model.weights -= 0.05 * slope_w / np.sqrt(seen_w)
            slope_b = np.array([-d.sum(), d.sum()])
            seen_b += slope_b**2
            model.bias -= 0.05 * slope_b / np.sqrt(seen_b)
    judged = tried if len(np.unique(label[tried])) == 2 else held
    z = np.concatenate([forward(judged[a : a + batch], 1.0)[0] for a in range(0, len(judged), batch)])
    a, b = _curve(z, label[judged])
    if toxic_share is not None and 0 < toxic_share < 1:  # a sample of even labels has more toxic texts than the corpus
        b += np.log(toxic_share / (1 - toxic_share)) - np.log(label[judged].mean() / (1 - label[judged].mean()))
    model.curve = (a, float(b))
    return model


def _curve(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The logistic curve of greatest likelihood over log-odds, by Newton's steps, held back a little."""
    a, b = 1.0, 0.0
    weight = np.ones(len(z))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([(weight * (label - p) * z).sum() - 0.1 * (a - 1), (weight * (label - p)).sum()])
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + move[0], b + move[1]
        if np.abs(move).max() < 1e-6:
            break
    return max(float(a), 1e-2), float(b)


def toxic_held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the model does not learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 2500, sample_chars: int = 20_000, **settings) -> SubwordModel:
    """Fits on at most `sample_rows` labelled documents, half of them toxic where there are
    as many: those of lowest id hash, without held-out ids, null labels and texts over
    `sample_chars` characters, and one text an id, the first in order. That bounds what the driver holds;
    scoring has no such bound. Ids of several labels count as toxic."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~toxic_held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    share, toxic = known.agg(F.avg("label"), F.sum("label")).first()
    pick = lambda v, n: known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = pick(1, sample_rows // 2).unionByName(pick(0, sample_rows - min(toxic or 0, sample_rows // 2)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id").where(F.length("text") <= sample_chars)
    sample = rows.groupBy("id", "label").agg(F.min("text").alias("text")).toArrow()
    order = np.lexsort((np.array([hash_of(t) for t in sample.column("text").to_pylist()], np.uint32), np.asarray(sample.column("label")))) if len(sample) else []
    texts, label = sample.column("text").to_pylist(), np.asarray(sample.column("label"))
    return fit([texts[k] for k in order], label[order] if len(order) else np.zeros(0, np.int64), share, **settings)


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def score(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 18) -> DataFrame:
    """(id_col, score, worst_start, worst_end): the probability that the whole text is toxic, and the
    code points between which its most toxic window stands (0 and 0 where it has no word)."""
    slopes, curve = model.slopes(), model.curve
    light = SubwordModel(np.zeros((0, 0), np.float32), model.weights, model.bias, curve, model.window, model.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            parts = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i, j in blocks(off, block_bytes):
                parts.append(light.log_odds(raw[off[i] : off[j]], off[i : j + 1] - off[i], slopes))
            z, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
            p = 1 / (1 + np.exp(-np.clip(curve[0] * z + curve[1], -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array(lo), pa.array(hi)], names=["id", "score", "worst_start", "worst_end"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, worst_start long, worst_end long").withColumnRenamed("id", id_col)
