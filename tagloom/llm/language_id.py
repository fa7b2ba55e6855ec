"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier over
character n-grams of letters tells the languages with that bit set from the
others. A text's bit margins are decoded to the codeword of least loss, where a
bit's loss for a language is weighted by how well its classifier did on that
language in training; a small lead over the next codeword marks the text as
ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.llm.tables import bounded_batches, held_out
from tagloom.llm.textblocks import blocks, codepoints, lookup, mix, through, utf8

UNDETERMINED = "und"
#: Hashed n-gram space and n-gram sizes.
SPACE_BITS = 16
SIZES = (1, 2, 3)
_FOLD = lookup(lambda c: ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32, np.uint32)


def codebook(languages: int, seed: int = 11) -> np.ndarray:
    """Codewords as rows of -1 and 1. Up to 7 languages: all splits of them into
    two parts (the exhaustive code); more: the best of many random dense codes by
    least distance between rows, without constant or repeated columns."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 7:
        bits = np.arange(1, 2 ** (languages - 1))
        code = np.array([[1 if language == 0 else (1 if (int(b) >> (language - 1)) & 1 == 0 else -1) for b in bits] for language in range(languages)], np.int8)
        return code
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, most = None, -1
    for _ in range(200):
        code = np.where(rng.random((languages, width)) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(axis=1 - 1)) < languages]
        code = np.unique(code * code[:1], axis=1)
        apart = ((code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(languages, dtype=np.int64) * 10**6).min()
        if apart > most:
            best, most = code, int(apart)
    return best


def gram_ids(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, text) of every n-gram of folded letters; runs of other
    characters are one gap, and grams of gaps alone are left out."""
    c = through(_FOLD, points)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    gap = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (rows[1:] == rows[:-1]))
    c, rows, gap = c[keep].astype(np.uint64), rows[keep], gap[keep]
    ids, where = [], []
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + m]
        ok = rows[:m] == rows[n - 1 :]
        ok &= ~gap[:m] if n == 1 else ~(gap[:m] & gap[n - 1 :] & (n == 2))
        ids.append((mix(h[ok]) >> np.uint64(64 - SPACE_BITS)).astype(np.int64))
        where.append(rows[:m][ok])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(where)


def has_letter(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letters = np.concatenate(([0], np.cumsum(through(_FOLD, points) != 32)))
    return letters[offsets[1:]] > letters[offsets[:-1]]


@dataclass
class Ecoc:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-gram space x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits; rows sum to 1

    def margins(self, ids: np.ndarray, rows: np.ndarray, texts: int) -> np.ndarray:
        n = np.maximum(1, np.bincount(rows, minlength=texts))
        sums = np.stack([np.bincount(rows, weights=self.weights[ids, b], minlength=texts) for b in range(self.code.shape[1])], axis=1)
        # Evidence grows with the text, but slowly: n-grams of a text depend on each other.
        return (sums / n[:, None] + self.bias) * np.sqrt(np.minimum(n, 400))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its probability, lead in loss over the next)."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :])
        total = (loss * self.trust[None, :, :]).sum(axis=2) * self.code.shape[1]
        best = total.argmin(axis=1)
        least = total[np.arange(len(total)), best]
        p = 1 / np.exp(np.clip(least[:, None] - total, -50, 0)).sum(axis=1)
        rest = np.where(np.arange(total.shape[1])[None, :] == best[:, None], np.inf, total).min(axis=1) if total.shape[1] > 1 else np.full(len(total), np.inf)
        return best, p, rest - least


def _grams_by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8(batch.column("text"))
        langs = batch.column("lang")
        for i, j in blocks(off):
            points, at = codepoints(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            ids, rows = gram_ids(points, at)
            key, count = np.unique((rows << SPACE_BITS) + ids, return_counts=True)
            cut = np.searchsorted(key, np.arange(j - i + 1) << SPACE_BITS)
            grams = (key & ((1 << SPACE_BITS) - 1)).astype(np.uint32)
            count = count.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [langs.slice(i, j - i), pa.array([grams[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([count[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["lang", "grams", "counts"],
            )


def fit(langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray], smooth: float = 0.5) -> Ecoc | None:
    """One log-odds classifier for each bit, from n-gram shares averaged over texts;
    each language weighs the same in its side of a bit."""
    languages = sorted(set(langs))
    if not languages:
        return None
    code = codebook(len(languages))
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in langs])
    share = np.zeros((len(languages), 1 << SPACE_BITS))
    for k, g, c in zip(y, grams, counts, strict=True):
        np.add.at(share[k], g, np.minimum(c, 20))
    share = (share + smooth * (share.sum(axis=0) > 0)) + 1e-3
    share /= share.sum(axis=1, keepdims=True)
    weights = np.zeros((1 << SPACE_BITS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        on, off = code[:, b] > 0, code[:, b] < 0
        if on.any() and off.any():
            weights[:, b] = np.log(share[on].mean(axis=0)) - np.log(share[off].mean(axis=0))
    weights = np.clip(weights, -6, 6)
    model = Ecoc(languages, code, weights, np.zeros(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    n = [int(c.sum()) for c in counts]
    rows = np.repeat(np.arange(len(y)), [len(g) for g in grams])
    flat, times = np.concatenate([np.zeros(0, np.int64), *grams]).astype(np.int64), np.concatenate([np.zeros(0), *counts])
    sums = np.stack([np.bincount(rows, weights=weights[flat, b] * times, minlength=len(y)) for b in range(code.shape[1])], axis=1)
    margin = (sums / np.maximum(1, n)[:, None]) * np.sqrt(np.minimum(np.maximum(1, n), 400))[:, None]
    right = margin * code[y] > 0
    trust = np.array([right[y == k].mean(axis=0) for k in range(len(languages))]) + 1e-6
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_each: int = 1500, sample_chars: int = 20_000, rows_all: int = 60_000) -> Ecoc | None:
    """Learns every language of the table from the texts of at most `rows_each` ids,
    those of lowest hash, or fewer where `rows_all` would not do for all languages,
    but 20 at least. Held-out ids and texts of more than `sample_chars` characters
    are left out, and an id gives one text to a language, the first in order, so
    that repeated rows change nothing. The driver holds these texts' n-grams and
    half a megabyte for each language."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text_col).isNotNull() & (F.length(text_col) <= sample_chars))
    usable = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("c")).collect()  # a row for each language
    if not counts:
        return None
    each = min(rows_each, max(20, rows_all // len(counts)))
    # Before ids are ranked, about twice as many as asked for are let through by hash, so that no task ranks all ids of a language.
    near = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (2 * each + 50) / max(1, r.c))) for r in counts], "lang string, share double")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    ids = usable.select("lang", "id").join(F.broadcast(near), "lang").withColumn("place", place).where(F.col("place") < F.col("share") * (1 << 30)).select("lang", "id", "place").distinct()
    chosen = ids.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("place", "id"))).where(F.col("k") <= each).select("lang", "id")
    rows = usable.join(F.broadcast(chosen), ["lang", "id"], "left_semi").groupBy("lang", "id").agg(F.min("text").alias("text"))
    sample = rows.select("text", "lang").mapInArrow(_grams_by_text, "lang string, grams binary, counts binary").toArrow()
    return fit(sample.column("lang").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint32) for x in sample.column("grams")], [np.frombuffer(x.as_buffer(), np.uint32) for x in sample.column("counts")])


def predict_block(model: Ecoc | None, raw: np.ndarray, offsets: np.ndarray, lead: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    points, at = codepoints(raw, offsets)
    texts = len(offsets) - 1
    some = has_letter(points, at)
    if model is None:
        return [UNDETERMINED] * texts, np.zeros(texts), some
    best, p, ahead = model.decode(model.margins(*gram_ids(points, at), texts))
    return [model.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, p, 0.0), some & (ahead < lead)


def identify(docs: DataFrame, model: Ecoc | None, id_col: str = "doc_id", text_col: str = "text", lead: float = 0.5) -> DataFrame:
    """(id_col, lang_pred, score, ambiguous) of the whole text of every row.

    lang_pred is a learned language; `und` with score 0 where the text is null or
    has no letter, or where there was nothing to learn from. ambiguous: the next
    codeword's loss is less than `lead` above the best. Ties go to the language
    first in alphabetical order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            names, scores, doubt = [], [np.zeros(0)], [np.zeros(0, bool)]
            for i, j in blocks(off):
                a, b, c = predict_block(model, raw[off[i] : off[j]], off[i : j + 1] - off[i], lead)
                names += a
                scores.append(b)
                doubt.append(c)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(doubt))], names=["id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)
