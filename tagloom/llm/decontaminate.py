"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as their lower-cased letters and digits, so case, spacing and
punctuation do not matter. Benchmark items are cut into overlapping windows, long
ones for edited passages and short ones so close that any passage of a stated
length holds a whole one; a window of m characters may differ by k = floor(rate * m) edits. By the q-gram
lemma a region within k edits shares at least m + 1 - q (k + 1) q-grams with the
window, on diagonals that lie within k of each other. Shared q-grams are counted
in overlapping bands of 2 (k + 1) diagonals; bands that reach the bound are
verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.tables import bounded_batches, keyed_or_broadcast
from tagloom.llm.textblocks import blocks, codepoints, lookup, mix, through, utf8
from tagloom.plans.staging import Staged

_LOWER = lookup(lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c), np.uint32)
_WORDLY = lookup(str.isalnum, bool)
_FILTER_BITS = 22


def normal(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters and digits in lower case, their places in the input, offsets)."""
    at = np.flatnonzero(through(_WORDLY, points))
    return through(_LOWER, points[at]), at, np.searchsorted(at, offsets)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place."""
    n = max(0, len(points) - q + 1)
    out = np.zeros(n, np.uint64)
    wide = points.astype(np.uint64)
    done, part = 0, wide
    # Doubling: the hash of 2^b characters is made of two of 2^(b-1).
    span = 1
    while done < q:
        if q - done >= span and (q & span):
            out = out * np.uint64(0x9E3779B97F4A7C15) + part[done : done + n]
            done += span
        if done < q:
            part = mix(part[: len(part) - span] * np.uint64(0xD6E8FEB86659FD93) + part[span:]) if len(part) > span else part[:0]
            span *= 2
    return mix(out)


@dataclass
class Index:
    """Windows of benchmark items and the sorted hashes of their q-grams."""

    q: int
    item: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    lens: np.ndarray
    budget: np.ndarray
    gram: np.ndarray
    window: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    #: Items too short for a window, by their letters and digits.
    whole: dict[bytes, list[int]]
    longest_whole: int

    @property
    def bound(self) -> np.ndarray:
        return np.maximum(1, self.lens + 1 - self.q * (self.budget + 1))


def build_index(items: list[tuple[int, str]], q: int, rate: float, window: int, least: int, passage: int = 60) -> Index:
    short = max(q, 2 * passage // 3)
    item, pieces, lens, whole = [], [], [], {}
    for key, text in items:
        p = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        low, _, _ = normal(p, np.array([0, len(p)]))
        if len(low) < max(least, q):
            if len(low):
                whole.setdefault(low.tobytes(), []).append(key)
            continue
        starts = [0] if len(low) <= window + window // 4 else sorted({*range(0, len(low) - window, window // 2), len(low) - window})
        cut = [low if len(starts) == 1 else low[s : s + window] for s in starts]
        if len(low) >= passage:
            # Starts at most passage - short + 1 apart: the first one inside a passage has room for its window.
            cut += [low[s : s + short] for s in sorted({*range(0, len(low) - short, max(1, passage - short + 1)), len(low) - short})]
        for w in cut:
            item.append(key)
            pieces.append(w)
            lens.append(len(w))
    lens_a = np.array(lens, np.int64)
    # Short windows get a smaller budget, so that the lemma's bound stays above zero.
    budget = np.minimum((rate * lens_a).astype(np.int64), np.maximum(0, lens_a // q - 2))
    gram = [grams(w, q) for w in pieces]
    count = [len(g) for g in gram]
    all_grams = np.concatenate([np.zeros(0, np.uint64), *gram])
    order = np.argsort(all_grams, kind="stable")
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[(all_grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(
        q, np.array(item, np.int64), np.concatenate([np.zeros(0, np.uint32), *pieces]), np.cumsum([0, *lens])[:-1].astype(np.int64), lens_a, budget, all_grams[order],
        np.repeat(np.arange(len(lens)), count)[order], np.concatenate([np.zeros(0, np.int64), *(np.arange(c) for c in count)])[order], maybe, whole, max(least, q),
    )


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, index) for every index of the ranges."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def candidates(ix: Index, low: np.ndarray, offsets: np.ndarray, at_once: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, first diagonal of the band) of the regions that reach the bound."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(ix.lens) or len(low) < ix.q:
        return none
    h = grams(low, ix.q)
    hit = ix.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
    ends = offsets[1:][offsets[1:] >= ix.q - 1]
    for back in range(1, ix.q):  # no q-gram crosses from one text to the next
        at = ends - back
        hit[at[(at >= 0) & (at < len(hit))]] = False
    # A region within the budget has at least `least` hits in `span` places.
    span, least = int((ix.lens + ix.budget).max()), int(ix.bound.min())
    total = np.concatenate(([0], np.cumsum(hit)))
    reach = np.minimum(np.arange(len(hit)) + span, len(hit))
    busy = np.flatnonzero(total[reach] - total[:-1] >= least)
    if not len(busy):
        return none
    cover = np.zeros(len(hit) + 1, np.int64)
    np.add.at(cover, busy, 1)
    np.add.at(cover, reach[busy], -1)
    places = np.flatnonzero(hit & (np.cumsum(cover[:-1]) > 0))
    lo, hi = np.searchsorted(ix.gram, h[places], "left"), np.searchsorted(ix.gram, h[places], "right")
    key, count, done = np.zeros(0, np.int64), np.zeros(0, np.int64), np.cumsum(hi - lo)
    cuts = np.unique(np.append(np.searchsorted(done, np.arange(0, int(done[-1]) if len(done) else 0, at_once)[1:], "left"), [0, len(places)]))
    shift = 1 << 21  # bands, of both signs, are fewer than places
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # hits on q-grams of many windows are counted in parts
        which, k = _expand(lo[a:b], hi[a:b])
        place, window = places[a:b][which], ix.window[k]
        text = np.searchsorted(offsets, place, "right") - 1
        band = (place - offsets[text] - ix.place[k]) // (ix.budget[window] + 1)
        packed = (text * len(ix.lens) + window) * 2 * shift + band + shift
        found, n = np.unique(np.concatenate([packed, packed - 1]), return_counts=True)
        both = np.concatenate([key, found])
        key, back = np.unique(both, return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([count, n]), minlength=len(key)).astype(np.int64)
    pair, band = key // (2 * shift), key % (2 * shift) - shift
    text, window = pair // len(ix.lens), pair % len(ix.lens)
    ok = count >= ix.bound[window]
    return text[ok], window[ok], band[ok] * (ix.budget[window[ok]] + 1)


def align(ix: Index, low: np.ndarray, offsets: np.ndarray, text: np.ndarray, window: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits of each window against its text on the band's diagonals, with
    the start and end of the aligned region in the text; free ends in the text."""
    edits, begin, end = (np.zeros(len(text), np.int64) for _ in range(3))
    padded = np.append(low, np.uint32(0xFFFFFFFF))
    for m, k in {(int(a), int(b)) for a, b in zip(ix.lens[window], ix.budget[window], strict=True)}:
        rows = np.flatnonzero((ix.lens[window] == m) & (ix.budget[window] == k))
        width = 2 * (k + 1)
        unit = np.int64(1 << 20)
        col = np.arange(width)
        base = offsets[text[rows]][:, None]
        stop = offsets[text[rows] + 1][:, None]
        d = first[rows][:, None] + col
        cost = np.broadcast_to(col.astype(np.int64), d.shape).copy()  # cost * unit + column of the start
        pattern = ix.points[ix.starts[window[rows]][:, None] + np.arange(m)]
        for i in range(m):
            at = base + d + i
            inside = (at >= base) & (at < stop)
            same = padded[np.where(inside, at, len(low))] == pattern[:, i : i + 1]
            step = cost + np.where(same & inside, 0, unit)
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + unit)
            cost = np.minimum.accumulate(step - col * unit, axis=1) + col * unit
        best = cost.argmin(axis=1)
        value = cost[np.arange(len(rows)), best]
        edits[rows] = value // unit
        size = (stop - base)[:, 0]
        begin[rows] = np.clip(first[rows] + value % unit, 0, size)
        end[rows] = np.clip(first[rows] + best + m, 0, size)
    return edits, begin, end


def _matcher(ix: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            ids = batch.column("id")
            for i, j in blocks(off):
                points, at = codepoints(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                low, where, offsets = normal(points, at)
                if ix.whole:
                    size = np.diff(offsets)
                    same = [(k, item) for k in np.flatnonzero((size > 0) & (size < ix.longest_whole)).tolist() for item in ix.whole.get(low[offsets[k] : offsets[k + 1]].tobytes(), ())]
                    k = np.array([a for a, _ in same], np.int64)
                    nothing = np.zeros(len(k), np.int64)
                    stop = where[offsets[k + 1] - 1] + 1 - at[k] if len(k) else nothing
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(k + i)), pa.array([b for _, b in same], pa.int64()), pa.array(where[offsets[k]] - at[k] if len(k) else nothing), pa.array(stop), pa.array(nothing)], names=["id", "item_id", "start", "stop", "edits"])
                text, window, first = candidates(ix, low, offsets)
                edits, begin, end = align(ix, low, offsets, text, window, first)
                ok = (edits <= ix.budget[window]) & (end > begin)
                text, window, edits, begin, end = text[ok], window[ok], edits[ok], begin[ok], end[ok]
                if not len(text):
                    continue
                origin = at[text]
                start = where[offsets[text] + begin] - origin
                stop = where[offsets[text] + end - 1] + 1 - origin
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text + i)), pa.array(ix.item[window]), pa.array(start), pa.array(stop), pa.array(edits)], names=["id", "item_id", "start", "stop", "edits"]
                )

    return run


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = 8, rate: float = 0.08, window_chars: int = 100, least_chars: int = 20, block_chars: int = 8_000_000, passage_chars: int = 60
) -> DataFrame:
    """Pairs (id_col, item_id) whose texts share a window within the edit budget:
    start and end, in code points of the document, of the longest region that the
    windows found cover, the number of such regions and of windows, and the fewest edits of a window.

    Items are cut into windows of `window_chars` letters and digits, half
    overlapping; an item of up to a quarter more is one window. Items of at least
    `passage_chars` are cut into windows of two thirds of it as well, so that any
    passage of `passage_chars` letters and digits of an item is found wherever it
    starts and ends: it holds a whole window, with the edits that the window's
    length allows (3 of 40). An item with fewer than `least_chars` letters and digits is
    found in documents that hold the same letters and digits and no others. Null texts or ids of
    items are not searched for. A null or empty document matches nothing; repeated rows
    with one id are one document. The benchmark goes to the tasks in blocks of
    about `block_chars` characters, one pass of the documents for each block; where
    there are several, the hits of each are written before the next block is indexed.
    """
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-chars // block_chars))
    texts = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = None
    for k in range(count):
        part = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k)
        ix = build_index([(r.item_id, r.text) for r in part.toLocalIterator()], q, rate, window_chars, least_chars, passage_chars)
        rows = texts.mapInArrow(_matcher(ix), "id long, item_id long, start long, stop long, edits long")
        rows = rows if count == 1 else Staged(rows, "hits").df
        found = rows if found is None else found.unionByName(rows)
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    pairs = found.groupBy("id", "item_id").agg(spans.alias("spans"), F.min("edits").alias("edits"))

    def join(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (last["stop"] >= x["start"]), grown).otherwise(F.concat(acc, F.array(x)))

    regions = F.aggregate("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"), join)
    best = F.array_max(F.transform("regions", lambda r: F.struct((r["stop"] - r["start"]).alias("size"), (-r["start"]).alias("start"))))
    return pairs.withColumn("regions", regions).withColumn("best", best).select(
        F.col("id").alias(id_col), "item_id", (-F.col("best.start")).alias("start"), (F.col("best.size") - F.col("best.start")).alias("stop"), "edits", F.size("spans").cast("long").alias("windows"), F.size("regions").cast("long").alias("regions")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, **params) -> DataFrame:
    """`docs` without the documents that contain benchmark passages. Rows with a null id are kept."""
    hits = Staged(benchmark_matches(docs, benchmark, id_col, text_col, **params).select(id_col).distinct(), "hits").df
    return docs.join(keyed_or_broadcast(hits, hits.count(), broadcast_rows), id_col, "left_anti").select(docs.columns)
