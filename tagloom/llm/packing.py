"""Best-fit packing of token sequences by minimum bin slack.

All pieces of one length are alike, so the packing is planned on the histogram of
lengths, which has at most `capacity` rows however large the corpus is. Per bin,
the longest piece left is placed and a bitset subset-sum over the lengths left
finds the fullest feasible combination; it is used as often as the counts allow
and removed. The plan is a list of patterns; pieces take their places by their
rank within their length, which Spark counts in two levels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.llm.tables import bounded_batches
from tagloom.llm.textblocks import blocks, utf8
from tagloom.llm.tokens import vocabulary, word_ids
from tagloom.plans.staging import Staged

#: Pieces of a length that one task ranks, about.
RANKED_ROWS = 500_000


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths (descending), how many of each give the largest sum <= room."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        left = min(counts[n], room // n)
        k = 1
        while left > 0:  # multiples by binary splitting
            take = min(k, left)
            after = (reach | (reach << (take * n))) & full
            if after != reach:
                steps.append((n, take, reach))
                reach = after
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            total -= n * take
            used[n] = used.get(n, 0) + take
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how many}) patterns that use up the histogram."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        top = lengths[0]
        counts[top] -= 1
        used = fullest(lengths if counts[top] else lengths[1:], counts, capacity - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[n] // m for n, m in used.items())
        for n, m in used.items():
            counts[n] -= m * times
            if not counts[n]:
                del counts[n]
        out.append((times, used))
    return out


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_ids(path)
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in blocks(off):
                row, piece, start, length, crc = [], [], [], [], []
                for k, x in enumerate(tokens.ids_of(raw[off[i] : off[j]], off[i : j + 1] - off[i]), i):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    for n, s in enumerate(range(0, len(x), capacity)):
                        part = x[s : s + capacity]
                        row.append(k)
                        piece.append(n)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _place(patterns: list[tuple[int, dict[int, int]]]):
    """(length, rank) to (sequence, offset): for each length its ranks' ranges by pattern."""
    keys, times_m, base, offset, length_of = [], [], [], [], []
    next_rank: dict[int, int] = {}
    sequence = 0
    for times, used in patterns:
        at = 0
        for n in sorted(used, reverse=True):
            r = next_rank.get(n, 0)
            keys.append((n << 44) + r)
            times_m.append(used[n])
            base.append(sequence)
            offset.append(at)
            length_of.append(n)
            next_rank[n] = r + used[n] * times
            at += n * used[n]
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    keys_a, m, b, o, n_a = (np.array(x, np.int64)[order] for x in (keys, times_m, base, offset, length_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            key = (n << 44) + rank
            k = np.searchsorted(keys_a, key, "right") - 1
            r = key - keys_a[k] if len(key) else key
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(b[k] + r // m[k]), pa.array(o[k] + r % m[k] * n_a[k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its text's and then `end_id`; a null or empty text is
    `end_id` alone. Documents over `capacity` are cut into pieces of it. Repeated
    rows are packed each. Other columns are ignored; no row gives no piece.
    """
    path = path or vocabulary("word_bpe_49k.json")
    texts = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = Staged(texts.mapInArrow(_pieces(path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces").df
    # Ranks must not change between the two reads of the pieces, nor from run to run: they follow all columns.
    salts = max(1, -(-pieces.count() // RANKED_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("c"))
    held = Staged(counts, "counts").df
    histogram = {r.length: r.c for r in held.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    offsets = held.withColumn("before", F.sum("c").over(W.partitionBy("length").orderBy("salt")) - F.col("c")).drop("c")  # a row for each salt
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(offsets, ["length", "salt"]).withColumn("rank", (F.col("before") + F.col("own") - 1).cast("long"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(plan(histogram, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
