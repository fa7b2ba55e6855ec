"""Hard negatives by Kronecker-packed integer products.

Components are whole numbers, floor(scale * x). Those of two candidates, biased so that
none is negative, stand in two fields of one wide integer, and a product with an anchor's
biased component multiplies both at once. Fields are as wide as the largest sum of such products, so that no
carry crosses them; the integers are doubles of at most 53 bits, whose sums are exact, so that a
block of anchors meets a block of packed candidates as one matrix product. Exact scores
are unpacked from the fields and freed of the biases. Components of anchors too large for that are
split into limbs, a product each; candidates' components so large that no limb fits beside a second field stand alone.

Blocks meet as `operators.blocks` has it: every row is a candidate for every anchor, no pair is
a row, and labels deal nothing out, so that a label of a third of all rows does no harm.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.operators.blocks import meet_blocks, none_of, pack_blocks, rows_for
from tagloom.plans.staging import Staged

_EXACT_BITS = 53


def packed_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the whole-number rows of `a` and `c`, as int64.

    Raises ValueError where a score could pass 62 bits."""
    n, m, d = len(a), len(c), a.shape[1]
    if not n or not m or not d:
        return np.zeros((n, m), np.int64)
    bias_a, bias_c = int(np.abs(a).max()), int(np.abs(c).max())
    if d * max(1, bias_a) * max(1, bias_c) >= 1 << 62:
        raise ValueError("components are too large: scores would pass 62 bits")
    sums = d.bit_length() + (2 * bias_c).bit_length()
    fields = 2 if _EXACT_BITS // 2 - sums >= 4 else 1
    width = _EXACT_BITS // fields
    limb = width - sums  # bits of an anchor's component that a field has room for
    if limb < 1:
        raise ValueError("components are too large: a field has no room for them")
    up = c + bias_c
    if fields == 2:
        half = -(-m // 2)
        wide = up[:half].astype(np.float64)
        wide[: m - half] += up[half:].astype(np.float64) * float(1 << width)
    else:
        wide = up.astype(np.float64)
    rest, total, shift = a + bias_a, np.zeros((n, m), np.int64), 0
    while True:
        product = (rest & ((1 << limb) - 1)).astype(np.float64) @ wide.T
        if fields == 2:
            both = product.astype(np.int64)
            total[:, :half] += (both & ((1 << width) - 1)) << shift
            total[:, half:] += (both >> width)[:, : m - half] << shift
        else:
            total += product.astype(np.int64) << shift
        rest, shift = rest >> limb, shift + limb
        if not rest.any():
            break
    return total - bias_c * a.sum(axis=1)[:, None] - bias_a * c.sum(axis=1)[None, :] - d * bias_a * bias_c


def _features(table: pa.Table) -> bytes:
    """A block's vectors in the fewest bytes, labels, ids, and the window of scores of rows that ask for one."""
    flat = table.column("v").combine_chunks()
    x = np.asarray(flat.flatten(), np.int64).reshape(len(table), -1)
    most = int(np.abs(x).max()) if x.size else 0
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    one = lambda name: np.asarray(table.column(name), np.int64).tobytes()
    return struct.pack("<3q", x.shape[1], len(table), np.dtype(kind).itemsize) + one("label") + one("own") + one("least") + one("most") + x.astype(kind).tobytes()


def _read(data: bytes) -> tuple[np.ndarray, ...]:
    d, n, item = struct.unpack_from("<3q", data)
    label, own, least, most = np.frombuffer(data, np.int64, 4 * n, 24).reshape(4, n)
    return label, own, least, most, np.frombuffer(data, f"<i{item}", n * d, 24 + 32 * n).reshape(n, d)


def _scores(same: bool) -> Callable[[bytes, bytes, slice], np.ndarray]:
    """Scores of rows of equal labels, or of other labels within the asking row's window."""

    def run(a: bytes, b: bytes, rows: slice) -> np.ndarray:
        label, own, least, most, x = (v[rows] for v in _read(a))
        other, ids, _, _, y = _read(b)
        out = np.empty((len(label), len(other)), np.int64)
        # A vector that asks for several windows is multiplied once.
        distinct, back = np.unique(x, axis=0, return_inverse=True)
        out[:] = packed_products(distinct.astype(np.int64), y.astype(np.int64))[back.reshape(-1)]
        apart = label[:, None] != other[None, :]
        ok = ~apart & (own[:, None] != ids[None, :]) if same else apart & (out >= least[:, None]) & (out <= most[:, None])
        out[~ok] = none_of(out)
        return out

    return run


def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(own, label, v): ids, labels and components floor(scale * x) of the rows that take part; equal rows once."""
    x = rows.select(F.col(f"`{id_col}`").cast("long").alias("own"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = x.where(F.col("own").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return x.withColumn("v", F.transform("v", lambda c: F.floor(c * scale))).distinct()


def mine(embeddings: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows that satisfy `anchors` are anchors. An anchor's positives are the first `positives` other
    rows of its label by integer inner product, ties by smaller id; for each, the
    first `negatives` rows of other labels with low * positive <= 100 * negative <= high * positive.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Equal rows (id, label and components) count once; rows that differ but share an id are rows of their own, though
    never each other's positives. Shorter vectors count as filled up with zeros. Anchors without a positive or a negative have no rows."""
    spark = embeddings.sparkSession
    rows = Staged(whole_vectors(embeddings, id_col, label_col, vector_col, scale), "whole-vectors").df
    chosen = embeddings.where(F.coalesce(anchors, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("own")).distinct()
    n, wide = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    block_rows = block_rows or rows_for(spark.sparkContext.defaultParallelism, n, max(256, min(8192, (2 << 20) // (2 * max(1, wide)))))
    full = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("v")))
    zero = F.lit(0).cast("long")
    block = lambda df, key, least, most: df.select(F.lit("").alias("g"), key.alias("id"), F.lit(0.0).alias("tie"), "own", "label", full.alias("v"), least.alias("least"), most.alias("most"))
    have = pack_blocks(block(rows, F.col("own"), zero, zero), _features, block_rows, "negative-candidates")
    asked = rows.join(chosen, "own", "left_semi").withColumn("key", F.xxhash64("own", "label", "v"))
    first = meet_blocks(pack_blocks(block(asked, F.col("key"), zero, zero), _features, block_rows, "anchors"), have, positives, _scores(True), "long")
    found = Staged(first.select(F.col("source").alias("key"), F.col("candidate").alias("positive_id"), F.col("score").alias("positive_score")), "positives").df
    # A window of negative scores: from ceil(low * positive / 100) to floor(high * positive / 100), in whole numbers.
    window = found.select("key", "positive_score").distinct().join(asked, "key").withColumn("id", F.xxhash64("key", "positive_score"))
    hundredth = lambda n: F.expr(f"({n}L * positive_score - pmod({n}L * positive_score, 100L)) div 100L")
    up, down = -hundredth(-low), hundredth(high)
    second = meet_blocks(pack_blocks(block(window, F.col("id"), up, down), _features, block_rows, "windows"), have, negatives, _scores(False), "long")
    named = found.withColumn("source", F.xxhash64("key", "positive_score")).join(asked.select("key", F.col("own").alias("anchor_id")), "key")
    return second.select("source", F.col("rnk").cast("int").alias("rank"), F.col("candidate").alias("negative_id"), F.col("score").alias("negative_score")).join(named, "source").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
