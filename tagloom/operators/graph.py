"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.plans.staging import Staged


def _starred(edges: DataFrame, large: bool, hot: int | None) -> DataFrame:
    """One star step. Large: every larger neighbour of a node is linked to the
    smallest of the node and its neighbours. Small: the same for the smaller
    neighbours and the node itself. With `hot`, nodes of more neighbours than that are
    looked up by broadcast, so that no task gets all of a node's edges."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    if hot is None:
        joined = both.join(low.select("u", "m"), "u")
    else:
        split = both.join(F.broadcast(low.where(F.col("n") > hot).select("u", "m")), "u", "left")
        rest = split.where("m is null").drop("m").join(low.where(F.col("n") <= hot).select("u", "m"), "u")
        joined = split.where("m is not null").select("u", "v", "m").unionByName(rest)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges with the smallest node that these edges link it to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        least, after = np.minimum(low[a], low[b]), low.copy()
        np.minimum.at(after, low[a], least)
        np.minimum.at(after, low[b], least)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, low):
            return nodes, nodes[low]
        low = after


def _forest(most: int):
    """A task's edges as stars: a row a node. At most `most` edges more than nodes seen are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held, more = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            held.append([np.asarray(batch.column(c), np.int64) for c in ("u", "v")])
            more += batch.num_rows
            if more >= most:
                u, v = _linked(*(np.concatenate(x) for x in zip((u, v), *held, strict=True)))
                held, more = [], 0
        if held:
            u, v = _linked(*(np.concatenate(x) for x in zip((u, v), *held, strict=True)))
        for k in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000]), pa.array(v[k : k + 100_000])], names=["u", "v"])

    return run


def spanning_forest(ends: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Edges (u, v) of whole numbers that link the same nodes as `ends` does, a row at most for each node that a task sees, each node among
    the u. Edges are shuffled only after that."""
    kinds = dict(ends.dtypes)
    return ends.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_forest(most), "u long, v long").select(*(F.col(c).cast(kinds[c]) for c in ("u", "v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50, hot_rows: int = 1_000_000) -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest
    node id that is reachable.

    Alternates large-star and small-star steps, each written to the shared
    folder, until the edges no longer change; only their count and checksum
    come to the driver. A self-edge makes its node a component of its own;
    edges with a null end are left out. An empty table gives no rows. A graph of
    more than `hot_rows` edges may have nodes that are too much for one task: those
    of over `hot_rows` neighbours, or of a thousandth of
    all edges where that is more. They are a few thousand at most and are broadcast.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    if {t for _, t in ends.dtypes} <= {"int", "bigint"}:
        ends = Staged(spanning_forest(ends), "forest").df
    nodes = Staged(ends.select("u").union(ends.select("v")).distinct(), "nodes")
    now = Staged(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, count = None, now.df.count()
    for _ in range(max_rounds):
        hot = max(hot_rows, count // 1000) if count > hot_rows else None
        after = Staged(_starred(_starred(now.df, True, hot), False, hot), "edges")
        new = after.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        now.drop()
        now = after
        if tuple(new) == mark:
            break
        mark, count = tuple(new), new[0]
    else:
        raise RuntimeError("connected components did not settle; raise max_rounds")
    labels = now.df.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.df.join(labels, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
