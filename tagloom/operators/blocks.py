"""The best rows of one table for each row of another, in blocks.

Rows are dealt to blocks and each block is packed to one row. A task meets some
blocks of sources with some blocks of candidates, a cell of a grid, and keeps each source's best; only
those are shuffled again. No row for a pair of rows is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.plans.staging import Staged

#: Rows of candidates that a task holds before it keeps the best.
_KEPT = 500_000
#: Rows that a task ranks at the end.
_RANKED = 1_000_000
_PACK = "g string, blocks long, b long, ids binary, ties binary, features binary"


def packed(rows: DataFrame, block_rows: int, features: Callable[[pa.Table], bytes]) -> DataFrame:
    """One row per block of rows(g, id, tie, ...): ids and ties in order of tie and id, and the block's features. Rows are dealt by their
    id, or by a column `deal`: equal ones to one block."""

    def run(table: pa.Table) -> pa.Table:
        ids, ties = np.asarray(table.column("id"), np.int64), np.asarray(table.column("tie"), np.float64)
        order = np.lexsort((ids, ties))
        table = table.take(pa.array(order))
        head = table.slice(0, 1).select(["g", "blocks", "b"])
        data = [ids[order].tobytes(), ties[order].tobytes(), features(table)]
        return pa.table([*head.columns, *(pa.array([x], pa.binary()) for x in data)], names=["g", "blocks", "b", "ids", "ties", "features"])

    sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    dealt = rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("deal" if "deal" in rows.columns else "id"), F.col("blocks")))
    return dealt.groupBy("g", "b").applyInArrow(run, _PACK)


def none_of(score: np.ndarray):
    """What stands in a matrix of scores for a pair that doesn't count."""
    return np.iinfo(score.dtype).min if score.dtype.kind == "i" else -np.inf


def first_best(score: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's `k` highest scores, without pairs that don't count; of equal ones the first."""
    some = score > none_of(score)
    if score.shape[1] <= k:
        return some
    least = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
    above = score > least
    even = (score == least) & some
    return above | (even & (np.cumsum(even, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def _keep(parts: list[tuple], k: int) -> list[tuple]:
    """The best `k` of each row of the parts (row, score, tie, id), as one part in order."""
    row, score, tie, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, tie, -score, row))
    row, score, tie, ids = row[order], score[order], tie[order], ids[order]
    first = np.searchsorted(row, row, "left")
    ok = np.arange(len(row)) - first < k
    return [(row[ok], score[ok], tie[ok], ids[ok])]


def _meet(k: int, score: Callable[[bytes, bytes, slice], np.ndarray]):
    """Holds the candidate blocks of a cell of the grid, then meets its source blocks with them one by one."""

    def best_of(ids: np.ndarray, features: bytes, held: list[tuple]) -> Iterator[tuple]:
        # Some source rows at a time with all blocks held: what is kept is bounded by these rows, not by the block.
        strip = max(1, min(2_000_000 // max(1, max((len(own) for own, *_ in held), default=1)), max(64, 250_000 // max(1, k))))
        for start in range(0, len(ids), strip):
            rows = slice(start, min(start + strip, len(ids)))
            parts: list[tuple] = []
            for own, ties, data in held:
                s = score(features, data, rows)
                s[ids[rows, None] == own[None, :]] = none_of(s)
                row, col = np.nonzero(first_best(s, k))
                parts.append((row + start, s[row, col], ties[col], own[col]))
                if sum(len(p[0]) for p in parts) > max(_KEPT, 2 * k * (rows.stop - start)):
                    parts = _keep(parts, k)
            if parts:
                ((row, s, tie, other),) = _keep(parts, k)
                for a in range(0, len(row), 100_000):
                    c = slice(a, a + 100_000)
                    yield ids[row[c]], other[c], tie[c], s[c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i]  # noqa: B023, E731
                mine = (at("g").as_py(), at("down").as_py(), at("across").as_py())
                if mine != key:
                    key, held = mine, []
                ids = np.frombuffer(at("ids").as_buffer(), np.int64).copy()
                if at("side").as_py() == 0:
                    held.append((ids, np.frombuffer(at("ties").as_buffer(), np.float64).copy(), at("features").as_py()))
                    continue
                for source, other, tie, s in best_of(ids, at("features").as_py(), held):
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(source), pa.string()), pa.array(source), pa.array(other), pa.array(tie), pa.array(s)], names=["g", "source", "candidate", "tie", "score"])

    return run


def pack_blocks(rows: DataFrame, features: Callable[[pa.Table], bytes], block_rows: int, name: str = "blocks") -> DataFrame:
    """Blocks of rows(g, id, tie, ...), written once, for `meet_blocks`."""
    return Staged(packed(rows, block_rows, features), name).df


def meet_blocks(ask: DataFrame, have: DataFrame, k: int, score: Callable[[bytes, bytes, slice], np.ndarray], score_type: str = "double", hold_bytes: int = 64 << 20) -> DataFrame:
    """(g, source, candidate, score, rnk) as `block_topk` has them, for packed blocks of both sides.

    Source blocks and candidate blocks of a group are laid out as a grid that is cut into cells, as
    square as may be; a task holds a cell's candidate blocks (at most `hold_bytes`) and meets its source blocks with
    them one at a time. A block is sent to one row or column of cells, so that for n blocks and t tasks each
    side is shuffled about sqrt(t) times, not n times.

    Many best rows are dealt by source to as many tasks as their number asks for. They are not sorted before that: a cell gives
    at most k a source, so that there is hardly a row to leave out, and its rows would be held as they grow with the cell."""
    tasks = ask.sparkSession.sparkContext.defaultParallelism
    size = F.length("features") + F.length("ids") + F.length("ties")
    per_group = ask.groupBy("g").agg(F.max("blocks").alias("asked"), F.sum(F.length("ids") / 8).alias("rows")).join(have.groupBy("g").agg(F.max("blocks").alias("had"), F.max(size).alias("bytes")), "g")
    total = per_group.agg(F.sum(F.col("asked") * F.col("had"))).first()[0]
    cell = max(1, int(total or 0) // (8 * tasks))  # meetings of two blocks in one task
    across = F.greatest(F.lit(1), F.least("had", F.floor(F.lit(hold_bytes) / F.greatest("bytes", F.lit(1))), F.greatest(F.lit(int(np.ceil(np.sqrt(cell)))), F.ceil(F.lit(cell) / F.col("asked"))))).cast("long")
    plan = per_group.withColumn("wide", across).withColumn("tall", F.greatest(F.lit(1), F.least("asked", F.floor(F.lit(cell) / F.col("wide")))).cast("long"))
    beside = F.ceil(F.col("had") / F.col("wide"))
    cells, met = plan.agg(F.sum(F.ceil(F.col("asked") / F.col("tall")) * beside), F.sum(F.col("rows") * beside)).first()
    every = lambda n, step: F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col(n) / F.col(step)) - 1).cast("long")))
    left = ask.drop("blocks").join(plan, "g").select("g", F.floor(F.col("b") / F.col("tall")).cast("long").alias("down"), every("had", "wide").alias("across"), F.lit(1).alias("side"), "b", "ids", "ties", "features")
    right = have.drop("blocks").join(plan, "g").select("g", every("asked", "tall").alias("down"), F.floor(F.col("b") / F.col("wide")).cast("long").alias("across"), F.lit(0).alias("side"), "b", "ids", "ties", "features")
    shuffled = left.unionByName(right).repartition(max(1, min(int(cells or 1), 32 * tasks)), "g", "down", "across").sortWithinPartitions("g", "down", "across", "side", "b")
    best = shuffled.mapInArrow(_meet(k, score), f"g string, source long, candidate long, tie double, score {score_type}")
    ranking = -int(-(met or 0) * k // _RANKED)
    if ranking > tasks:
        best = best.repartition(ranking, "g", "source")
    order = W.partitionBy("g", "source").orderBy(F.desc("score"), "tie", "candidate")
    return best.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k).select("g", "source", "candidate", "score", "rnk")


@dataclass(frozen=True)
class Search:
    """Another way to meet blocks: begin(candidates) takes the features of all candidate blocks of a cell and gives what makes, of the
    features of a source block, batches of columns source, candidate, tie, score and rnk and others of `columns`."""

    begin: Callable[[list[bytes]], Callable[[bytes], Iterator[dict[str, np.ndarray]]]]
    columns: str
    features: Callable[[pa.Table], bytes]
    candidate_rows: int
    hold_bytes: int = 160 << 20


def _search(search: Search):
    names = [c.split()[0] for c in search.columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, meet = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                mine = (at("g"), at("cell"))
                if mine != key:
                    key, held, meet = mine, [], None
                if at("side") == 0:
                    held.append(at("features"))
                    continue
                if meet is None:
                    meet, held = search.begin(held) if held else lambda _: (), []
                for rows in meet(at("features")):
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows["source"]), pa.string()), *(pa.array(rows[c]) for c in names)], names=["g", *names])

    return run


def search_blocks(ask: DataFrame, have: DataFrame, k: int, search: Search) -> DataFrame:
    """(g, source, candidate, score, rnk, ...) of packed blocks as `search` meets them. A cell holds all candidate blocks of a group within
    `hold_bytes` and meets some of its source blocks, so that its ranks are final; only beyond that cells' best rows are ranked again."""
    tasks = ask.sparkSession.sparkContext.defaultParallelism
    plan = ask.groupBy("g").agg(F.count(F.lit(1)).alias("asked")).join(have.groupBy("g").agg(F.least(F.count(F.lit(1)), F.ceil(F.sum(F.length("features")) / search.hold_bytes)).alias("across")), "g")
    plan = plan.withColumn("down", F.least("asked", F.lit(4 * tasks))).withColumn("first", F.sum(F.col("across") * F.col("down")).over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)))
    plan = Staged(plan.select("g", "across", "down", F.coalesce("first", F.lit(0)).alias("first")), "search-plan").df
    cells, most = plan.agg(F.sum(F.col("across") * F.col("down")), F.max("across")).first()
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda d, down, across, side: d.join(plan, "g").withColumn("down_", down).withColumn("across_", across).select("g", (F.col("first") + F.col("down_") * F.col("across") + F.col("across_")).alias("cell"), F.lit(side).alias("side"), "b", "features")
    left = place(ask, F.pmod("b", F.col("down")), every("across"), 1)
    right = place(have, every("down"), F.pmod("b", F.col("across")), 0)
    n = max(1, min(int(cells or 1), 32 * tasks))
    dealt = left.unionByName(right).repartitionById(n, F.pmod("cell", F.lit(n)).cast("int")).sortWithinPartitions("g", "cell", "side", "b")
    best = dealt.mapInArrow(_search(search), f"g string, {search.columns}")
    if (most or 0) > 1:
        best = best.withColumn("rnk", F.row_number().over(W.partitionBy("g", "source").orderBy(F.desc("score"), "tie", "candidate"))).where(F.col("rnk") <= k)
    return best.drop("tie")


def block_topk(sources: DataFrame, candidates: DataFrame, k: int, features: Callable[[pa.Table], bytes], score: Callable[[bytes, bytes, slice], np.ndarray] | None, block_rows: int, search: Search | None = None) -> DataFrame:
    """(g, source, candidate, score, rnk): for each row of sources(g, id, tie, ...) the `k`
    best candidates of its group g by score, then tie and id; an id is never its own candidate.

    features(table) packs a block's rows; score(a, b, rows) gives the matrix of
    scores of some source rows of block a and all rows of block b, with `none_of` it
    for pairs that don't count. `search` takes the place of scores where not all pairs need be looked at."""
    if search:
        return search_blocks(pack_blocks(sources, features, block_rows, "source-blocks"), pack_blocks(candidates, search.features, search.candidate_rows, "candidate-blocks"), k, search)
    have = pack_blocks(candidates, features, block_rows, "candidate-blocks")
    ask = have if sources is candidates else pack_blocks(sources, features, block_rows, "source-blocks")
    return meet_blocks(ask, have, k, score)


def rows_for(parallel: int, rows: int, most: int, least: int = 64) -> int:
    """Rows of a block: `most`, or fewer where the table would not give all tasks a block to do."""
    return max(least, min(most, -(-rows // max(1, int(np.ceil(np.sqrt(2 * parallel)))))))
