"""A Merkle manifest with incremental witnesses.

Every row of a table is a leaf; the leaves of a group stand in order in a tree of `ARITY`
children a node, and the groups' roots likewise in one more tree, whose root stands for the whole table.
A leaf's witness is the text of its siblings on each level, with which anyone can
fold a row's digest up to the root.

Witnesses grow as leaves are appended (`OpenTree`): a node that is appended to an open run
takes what already stands there as its left siblings, and each later one extends it on the right; when a run is full, its
members' witnesses are complete on that level and the run's digest is appended one level higher.
Leaves are ranked in their group without ever gathering it (sorted ranges and their counts) and cut
into aligned blocks of `ARITY ** LEVELS`; each block is closed in a task of its own, and the blocks' roots are
appended to the trees above in the same way, block by block, until one node is left. Witnesses of blocks come down again
and complete those of their leaves. A group of a third of all rows is just many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.plans.staging import Staged

ARITY = 16
#: Levels that a task closes at once.
LEVELS = 3
_PATH = "array<struct<before:string,after:string>>"
_PATH_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class OpenTree:
    """Appends of digests to a tree, level by level, with the witness of every leaf (unless `witnesses` is
    false): a list of (left siblings, right siblings), joined texts, from its own level up."""

    def __init__(self, witnesses: bool = True) -> None:
        self.witnesses = witnesses
        self.paths: list[list[tuple[str, str]]] = []
        self.runs: list[list[list]] = []  # open runs: nodes as [digest, first leaf, end, left siblings, right siblings]
        self.leaves = 0

    def append(self, leaf: str) -> None:
        self.paths.append([])
        self._push(0, leaf, self.leaves, self.leaves + 1)
        self.leaves += 1

    def _push(self, level: int, node: str, first: int, end: int) -> None:
        if len(self.runs) <= level:
            self.runs.append([])
        run = self.runs[level]
        if self.witnesses:
            for sibling in run:
                sibling[4].append(node)
        run.append([node, first, end, "".join(x[0] for x in run) if self.witnesses else "", []])
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        if self.witnesses:
            for _, first, end, before, after in run:
                step = (before, "".join(after))
                for k in range(first, end):
                    self.paths[k].append(step)
        self._push(level + 1, digest("".join(x[0] for x in run)), run[0][1], run[-1][2])

    def finish(self, depth: int | None = None) -> str:
        """Closes open runs, to `depth` levels or until one node is left, and returns that node's digest."""
        level = 0
        while True:
            run = self.runs[level] if level < len(self.runs) else []
            if level == depth or (depth is None and len(run) == 1 and not any(self.runs[level + 1 :])):
                return run[0][0]
            if run:
                self._close(level)
            level += 1


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its witness give."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def row_digest(*columns: Column) -> Column:
    """Hex sha256 of the columns' texts, each as its count of UTF-8 bytes, a colon and itself; a null is a hyphen."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(told(c.cast("string")) for c in columns)), 256)


def ranked(nodes: DataFrame, by: list[str]) -> DataFrame:
    """`nodes` with each row's place `rank` in its group `g` in the order of `by`, and the group's `total`.

    Rows are dealt to sorted ranges and written; places come from each range's counts. A range may
    hold a part of a group, so no group is gathered; of equal rows any may come first."""
    order = ["g", *by, "_turn"]
    dealt = nodes.withColumn("_turn", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_turn")
    rows = Staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").df.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("g", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy("g")
    told = counts.select("g", "_range", "_first", F.sum("_n").over(group).alias("total"), (F.sum("_n").over(group.orderBy("_range")) - F.col("_n")).alias("_before"))
    return rows.join(told, ["g", "_range"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of nodes(g, rank, total, name, digest, given), each with the digest that its nodes close to:
    (g, block, total, names, digests, givens, root). Digests are 32 bytes each; a null `given` is the digest itself."""
    name_type = nodes.schema["name"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        tree, total = OpenTree(witnesses=False), table.column("total")[0].as_py()
        digests = table.column("digest").to_pylist()
        for d in digests:
            tree.append(d)
        root = tree.finish(LEVELS if total > ARITY**LEVELS else None)
        givens = [g or d for g, d in zip(table.column("given").to_pylist(), digests, strict=True)]
        names = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column("name").combine_chunks())
        head = table.slice(0, 1)
        raw = lambda x: pa.array([bytes.fromhex("".join(x))], pa.binary())
        return pa.table([head.column("g"), head.column("block"), head.column("total"), names, raw(digests), raw(givens), pa.array([root])], names=["g", "block", "total", "names", "digests", "givens", "root"])

    dealt = nodes.withColumn("block", F.floor(F.col("rank") / ARITY**LEVELS).cast("long"))
    shape = f"g string, block long, total long, names array<{name_type}>, digests binary, givens binary, root string"
    return Staged(dealt.groupBy("g", "block").applyInArrow(run, shape), "tree-blocks").df


def _hex(data: bytes) -> list[str]:
    text = data.hex()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, OpenTree, list[str]]]:
    """Each block's row, its tree with the witnesses inside the block, and its nodes' digests."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            tree, digests = OpenTree(), _hex(row["digests"].as_py())
            for d in digests:
                tree.append(d)
            tree.finish(LEVELS if row["total"].as_py() > ARITY**LEVELS else None)
            yield row, tree, digests


def _child_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, block, path) of the nodes of each block: the part inside the block and then the block's own path."""
    for row, tree, digests in _closed(batches):
        first, above = row["block"].as_py() * ARITY**LEVELS, [(s["before"], s["after"]) for s in row["path"].as_py()]
        for a in range(0, len(digests), 256):  # a batch of bounded bytes
            paths = [[{"before": b, "after": e} for b, e in [*own, *above]] for own in tree.paths[a : a + 256]]
            yield pa.RecordBatch.from_arrays([pa.array([row["g"].as_py()] * len(paths), pa.string()), pa.array(range(first + a, first + a + len(paths)), pa.int64()), pa.array(paths, _PATH_ARROW)], names=["g", "block", "path"])


@dataclass
class Risen:
    """A forest closed from aligned blocks: the lowest blocks, those of block roots above them, and (g, root) of all groups."""

    lowest: DataFrame
    upper: list[DataFrame]
    roots: DataFrame

    def block_paths(self, of_groups: DataFrame) -> DataFrame:
        """(g, block, path) of the lowest blocks, from paths of the groups' roots (g, path)."""
        known = of_groups.select("g", F.lit(0).cast("long").alias("block"), "path")
        for blocks in reversed(self.upper):
            children = blocks.join(known, ["g", "block"]).select("g", "block", "total", "digests", "path").mapInArrow(_child_paths, f"g string, block long, path {_PATH}")
            known = known.join(blocks.select("g").distinct(), "g", "left_anti").unionByName(children)
        return known


def rise(nodes: DataFrame) -> Risen:
    """Closes nodes(g, rank, total, name, digest, given) to one root a group. Each round closes blocks of
    `ARITY ** LEVELS` nodes, so that rounds grow as the logarithm of the largest group."""
    lowest = _blocks(nodes)
    per, none = ARITY**LEVELS, F.lit(None).cast("string")
    level = lowest.select("g", F.col("block").alias("rank"), F.ceil(F.col("total") / per).cast("long").alias("total"), none.alias("name"), F.col("root").alias("digest"), none.alias("given"))
    roots, upper = level.where("total = 1").select("g", F.col("digest").alias("root")), []
    while (level := level.where("total > 1")).limit(1).count():
        upper.append(_blocks(level))
        level = upper[-1].select("g", F.col("block").alias("rank"), F.ceil(F.col("total") / per).cast("long").alias("total"), none.alias("name"), F.col("root").alias("digest"), none.alias("given"))
        roots = roots.unionByName(level.where("total = 1").select("g", F.col("digest").alias("root")))
    return Risen(lowest, upper, roots)


def manifest(leaves: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for leaves(id, source, leaf, given).

    Leaves ascend by `order` (by default id and leaf; nulls first) in their source, sources by their UTF-8 bytes, null first. proof_sha256 is
    the digest of a leaf's witness, folded_root what the witness makes of `given` (of the leaf itself where
    that is null), and verified says whether that is the root.

    Repeated rows are leaves of their own, one after the other; null ids stand first; a table
    without rows has no root and gives no rows."""
    key = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))  # null before all texts, the empty one too
    nodes = leaves.select(key.alias("g"), F.col("id").alias("name"), F.col("leaf").alias("digest"), "given")
    trees = rise(ranked(nodes, ["name", "digest"]))
    tops = ranked(trees.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("given")), ["name"])
    top = rise(tops)
    whole = top.roots.select("g", "root", F.array().cast(_PATH).alias("path"))

    def of_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, tree, digests in _closed(batches):
            above, names = [(s["before"], s["after"]) for s in row["path"].as_py()], row["names"].as_py()
            for a in range(0, len(digests), 256):
                paths = [[{"before": b, "after": e} for b, e in [*own, *above]] for own in tree.paths[a : a + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 256], pa.string()), pa.array(digests[a : a + 256]), pa.array([row["whole"].as_py()] * len(paths), pa.string()), pa.array(paths, _PATH_ARROW)], names=["g", "subroot", "whole", "path"])

    asked = top.lowest.join(top.block_paths(whole), ["g", "block"]).join(whole.select("g", F.col("root").alias("whole")), "g")
    sources = Staged(asked.select("total", "names", "digests", "path", "whole").mapInArrow(of_sources, f"g string, subroot string, whole string, path {_PATH}"), "source-paths").df

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, tree, digests in _closed(batches):
            above = [(s["before"], s["after"]) for s in row["path"].as_py()]
            rest = "".join(b + e for b, e in above)
            proofs = [digest("".join(b + e for b, e in own) + rest) for own in tree.paths]
            folded = [fold(g, [*own, *above]) for g, own in zip(_hex(row["givens"].as_py()), tree.paths, strict=True)]
            n, root, subroot = len(digests), row["whole"].as_py(), row["subroot"].as_py()
            yield pa.RecordBatch.from_arrays(
                [row["names"].values, pa.array(digests), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])],
                names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    id_type = leaves.schema["id"].dataType.simpleString()
    blocks = trees.lowest.join(trees.block_paths(sources.select("g", "path")), ["g", "block"]).join(sources.select("g", "subroot", "whole"), "g")
    return blocks.select("total", "names", "digests", "givens", "path", "subroot", "whole").mapInArrow(finish, f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
