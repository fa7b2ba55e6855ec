"""Candidate lists that many sources share: pairs that are never shuffled.

A pair is a member of a list and a candidate of that list, unless both are one item. What is known of an item joins the list's
member or candidate before they meet, so that work before the pairs grows with the items and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.plans.staging import Staged

#: Pairs of one task, and of one cell of a task.
TASK_PAIRS, CELL_PAIRS = 2_000_000, 300_000


@dataclass(frozen=True)
class SharedLists:
    """members(list_id, source, ...), each source in one list, and listed(list_id, candidate, ...), each candidate once in a list."""

    members: DataFrame
    listed: DataFrame

    def known(self, members: DataFrame | None = None, listed: DataFrame | None = None) -> SharedLists:
        """The lists with more columns: members joined with `members`(source, ...), candidates with `listed`(candidate, ...), inner."""
        return SharedLists(self.members if members is None else self.members.join(members, "source"), self.listed if listed is None else self.listed.join(listed, "candidate"))

    def bare(self) -> SharedLists:
        return SharedLists(self.members.select("list_id", "source"), self.listed.select("list_id", "candidate"))

    def sizes(self) -> tuple[DataFrame, int]:
        """(list_id, n_members, n_listed) of every list with both, and the number of pairs."""
        both = self.members.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_members")).join(self.listed.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_listed")), "list_id")
        held = Staged(both, "list-sizes").df
        return held, int(held.agg(F.sum(F.col("n_members") * F.col("n_listed"))).first()[0] or 0)

    def tasks(self, pairs: int) -> int:
        return max(self.members.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS))

    def pairs(self, limit: int = 48 << 20) -> DataFrame:
        """All pairs with the columns of both sides. Lists of candidates are broadcast while they are within
        `limit` bytes, by an upper bound of 8 bytes a number and 24 more a value of any other type; beyond it they meet by list."""
        listed = Staged(self.listed, "listed").df
        width = sum((F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) + 24 if t not in ("bigint", "int", "double", "boolean") else F.lit(8) for c, t in listed.dtypes), F.lit(0))
        size = listed.agg(F.sum(width.cast("long"))).first()[0] or 0
        if size > limit:
            return self.members.join(listed, "list_id").where("source <> candidate")
        spread = self.members.repartition(self.tasks(self.sizes()[1]))
        return spread.join(F.broadcast(listed), "list_id").where("source <> candidate")


def meet_lists(lists: SharedLists, sources: DataFrame, offered: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """What run(sources, candidates) makes of each cell: some members of a list with their rows of sources(source, ...), and all its
    candidates with theirs of offered(candidate, ...), or nulls. Members without a row in `sources` are left out."""
    sizes, pairs = lists.sizes()
    parts = F.ceil(F.col("n_members") * F.col("n_listed") / CELL_PAIRS).cast("long")
    sizes, tasks = sizes.select("list_id", parts.alias("_parts")), lists.tasks(pairs)
    left = lists.members.join(sizes, "list_id").join(sources, "source").withColumn("_part", F.pmod(F.xxhash64("source"), F.col("_parts"))).drop("_parts")
    right = lists.listed.join(sizes, "list_id").join(offered, "candidate", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    cells = lambda d: d.repartition(tasks, "list_id", "_part").groupBy("list_id", "_part")
    return cells(left).cogroup(cells(right)).applyInArrow(run, schema)
