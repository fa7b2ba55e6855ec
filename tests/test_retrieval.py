"""Live candidate lists: made for the sources that need them, merged in rows of any batches, and ranked by as many tasks as their rows ask for."""

import random

import numpy as np
import pytest

from tagloom.operators import blocks
from tagloom.operators import retrieval as S
from tagloom.operators.lists import SharedLists
from tagloom.operators.tables import interleave


def test_live_lists_are_made_for_their_sources_alone(spark):
    random.seed(4)
    items = list(range(40))
    listed = {k: random.sample(items, 6) for k in range(5)}
    listed[3] = [29, 39]  # of which `items` has none
    listed[4] = [14]  # itself alone for source 14
    places = spark.createDataFrame([(k, c, at + 1) for k, x in listed.items() for at, c in enumerate(x)], "list_id long, candidate long, at int")
    members = spark.createDataFrame([(s % 5, s, listed[s % 5].index(s) + 1 if s in listed[s % 5] else None) for s in range(0, 40, 2)], "list_id long, source long, place int")
    lists = SharedLists(members, places)
    pairs = lists.pairs().select("source", "candidate", S.place_rank().alias("rnk"))
    ranked = lambda size: spark.createDataFrame([(s, c, k + 1) for s in items for k, c in enumerate(random.sample([x for x in items if x != s], size))], "source long, candidate long, rnk int")
    screen, near = ranked(9), ranked(7)
    ids = lambda x, name: spark.createDataFrame([(k,) for k in x], f"{name} long")
    changed, there = ids([s for s in items if s % 3 == 0], "source"), ids([c for c in items if c % 10 != 9], "item_id")
    asked = {}

    def screened(sources):
        asked["screened"] = {r.source for r in sources.collect()}
        return screen.join(sources, "source", "left_semi")

    def nearest(without):
        asked["without"] = {r.source for r in without.collect()}
        return near.join(without, "source", "left_anti")

    rows = lambda d: sorted((r.source, r.candidate, r.rnk) for r in d.collect())
    got = rows(S.retrieve_candidates(lists, screened, nearest, 5, changed, there))
    assert got == rows(S.retrieve_candidates(pairs, screen, near, 5, changed, there))
    have = {s for s in range(0, 40, 2) if s % 5 < 3} | {s for s in range(4, 40, 10) if s != 14}
    assert asked == {"screened": {s for s in items if s % 3 == 0} - have, "without": have}
    assert {s for s, _, _ in got} == set(items)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_interleave_across_batches(spark, batch):
    random.seed(batch)
    rows = [(s, n, r, random.randrange(12), f"{s}:{n}:{r}") for s in range(25) for n in range(2 if s % 3 else 1) for r in range(random.randrange(1, 11))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for r in interleave(spark.createDataFrame(rows, "source long, list_no int, rnk int, candidate long, at string"), 8).orderBy("source", "rnk").collect():
            got.setdefault(r.source, []).append((r.candidate, r.at))
        with pytest.raises(Exception, match="more ranked rows than the bound"):
            interleave(spark.createDataFrame(rows, "source long, list_no int, rnk int, candidate long, at string"), 8, most_rows=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in range(25):
        queues, want = [[(c, at) for a, b, _, c, at in rows if (a, b) == (s, n)] for n in range(2)], []
        while any(queues) and len(want) < 8:
            for q in queues:
                while q and q[0][0] in {c for c, _ in want}:
                    q.pop(0)
                if q and len(want) < 8:
                    want.append(q.pop(0))
        assert got.get(s, []) == want


def test_best_rows_are_ranked_by_tasks_for_their_number(spark, monkeypatch):
    r = np.random.default_rng(6)
    e = spark.createDataFrame([(k, r.normal(size=5).tolist()) for k in range(200)], "item_id long, embedding array<double>")
    want = {(x.source, x.candidate, x.rnk) for x in S.knn_join(e, 10, block_rows=50).collect()}
    monkeypatch.setattr(blocks, "_RANKED", 100)
    many = S.knn_join(e, 10, block_rows=50)
    assert {(x.source, x.candidate, x.rnk) for x in many.collect()} == want and len(want) == 2000
    assert many.rdd.getNumPartitions() >= 20
