"""Hashed nearest neighbours against the exact ones, and lists that are kept up to date against lists made anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import retrieval as S


def recall(exact, found):
    want = {(r.source, r.candidate) for r in exact.collect()}
    return len(want & {(r.source, r.candidate) for r in found.collect()}) / len(want)


def test_recall_of_hashed_neighbours(spark):
    """On rows of the test table, whose nearest rows are hardly nearer than others (cosine 0.35), and on rows with near ones."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    q = e.where("item_id % 20 = 0")
    assert recall(S.knn_join(e, 10, queries=q), S.knn_join_hashed(e, 10, queries=q, bits=5)) >= 0.9
    r = np.random.default_rng(3)
    centres = r.normal(size=(300, 32))
    rows = [(k, (centres[k % 300] + 0.35 * r.normal(size=32)).tolist()) for k in range(3000)] + [(k, [1.0] * 32) for k in range(3000, 3600)]
    near = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    some = near.where("item_id % 20 = 0")
    found = S.knn_join_hashed(near, 9, queries=some, bits=8)
    assert recall(S.knn_join(near, 9, queries=some), found) >= 0.9
    assert found.groupBy("source").count().where("count > 9").count() == 0


def test_hashed_neighbours_of_few_and_odd_rows(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0, 0.1])], "item_id long, embedding array<double>")
    for bits in (None, 2):
        got = S.knn_join_hashed(odd, 1, bits=bits, tables=4, probes=3)
        assert {r.source for r in got.collect()} <= {1, 2, 4} and ((1, 4) in {(r.source, r.candidate) for r in got.collect()})
    assert S.knn_join_hashed(odd.limit(0), 3).count() == 0


@pytest.mark.parametrize("case", ["all kinds", "nothing", "only deletes"])
def test_refreshed_lists_equal_lists_made_anew(spark, case):
    r = np.random.default_rng(5)
    old = {k: r.normal(size=6).round(2).tolist() for k in range(60)}
    new = dict(old)
    changed, gone = [], []
    if case != "nothing":
        gone = [3, 17, 40]
        for k in gone:
            del new[k]
    if case == "all kinds":
        changed = [5, 9, 60, 61, 62]
        for k in changed:
            new[k] = r.normal(size=6).round(2).tolist()
        new[62] = new[5]
    frame = lambda d: spark.createDataFrame(list(d.items()), "item_id long, embedding array<double>")
    ids = lambda x: spark.createDataFrame([(k,) for k in x], "item_id long")
    lists = S.knn_join(frame(old), 5)
    part = S.refresh_neighbors(lists, frame(new), ids(changed), ids(gone), 5).collect()
    got = {(x.source, x.candidate, x.rnk) for x in lists.collect() if x.source not in {p.source for p in part}} | {(x.source, x.candidate, x.rnk) for x in part if x.candidate is not None}
    assert got == {(x.source, x.candidate, x.rnk) for x in S.knn_join(frame(new), 5).collect()}
    if case == "nothing":
        assert not part
