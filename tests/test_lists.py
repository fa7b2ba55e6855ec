"""Pairs of shared lists give what the same pairs give as rows, without a shuffled row for a pair."""

import random

from pyspark.sql import functions as F

from tagloom.operators import recommend as R
from tagloom.operators.lists import SharedLists


def _items(spark, n=40, seed=5):
    rng = random.Random(seed)
    tags = [(i, c, f"{c[:2]}{t}", float(rng.randint(1, 9))) for i in range(n) if i % 11 for c in R.VECTOR for t in rng.sample(range(12), rng.randint(1, 6))]
    fields = ["signature_tag", "niche_anchors", "identity_tags", "micro_tags", "music_primary", "setting_tags", "genre.primary", "genre.sub", "genre.sub_sub"]
    lists = [(i, f, f"x{t}", p + 1) for i in range(n) for f in fields for p, t in enumerate(rng.sample(range(8), rng.randint(0, 5)))]
    axes = [(i, *(rng.choice([None, rng.randint(-20, 120)]) for _ in R.AXES)) for i in range(n)]
    signals = [(i, *(rng.randint(0, 50) for _ in range(6))) for i in range(n)]
    return (
        spark.createDataFrame(tags, "item_id long, context string, tag string, weight double"), spark.createDataFrame(lists, "item_id long, field string, tag string, pos int"), spark.createDataFrame(axes, "item_id long, " + ", ".join(f"{x} int" for x in R.AXES)),
        spark.createDataFrame(signals, "item_id long, positive int, negative int, review_count int, recommendations_total int, owners int, ccu int"), spark.createDataFrame([(i, f"Name {i % 7}") for i in range(n)], "item_id long, name string"),
    )


def _lists(spark, n=40):
    members = spark.createDataFrame([(i % 3, i) for i in range(n)], "list_id long, source long")
    listed = spark.createDataFrame([(g, c) for g in range(3) for c in range(n) if (c + g) % 2] + [(0, 999)], "list_id long, candidate long")
    return SharedLists(members, listed)


def _rows(df):
    return sorted((tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect()))


def test_shared_lists_score_as_pairs_do(spark):
    tables, lists = _items(spark), _lists(spark)
    pairs = lists.pairs().select("source", "candidate")
    assert _rows(R.recommend_batch(lists, *tables, k=4)) == _rows(R.recommend_batch(pairs, *tables, k=4))
    prefs, offers = R.build_preferences(*tables[:2]), R.candidate_weights(*tables[:2])
    got = R.pair_overlaps(lists, prefs, offers)
    assert _rows(got) == _rows(R.pair_overlaps(pairs, prefs, offers)) and got.count() > 400
    assert _rows(R.matched_tags_topk(lists, prefs, offers)) == _rows(R.matched_tags_topk(pairs, prefs, offers))


def test_no_join_or_shuffle_above_the_pairs_of_shared_lists(spark):
    tables, lists = _items(spark), _lists(spark)
    over = R.pair_overlaps(lists, R.build_preferences(*tables[:2]), R.candidate_weights(*tables[:2])).select("source", F.col("o_genre"))
    plan = over._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapCoGroupsInArrow")]


def test_pairs_of_lists_are_the_same_beyond_the_limit_of_a_broadcast(spark):
    lists = _lists(spark)
    want = sorted((i, c) for i in range(40) for g, c in [(g, c) for g in range(3) for c in range(40) if (c + g) % 2] + [(0, 999)] if g == i % 3 and c != i)
    for limit in (0, 48 << 20):
        assert sorted(tuple(r) for r in lists.pairs(limit).select("source", "candidate").collect()) == want


def test_chips_and_explanations_of_rows_are_those_of_long_tables(spark):
    from tagloom.operators import views as V

    tables, lists = _items(spark), _lists(spark)
    prefs, offers = R.build_preferences(*tables[:2]), R.candidate_weights(*tables[:2])
    long, hits = R.matched_tags_topk(lists, prefs, offers), R.pair_overlaps(lists, prefs, offers)
    boosts = spark.createDataFrame([("mechanics", "me1", 30.0), ("mechanics", "me5", 5.0), ("vibe", "vi2", 20.0), ("vibe", "none", 40.0)], "context string, tag string, requested double")
    asked = V.asked_of(lists.members.select("source"), boosts, tables[0])
    rows = R.matched_rows(lists, prefs, offers, sources=asked)
    assert _rows(V.chips_of_rows(rows, list(R.MATCHED))) == _rows(V.reason_chips(long))
    contexts = ["mechanics", "vibe"]
    hits = hits.select("source", "candidate", *(F.col(f"o_{c}").alias(c) for c in contexts)).unpivot(["source", "candidate"], contexts, "context", "hit")
    want = _rows(V.explain_match(long, boosts, tables[0], hits))
    assert len(want) > 100 and _rows(V.explain_rows(rows, {c: F.col(f"o_{c}") for c in contexts}, list(R.MATCHED))) == want


def test_frequent_tags_of_lists_are_those_of_their_pairs(spark):
    from tagloom.operators import reports as P

    tags, lists = _items(spark)[0], _lists(spark)
    sets = lists.pairs().select(F.col("source").alias("set_id"), F.col("candidate").alias("item_id")).join(tags, "item_id")
    assert _rows(P.frequent_tags_of_lists(lists, tags)) == _rows(P.frequent_tags(sets))


def test_a_task_sends_on_one_edge_a_node(spark):
    from tagloom.operators.graph import connected_components, spanning_forest

    ends = spark.range(30_000).selectExpr("id % 300 as u", "(id * 7) % 299 + 300 * (id % 2) as v")
    assert spanning_forest(ends.coalesce(1), most=1_000).count() == ends.select("u").union(ends.select("v")).distinct().count()
    assert connected_components(ends, "u", "v").select("component").distinct().count() == 1


def test_facts_are_dealt_by_item_and_by_their_number(spark, monkeypatch):
    from tagloom.sources import inputs as I

    monkeypatch.setattr(I, "_TASK_FACTS", 500)
    assert I.lines(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 10


def test_prescreen_meets_kinds_of_items_and_not_items(spark, monkeypatch):
    """Copies are one kind: they stand in order of popularity and id, and none is its own candidate."""
    from tagloom.operators import retrieval as S

    rng = random.Random(3)
    fields = ["signature_tag", "niche_anchors", "identity_tags", "micro_tags", "setting_tags", "music_primary", "genre.primary"]
    kinds = [[(f, f"t{rng.randint(0, 4)}") for f in fields for _ in range(rng.randint(0, 2))] for _ in range(12)]
    of = {i: kinds[i % 12 if i % 5 else 0] for i in range(90)}
    popular = {i: rng.randint(0, 3) for i in of if i % 7}
    tags = spark.createDataFrame([(i, f, t) for i, k in of.items() for f, t in k], "item_id long, field string, tag string")
    met = []
    real = S.block_topk
    monkeypatch.setattr(S, "block_topk", lambda a, b, *more: met.append((a.count(), b.count())) or real(a, b, *more))
    for k in (5, 40, 200):
        got = {tuple(r) for r in S.prescreen_candidates(tags, spark.createDataFrame(list(popular.items()), "candidate long, popularity long"), k, block_rows=3).collect()}
        want = set()
        for i, mine in of.items():
            found = []
            for j, theirs in of.items():
                hits = sum(w for fs, to, w in S.PREDICATES if {t for f, t in mine if f in fs} & {t for f, t in theirs if f == to})
                if j != i and hits:
                    found.append((-hits, -popular[j] if j in popular else float("inf"), j))
            want |= {(i, j, -h, n + 1) for n, (h, _, j) in enumerate(sorted(found)[:k])}
        assert got == want
    assert max(max(x) for x in met) <= 12


def test_tables_of_items_are_grouped_without_a_shuffle_and_facts_are_joined_once(spark):
    from tagloom.sources import inputs as I

    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for rows in (I.item_tags(spark, sf), I.list_tags(spark, sf), I.signals(spark, sf)):
        assert "Exchange" not in plan(rows.groupBy("item_id").count())
    assert "lineitem" not in plan(I.signals(spark, sf)) and "Exchange" not in plan(I.ranked_tags(spark, sf))


def test_ranked_lists_merge_as_their_pairs_do_without_a_shuffle_of_pairs(spark):
    from tagloom.operators import tables as B
    from tagloom.queries_tables import hydrate_ranked, round_robin_merge

    lists = _lists(spark)
    listed = lists.listed.withColumns({"list_no": (F.col("candidate") % 3).cast("int"), "rnk": F.col("candidate") * 7 % 43})
    pairs = SharedLists(lists.members, listed)
    for limit in (4, 300):
        assert _rows(B.interleave_lists(pairs, limit)) == _rows(B.interleave(pairs.pairs().drop("list_id"), limit))
    for query in (hydrate_ranked, round_robin_merge):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        top = plan[: plan.index("Repartition")]
        assert "Window" not in top and "Aggregate" not in top and "FlatMapGroups" not in top


def test_a_task_keeps_the_best_of_a_few_source_rows_at_a_time(monkeypatch):
    """Many source rows, many blocks: the rows held at once do not grow with the source block."""
    import numpy as np
    import pyarrow as pa

    from tagloom.operators import blocks as K

    rng = np.random.default_rng(1)
    sizes, real = [], K._keep
    monkeypatch.setattr(K, "_keep", lambda parts, k: sizes.append(sum(len(p[0]) for p in parts)) or real(parts, k))
    ids, own = np.arange(4_000), [np.arange(a, a + 500) for a in range(0, 6_000, 500)]
    table = rng.integers(0, 50, (4_000, 6_000)).astype(float)
    score = lambda a, b, rows: table[rows, int(b) : int(b) + 500].copy()
    row = lambda side, i, f: (("g", 0, 0, side, i.tobytes(), np.zeros(len(i)).tobytes(), f))
    rows = [row(0, o, str(o[0]).encode()) for o in own] + [row(1, ids, b"")]
    names = ["g", "down", "across", "side", "ids", "ties", "features"]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])], names=names)
    got = pa.Table.from_batches(list(K._meet(300, score)(iter([batch]))))
    assert got.num_rows == 4_000 * 300 and max(sizes) < 1_200_000
    for s in (0, 1_777, 3_999):
        mine = np.asarray(got.column("candidate"))[np.asarray(got.column("source")) == s]
        want = sorted((-table[s, c], c) for c in range(6_000) if c != s)[:300]
        assert mine.tolist() == [c for _, c in want]


def test_pairs_of_some_contexts_carry_and_pack_these_alone(spark):
    tables, lists = _items(spark), _lists(spark)
    prefs, offers = R.build_preferences(*tables[:2]), R.candidate_weights(*tables[:2])
    whole = R.pair_overlaps(lists, prefs, offers).cache()
    for only in (["genre"], ["identity", "setting"], R.VECTOR):
        got = R.pair_overlaps(lists, prefs, offers, only)
        own = [f"t_{c}" if c not in R.VECTOR else f"a_{c}" for c in only] + [f"o_{c}" for c in only] + (list(R._ROLES) if "identity" in only else [])
        assert sorted(got.columns) == sorted(["source", "candidate", *own])
        assert _rows(got) == _rows(whole.select(*got.columns))
    packed = lambda only: R.packed_preferences(prefs, only).agg(F.count("source"), F.sum(F.length("want")), F.count_if(F.length("want") == 0)).first()
    (n, size, none), (all_n, all_size, _) = packed(["setting"]), packed(None)
    assert n == all_n and none > 0 and size < all_size / 10


def test_closeness_of_pairs_is_made_in_their_cells_without_genres(spark):
    tables, lists = _items(spark), _lists(spark)
    prefs, offers = R.build_preferences(*tables[:2]), R.candidate_weights(*tables[:2])
    base = tables[2].select(F.col("item_id").alias("source"), *(F.col(x).alias(f"b_{x}") for x in R.AXES))
    own = tables[2].withColumnRenamed("item_id", "candidate")
    sources, only = R.packed_preferences(prefs, ["identity"]).drop("want_tag").join(base, "source"), ["identity"]
    got = R.list_overlaps(lists.bare(), sources, R.packed_offers(offers, only).join(own, "candidate", "right"), appeal=True, only=only)
    assert sorted(got.columns) == sorted(["source", "candidate", "t_identity", "o_identity", "closeness", *R._ROLES])
    want = lists.bare().pairs().join(base, "source").join(own, "candidate", "left").select("source", "candidate", R.appeal_distance().alias("closeness"))
    assert _rows(got.select(*want.columns)) == _rows(want.join(sources.select("source"), "source", "left_semi"))


def test_tasks_of_the_join_of_the_facts_grow_with_the_facts(spark, monkeypatch):
    import re

    from tagloom.sources import inputs as I

    monkeypatch.setattr(I, "_TASK_FACTS", 500)
    sf = "/root/testdata/sf0.001"
    n = I.fact_tasks(spark, sf)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = I.lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert {(k, int(p)) for k, p in re.findall(r"hashpartitioning\((\w_orderkey)#\d+L?, (\d+)\)", plan)} == {("l_orderkey", n), ("o_orderkey", n)}
