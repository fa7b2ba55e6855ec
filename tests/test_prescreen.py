"""The prescreen looks no further than others could be among the best, and facts are counted by item in one pass."""

import random

import pyarrow as pa

from tagloom.operators import prescreen as P
from tagloom.operators import retrieval as S


def _some(n, seed=4):
    rng = random.Random(seed)
    fields = {"signature_tag": 8, "niche_anchors": 9, "identity_tags": 5, "micro_tags": 4, "setting_tags": 5, "music_primary": 4, "music_secondary": 4, "genre.primary": 3, "genre.sub": 5}
    tags = [(i, f, f"{t}") for i in range(n) for f, m in fields.items() for t in rng.sample(range(m), rng.randint(0, 2))]
    return tags, {i: rng.choice([None, 1, 2]) for i in range(n)}


def _want(tags, popular, boosts, k, sources, there):
    held, asked = {}, {}
    for i, f, t in tags:
        held.setdefault(i, set()).add((f, t))
        asked.setdefault(i, set()).add((f, t))
    for i, f, t in boosts:
        asked.setdefault(i, set()).add((f, t))
    out = set()
    for s in sources:
        found = []
        for c, own in held.items():
            hits = sum(w for fs, to, w in S.PREDICATES if {t for f, t in asked.get(s, ()) if f in fs} & {t for f, t in own if f == to})
            if c != s and hits:
                found.append((-hits, float("inf") if popular.get(c) is None else -popular[c], c))
        out |= {(s, c, -h, c in there, n + 1) for n, (h, _, c) in enumerate(sorted(found)[:k])}
    return out


def test_search_gives_the_rows_of_all_pairs_in_one_cell_and_in_many(spark):
    tags, popular = _some(150)
    boosts = [(i, f, str(i % 4)) for i in range(0, 155, 3) for f in ("boost:identity", "boost:setting", "boost:music")]
    sources, there = list(range(0, 155, 2)), set(range(0, 150, 4))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for k, step, hold in ((4, 1000, None), (30, 7, 2_000), (200, 20, 1)):
        got = S.prescreen_candidates(
            frame(tags, "item_id long, field string, tag string"), frame(list(popular.items()), "candidate long, popularity long"), k,
            frame(boosts, "item_id long, field string, tag string"), step, frame([(s,) for s in sources], "source long"), frame([(c,) for c in there], "candidate long"), hold,
        )
        assert {tuple(r) for r in got.collect()} == _want(tags, popular, boosts, k, sources, there)


def test_search_leaves_out_candidates_that_cannot_be_among_the_best():
    """All are kinds of their own; half share signature and genres with the sources, the others nothing but a micro tag."""
    n = 4000
    of = [[("signature_tag", 1), ("genre.primary", 1), ("niche_anchors", i % 3), ("micro_tags", 1)] if i % 2 else [("signature_tag", 100 + i), ("micro_tags", 1)] for i in range(n)]
    lists = pa.array([[{"f": P.FIELDS.index(f), "t": t} for f, t in own] for own in of], pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int64())])))
    members = pa.array([[{"tie": 0.0, "id": i, "there": True}] for i in range(n)], pa.list_(pa.struct([("tie", pa.float64()), ("id", pa.int64()), ("there", pa.bool_())])))
    held = P.Held([P.pack_candidates(pa.table({"tags": lists, "members": members}))])
    seen = []
    asked = [(P.FIELDS.index(f), t) for f, t in of[1]]
    field, tag = pa.array([f for f, _ in asked]).to_numpy(), pa.array([t for _, t in asked]).to_numpy()
    part = lambda g: held.scores(g, *(x[P._ASKED[g][field]] for x in (field, tag)))
    chunks = (seen.append(len(c[1])) or c for c in held.chunks(part(0), 10))
    place, points = held.best([part(1), part(2)], chunks, 20)
    assert list(held.ids[place]) == [i for i in range(1, n, 2) if i % 3 == 1][:20] and set(points) == {18 + 10 + 12 + 3}
    assert sum(seen) <= n


def test_facts_of_an_item_are_counted_in_one_pass():
    from tagloom.sources import inputs as I

    rows = [(7, "a", "x", "RF", "N", "E", 1, 1, 2.0), (7, "a", "y", None, "N", "E", 1, 0, 3.0), (10, "b", "x", "RF", "M", "E", 2, 0, 1.0), (7, "b", "x", "RF", "N", "A", 3, None, 4.0)]
    names = ["item_id", *I._KINDS.values(), "s_suppkey", "returned", "quantity"]
    types = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int32(), pa.float64()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
    got = {r["item_id"]: r for b in I._counted(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()}
    tags = {(t["context"], t["tag"]): t["weight"] for t in got[7]["tags"]}
    assert tags == {("mechanics", "a"): 2, ("mechanics", "b"): 1, ("narrative", "x"): 2, ("narrative", "y"): 1, ("vibe", "RF"): 2, ("vibe", None): 1, ("structure_loop", "N"): 3, ("region", "E"): 2, ("region", "A"): 1}
    want = {"positive": 1, "negative": 1, "review_count": 3, "recommendations_total": 9, "owners": 9, "ccu": 2}
    assert {k: got[7][k] for k in want} == want and got[10]["review_count"] == 0 and len(got) == 2
