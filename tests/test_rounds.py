"""Greedy merges in rounds against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import canon as C


def plain_merge(rows):
    """base of each tag: seeds in order absorb later ones; rows (context, norm, n) of one bucket."""
    left, out = sorted((-n, len(t), t) for _, t, n in rows), {}
    while left:
        seed, rest = left[0][2], []
        out[seed] = seed
        for r in left[1:]:
            a, b = set(seed.split()), set(r[2].split())
            if len(a & b) / len(a | b) >= 0.66:
                out[r[2]] = seed
            else:
                rest.append(r)
        left = rest
    return out


@pytest.mark.parametrize("words", [9, 14])
def test_rounds_equal_the_loop(spark, words):
    rng = random.Random(words)
    tags = {" ".join([*rng.choices([f"w{k}" for k in range(words)], k=5), "end"]): rng.randrange(1, 4) for _ in range(90)}
    rows = [("c", t, n) for t, n in tags.items()]
    frame = spark.createDataFrame(rows, "context string, norm string, n long")
    got = {r.norm: r.base for r in C.merge_surface_variants(frame, most=10).collect()}
    assert got == {r.norm: r.base for r in C.merge_surface_variants(frame).collect()} == plain_merge(rows)


def test_a_large_bucket_of_tags_that_are_all_alike(spark):
    """Every tag is like every other: no table of pairs is made."""
    frame = spark.range(30_000).select(F.lit("c").alias("context"), F.concat(F.lit("aa bb cc dd x"), F.col("id"), F.lit(" end")).alias("norm"), (F.col("id") % 7).alias("n"))
    got = C.merge_surface_variants(frame, most=1000)
    assert got.select("base").distinct().count() == 1 and got.count() == 30_000


def test_counters_equal_a_recount(spark):
    from tagloom.operators.reports import TagStates

    rows = [("niche_anchors", f"alpha beta t{k}", "", 1, 1, [f"alpha beta t{k}"], "p", []) for k in range(30)] + [("niche_anchors", f"gamma delta u{k}", "", 1, 1, [f"gamma delta u{k}"], "p", []) for k in range(4)] + [("setting_tags", f"common x{k}", "", 1, 1, [f"common x{k}"], "p", []) for k in range(260)]
    groups = spark.createDataFrame(rows, "context string, canon_tag string, final_tag string, member_count int, total_occurrences int, member_tags array<string>, pattern_type string, anchor_tokens array<string>")
    seen = C.Counters()
    one = lambda text: F.array(F.lit(1.0), F.length(text) * 0.0)  # noqa: E731  all texts alike
    out = C.canon_v3(groups, one, seen).collect()
    merged = [r for r in out if r.pattern_type == "semantic_bucket"]
    got = seen.read()
    assert got["merged_groups"] == len(merged) == 1 and got["merged_rows"] == sum(r.member_count for r in merged) == 4
    assert got["oversized_groups"] == 1 and got["skipped_buckets"] == 1 and got["buckets"] == 4 and got["pairs"] == 30 * 29 // 2 + 6
    assert len(out) == len(rows) - 4 + 1


def test_tag_states_give_the_one_pass_counts_however_they_are_split(spark, tmp_path):
    from tagloom.operators.reports import TagStates

    tags = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("context"), F.concat(F.lit("t"), F.col("id") % 25_000).alias("tag"), "id")
    want = {(r.context, r.tag): r.n for r in tags.groupBy("context", "tag").agg(F.count("*").alias("n")).collect()}
    for split in (1, 4):
        states = TagStates(spark, str(tmp_path / f"s{split}"))
        for k in [*range(split), 0]:  # the first batch is run again
            states.append(tags.where(F.pmod(F.hash("id"), F.lit(split)) == k), k)
        assert {(r.context, r.tag): r.n for r in states.counts().collect()} == want
        exact = {c: len({t for d, t in want if d == c}) for c in ("a", "b")}
        assert all(abs(r.tags / exact[r.context] - 1) < 0.03 for r in states.unique().collect())
    states.append(spark.createDataFrame([("c", " "), ("c", None)], "context string, tag string"), 9)
    assert states.counts().where("context = 'c'").count() == 0
