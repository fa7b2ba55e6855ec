"""Canonical tags: grouping of tag variants in stages.

Groups are rows (context, canon_tag, final_tag, member_count, total_occurrences,
member_tags, pattern_type, anchor_tokens).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.functions.profiles import V3, V4, V5, V6, Profile, concept_core, semantic_tokens
from tagloom.functions.text import format_display, head_token, mapped, normalize_tag, token_jaccard, tokenize_tag
from tagloom.functions.weights import cosine
from tagloom.operators.graph import connected_components
from tagloom.operators.retrieval import hashed_tf_embedding
from tagloom.plans.staging import stage

COLUMNS = ["context", "canon_tag", "final_tag", "member_count", "total_occurrences", "member_tags", "pattern_type", "anchor_tokens"]
def _empty() -> Column:
    return F.lit("")


def collapse_normalized(raw: DataFrame) -> DataFrame:
    """(context, norm, n, members): raw tags(context, tag, n) by their normal form; tags without one go."""
    x = raw.withColumn("norm", normalize_tag("tag")).where("norm <> ''")
    return x.groupBy("context", "norm").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("tag", "n"))).alias("members"))


#: Least Jaccard similarity at which a seed absorbs a tag.
_ALIKE = 0.66


def merge_surface_variants(tags: DataFrame, most: int = 50_000) -> DataFrame:
    """(context, base, norm): the seed that absorbs each normalised tag.

    Within a bucket of (last token, number of tokens), seeds in order of count,
    length and tag absorb later tags of Jaccard similarity 0.66 or more. With
    fewer than five tokens that means equal token sets, which needs no bucket:
    only longer tags, and those with a repeated token, are compared: in a grouped pandas step where a bucket
    has at most `most` of them, else in rounds over all machines (`absorbed_in_rounds`), with the same result.
    """
    x = tags.withColumns({"toks": tokenize_tag("norm"), "head": head_token("norm")}).withColumn("len", F.size("toks"))
    plain = (F.col("len") < 5) & (F.size(F.array_distinct("toks")) == F.col("len"))
    order = W.partitionBy("context", "head", "key").orderBy(F.desc("n"), F.length("norm"), "norm")
    easy = x.where(plain).withColumn("key", F.array_join(F.array_sort("toks"), " ")).withColumn("key", F.when(F.col("len") < 2, F.col("norm")).otherwise(F.col("key")))
    short = easy.select("context", F.first("norm").over(order).alias("base"), "norm")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((-n, len(t), t, frozenset(k)) for t, n, k in zip(pdf["norm"], pdf["n"], pdf["toks"], strict=True)))
        left, out = rows, []
        while left:
            seed, rest = left[0], []
            out.append((seed[2], seed[2]))
            for r in left[1:]:
                if len(seed[3] & r[3]) / len(seed[3] | r[3]) >= _ALIKE:
                    out.append((seed[2], r[2]))
                else:
                    rest.append(r)
            left = rest
        return pd.DataFrame({"context": pdf["context"].iloc[0], "base": [a for a, _ in out], "norm": [b for _, b in out]})

    key = ["context", "head", "len"]
    long = x.where(~plain).select(*key, "norm", "n", "toks")
    sizes = stage(long.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), "buckets")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    of = lambda big: long.alias("a").join(sizes.where(F.col("_n") > most if big else F.col("_n") <= most).alias("b"), same, "left_semi")
    small = of(False).groupBy(*key).applyInPandas(run, "context string, base string, norm string")
    if not sizes.where(F.col("_n") > most).limit(1).count():
        return short.unionByName(small)
    return short.unionByName(small).unionByName(absorbed_in_rounds(of(True), key))


def absorbed_in_rounds(tags: DataFrame, key: list[str]) -> DataFrame:
    """(context, base, norm) of tags(*key, norm, n, toks) as the loop over each bucket gives it, for buckets of any size.

    Tags of Jaccard similarity 0.66 share one of the few rarest tokens of each. In a round, an open tag that is the
    first of the open tags for all of these is a seed, since no earlier one can absorb it; so a token has at
    most one new seed, and a round's work is linear in the tags. A tag that a seed absorbs is never a seed; it waits for
    earlier seeds, which later rounds may still find. The first open tag is always a seed, so that every round settles some."""
    bucket = F.xxhash64(*key)
    x = tags.select("context", "norm", bucket.alias("bucket"), F.struct((-F.col("n")).alias("n"), F.length("norm").alias("size"), F.col("norm").alias("tag")).alias("place"), F.array_distinct("toks").alias("toks"))
    df = x.select("bucket", F.explode("toks").alias("token")).groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df"))
    rare = x.select("context", "bucket", "norm", F.explode("toks").alias("token")).join(df, ["bucket", "token"]).groupBy("context", "bucket", "norm").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by"))
    first = F.slice(F.transform("by", lambda t: t["token"]), 1, F.size("by") - F.ceil(F.lit(_ALIKE) * F.size("by") - 1e-9).cast("int") + 1)
    own = ["context", "bucket", "norm"]
    state = stage(x.join(rare.select(*own, first.alias("keys")), own).withColumn("best", F.lit(None).cast(x.schema["place"].dataType)), "tags")
    done = []
    while state.where("best is null").limit(1).count():
        open_ = state.where("best is null")
        each = open_.select(*own, "place", F.explode("keys").alias("token"))
        leads = each.groupBy("bucket", "token").agg(F.min("place").alias("lead"))
        ahead = each.join(leads, ["bucket", "token"]).groupBy(*own).agg(F.every(F.col("place") == F.col("lead")).alias("_all")).where("_all").select(*own)
        seeds = stage(open_.join(ahead, own, "left_semi"), "seeds")
        done.append(seeds.select("context", F.col("norm").alias("base"), "norm"))
        rest = state.join(seeds.select(*own), own, "left_anti")
        by_token = seeds.select("bucket", F.explode("keys").alias("token"), F.col("place").alias("seed"), F.col("toks").alias("held"))
        met = rest.select(*own, "place", "toks", F.explode("keys").alias("token")).join(by_token, ["bucket", "token"]).where((F.col("seed") < F.col("place")) & (token_jaccard(F.col("toks"), F.col("held")) >= _ALIKE))
        found = met.groupBy(*own).agg(F.min("seed").alias("_seed"))
        state = stage(rest.join(found, own, "left").withColumn("best", F.least("best", "_seed")).drop("_seed"), "tags")
    out = state.select("context", F.col("best.tag").alias("base"), "norm")
    for d in done:
        out = out.unionByName(d)
    return out


def canon_v1(raw: DataFrame) -> DataFrame:
    """Raw tag counts to groups, with the display form of the commonest raw spelling."""
    norm = collapse_normalized(raw)
    seeds = merge_surface_variants(norm.select("context", "norm", "n"))
    all_raw = norm.select("context", "norm", F.explode("members").alias("m")).join(seeds, ["context", "norm"])
    best = F.min_by(F.col("m.tag"), F.struct(-F.col("m.n"), F.length("m.tag"), F.col("m.tag")))
    g = all_raw.groupBy("context", "base").agg(F.sum("m.n").alias("total_occurrences"), F.array_sort(F.collect_set("m.tag")).alias("member_tags"), best.alias("best"))
    own = F.col("context").startswith("genre_tree.") | F.col("context").isin("music_primary", "music_secondary", "setting_tags")
    parent = F.when(own, F.col("base")).otherwise(F.coalesce(F.nullif(head_token("base"), _empty()), F.col("base")))
    return g.select(
        "context", F.col("base").alias("canon_tag"), format_display("best").alias("final_tag"), F.size("member_tags").alias("member_count"), F.col("total_occurrences").cast("int").alias("total_occurrences"), "member_tags",
        F.lit("v1").alias("pattern_type"), F.slice(tokenize_tag("base"), 1, 1).alias("anchor_tokens"), format_display(parent).alias("parent_tag"), F.when(parent == F.col("base"), 1).otherwise(2).alias("specificity"),
    )


def _leaves() -> Column:
    return F.when(F.size("member_tags") > 0, F.col("member_tags")).otherwise(F.array("canon_tag"))


def canon_v2(groups: DataFrame) -> DataFrame:
    """Tags of equal content merge; of the input only merged single-member rows go."""
    x = groups.withColumn("core", concept_core("canon_tag"))
    big = x.where("core <> ''").groupBy("context", "core").agg(F.countDistinct("canon_tag").alias("k"), F.sum("total_occurrences").cast("int").alias("total_occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(_leaves())))).alias("member_tags")).where("k >= 2")
    merged = big.select("context", F.col("core").alias("canon_tag"), _empty().alias("final_tag"), F.size("member_tags").alias("member_count"), "total_occurrences", "member_tags", F.lit("concept_core").alias("pattern_type"), tokenize_tag("core").alias("anchor_tokens"))
    gone = x.where("member_count = 1").join(big.select("context", "core"), ["context", "core"], "left_semi").select("context", "canon_tag")
    return groups.select(*COLUMNS).join(gone, ["context", "canon_tag"], "left_anti").select(*COLUMNS).unionByName(merged)


def with_tokens(groups: DataFrame, profile: Profile, leaves: bool) -> DataFrame:
    """Adds `toks`, the distinct content tokens of the tag (and of its members), and a row id."""
    own = semantic_tokens("canon_tag", profile)
    toks = F.array_sort(F.array_distinct(F.flatten(F.concat(F.array(own), F.transform("member_tags", lambda m: semantic_tokens(m, profile)))))) if leaves else F.array_sort(F.array_distinct(own))
    return groups.withColumns({"toks": toks, "rid": F.xxhash64("context", "canon_tag")})


class Counters:
    """Figures of a stage that are counted as its rows pass by, in the pass that writes them, and not by a second one."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def watched(self, df: DataFrame, name: str, **figures: Column) -> DataFrame:
        """`df` written once, with its figures counted meanwhile."""
        seen = Observation()
        self._seen.append(seen)
        return stage(df.observe(seen, *(c.alias(n) for n, c in figures.items())), name)

    def read(self) -> dict[str, int]:
        """The figures so far; of equal names the sums."""
        out: dict[str, int] = {}
        for seen in self._seen:
            for name, n in seen.get.items():
                out[name] = out.get(name, 0) + (n or 0)
        return out


def blocked_self_join(rows: DataFrame, least: int = 2, most: int = 200, bucket: int | None = None, tokens: str = "toks", counters: Counters | None = None) -> DataFrame:
    """(context, a, b), a < b: row pairs of a context that share a token held by `least` to `most` rows.

    `counters` get buckets and skipped_buckets: tokens in reach, and those of too many rows."""
    t = rows.select("context", "rid", F.explode(tokens).alias("token")).distinct()
    df, top = t.groupBy("context", "token").agg(F.count(F.lit(1)).alias("df")), min(most, bucket or most)
    if counters is not None:
        df = counters.watched(df, "buckets", buckets=F.count_if((F.col("df") >= least) & (F.col("df") <= top)), skipped_buckets=F.count_if(F.col("df") > top))
    df = df.where((F.col("df") >= least) & (F.col("df") <= top))
    kept = t.join(df.select("context", "token"), ["context", "token"])
    other = kept.select("context", "token", F.col("rid").alias("b"))
    return kept.withColumnRenamed("rid", "a").join(other, ["context", "token"]).where("a < b").select("context", "a", "b").distinct()


def bucket_topk(tokens: DataFrame, n: int) -> DataFrame:
    """tokens(context, token, df): the `n` largest of each context, ties by token."""
    return tokens.withColumn("rnk", F.row_number().over(W.partitionBy("context").orderBy(F.desc("df"), "token"))).where(F.col("rnk") <= n)


def similar_pairs(pairs: DataFrame, rows: DataFrame, least_cosine: float, least_jaccard: float) -> DataFrame:
    """(context, a, b, sim) of the pairs that reach both thresholds. rows: (rid, toks, embedding)."""
    left = rows.select(F.col("rid").alias("a"), F.col("toks").alias("ta"), F.col("embedding").alias("ea"))
    right = rows.select(F.col("rid").alias("b"), F.col("toks").alias("tb"), F.col("embedding").alias("eb"))
    x = pairs.join(left, "a").join(right, "b").withColumn("sim", F.round(cosine(F.col("ea"), F.col("eb")), 9))
    return x.where((F.col("sim") >= least_cosine) & (token_jaccard(F.col("ta"), F.col("tb")) >= least_jaccard)).select("context", "a", "b", "sim")


def embedded(rows: DataFrame, text: Column, encoder=hashed_tf_embedding) -> DataFrame:
    """Adds `embedding`; the encoder is any function from a text column to a vector column."""
    return rows.withColumn("embedding", encoder(text))


def semantic_text(examples: int, full: bool = False) -> Column:
    """The tag, some of its members, and (full) its final form and anchors, set apart by double bars."""
    shown = F.transform(F.slice(F.filter("member_tags", lambda m: m != F.col("canon_tag")), 1, examples), normalize_tag)
    parts = [F.array(normalize_tag("canon_tag"))]
    if full:
        parts.append(F.when((F.col("final_tag") != "") & (F.col("final_tag") != F.col("canon_tag")), F.array(normalize_tag("final_tag"))).otherwise(F.array().cast("array<string>")))
    parts.append(shown)
    if full:
        parts.append(F.array(F.array_join("anchor_tokens", " ")))
    return F.array_join(F.filter(F.concat(*parts), lambda p: p != ""), " || ")


def _components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with `component`; a row without an edge is its own."""
    found = stage(connected_components(edges, "a", "b"), "components").withColumnsRenamed({"node": "rid"})
    return rows.join(found, "rid", "left").withColumn("component", F.coalesce("component", "rid"))


def _anchors(rows: DataFrame, keys: list[str]) -> DataFrame:
    t = rows.select(*keys, "rid", F.explode("toks").alias("token")).distinct()
    two = t.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return two.groupBy(*keys).agg(F.array_sort(F.collect_list("token")).alias("anchors"))


def _merge(groups: DataFrame, accepted: DataFrame, pattern: str) -> DataFrame:
    """accepted: rows with component and anchors. They give way to one row per component."""
    pick = F.min_by(F.col("canon_tag"), F.struct(-F.col("total_occurrences"), -F.col("member_count"), F.length("canon_tag"), F.lower("canon_tag"), F.col("canon_tag")))
    merged = accepted.groupBy("context", "component").agg(
        pick.alias("canon_tag"), F.sum("total_occurrences").cast("int").alias("total_occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(_leaves())))).alias("member_tags"), F.first("anchors").alias("anchor_tokens")
    )
    out = merged.select("context", "canon_tag", _empty().alias("final_tag"), F.size("member_tags").alias("member_count"), "total_occurrences", "member_tags", F.lit(pattern).alias("pattern_type"), "anchor_tokens")
    return groups.select(*COLUMNS).join(accepted.select("context", "canon_tag"), ["context", "canon_tag"], "left_anti").select(*COLUMNS).unionByName(out)


def canon_v3(groups: DataFrame, encoder=hashed_tf_embedding, counters: Counters | None = None) -> DataFrame:
    """Blocked pairs with cosine 0.74 and Jaccard 0.5; components of 2 to 25, with two shared tokens from six on. Music contexts stay.

    `counters` get buckets, skipped_buckets, pairs, oversized_groups, merged_groups and merged_rows."""
    counters = counters or Counters()
    groups = stage(groups, "groups")
    rows = stage(embedded(with_tokens(groups.where(~F.col("context").isin("music_primary", "music_secondary")), V3, False), normalize_tag("canon_tag"), encoder), "rows")
    edges = counters.watched(similar_pairs(blocked_self_join(rows, 2, 250, 200, counters=counters), rows, 0.74, 0.5), "pairs", pairs=F.count(F.lit(1)))
    # A component is named for its first row, so that this row stands for it in counts.
    x = _components(rows, edges).drop("embedding").withColumn("size", F.count(F.lit(1)).over(W.partitionBy("context", "component")))
    x = counters.watched(x, "sized", oversized_groups=F.count_if((F.col("size") > 25) & (F.col("rid") == F.col("component"))))
    x = x.where("size between 2 and 25").join(_anchors(x, ["context", "component"]), ["context", "component"], "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))
    accepted = x.where((F.col("size") < 6) | (F.size("anchors") >= 2))
    return _merge(groups, counters.watched(accepted, "accepted", merged_groups=F.count_if(F.col("rid") == F.col("component")), merged_rows=F.count(F.lit(1))), "semantic_bucket")


def canon_v4(groups: DataFrame, most_members: int = 5_000) -> DataFrame:
    """Checks the grouped rows of niche_anchors: kept if their members share a token,
    are similar and have a dominant token; else split by their commonest tokens; else
    dropped. A row of over `most_members` members is an error."""
    target = (F.col("context") == "niche_anchors") & (F.col("member_count") >= 2)
    toks = F.transform("member_tags", lambda m: F.struct(m.alias("tag"), F.array_distinct(semantic_tokens(m, V4)).alias("toks")))
    schema = groups.select(*COLUMNS).schema

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            members = [(m["tag"], set(m["toks"])) for m in row.pop("toks")]
            if len(members) > most_members:
                raise ValueError("a group has more members than the bound")
            counts: dict[str, int] = {}
            for _, t in members:
                for k in t:
                    counts[k] = counts.get(k, 0) + 1
            shared = sorted(k for k, c in counts.items() if c >= 2)
            pairs = [(a, b) for i, (_, a) in enumerate(members) for _, b in members[i + 1 :]]
            mean = sum(len(a & b) / len(a | b) if a and b else 0.0 for a, b in pairs) / len(pairs) if pairs else 0.0
            cover = max(counts.values(), default=0) / len(members)
            row["member_tags"] = [t for t, _ in members]
            row["anchor_tokens"] = list(row["anchor_tokens"])
            if len(shared) >= (2 if len(members) >= 6 else 1) and mean >= 0.34 and cover >= 0.66:
                out.append(row | {"anchor_tokens": shared})
                continue
            taken: set[str] = set()
            for token in sorted(shared, key=lambda k: (-counts[k], k)):
                part = sorted(t for t, s in members if t not in taken and token in s)
                if len(part) < 2:
                    continue
                taken.update(part)
                inner: dict[str, int] = {}
                for t, s in members:
                    if t in part:
                        for k in s:
                            inner[k] = inner.get(k, 0) + 1
                common = sorted(k for k, c in inner.items() if c >= 2) or [token]
                best = min(part, key=lambda t: (-len(set(common) & dict(members)[t]), len(t), t.lower(), t))
                out.append(row | {"canon_tag": best, "final_tag": "", "member_count": len(part), "member_tags": part, "pattern_type": "v4_split", "anchor_tokens": common})
        return pd.DataFrame(out, columns=COLUMNS)

    # Rows are judged one by one; dealing them by key keeps the tasks even.
    x = groups.where(target).select(*COLUMNS, toks.alias("toks"))
    judged = x.groupBy("context", "canon_tag").applyInPandas(judge, schema)
    return groups.where(~target | F.col("context").isNull()).select(*COLUMNS).unionByName(judged)


def canon_v5(groups: DataFrame, encoder=hashed_tf_embedding) -> DataFrame:
    """Tokens of 2 (3 or 4 in wide contexts) to 200 rows, buckets to 120, cosine 0.79, Jaccard 0.22; groups whose members are
    alike (0.22) with a dominant token (0.6) and at most 64 members."""
    from tagloom.operators.reports import avg_pairwise_jaccard, dominant_token_coverage

    groups = stage(groups, "groups")
    rows = stage(embedded(with_tokens(groups, V5, True), semantic_text(3), encoder), "rows")
    wide = {"narrative": 3, "setting_tags": 3, "signature_tag": 4}
    pairs = blocked_self_join(rows.where(~F.col("context").isin(list(wide))), 2, 200, 120)
    for context, least in wide.items():
        pairs = pairs.unionByName(blocked_self_join(rows.where(F.col("context") == context), least, 200, 120))
    x = _components(rows, stage(similar_pairs(pairs, rows, 0.79, 0.22), "pairs"))
    x = stage(x.drop("embedding").withColumn("size", F.count(F.lit(1)).over(W.partitionBy("context", "component"))).where("size >= 2"), "merged")
    key = ["context", "component"]
    total = x.groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_list(_leaves())))).alias("total")).where("total <= 64").select(*key)
    x = stage(x.join(total, key), "bounded")  # before any of a component's pairs are met
    alike = avg_pairwise_jaccard(x.withColumn("tokens", F.col("toks")), key, "rid")
    cover = dominant_token_coverage(x.select(*key, "rid", F.explode_outer("toks").alias("token")), key, "rid")
    good = alike.join(cover, key).where("jaccard >= 0.22 and coverage >= 0.6").select(*key)
    x = x.join(good, key).join(_anchors(x, key), key, "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))
    return _merge(groups, x, "v5_semantic")


# Names of families.
FAMILY_TAGS = {"automation": "automation systems", "roguelike": "roguelike systems", "deckbuilding": "deckbuilding systems", "social": "social simulation systems", "progression": "progression systems"}


def token_counts(groups: DataFrame) -> DataFrame:
    """(context, rid, token, n): how often the content tokens of a row occur in its tag, final form, members and anchors."""
    rows = groups.withColumn("rid", F.xxhash64("context", "canon_tag"))
    each = F.concat(F.array("canon_tag", "final_tag"), F.col("member_tags"))
    toks = F.concat(F.flatten(F.transform(each, lambda t: F.array_distinct(semantic_tokens(t, V6)))), F.col("anchor_tokens"))
    return rows.select("context", "rid", F.explode(toks).alias("token")).groupBy("context", "rid", "token").agg(F.count(F.lit(1)).alias("n"))


def row_bucket_tokens(groups: DataFrame) -> DataFrame:
    """(context, rid, token): the three commonest tokens of a row that occur twice, else its first anchors, else its first content tokens."""
    rows = groups.withColumn("rid", F.xxhash64("context", "canon_tag"))
    best = token_counts(groups).where("n >= 2").withColumn("k", F.row_number().over(W.partitionBy("context", "rid").orderBy(F.desc("n"), "token"))).where("k <= 3").select("context", "rid", "token")
    rest = rows.join(best.select("rid").distinct(), "rid", "left_anti")
    other = F.when(F.size("anchor_tokens") > 0, F.col("anchor_tokens")).otherwise(semantic_tokens("canon_tag", V6))
    return best.unionByName(rest.select("context", "rid", F.explode(F.array_distinct(F.slice(other, 1, 3))).alias("token")))


def component_anchor(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """(context, component, anchor): the commonest token (twice at least) of a component, else the first anchor or content token of its first row."""
    key = ["context", "component"]
    total = counts.join(rows.select("rid", "component"), "rid").groupBy(*key, "token").agg(F.sum("n").alias("n")).where("n >= 2")
    best = total.groupBy(*key).agg(F.min_by("token", F.struct(-F.col("n"), F.col("token"))).alias("anchor"))
    first = rows.groupBy(*key).agg(F.min(F.struct("canon_tag", "anchor_tokens", semantic_tokens("canon_tag", V6).alias("toks"))).alias("f"))
    fallback = F.coalesce(F.try_element_at("f.anchor_tokens", F.lit(1)), F.try_element_at("f.toks", F.lit(1)), _empty())
    return first.join(best, key, "left").select(*key, F.coalesce("anchor", fallback).alias("anchor"))


def canon_v6(groups: DataFrame, encoder=hashed_tf_embedding, neighbours: int = 5) -> DataFrame:
    """Every row with its family: anchor, family and subfamily tags, confidence (the best similarity in the family; 0 alone) and nearest tags."""
    groups = stage(groups, "groups")
    rows = embedded(groups.withColumn("rid", F.xxhash64("context", "canon_tag")), semantic_text(4, True), encoder)
    counts = stage(token_counts(groups), "counts")
    bag = counts.groupBy("rid").agg(F.array_sort(F.collect_list("token")).alias("toks"))
    rows = stage(rows.join(bag, "rid", "left").withColumn("toks", F.coalesce("toks", F.array().cast("array<string>"))), "rows")
    buckets = row_bucket_tokens(groups)
    pairs = blocked_self_join(buckets.groupBy("context", "rid").agg(F.collect_set("token").alias("toks")), 2, 160)
    edges = stage(similar_pairs(pairs, rows, 0.68, 1e-12), "pairs")  # any shared token will do
    x = stage(_components(rows, edges).drop("embedding"), "families")
    key = ["context", "component"]
    anchor = component_anchor(counts, x)
    sub = F.min_by("canon_tag", F.struct(-F.col("total_occurrences"), -F.col("member_count"), F.size(semantic_tokens("canon_tag", V6)), F.length("canon_tag"), F.lower("canon_tag"), F.col("canon_tag")))
    family = x.groupBy(*key).agg(sub.alias("subfamily_tag"))
    sure = edges.join(x.select(F.col("rid").alias("a"), "component"), "a").groupBy("context", "component").agg(F.max("sim").alias("confidence"))
    names = x.select(F.col("rid").alias("n"), F.col("canon_tag").alias("name"))
    both = edges.select(F.col("a").alias("rid"), F.col("b").alias("n"), "sim").unionByName(edges.select(F.col("b").alias("rid"), F.col("a").alias("n"), "sim"))
    near = both.join(names, "n").withColumn("k", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("sim"), F.lower("name"), "name"))).where(F.col("k") <= neighbours)
    near = near.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda z: z["name"]).alias("semantic_neighbors"))
    tag = F.when(F.col("anchor").isin(list(FAMILY_TAGS)), mapped(F.col("anchor"), FAMILY_TAGS)).otherwise(format_display("anchor"))
    return x.join(anchor, key).join(family, key).join(sure, key, "left").join(near, "rid", "left").select(
        *COLUMNS, F.col("anchor").alias("family_anchor"), tag.alias("family_tag"), "subfamily_tag", F.coalesce("confidence", F.lit(0.0)).alias("family_confidence"), F.coalesce("semantic_neighbors", F.array().cast("array<string>")).alias("semantic_neighbors")
    )


def canon_lookup_join(item_tags: DataFrame, mapping: DataFrame, tag: str = "tag") -> DataFrame:
    """Tags under mapping(context, norm, rep); a tag that is not mapped stays."""
    x = item_tags.withColumn("norm", normalize_tag(tag)).join(mapping, ["context", "norm"], "left")
    return x.withColumn(tag, F.coalesce("rep", tag)).drop("norm", "rep")


def build_mapping(groups: DataFrame) -> DataFrame:
    """(context, norm, rep): the last row in order of size, occurrences, context and tag wins."""
    rep = F.coalesce(F.nullif("final_tag", _empty()), F.col("canon_tag"))
    x = groups.select("context", F.explode(F.array_union(_leaves(), F.array("canon_tag"))).alias("m"), rep.alias("rep"), "member_count", "total_occurrences", "canon_tag").withColumn("norm", normalize_tag("m"))
    last = W.partitionBy("context", "norm").orderBy(F.asc("member_count"), F.asc("total_occurrences"), F.desc(F.lower("canon_tag")), F.desc("canon_tag"))
    return x.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("context", "norm", "rep")


def canonicalise_items(item_tags: DataFrame, groups: DataFrame) -> DataFrame:
    """(item_id, context, tag, weight): tags rewritten, equal ones merged."""
    x = canon_lookup_join(item_tags, build_mapping(groups))
    return x.groupBy("item_id", "context", "tag").agg(F.sum("weight").alias("weight"))
