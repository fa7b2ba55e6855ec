"""Visual identity of items from image vectors and a tree of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.operators.tables import pick_distinct

# Labels that are shown of a branch, and the gap in score after which no more are.
LIMITS = {"presentation": (2, 1.6), "trait": (4, 1.2)}


def label_scores(images: DataFrame, labels: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, branch, parent, label, group, score, exact): how well labels suit an item's images.

    images(item, image_id, embedding); labels(branch, parent, label, group, label_embedding), a
    user's list. Per image a softmax of the dot products runs over the labels of one branch and parent; `exact` is its
    mean over the item's images, to nine digits, `score` that in percent, to two. So styles are judged among those of their own
    family, and all families are judged in one pass over the images.

    Images without a vector take no part; a null parent is a parent of its own."""
    one = labels.select("branch", "parent", "label", "group", F.col("label_embedding").alias("_v"))
    dot = F.aggregate(F.zip_with("embedding", "_v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x = images.where("embedding is not null").select(item, "image_id", "embedding").crossJoin(one).select(item, "image_id", "branch", "parent", "label", "group", F.exp(F.round(dot, 9)).alias("_e"))
    whole = F.sum(F.col("_e").cast("decimal(30,15)")).over(W.partitionBy(item, "image_id", "branch", "parent")).cast("double")
    scored = x.select(item, "branch", "parent", "label", "group", (F.col("_e") / whole).alias("_p"))
    mean = F.sum(F.col("_p").cast("decimal(20,12)")).cast("double") / F.count(F.lit(1))
    return scored.groupBy(item, "branch", "parent", "label", "group").agg(F.round(mean, 9).alias("exact"), F.round(mean * 100, 2).alias("score"))


def image_label_profile(images: DataFrame, labels: DataFrame, item: str = "item_id", limits: dict[str, tuple[int, float]] | None = None) -> DataFrame:
    """(item, render_family, render_style_primary, render_style_secondary, presentation_style, visual_traits).

    Branches of `labels`: family, style (whose parent is a family), presentation and trait. The best family wins; the
    first two styles among its own follow ('' where it has fewer). Presentations and traits are the best label of each group, in
    order, up to the branch's limit or its gap. Ties go to the smaller label. Items without a vector have no row."""
    limits = LIMITS | (limits or {})
    scores = label_scores(images, labels, item)
    best = F.row_number().over(W.partitionBy(item).orderBy(F.desc("exact"), "label"))
    family = scores.where("branch = 'family'").withColumn("_k", best).where("_k = 1").select(item, F.col("label").alias("render_family"))
    styles = scores.where("branch = 'style'").join(family, item).where(F.col("parent") == F.col("render_family")).withColumn("_k", best).where("_k <= 2")
    style = lambda k: F.coalesce(F.max(F.when(F.col("_k") == k, F.col("label"))), F.lit(""))
    named = styles.groupBy(item).agg(style(1).alias("render_style_primary"), style(2).alias("render_style_secondary"))
    out = family.join(named, item, "left").fillna("", ["render_style_primary", "render_style_secondary"])
    for branch, name in (("presentation", "presentation_style"), ("trait", "visual_traits")):
        most, gap = limits[branch]
        own = scores.where(F.col("branch") == branch).withColumn("group", F.coalesce("group", "label"))
        picked = pick_distinct(own, item, "group", "label", "score", most, gap, by="exact")
        listed = picked.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "label"))), lambda x: x["label"]).alias(name))
        out = out.join(listed, item, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
