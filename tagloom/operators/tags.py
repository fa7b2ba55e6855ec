"""Quality and clean-up of tags of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.functions.text import label_norm

# Word lists of the tag rules.
GENERIC_HEADS = [
    "action", "adventure", "aesthetic", "atmosphere", "challenge", "design", "experience", "feature", "game", "gameplay", "graphic", "interface", "level", "limit", "mechanic", "mode", "music", "nostalgia", "pacing",
    "platformer", "puzzle", "racing", "rpg", "setting", "simulation", "story", "strategy", "style", "system", "theme", "turn", "visual", "weapon",
]
VAGUE_LEADERS = ["arbitrary", "authentic", "captivating", "engaging", "fun", "good", "great", "immersive", "interesting", "nice", "random", "unique", "varied", "various"]
STOPLIKE = ["a", "an", "and", "co", "op", "for", "in", "of", "on", "the", "to", "with"]
SHORT_OK = ["2d", "3d", "4x", "4k", "8bit", "16bit", "18xx", "ai", "ui", "vr", "pvp", "pve", "rts", "fps", "mmo", "jrpg", "rpg"]
CLIPPED = ["driv", "generat", "licen", "matche", "narrat", "profil", "sett", "spott", "styliz"]
NARROW = ["micro_tags", "identity_tags", "setting_tags"]
FIELD_PRIORITY = ["signature_tag", "genre.primary", "genre.sub", "genre.sub_sub", "music_primary", "music_secondary", "niche_anchors", "identity_tags", "setting_tags", "micro_tags"]


def tag_words(tag: Column) -> Column:
    return F.filter(F.split(label_norm(tag), " "), lambda t: t != "")


def is_low_quality_tag(tag: Column, field: Column) -> Column:
    """No word or over five, a clipped or vague first word, nothing informative, or
    against the field's own rules for length."""
    t = tag_words(tag)
    n = F.size(t)
    clipped = F.exists(t, lambda w: ~w.isin(SHORT_OK) & w.rlike("(?:" + "|".join(CLIPPED) + ")$"))
    informative = F.filter(t, lambda w: ~w.isin(STOPLIKE) & ~F.regexp_replace(w, "[sx]", "").rlike("^[0-9]+$"))
    heads = F.try_element_at(informative, F.lit(-1)).isin(GENERIC_HEADS) & (F.size(informative) < 2)
    weighty = F.exists(informative, lambda w: (F.length(w) >= 4) | w.isin(SHORT_OK))
    narrow = field.isin(NARROW) & ((n < 2) | (n > 4) | F.coalesce(heads, F.lit(False)) | ~weighty)
    out = (n == 0) | (n > 5) | clipped | F.coalesce(F.try_element_at(t, F.lit(1)).isin(VAGUE_LEADERS), F.lit(False)) | (F.size(informative) == 0) | narrow | ((field == "niche_anchors") & (n < 2))
    return F.coalesce(out, F.lit(True))


def clean_tags(df: DataFrame, most: int, item: str = "item_id", field: str = "field", tag: str = "tag", pos: str = "pos", length: int = 60) -> DataFrame:
    """Good tags of an item's field, the first of equal labels, cut to `length`, at most `most`."""
    from tagloom.functions.text import collapse_ws

    x = df.withColumn(tag, F.substring(collapse_ws(F.col(tag)), 1, length)).where(~is_low_quality_tag(F.col(tag), F.col(field)))
    first = x.withColumn("_d", F.row_number().over(W.partitionBy(item, field, label_norm(F.col(tag))).orderBy(pos))).where("_d = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy(item, field).orderBy(pos))).where(F.col("place") <= most).drop("_d")


def dedupe_fields(list_tags: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Of equal labels of an item the one in the field of highest priority stays."""
    rank = F.lit(len(FIELD_PRIORITY))
    for k, f in enumerate(FIELD_PRIORITY):
        rank = F.when(F.col("field") == f, k).otherwise(rank)
    x = list_tags.withColumn("_p", rank)
    kept = x.withColumn("_d", F.row_number().over(W.partitionBy("item_id", label_norm(F.col("tag"))).orderBy("_p", "pos", "tag"))).where("_d = 1").drop("_d", "_p")
    for f, n in (caps or {}).items():
        kept = kept.where((F.col("field") != f) | (F.col("pos") <= n))
    return kept


def filter_by_tags(df: DataFrame, tags: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows whose tags contain every include text and none of the exclude texts, without regard to case."""
    has = lambda t: F.exists(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(t.lower())))
    out = df
    for t in include:
        out = out.where(has(t))
    for t in exclude:
        out = out.where(~has(t))
    return out


def tags_containing(list_tags: DataFrame, needle: str) -> DataFrame:
    return list_tags.where(F.contains(F.lower("tag"), F.lit(needle.lower())))


def evidence_reflected(evidence: Column, terms: Column) -> Column:
    """Some word of an evidence term is a word of a term; true without evidence."""
    flat = lambda c: F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.filter(F.split(F.regexp_replace(F.translate(F.lower(F.trim(x)), "_-", "  "), r"\s+", " "), " "), lambda w: w != "")))
    return (F.size(flat(evidence)) == 0) | F.arrays_overlap(flat(evidence), flat(terms))


def retry_reason(text: Column) -> Column:
    """Which rule an error text names."""
    t = F.lower(text)
    has = lambda s: F.contains(t, F.lit(s))
    return (
        F.when(has("jsondecodeerror"), "invalid_json").when(has("vector must sum to 100") | has("contained no positive integer weights"), "vector_sum_invalid").when(has("must not be empty"), "missing_required_field")
        .when(has("did not preserve strong evidence signals"), "evidence_not_reflected").when(has("validation"), "schema_validation_failed").otherwise("unknown_validation_failure")
    )


def semantics_checks(item_tags: DataFrame, list_tags: DataFrame) -> DataFrame:
    """(item_id, rule, ok): weights of each context sum to 100; signature and genre branches are there."""
    sums = item_tags.groupBy("item_id", F.concat(F.lit("sum:"), F.col("context")).alias("rule")).agg((F.round(F.sum("weight"), 6) == 100).alias("ok"))
    items = item_tags.select("item_id").distinct()
    rules = items.select("item_id", F.explode(F.array(*map(F.lit, ["signature_tag", "genre.primary", "genre.sub", "genre.sub_sub"]))).alias("rule"))
    there = list_tags.where(F.trim("tag") != "").select("item_id", F.col("field").alias("rule")).distinct().withColumn("_h", F.lit(True))
    return sums.unionByName(rules.join(there, ["item_id", "rule"], "left").select("item_id", "rule", F.coalesce("_h", F.lit(False)).alias("ok")))
