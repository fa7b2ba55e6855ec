"""Weights as tables: rounding to 100, shares, presets, boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.operators.recommend import COMPONENTS, CONTEXTS, SIGNALS, VECTOR, exact_sum, short_map

# Six named changes of weights, by intent, scope and key.
INTENTS = {
    "more_similar": {"context": {"mechanics": 8, "structure_loop": 16, "identity": -4, "setting": -4, "music": -3}, "match": {"vector": 18, "genre": -6, "appeal": -6, "music": -6}},
    "more_different": {"context": {"identity": 12, "setting": 10, "music": 8, "mechanics": -6, "structure_loop": -8}, "match": {"music": 12, "appeal": 8, "vector": -10, "genre": -10}, "appeal": {"creativity": 82}},
    "better_gameplay": {"context": {"mechanics": 18, "structure_loop": 14, "identity": -4, "setting": -4}, "match": {"vector": 16, "genre": -8, "appeal": -4, "music": -4}, "appeal": {"challenge": 68, "complexity": 66, "pace": 58}},
    "more_story": {"context": {"narrative": 20, "vibe": 6, "mechanics": -6, "structure_loop": -6}, "match": {"appeal": 14, "vector": 6, "genre": -10, "music": -10}, "appeal": {"narrative_focus": 84, "creativity": 62}},
    "stronger_atmosphere": {"context": {"vibe": 18, "music": 10, "setting": 6, "mechanics": -6, "structure_loop": -6}, "match": {"appeal": 12, "music": 10, "vector": -8, "genre": -8}, "appeal": {"creativity": 74, "pace": 40, "narrative_focus": 58}},
    "more_distinctive": {"context": {"identity": 18, "setting": 12, "music": 8, "structure_loop": -6, "mechanics": -6}, "match": {"music": 10, "appeal": 10, "vector": -8, "genre": -12}, "appeal": {"creativity": 86, "complexity": 58}},
}


def intent_rows() -> list[tuple[str, str, str, float]]:
    return [(i, s, k, float(v)) for i, scopes in INTENTS.items() for s, keys in scopes.items() for k, v in keys.items()]


def to_weights_equal(tags: Column) -> Column:
    """Array of (tag, weight): 100 dealt equally, one more to each of the first 100 mod n."""
    n = F.size(tags)
    return F.transform(tags, lambda t, i: F.struct(t.alias("tag"), (F.floor(F.lit(100) / n) + F.when(i < F.lit(100) % n, 1).otherwise(0)).cast("int").alias("weight")))


def largest_remainder_100(df: DataFrame, keys: list[str], tag: str = "tag", weight: str = "weight") -> DataFrame:
    """Integers that sum to 100 in each group: floors, and one more for the largest
    fractions (ties: larger weight, then larger tag); zeros are dropped."""
    total = exact_sum(F.col(weight), W.partitionBy(*keys))
    scaled = df.where(F.col(weight) > 0).withColumn("_s", F.round(F.col(weight) * 100.0 / total, 9))
    rest = (F.lit(100) - F.sum(F.floor("_s")).over(W.partitionBy(*keys))).alias("_rest")
    order = W.partitionBy(*keys).orderBy(F.desc(F.round(F.col("_s") - F.floor("_s"), 9)), F.desc(weight), F.desc(tag))
    x = scaled.withColumns({"_r": F.row_number().over(order)}).select("*", rest)
    return x.withColumn("points", (F.floor("_s") + F.when(F.col("_r") <= F.col("_rest"), 1).otherwise(0)).cast("int")).where("points > 0").drop("_s", "_r", "_rest")


def round_to_100(df: DataFrame, keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """Half-even rounding of percentages; what is missing from 100 goes to the largest residuals."""
    total = exact_sum(F.col(value), W.partitionBy(*keys))
    p = df.withColumn("_p", F.round(F.col(value) * 100.0 / total, 9)).withColumn("_b", F.bround("_p", 0))
    p = p.withColumn("_d", F.lit(100) - F.sum("_b").over(W.partitionBy(*keys)))
    order = W.partitionBy(*keys).orderBy(F.desc((F.col("_p") - F.col("_b")) * F.signum("_d")), key)
    p = p.withColumn("_r", F.row_number().over(order))
    return p.withColumn("points", (F.col("_b") + F.when(F.col("_r") <= F.abs("_d"), F.signum("_d")).otherwise(0)).cast("int")).drop("_p", "_b", "_d", "_r")


def rebalance_100(df: DataFrame, keys: list[str], key: str = "key", value: str = "value", boost: str = "boost") -> DataFrame:
    """Value plus boost, not below 0, rounded half up to percent; the difference to 100 goes to the largest key."""
    up = F.greatest(F.col(value) + F.coalesce(boost, F.lit(0.0)), F.lit(0.0))
    x = df.withColumn("_v", up).withColumn("_t", exact_sum(F.col("_v"), W.partitionBy(*keys)))
    x = x.withColumn("_p", F.when(F.col("_t") > 0, F.floor(F.round(F.col("_v") * 100.0 / F.col("_t"), 9) + 0.5)).otherwise(0))
    order = W.partitionBy(*keys).orderBy(F.desc("_p"), key)
    x = x.withColumns({"_r": F.row_number().over(order), "_d": F.lit(100) - F.sum("_p").over(W.partitionBy(*keys))})
    return x.withColumn("points", (F.col("_p") + F.when((F.col("_r") == 1) & (F.col("_t") > 0), F.col("_d")).otherwise(0)).cast("int")).drop("_v", "_t", "_p", "_r", "_d")


def group_multipliers(df: DataFrame, profile: str = "profile_id", key: str = "key", value: str = "value") -> DataFrame:
    """(profile, key, multiplier): a context's share of its group times the group's size; the defaults where a group's sum is not positive."""
    group = F.when(F.col(key).isin(VECTOR), "vector").when(F.col(key).isin(SIGNALS), "signal")
    x = df.withColumn("_g", group).where("_g is not null")
    total = exact_sum(F.col(value), W.partitionBy(profile, "_g"))
    size = F.when(F.col("_g") == "vector", len(VECTOR)).otherwise(len(SIGNALS))
    return x.withColumn("_t", total).select(profile, key, F.when(F.col("_t") > 0, F.col(value) / F.col("_t") * size).otherwise(short_map(F.col(key), CONTEXTS)).alias("multiplier"))


def component_weights(df: DataFrame, profile: str = "profile_id", key: str = "key", value: str = "value") -> DataFrame:
    total = exact_sum(F.col(value), W.partitionBy(profile))
    return df.withColumn("_t", total).select(profile, key, F.when(F.col("_t") > 0, F.col(value) / F.col("_t")).otherwise(short_map(F.col(key), COMPONENTS)).alias("share"))


def parse_boosts(df: DataFrame, text: str = "boost") -> DataFrame:
    """`context:tag=value` to (context, tag, value not below 0, ok): the first colon and the last equals sign count."""
    part = lambda k: F.trim(F.regexp_extract(F.col(text), r"^([^:]*):(.*)=([^=]*)$", k))
    value = part(3).try_cast("double")
    ok = (part(1) != "") & (part(2) != "") & value.isNotNull()
    return df.withColumns({"context": part(1), "tag": part(2), "value": F.when(value < 0, 0.0).otherwise(value), "ok": F.coalesce(ok, F.lit(False))})


def weight_entries(df: DataFrame, text: str = "raw") -> DataFrame:
    """Rows (tag, weight) of a text that is a JSON map, a JSON list or one tag; without a weight it is null."""
    first = F.substring(F.trim(F.col(text)), 1, 1)
    as_map = F.map_entries(F.from_json(text, "map<string,string>"))
    as_list = F.transform(F.from_json(text, "array<string>"), lambda t: F.struct(t.alias("key"), F.lit(None).cast("string").alias("value")))
    one = F.array(F.struct(F.trim(F.col(text)).alias("key"), F.lit(None).cast("string").alias("value")))
    rows = F.when(first == "{", as_map).when(first == "[", as_list).when(F.trim(F.col(text)) != "", one)
    return df.select("*", F.explode(rows).alias("_e")).select(*df.columns, F.col("_e.key").alias("tag"), F.col("_e.value").alias("weight"))


def describe_mix(v: Column) -> Column:
    return F.when(v >= 45, "dominant").when(v >= 25, "strong").when(v >= 12, "supporting").otherwise("light")


def review_relevance(positive: Column, negative: Column, reviews: Column) -> Column:
    """0.72 of the positive percentage and up to 28 for the number of reviews; null without reviews."""
    total = positive + negative
    return F.when(total > 0, 0.72 * (positive * 100.0 / total) + 28.0 * F.least(F.log10(reviews + 1) / 5.0, F.lit(1.0)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one of them is null, empty or zero."""

    def of(x: Column) -> Column:
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
        return F.struct(dot(x["a"], x["b"]).alias("d"), (F.sqrt(dot(x["a"], x["a"])) * F.sqrt(dot(x["b"], x["b"]))).alias("n"))

    return F.coalesce(let(let(F.struct(a.alias("a"), b.alias("b")), of), lambda y: F.when(y["n"] > 0, y["d"] / y["n"])), F.lit(0.0))
