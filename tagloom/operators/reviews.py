"""Review filters, quality and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.functions.text import collapse_ws
from tagloom.functions.weights import cosine
from tagloom.operators.retrieval import hashed_tf_embedding
from tagloom.plans.staging import stage

# Patterns and phrases of the review rules.
TEMPLATES = [r"---\{\s*graphics\s*\}---", r"---\{\s*gameplay\s*\}---", r"---\{\s*audio\s*\}---", r"---\{\s*price\s*\}---", r"---\{\s*bugs\s*\}---", r"---\{\s*\?\s*/\s*10\s*\}---"]
FORMATS = [r"\bgraphics\b.{0,40}\bgameplay\b.{0,40}\baudio\b", r"\bpros?\b.{0,60}\bcons?\b", r"\bscore\s*:\s*\d+(\.\d+)?\s*/\s*10\b"]
HARD_PHRASES = ["you can run it on a microwave"]
CONCRETE = [
    r"\b(recoil|spray|aim|crosshair|movement|straf|peek|headshot|weapon|loadout|economy|round|match|server|mod|map|bomb|flash|smoke)\w*\b",
    r"\b(soundtrack|audio|sound design|soundscape|footstep|gunshot|music|mix|voice line)\b",
    r"\b(graphics|visuals|textures|lighting|animation|ui|interface|art style|palette|model)\b",
    r"\b(setting|city|school|dungeon|factory|kitchen|restaurant|ocean|space|wilderness|urban|world)\b",
]
DEPTH = [
    r"\bautomation\b", r"\bautomate\w*\b", r"\boptimi[sz]\w*\b", r"\befficien\w*\b", r"\bworkflow\b", r"\brouting\b", r"\bthroughput\b", r"\blayout\b", r"\bmastery\b", r"\bskill ceiling\b", r"\bdepth of knowledge\b", r"\blearn\b",
    r"\bexperiment\w*\b", r"\bprogression\b", r"\bunlock\w*\b",
]
CHECKBOXES = "[☐☑✅❌🔲]"
PLAYTIME = 60
CATEGORY_LIMITS = {"descriptive": 5, "artistic": 2, "music": 2, "systems_depth": 4}


def words(text: Column) -> Column:
    return F.filter(F.split(collapse_ws(text), " "), lambda w: w != "")


def is_ascii_art(text: Column) -> Column:
    total = F.length(F.trim(text))
    return F.when(total == 0, True).otherwise(F.length(F.regexp_replace(text, "[^a-zA-Z]", "")) / total < 0.5)


def keep_flags(least_words: int, playtime: int = PLAYTIME) -> list[tuple[str, Column]]:
    """The filters in their order."""
    text = F.coalesce("text", F.lit(""))
    return [("not_refunded", ~F.col("refunded")), ("min_words", F.size(words(text)) >= least_words), ("playtime", F.col("playtime_min") >= playtime), ("not_ascii_art", ~is_ascii_art(text))]


def filter_reviews(reviews: DataFrame, least_words: int = 50, playtime: int = PLAYTIME) -> DataFrame:
    out = reviews
    for _, flag in keep_flags(least_words, playtime):
        out = out.where(flag)
    return out


def filter_funnel(reviews: DataFrame, least_words: int = 50) -> DataFrame:
    """One row per item: how many reviews are left after each filter, and distinct texts at the end."""
    cols, so_far = [F.count(F.lit(1)).alias("raw")], F.lit(True)
    for name, flag in keep_flags(least_words):
        so_far = so_far & F.coalesce(flag, F.lit(False))
        cols.append(F.count_if(so_far).alias(name))
    return reviews.groupBy("item_id").agg(*cols, F.countDistinct(F.when(so_far, F.trim("text"))).alias("deduped"))


def filter_with_fallback(reviews: DataFrame, strict: int = 50, relaxed: int = 20) -> DataFrame:
    """The reviews of at least `strict` words of an item, or of `relaxed` where it has none; `mode` tells which. Texts stay where they
    are read: one flag an item is joined to them (by broadcast up to a million items), since an item may have any number of reviews."""
    s, r = (F.lit(True), F.lit(True))
    for (_, a), (_, b) in zip(keep_flags(strict), keep_flags(relaxed), strict=True):
        s, r = s & a, r & b
    x = reviews.withColumns({"_s": s, "_r": r})
    items = stage(x.groupBy(F.col("item_id").alias("_item")).agg(F.max("_s").alias("_any")), "strict-items")
    x = x.join(F.broadcast(items) if items.count() <= 1_000_000 else items, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    return x.where(F.when(F.col("_any"), F.col("_s")).otherwise(F.col("_r"))).withColumn("mode", F.when(F.col("_any"), "strict").otherwise("relaxed")).drop("_s", "_r", "_any")


def _any(text: Column, patterns: list[str], flags: str = "(?iU)") -> Column:
    return text.rlike("|".join(f"(?:{flags}{p})" for p in patterns))


def strip_checkbox_emoji(text: Column) -> Column:
    return F.regexp_replace(text, CHECKBOXES, "")


def is_template(text: Column) -> Column:
    t = F.trim(strip_checkbox_emoji(text))
    phrase = F.lit(False)
    for p in HARD_PHRASES:
        phrase = phrase | F.lower(t).contains(p)
    return (t == "") | phrase | _any(t, TEMPLATES)


def is_joke(text: Column, repeats: bool = True) -> Column:
    t = collapse_ws(text)
    w = words(t)
    n = F.size(w)
    again = n - F.size(F.array_distinct(F.transform(w, F.lower)))
    upper, letters = F.length(F.regexp_replace(t, r"\P{Lu}", "")), F.length(F.regexp_replace(t, r"\P{L}", ""))
    out = (t == "") | ((n < 20) & (again >= F.greatest(F.lit(4), F.floor(n / 3)))) | ((letters > 0) & (upper / letters > 0.55))
    return out | t.rlike(r"(?iU)\b(\w+)(?:\W+\1){4,}\b") if repeats else out


def _hits(text: Column, patterns: list[str], flags: str = "(?iU)") -> Column:
    return sum((text.rlike(f"{flags}{p}").cast("int") for p in patterns), F.lit(0))


def quality_multiplier(text: Column, repeats: bool = True) -> Column:
    bonus = F.least(0.12 * _hits(text, CONCRETE), F.lit(0.36))
    base = 1.0 - F.least(0.25 * _hits(text, FORMATS, "(?isU)"), F.lit(0.5))
    return F.when(is_template(text), 0.0).otherwise(F.greatest(base * F.when(is_joke(text, repeats), 0.55).otherwise(1.0) + bonus, F.lit(0.1)))


def systems_depth_bonus(text: Column) -> Column:
    h = _hits(text, DEPTH)
    return F.when(h > 0, F.least(1.25 + 0.45 * (h - 1), F.lit(4.0))).otherwise(0.0)


def lexicon_scores(reviews: DataFrame, lexicon: DataFrame, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """(id, category, score): the summed weights of the lexicon's terms in the lower-cased text, as
    2 for core terms, 1 for context, 0.5 for modifiers. The lexicon meets a text as one array, so that
    no text is copied for each term."""
    terms = lexicon.select("category", "term", "weight").distinct().agg(F.collect_list(F.struct("category", "term", "weight")).alias("_terms"))
    held = reviews.select(id_col, F.lower(text_col).alias("_t")).crossJoin(F.broadcast(terms))  # one row
    hits = held.select(id_col, F.explode(F.filter("_terms", lambda x: F.contains("_t", x["term"]))).alias("x"))
    return hits.groupBy(id_col, F.col("x.category").alias("category")).agg(F.sum("x.weight").alias("score"))


# How many of the best by score are read again, and the texts that they are held against.
POOLS = {"descriptive": 30, "artistic": 30, "music": 30, "systems_depth": 40}
PROMPTS = {
    "descriptive": "a deep insightful review explaining why the game works or does not",
    "artistic": "a review describing visuals art style aesthetics and design",
    "music": "a review that clearly describes the soundtrack style, genre, instrumentation, or musical identity of the game rather than generic sound quality",
    "systems_depth": "a review explaining the deeper systems, automation, optimization, routing, progression, mastery, or hidden depth that makes this game stand out from superficially similar games",
}


def _by_category(table: dict[str, int], other: int = 0) -> Column:
    out = F.lit(other)
    for c, n in table.items():
        out = F.when(F.col("category") == c, n).otherwise(out)
    return out


def category_pools(scores: DataFrame, pools: dict[str, int]) -> DataFrame:
    """scores(item_id, review_id, category, score) of the best of each item and category with a positive score, with their place `_r`."""
    w = W.partitionBy("item_id", "category").orderBy(F.desc(F.round("score", 9)), "review_id")
    return scores.where("score > 0").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= _by_category(pools))


def sample_topk_per_category(scores: DataFrame, similarity: DataFrame | None = None, pool: int = 30, limits: dict[str, int] | None = None) -> DataFrame:
    """scores(item_id, review_id, category, score): per item and category the best
    `pool` with a positive score, then the best by `similarity`(review_id, category,
    sim), or by score without it, up to the category's limit."""
    limits = limits or CATEGORY_LIMITS
    top = category_pools(scores, dict.fromkeys(limits, pool))
    top = top.join(similarity, ["review_id", "category"], "left") if similarity is not None else top.withColumn("sim", F.col("score"))
    return best_of_pools(top, limits)


def best_of_pools(top: DataFrame, limits: dict[str, int]) -> DataFrame:
    w = W.partitionBy("item_id", "category").orderBy(F.desc_nulls_last("sim"), "_r", "review_id")
    return top.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= _by_category(limits)).drop("_r", "sim")


def rerank_by_prompt(pool: DataFrame, encoder, prompts: dict[str, str] | None = None) -> DataFrame:
    """`pool`(category, text, ...) with `sim`, the cosine of a text's vector and that of its category's prompt.
    Only rows of the pool are encoded."""
    prompt = F.lit(None).cast("string")
    for c, text in (prompts or PROMPTS).items():
        prompt = F.when(F.col("category") == c, F.lit(text)).otherwise(prompt)
    # A prompt's vector is made once a category, not once a row.
    spoken = pool.select("category").distinct().withColumn("_p", encoder(prompt))
    return pool.join(F.broadcast(spoken), "category").withColumn("sim", F.round(cosine(encoder(F.col("text")), F.col("_p")), 9)).drop("_p")


PRIORITY = ["systems_depth", "descriptive", "artistic", "music"]


def sample_union_cap(picked: DataFrame, per_category: int = 5, most: int = 14) -> DataFrame:
    """picked(item_id, category, rnk, review_id, text): categories in fixed order,
    repeated texts once, at most `most` an item; `place` counts from 1."""
    priority = F.lit(len(PRIORITY))
    for k, c in enumerate(PRIORITY):
        priority = F.when(F.col("category") == c, k).otherwise(priority)
    x = picked.where(F.col("rnk") <= per_category).withColumns({"_p": priority, "_t": F.trim("text")})
    first = x.withColumn("_d", F.row_number().over(W.partitionBy("item_id", "_t").orderBy("_p", "rnk", "review_id"))).where("_d = 1")
    place = F.row_number().over(W.partitionBy("item_id").orderBy("_p", "rnk", "review_id"))
    return first.withColumn("place", place).where(F.col("place") <= most).drop("_p", "_t", "_d")


def sample_reviews(reviews: DataFrame, lexicon: DataFrame, encoder=hashed_tf_embedding, strict: int = 50, relaxed: int = 20) -> DataFrame:
    """(item_id, status, place, category, review_id): filtered, scored and sampled
    reviews; items without any keep one row with the reason in `status`.

    Each category's best by score are read again: the nearest to its prompt by the encoder's vectors come first.
    Depth counts even in a review without a word of the lexicon; an item of which no review has one has no sample."""
    kept = filter_with_fallback(reviews, strict, relaxed).withColumn("text", strip_checkbox_emoji(F.col("text")))
    rated = kept.withColumns({"q": quality_multiplier(F.col("text")), "depth": systems_depth_bonus(F.col("text"))}).select("item_id", "review_id", "text", "q", "depth")
    kept = stage(rated, "rated-reviews")
    rated = kept.where("q > 0")  # of the written rows: the patterns are searched once a text
    raw = lexicon_scores(rated, lexicon)
    part = lambda c, w: F.sum(F.when(F.col("category") == c, F.col("score") * w).otherwise(0.0))
    plain = ("descriptive", "artistic", "music")
    per = raw.groupBy("review_id").agg(F.max("score").alias("most"), part("explainability", 1.0).alias("explainability"), *(part(c, 1.0).alias(c) for c in plain))
    wide = rated.join(per, "review_id", "left").withColumn("_any", F.max(F.coalesce("most", F.lit(0.0))).over(W.partitionBy("item_id"))).where("_any > 0")
    z = lambda c: F.coalesce(c, F.lit(0.0)) * F.col("q")
    each = [F.struct(F.lit(c).alias("category"), z(c).alias("score")) for c in plain] + [F.struct(F.lit("systems_depth").alias("category"), (z("explainability") + z("descriptive") * 0.5 + F.col("depth")).alias("score"))]
    scores = wide.select("item_id", "review_id", F.explode(F.array(*each)).alias("x")).select("item_id", "review_id", "x.category", "x.score")
    pool = category_pools(scores, POOLS).join(rated.select("review_id", "text"), "review_id")
    pool = pool.repartition(reviews.sparkSession.sparkContext.defaultParallelism, "review_id")  # few rows, but each is encoded
    picked = sample_union_cap(best_of_pools(rerank_by_prompt(pool, encoder), CATEGORY_LIMITS))
    had = kept.select("item_id").distinct().withColumn("_k", F.lit(True))
    items = reviews.select("item_id").distinct().join(had, "item_id", "left")
    out = items.join(picked.select("item_id", "place", "category", "review_id"), "item_id", "left")
    status = F.when(F.col("place").isNotNull(), "ok").when(F.col("_k"), "no_insightful_reviews").otherwise("no_reviews_after_filtering")
    return out.select("item_id", status.alias("status"), "place", "category", "review_id")
