"""Registered queries of reviews, tags of items, retrieval, canonical tags and item views."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom import canon_sql as Q
from tagloom.functions.text import norm_search_text
from tagloom.operators import canon as C
from tagloom.operators import ingest as G
from tagloom.operators import recommend as M
from tagloom.operators import reports as P
from tagloom.operators import retrieval as S
from tagloom.operators import reviews as V
from tagloom.operators import tables as B
from tagloom.operators import tags as T
from tagloom.operators.graph import connected_components
from tagloom.operators.lists import SharedLists
from tagloom.queries_reports import GROUPS, norm_sql, tokens_sql
from tagloom.queries_scoring import _CONF, _JOINED, _OFFERS, _PREFS, _SCORES
from tagloom.queries_tables import _fresh, _groups
from tagloom.plans.staging import stage
from tagloom.registry import query
from tagloom.sources import inputs as I

R = I.read

#: A lexicon of words that the test texts hold.
LEXICON = [(c, w, 2.0) for c, ws in {"descriptive": ["the", "and"], "artistic": ["les", "une"], "music": ["der", "und"], "explainability": ["by", "from"]}.items() for w in ws] + [("descriptive", "with", 1.0), ("descriptive", "of", 1.0), ("music", "ein", 0.5), ("artistic", "que", 0.5)]


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "category string, term string, weight double")


_LEX = "lex(category, term, weight) AS (VALUES " + ", ".join(f"('{c}', '{t}', {w}e0)" for c, t, w in LEXICON) + ")"
_WORDS = "len(list_filter(string_split(trim(regexp_replace(text, '[\\s\\x{{00A0}}\\x{{0085}}]+', ' ', 'g')), ' '), lambda w: w <> ''))".replace("{{", "{").replace("}}", "}")
_ART = "CASE WHEN length(trim(text, ' ')) = 0 THEN true ELSE length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / CAST(length(trim(text, ' ')) AS DOUBLE) < 0.5 END"
_FLAGS = f"flags AS (SELECT *, NOT refunded AS f1, {_WORDS} AS w, playtime_min >= 60 AS f3, NOT ({_ART}) AS f4 FROM fx_reviews)"


@query("review_filter", f"WITH {_FLAGS} SELECT item_id, review_id FROM flags WHERE f1 AND w >= 50 AND f3 AND f4")
def review_filter(spark, sf):
    return V.filter_reviews(I.reviews(spark, sf)).select("item_id", "review_id")


@query("review_filter_funnel", f"WITH {_FLAGS} SELECT item_id, count(*) AS raw, count(*) FILTER (f1) AS not_refunded, count(*) FILTER (f1 AND w >= 50) AS min_words, count(*) FILTER (f1 AND w >= 50 AND f3) AS playtime, count(*) FILTER (f1 AND w >= 50 AND f3 AND f4) AS not_ascii_art, count(DISTINCT CASE WHEN f1 AND w >= 50 AND f3 AND f4 THEN trim(text, ' ') END) AS deduped FROM flags GROUP BY item_id")
def review_filter_funnel(spark, sf):
    return V.filter_funnel(I.reviews(spark, sf))


@query("strict_relaxed_fallback", f"WITH {_FLAGS}, k AS (SELECT *, f1 AND w >= 900 AND f3 AND f4 AS s, f1 AND w >= 300 AND f3 AND f4 AS r FROM flags), m AS (SELECT *, max(s) OVER (PARTITION BY item_id) AS has FROM k) SELECT item_id, review_id, CASE WHEN has THEN 'strict' ELSE 'relaxed' END AS mode FROM m WHERE CASE WHEN has THEN s ELSE r END")
def strict_relaxed_fallback(spark, sf):
    return V.filter_with_fallback(I.reviews(spark, sf), 900, 300).select("item_id", "review_id", "mode")


_TPL = "regexp_matches(text, '(?i)---\\{\\s*(graphics|gameplay|audio|price|bugs)\\s*\\}---') OR regexp_matches(text, '(?i)---\\{\\s*\\?\\s*/\\s*10\\s*\\}---') OR contains(lower(text), 'you can run it on a microwave') OR trim(text, ' ') = ''"


@query("template_review_flag", f"SELECT review_id, {_TPL} AS template FROM (SELECT review_id, CASE WHEN review_id % 9 = 0 THEN text || ' ---{{ Audio }}---' ELSE text END AS text FROM fx_reviews) x")
def template_review_flag(spark, sf):
    x = I.reviews(spark, sf).withColumn("text", F.when(F.col("review_id") % 9 == 0, F.concat("text", F.lit(" ---{ Audio }---"))).otherwise(F.col("text")))
    return x.select("review_id", V.is_template(F.col("text")).alias("template"))


from tagloom.registry import ORACLES  # noqa: E402

ORACLES["template_review_flag"] = ORACLES["template_review_flag"].replace("---{{ Audio }}---", "---{ Audio }---")

_CW = "list_filter(string_split(t, ' '), lambda w: w <> '')"
_JOKE = f"(t = '' OR (len({_CW}) < 20 AND len({_CW}) - len(list_distinct(list_transform({_CW}, lambda w: lower(w)))) >= greatest(4, len({_CW}) // 3)) OR (length(regexp_replace(t, '\\P{{L}}', '', 'g')) > 0 AND length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) / CAST(length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS DOUBLE) > 0.55) OR len(list_filter(range(1, greatest(len(lw) - 3, 1)), lambda i: lw[i] = lw[i + 1] AND lw[i] = lw[i + 2] AND lw[i] = lw[i + 3] AND lw[i] = lw[i + 4])) > 0)"
#: Reviews with collapsed white space, and with their words for the rule on repeated ones.
_WORDED = "(SELECT *, list_transform(regexp_extract_all(t, '[\\pL\\pN_]+'), lambda w: lower(w)) AS lw FROM (SELECT review_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM fx_reviews) y)"


@query("joke_review_flag", f"SELECT review_id, {_JOKE} AS joke FROM {_WORDED} x")
def joke_review_flag(spark, sf):
    return I.reviews(spark, sf).select("review_id", V.is_joke(F.col("text")).alias("joke"))




def _words(pattern: str) -> str:
    """The pattern with Unicode words, for an engine whose word classes are ASCII."""
    head, tail = ("(?:^|[^\\pL\\pN_])", "(?:$|[^\\pL\\pN_])")
    return head + pattern.removeprefix("\\b").removesuffix("\\b").replace("\\w", "[\\pL\\pN_]") + tail


_CON = " + ".join(f"CAST(regexp_matches(text, '(?i){_words(p)}') AS INT)" for p in V.CONCRETE)
_FMT = " + ".join(f"CAST(regexp_matches(text, '(?is){_words(p)}') AS INT)" for p in V.FORMATS)


@query("quality_multiplier", f"SELECT review_id, round(CASE WHEN {_TPL} THEN 0.0e0 ELSE greatest((1.0e0 - least(0.25e0 * ({_FMT}), 0.5e0)) * CASE WHEN {_JOKE} THEN 0.55e0 ELSE 1.0e0 END + least(0.12e0 * ({_CON}), 0.36e0), 0.1e0) END, 6) AS q FROM {_WORDED} x")
def quality_multiplier(spark, sf):
    return I.reviews(spark, sf).select("review_id", F.round(V.quality_multiplier(F.col("text")), 6).alias("q"))


_DEP = " + ".join(f"CAST(regexp_matches(text, '(?i){_words(p)}') AS INT)" for p in V.DEPTH)


@query("systems_depth_bonus", f"SELECT review_id, round(CASE WHEN h > 0 THEN least(1.25e0 + 0.45e0 * (h - 1), 4.0e0) ELSE 0.0e0 END, 6) AS bonus FROM (SELECT review_id, {_DEP} AS h FROM (SELECT review_id, CASE WHEN review_id % 5 = 0 THEN text || ' Learn the workflow, unlocked.' ELSE text END AS text FROM fx_reviews) y) x")
def systems_depth_bonus(spark, sf):
    x = I.reviews(spark, sf).withColumn("text", F.when(F.col("review_id") % 5 == 0, F.concat("text", F.lit(" Learn the workflow, unlocked."))).otherwise(F.col("text")))
    return x.select("review_id", F.round(V.systems_depth_bonus(F.col("text")), 6).alias("bonus"))


@query("lexicon_score", f"WITH {_LEX} SELECT review_id, category, sum(weight) AS score FROM fx_reviews JOIN lex ON contains(lower(text), term) GROUP BY review_id, category")
def lexicon_score(spark, sf):
    return V.lexicon_scores(I.reviews(spark, sf), lexicon(spark))


_TOPK = f"""{_LEX}, sc AS (SELECT item_id, review_id, category, sum(weight) + any_value(review_id % 7) AS score FROM fx_reviews JOIN lex ON contains(lower(text), term) WHERE category <> 'explainability' GROUP BY item_id, review_id, category),
tk AS (SELECT *, row_number() OVER (PARTITION BY item_id, category ORDER BY score DESC, review_id) AS rnk FROM sc)"""


def _scored(spark, sf):
    x = V.lexicon_scores(I.reviews(spark, sf), lexicon(spark)).where("category <> 'explainability'").join(I.reviews(spark, sf).select("review_id", "item_id", "text"), "review_id")
    return x.withColumn("score", F.col("score") + F.col("review_id") % 7)


@query("sample_topk_per_category", f"WITH {_TOPK} SELECT item_id, review_id, category, CAST(rnk AS INT) AS rnk FROM tk WHERE rnk <= CASE category WHEN 'descriptive' THEN 5 ELSE 2 END")
def sample_topk_per_category(spark, sf):
    return V.sample_topk_per_category(_scored(spark, sf)).select("item_id", "review_id", "category", "rnk")


@query("sample_union_cap", f"""WITH {_TOPK}, p AS (SELECT tk.*, trim(text, ' ') AS t, CASE category WHEN 'descriptive' THEN 1 WHEN 'artistic' THEN 2 ELSE 3 END AS pr FROM tk JOIN fx_reviews r ON r.review_id = tk.review_id WHERE rnk <= CASE category WHEN 'descriptive' THEN 5 ELSE 2 END),
d AS (SELECT *, row_number() OVER (PARTITION BY item_id, t ORDER BY pr, rnk, review_id) AS d FROM p), e AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pr, rnk, review_id) AS place FROM d WHERE d = 1) SELECT item_id, review_id, category, CAST(place AS INT) AS place FROM e WHERE place <= 6""")
def sample_union_cap(spark, sf):
    return V.sample_union_cap(V.sample_topk_per_category(_scored(spark, sf)), most=6).select("item_id", "review_id", "category", "place")


_VEC = "list_transform(range(97, 123), lambda i: CAST(length({0}) - length(replace({0}, chr(CAST(i AS INT)), '')) AS DOUBLE) ** 4)"
_SAMPLED = f"""{_LEX}, {_FLAGS}, k AS (SELECT *, f1 AND w >= 50 AND f3 AND f4 AS s, f1 AND w >= 20 AND f3 AND f4 AS r FROM flags), m AS (SELECT *, max(s) OVER (PARTITION BY item_id) AS has FROM k),
kept AS (SELECT item_id, review_id, regexp_replace(text, '[☐☑✅❌🔲]', '', 'g') AS text FROM m WHERE CASE WHEN has THEN s ELSE r END),
rated AS (SELECT * FROM (SELECT item_id, review_id, text, CASE WHEN {_TPL} THEN 0.0e0 ELSE greatest((1.0e0 - least(0.25e0 * ({_FMT}), 0.5e0)) * CASE WHEN {_JOKE} THEN 0.55e0 ELSE 1.0e0 END + least(0.12e0 * ({_CON}), 0.36e0), 0.1e0) END AS q, CASE WHEN ({_DEP}) > 0 THEN least(1.25e0 + 0.45e0 * (({_DEP}) - 1), 4.0e0) ELSE 0.0e0 END AS depth
 FROM (SELECT *, list_transform(regexp_extract_all(t, '[\\pL\\pN_]+'), lambda w: lower(w)) AS lw FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM kept) y) x) z WHERE q > 0),
raw AS (SELECT review_id, item_id, category, sum(weight) AS score FROM rated JOIN lex ON contains(lower(text), term) GROUP BY ALL),
scores AS (SELECT raw.item_id, raw.review_id, category, score * q AS score FROM raw JOIN rated ON raw.review_id = rated.review_id WHERE category <> 'explainability'
 UNION ALL SELECT t.item_id, t.review_id, 'systems_depth', coalesce((SELECT sum(CASE category WHEN 'explainability' THEN score * q WHEN 'descriptive' THEN score * q * 0.5e0 END) FROM raw WHERE raw.review_id = t.review_id), 0) + depth FROM rated t WHERE item_id IN (SELECT item_id FROM raw)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, category ORDER BY round(score, 9) DESC, review_id) AS r FROM scores WHERE score > 0) x WHERE r <= CASE category WHEN 'systems_depth' THEN 40 ELSE 30 END),
prompts(category, prompt) AS (VALUES {', '.join(f"('{c}', '{t}')" for c, t in V.PROMPTS.items())}),
near AS (SELECT * REPLACE (CASE WHEN isnan(sim) THEN 0 ELSE sim END AS sim) FROM (SELECT pool.*, trim(text, ' ') AS t, round(list_cosine_similarity({_VEC.format("text")}, {_VEC.format("prompt")}), 9) AS sim FROM pool JOIN rated ON pool.review_id = rated.review_id JOIN prompts ON pool.category = prompts.category) x),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id, category ORDER BY sim DESC, r, review_id) AS rnk, CASE category WHEN 'systems_depth' THEN 0 WHEN 'descriptive' THEN 1 WHEN 'artistic' THEN 2 ELSE 3 END AS pr FROM near),
uniq AS (SELECT *, row_number() OVER (PARTITION BY item_id, t ORDER BY pr, rnk, review_id) AS d FROM best WHERE rnk <= CASE category WHEN 'descriptive' THEN 5 WHEN 'systems_depth' THEN 4 ELSE 2 END),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pr, rnk, review_id) AS INT) AS place FROM uniq WHERE d = 1)"""


@query("sample_reviews", f"""WITH {_SAMPLED} SELECT i.item_id, CASE WHEN place IS NOT NULL THEN 'ok' WHEN i.item_id IN (SELECT item_id FROM kept) THEN 'no_insightful_reviews' ELSE 'no_reviews_after_filtering' END AS status, place, category, review_id
FROM (SELECT DISTINCT item_id FROM fx_reviews) i LEFT JOIN (SELECT * FROM placed WHERE place <= 14) p ON p.item_id = i.item_id""")
def sample_reviews(spark, sf):
    return V.sample_reviews(I.reviews(spark, sf), lexicon(spark), _letters)


@query("strip_checkbox_emoji", "SELECT review_id, CAST(length(replace(text, '☑', '')) AS INT) AS n FROM fx_reviews")
def strip_checkbox_emoji(spark, sf):
    return I.reviews(spark, sf).select("review_id", F.length(V.strip_checkbox_emoji(F.concat("text", F.lit("☑✅")))).alias("n"))


_LQ_STOP = ", ".join(f"'{w}'" for w in T.STOPLIKE)
_LQ = f"""w AS (SELECT context, tag, list_filter(string_split(trim(regexp_replace(translate(lower(trim(tag)), '_-', '  '), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM fx_raw_tags),
i AS (SELECT *, list_filter(t, lambda x: x NOT IN ({_LQ_STOP}) AND NOT regexp_matches(regexp_replace(x, '[sx]', '', 'g'), '^[0-9]+$')) AS inf FROM w)"""
_LQ_OUT = f"""(len(t) = 0 OR len(t) > 5 OR len(list_filter(t, lambda x: regexp_matches(x, '({"|".join(T.CLIPPED)})$') AND x NOT IN ({", ".join(f"'{x}'" for x in T.SHORT_OK)}))) > 0 OR t[1] IN ({", ".join(f"'{x}'" for x in T.VAGUE_LEADERS)}) OR len(inf) = 0
 OR (context IN ('micro_tags', 'identity_tags', 'setting_tags') AND (len(t) < 2 OR len(t) > 4 OR (len(inf) < 2 AND inf[-1] IN ({", ".join(f"'{x}'" for x in T.GENERIC_HEADS)})) OR len(list_filter(inf, lambda x: length(x) >= 4)) = 0)) OR (context = 'niche_anchors' AND len(t) < 2))"""


@query("low_quality_tag_flag", f"WITH {_LQ} SELECT context, tag, {_LQ_OUT} AS bad FROM i")
def low_quality_tag_flag(spark, sf):
    return I.raw_tags(spark, sf).select("context", "tag", T.is_low_quality_tag(F.col("tag"), F.col("context")).alias("bad"))


@query("clean_tag_list", f"WITH {_LQ}, g AS (SELECT context, tag, n, row_number() OVER (PARTITION BY context, trim(regexp_replace(translate(lower(trim(tag)), '_-', '  '), '\\s+', ' ', 'g')) ORDER BY n DESC, tag) AS d FROM i JOIN fx_raw_tags USING (context, tag) WHERE NOT {_LQ_OUT}), r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, tag) AS place FROM g WHERE d = 1) SELECT context, tag, CAST(place AS INT) AS place FROM r WHERE place <= 20")
def clean_tag_list(spark, sf):
    x = I.raw_tags(spark, sf).select(F.lit(1).alias("item_id"), F.col("context").alias("field"), "tag", F.struct((-F.col("n")).alias("a"), F.col("tag").alias("b")).alias("pos"))
    return T.clean_tags(x, 20).select(F.col("field").alias("context"), "tag", "place")


@query("cross_field_dedupe", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY item_id, lower(tag) ORDER BY CASE field {' '.join(f'WHEN {f!r} THEN {k}' for k, f in enumerate(T.FIELD_PRIORITY))} END, pos, tag) AS d FROM (SELECT item_id, field, replace(replace(tag, '-', ' '), '_', ' ') AS l, tag, pos FROM fx_list_tags) x) SELECT item_id, field, tag, pos FROM r WHERE d = 1")
def cross_field_dedupe(spark, sf):
    return T.dedupe_fields(I.list_tags(spark, sf))


@query("include_exclude_tags", "SELECT p_partkey AS item_id FROM part WHERE (contains(lower(p_name), 'anvil') OR contains(lower(p_type), 'anvil')) AND NOT contains(lower(p_name), 'blue') AND NOT contains(lower(p_type), 'blue')")
def include_exclude_tags(spark, sf):
    p = R(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.array("p_name", "p_type").alias("tags"))
    return T.filter_by_tags(p, "tags", ["Anvil"], ["BLUE"]).select("item_id")


@query("min_review_filter", "SELECT item_id FROM fx_signals WHERE positive + negative = 0 OR positive * 100.0e0 / (positive + negative) >= 60")
def min_review_filter(spark, sf):
    total = F.col("positive") + F.col("negative")
    p = F.when(total > 0, F.col("positive") * 100.0 / total)
    return I.signals(spark, sf).where(p.isNull() | (p >= 60)).select("item_id")


@query("eligible_for_next_stage", "SELECT d.doc_id FROM documents d WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def eligible_for_next_stage(spark, sf):
    return R(spark, sf, "documents").where("n_chars > 500").select("doc_id").join(R(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("asset_backfill_targets", "SELECT d.doc_id FROM documents d LEFT JOIN labels b ON b.doc_id = d.doc_id WHERE trim(source) <> '' AND n_chars < 1000 AND (b.doc_id IS NULL OR b.quality = 0)")
def asset_backfill_targets(spark, sf):
    state = R(spark, sf, "labels").select("doc_id", "quality")
    return R(spark, sf, "documents").join(state, "doc_id", "left").where("trim(source) <> '' and n_chars < 1000 and (quality is null or quality = 0)").select("doc_id")


@query("find_needle_hits", "SELECT item_id, field, tag FROM fx_list_tags WHERE contains(lower(tag), 'an')")
def find_needle_hits(spark, sf):
    return T.tags_containing(I.list_tags(spark, sf), "AN").select("item_id", "field", "tag")


@query("screen_any_overlap", "SELECT DISTINCT source, candidate FROM fx_candidates JOIN fx_list_tags a ON a.item_id = source AND a.field = 'niche_anchors' JOIN fx_list_tags b ON b.item_id = candidate AND b.field = 'niche_anchors' AND a.tag = b.tag")
def screen_any_overlap(spark, sf):
    t = I.list_tags(spark, sf).where("field = 'niche_anchors'").groupBy("item_id").agg(F.collect_set("tag").alias("t"))
    c = I.candidate_lists(spark, sf).known(t.select(F.col("item_id").alias("source"), F.col("t").alias("a")), t.select(F.col("item_id").alias("candidate"), F.col("t").alias("b"))).pairs()
    return c.where(F.arrays_overlap("a", "b")).select("source", "candidate")


@query("evidence_reflected", "SELECT p_partkey, p_partkey % 3 <> 1 AS ok FROM part")
def evidence_reflected(spark, sf):
    k = F.col("p_partkey") % 3
    none = F.array().cast("array<string>")
    evidence = F.when(k == 0, none).when(k == 1, F.array(F.lit("zz-top"))).otherwise(F.array(F.concat(F.lit("a_"), F.substring_index("p_name", " ", 1))))
    return R(spark, sf, "part").select("p_partkey", T.evidence_reflected(evidence, F.array("p_name", "p_type")).alias("ok"))


@query("retry_reason_counts", "SELECT CASE event_type WHEN 'error' THEN 'vector_sum_invalid' WHEN 'click' THEN 'schema_validation_failed' ELSE 'unknown_validation_failure' END AS reason, count(*) AS n FROM events GROUP BY 1")
def retry_reason_counts(spark, sf):
    text = F.when(F.col("event_type") == "error", "Vector must sum to 100").when(F.col("event_type") == "click", "1 Validation error").otherwise(F.col("event_type"))
    return P.count_by(R(spark, sf, "events"), [T.retry_reason(text).alias("reason")], "n")


@query("semantics_valid", "SELECT item_id, 'sum:' || context AS rule, round(sum(weight), 6) = 100 AS ok FROM fx_item_tags GROUP BY item_id, context UNION ALL SELECT item_id, r, true FROM (SELECT DISTINCT item_id FROM fx_item_tags) x, (VALUES ('signature_tag'), ('genre.primary'), ('genre.sub'), ('genre.sub_sub')) v(r)")
def semantics_valid(spark, sf):
    return T.semantics_checks(I.item_tags(spark, sf), I.list_tags(spark, sf))


@query("evidence_text", "SELECT p_partkey, 'EVIDENCE SIGNALS:' || chr(10) || '- repeated systems: ' || p_name || '; ' || p_type || chr(10) || '- music signals: none' AS out FROM part")
def evidence_text(spark, sf):
    none = F.array().cast("array<string>")
    return R(spark, sf, "part").select("p_partkey", G.evidence_text({"repeated_systems": F.array("p_name", "p_type"), "music_signals": none}).alias("out"))


@query("retrieval_document", "SELECT p_partkey, p_name || chr(10) || p_type || chr(10) || p_brand || chr(10) || 'mechanics:' || p_name AS out FROM part")
def retrieval_document(spark, sf):
    none = F.array().cast("array<string>")
    p = R(spark, sf, "part")
    return p.select("p_partkey", G.retrieval_document(F.col("p_name"), F.lit(" "), F.array("p_type"), F.array("p_brand"), none, F.array(F.concat(F.lit("mechanics:"), "p_name"))).alias("out"))


#: A profile: weights of contexts, boosts of tags, boosts of the soundtrack.
_PROFILE = ({"mechanics": 27.0, "vibe": 0.0, "structure_loop": 45.0, "identity": 63.0, "setting": 5.0, "music": 100.0}, {"mechanics": {"1-URGENT": 60.0, "5-LOW": 12.0, **{f"m{k}": float(k) for k in range(6)}}, "setting": {"sea": 100.0}}, {"calm": 36.0, "loud": 84.0})


def _profile_sql() -> str:
    """The profile's lines as rows (item_id, o1, o2, text, times), by the rule of `query_parts`."""
    weights, boosts, music = _PROFILE
    times = lambda w, step, most: f"CAST(greatest(1, least({most}, round_even({w}e0 / {step}, 0))) AS INT)"
    rows, at = [], 10
    for c, w in weights.items():
        if w > 0:
            n = times(w, 18, 5)
            rows.append(f"SELECT p_partkey, {at}, 0, 'focus:{c}', {n} FROM part")
            fields = {"identity": "signature_tag,niche_anchors,identity_tags", "setting": "setting_tags", "music": "music_primary,music_secondary"}.get(c)
            source = f"SELECT item_id, tag, row_number() OVER (PARTITION BY item_id ORDER BY instr('{fields}', field), pos) AS k FROM fx_list_tags WHERE field IN ({', '.join(repr(f) for f in fields.split(','))})" if fields else f"SELECT item_id, tag, pos AS k FROM fx_ranked_tags WHERE context = '{c}'"
            rows.append(f"SELECT item_id, {at + 1}, k, tag, {n} FROM ({source}) x" + ("" if c == "music" else " WHERE k <= 4"))
            at += 2
    for c, table in boosts.items():
        for t, w in sorted(table.items(), key=lambda x: -x[1])[:6]:
            for text in (t, f"{c}:{t}"):
                rows.append(f"SELECT p_partkey, {at}, 0, '{text}', {times(w, 24, 4)} FROM part")
                at += 1
    for t, w in sorted(music.items(), key=lambda x: -x[1])[:4]:
        rows.append(f"SELECT p_partkey, {at}, 0, '{t}', {times(w, 24, 4)} FROM part")
        at += 1
    return " UNION ALL ".join(rows)


@query("query_document", f"WITH rows_(item_id, o1, o2, text, times) AS (SELECT p_partkey, 0, 0, p_name, 1 FROM part UNION ALL SELECT item_id, 1, row_number() OVER (PARTITION BY item_id ORDER BY context, pos), context || ':' || tag, 1 FROM fx_ranked_tags UNION ALL {_profile_sql()}) SELECT p_partkey, string_agg(repeat(chr(10) || text, times), '' ORDER BY o1, o2)[2:] AS out FROM rows_ JOIN part ON p_partkey = item_id GROUP BY p_partkey")
def query_document(spark, sf):
    ordered = lambda x: F.transform(F.sort_array(F.collect_list(x)), lambda t: t["text"])
    ranked = I.ranked_tags(spark, sf)
    contexts = ["mechanics", "structure_loop"]
    own = ranked.groupBy("item_id").agg(
        ordered(F.struct("context", "pos", F.concat_ws(":", "context", "tag").alias("text"))).alias("all_tags"),
        *(ordered(F.when(F.col("context") == c, F.struct("pos", F.col("tag").alias("text")))).alias(c) for c in contexts),
    )
    fields = {"identity": ["signature_tag", "niche_anchors", "identity_tags"], "setting": ["setting_tags"], "music": ["music_primary", "music_secondary"]}
    place = lambda fs: F.array_position(F.array(*map(F.lit, fs)), F.col("field"))
    lists = I.list_tags(spark, sf).groupBy("item_id").agg(*(ordered(F.when(F.col("field").isin(fs), F.struct(place(fs).alias("o"), "pos", F.col("tag").alias("text")))).alias(n) for n, fs in fields.items()))
    items = R(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name").join(own, "item_id", "left").join(lists, "item_id", "left")
    base = F.concat(F.array("p_name"), F.coalesce("all_tags", F.array().cast("array<string>")))
    weights, boosts, music = _PROFILE
    parts = G.query_parts(base, {c: F.col(c) for c in [*contexts, *fields]}, weights, boosts, music)
    return items.select(F.col("item_id").alias("p_partkey"), G.query_document(parts).alias("out"))


@query("serving_table", "SELECT p_partkey AS item_id, p_name AS name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS search_name, coalesce(owners, 0) AS owners FROM part LEFT JOIN (SELECT * FROM fx_signals WHERE item_id % 4 <> 0) s ON s.item_id = p_partkey")
def serving_table(spark, sf):
    items = R(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    return G.serving_row(items, I.signals(spark, sf).where("item_id % 4 <> 0")).select("item_id", "name", "search_name", "owners")


@query("image_sources", "SELECT page_id, kind, u AS url, CAST(pos AS INT) AS pos FROM (SELECT page_id, unnest(['a', 'screenshot']) AS kind, unnest([url, url || '?s']) AS u, unnest([0, 1]) AS pos FROM pages) x")
def image_sources(spark, sf):
    p = R(spark, sf, "pages").select("page_id", F.col("url").alias("a"), F.lit("").alias("b"), F.col("url").alias("c"), F.array("url", F.concat("url", F.lit("?s"))).alias("shots"))
    return G.image_sources(p, "page_id", ["a", "b", "c"], "shots")


@query("clean_vectors", "SELECT item_id, context, tag, CAST(weight AS INT) AS weight FROM fx_item_tags")
def clean_vectors(spark, sf):
    """The cleaned vectors of all items; what is counted of regions is no context of theirs."""
    m = I.tag_facts(spark, sf).groupBy("item_id", "context").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.col("weight").cast("int").cast("string").alias("w")))).alias("m"))
    v = m.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("context", "m"))).alias("v"))
    return v.select("item_id", F.explode(G.clean_vectors(F.col("v"), I.VECTOR_CONTEXTS)).alias("context", "m")).select("item_id", "context", F.explode("m").alias("tag", "weight"))


@query("repair_semantics", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS m1, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS m2 FROM part")
def repair_semantics(spark, sf):
    a, b = G.repair_music(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.lit(None).cast("string"), F.array("p_name", F.upper("p_name"), "p_type"))
    return R(spark, sf, "part").select("p_partkey", a.alias("m1"), b.alias("m2"))


def _emb(spark, sf):
    return R(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


@query("knn_join", f"SELECT source, candidate, CAST(rnk AS INT) AS rnk FROM (SELECT a.vec_id AS source, b.vec_id AS candidate, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rnk FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) x WHERE rnk <= 10")
def knn_join(spark, sf):
    e = _emb(spark, sf)
    return S.knn_join(e, 10, queries=e.where("item_id % 20 = 0")).select("source", "candidate", "rnk")


@query("precompute_candidates", f"SELECT source, candidate, CAST(rnk AS INT) AS rnk FROM (SELECT a.vec_id AS source, b.vec_id AS candidate, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rnk FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) x WHERE rnk <= 300")
def precompute_candidates(spark, sf):
    return S.knn_join(_emb(spark, sf), 300).select("source", "candidate", "rnk")


@query("knn_join_hashed")
def knn_join_hashed(spark, sf):
    e = _emb(spark, sf)
    return S.knn_join_hashed(e, 10, queries=e.where("item_id % 20 = 0"), bits=5).select("source", "candidate", "rnk")


_NOW = "e AS (SELECT vec_id, CASE WHEN vec_id % 13 = 5 THEN list_reverse(embedding::DOUBLE[]) ELSE embedding::DOUBLE[] END AS v FROM embeddings WHERE vec_id % 17 <> 3)"


@query("refresh_neighbors", f"WITH {_NOW} SELECT source, candidate, CAST(rnk AS INT) AS rnk FROM (SELECT a.vec_id AS source, b.vec_id AS candidate, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rnk FROM e a JOIN e b ON a.vec_id <> b.vec_id) x WHERE rnk <= 10")
def refresh_neighbors(spark, sf):
    """Some items go, some are new and some get another vector; the lists that this changes take the place of the old ones."""
    e = _emb(spark, sf)
    old = e.where("item_id % 11 <> 7")
    now = e.where("item_id % 17 <> 3").withColumn("embedding", F.when(F.col("item_id") % 13 == 5, F.reverse("embedding")).otherwise(F.col("embedding")))
    lists = stage(S.knn_join(old, 10), "lists")
    part = S.refresh_neighbors(lists, now, now.where("item_id % 11 = 7 or item_id % 13 = 5").select("item_id"), old.where("item_id % 17 = 3").select("item_id"), 10)
    return B.replace_by_key(lists, stage(part, "slice"), ["source"]).where("candidate is not null").select("source", "candidate", "rnk")


_LABELS = "lab AS (SELECT label, k, avg(v) AS v FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS k FROM embeddings) x GROUP BY label, k), labels_ AS (SELECT label, list(round(v, 6) ORDER BY k) AS e FROM lab GROUP BY label)"


def _label_vectors(spark, sf):
    x = _emb(spark, sf).select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    return x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda z: z["v"]).alias("label_embedding"))


_ZERO = f"""{_LABELS}, dots AS (SELECT vec_id // 10 AS item_id, vec_id AS image_id, l.label, exp(round(list_dot_product(embedding::DOUBLE[], e), 9)) AS x FROM embeddings CROSS JOIN labels_ l),
shares AS (SELECT *, x / CAST(sum(CAST(x AS DECIMAL(30,15))) OVER (PARTITION BY image_id) AS DOUBLE) AS p FROM dots),
zero AS (SELECT item_id, label, round(CAST(sum(CAST(p AS DECIMAL(20,12))) AS DOUBLE) / count(*) * 100, 2) AS score FROM shares GROUP BY ALL)"""


@query("zero_shot_join", f"WITH {_ZERO} SELECT * FROM zero")
def zero_shot_join(spark, sf):
    """Ten images an item."""
    images = _emb(spark, sf).select(F.floor(F.col("item_id") / 10).alias("item_id"), F.col("item_id").alias("image_id"), "embedding")
    return S.zero_shot_join(images, _label_vectors(spark, sf))


#: Families, their styles, presentations and traits: mean vectors of slices of the embeddings.
_SLICES = [("family", None, "'f' || label % 3", None, "true"), ("style", "'f' || label % 3", "'s' || label", None, "true"), ("presentation", None, "'p' || label", "'g' || label % 4", "vec_id % 2 = 0"), ("trait", None, "'t' || label", "'h' || label % 6", "vec_id % 2 = 1")]


def _tree(select):
    return " UNION ALL ".join(select.format(branch=b, parent=p or "CAST(NULL AS {s})", label=n, group=g or "CAST(NULL AS {s})", where=w) for b, p, n, g, w in _SLICES)


_LABEL_TREE = "tree AS (" + _tree("SELECT '{branch}' AS branch, {parent} AS parent, {label} AS label, {group} AS grp, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS k FROM embeddings WHERE {where}").replace("{s}", "VARCHAR") + "), labels_ AS (SELECT branch, parent, label, grp, list(round(v, 6) ORDER BY k) AS e FROM (SELECT branch, parent, label, grp, k, avg(v) AS v FROM tree GROUP BY ALL) x GROUP BY ALL)"


def _label_tree(spark, sf):
    each = spark.sql(_tree("SELECT '{branch}' AS branch, {parent} AS parent, {label} AS label, {group} AS `group`, posexplode(embedding) AS (k, v) FROM {{e}} WHERE {where}").replace("{{e}}", "{e}").replace("{s}", "STRING"), e=R(spark, sf, "embeddings"))
    x = each.groupBy("branch", "parent", "label", "group", "k").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    return x.groupBy("branch", "parent", "label", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda z: z["v"]).alias("label_embedding"))


def _picked(branch: str, most: int, gap: float) -> str:
    """One branch's labels: the best of each group, up to a limit and a gap."""
    b = branch[0]
    return f"""{b}1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, grp ORDER BY exact DESC, label) AS k FROM scores WHERE branch = '{branch}') y WHERE k = 1),
{b}2 AS (SELECT *, row_number() OVER w AS rnk, CASE WHEN lag(score) OVER w - score > {gap} THEN 1 ELSE 0 END AS gap FROM {b}1 WINDOW w AS (PARTITION BY item_id ORDER BY exact DESC, label)),
{b}3 AS (SELECT item_id, string_agg(label, '|' ORDER BY rnk) AS labels FROM (SELECT *, sum(gap) OVER (PARTITION BY item_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS n FROM {b}2) x WHERE n = 0 AND rnk <= {most} GROUP BY item_id)"""


@query("image_label_profile", f"""WITH {_LABEL_TREE}, dots AS (SELECT vec_id // 10 AS item_id, vec_id AS image_id, branch, parent, labels_.label, grp, exp(round(list_dot_product(embedding::DOUBLE[], e), 9)) AS x FROM embeddings CROSS JOIN labels_),
shares AS (SELECT *, x / CAST(sum(CAST(x AS DECIMAL(30,15))) OVER (PARTITION BY image_id, branch, parent) AS DOUBLE) AS p FROM dots),
means AS (SELECT item_id, branch, parent, label, grp, CAST(sum(CAST(p AS DECIMAL(20,12))) AS DOUBLE) / count(*) AS m FROM shares GROUP BY ALL), scores AS (SELECT *, round(m, 9) AS exact, round(m * 100, 2) AS score FROM means),
family AS (SELECT item_id, label AS render_family FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY exact DESC, label) AS k FROM scores WHERE branch = 'family') x WHERE k = 1),
styles AS (SELECT s.item_id, max(CASE WHEN k = 1 THEN label END) AS a, max(CASE WHEN k = 2 THEN label END) AS b FROM (SELECT s.*, row_number() OVER (PARTITION BY s.item_id ORDER BY exact DESC, label) AS k FROM scores s JOIN family f ON s.item_id = f.item_id AND s.branch = 'style' AND parent = render_family) s GROUP BY s.item_id),
{_picked('presentation', 2, 1.6)}, {_picked('trait', 4, 1.2)}
SELECT f.item_id, render_family, coalesce(a, '') AS render_style_primary, coalesce(b, '') AS render_style_secondary, p3.labels AS presentation_style, t3.labels AS visual_traits FROM family f LEFT JOIN styles s ON s.item_id = f.item_id LEFT JOIN p3 ON p3.item_id = f.item_id LEFT JOIN t3 ON t3.item_id = f.item_id""")
def image_label_profile(spark, sf):
    """Ten images an item; lists of labels are joined to texts."""
    from tagloom.operators.images import image_label_profile

    images = _emb(spark, sf).select(F.floor(F.col("item_id") / 10).alias("item_id"), F.col("item_id").alias("image_id"), "embedding")
    got = image_label_profile(images, _label_tree(spark, sf))
    return got.withColumns({c: F.array_join(c, "|") for c in ("presentation_style", "visual_traits")})


def _pre(where=""):
    one = " UNION ALL ".join(f"SELECT {i} AS p, '{f}' AS bf, '{to}' AS cf, {w} AS w" for i, (fs, to, w) in enumerate(S.PREDICATES) for f in fs if not f.startswith("boost"))
    return f"""rules AS ({one}), pairs_ AS (SELECT a.item_id AS source, b.item_id AS candidate, r.p, max(r.w) AS w FROM rules r JOIN fx_list_tags a ON a.field = r.bf JOIN fx_list_tags b ON b.field = r.cf AND b.tag = a.tag AND b.item_id <> a.item_id {where} GROUP BY ALL),
hits AS (SELECT source, candidate, CAST(sum(w) AS BIGINT) AS hits FROM pairs_ GROUP BY ALL), ranked AS (SELECT h.*, row_number() OVER (PARTITION BY source ORDER BY hits DESC, recommendations_total DESC NULLS LAST, candidate) AS rnk FROM hits h JOIN fx_signals s ON s.item_id = candidate)"""


def _popularity(spark, sf):
    return I.signals(spark, sf).select(F.col("item_id").alias("candidate"), F.col("recommendations_total").alias("popularity"))


def _prescreened(spark, sf, k):
    return S.prescreen_candidates(I.list_tags(spark, sf), _popularity(spark, sf), k)


@query("prescreen_candidates", f"WITH {_pre()} SELECT source, candidate, hits, CAST(rnk AS INT) AS rnk FROM ranked WHERE rnk <= 450")
def prescreen_candidates(spark, sf):
    return _prescreened(spark, sf, 450)


@query("prescreen_topk", f"WITH {_pre()} SELECT source, candidate FROM ranked WHERE rnk <= 5")
def prescreen_topk(spark, sf):
    return _prescreened(spark, sf, 5).select("source", "candidate")


@query("retrieve_candidates")
def retrieve_candidates(spark, sf):
    lists = I.candidate_lists(spark, sf)
    pre = SharedLists(lists.members.where("source % 2 = 0"), lists.listed)
    e, items = _emb(spark, sf), I.axes(spark, sf).where("item_id % 29 <> 0").select("item_id")
    there = items.select(F.col("item_id").alias("candidate"), F.lit(True).alias("there")).distinct()

    def near(without):
        queries = e.join(without.select(F.col("source").alias("item_id")).hint("merge"), "item_id", "left_anti")
        return S.knn_join(e, 300, queries=queries)

    def screened(sources):
        return S.prescreen_candidates(I.list_tags(spark, sf), _popularity(spark, sf), 450, sources=sources, there=there)

    changed = I.signals(spark, sf).where("item_id % 3 = 0").select(F.col("item_id").alias("source"))
    return S.retrieve_candidates(pre, screened, near, 300, changed, items)


def _search_inputs(spark, sf):
    names = R(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    items = names.join(I.signals(spark, sf).select("item_id", "recommendations_total"), "item_id", "left")
    q = R(spark, sf, "part").select(F.substring_index("p_name", " ", 1).alias("q")).unionByName(R(spark, sf, "part").select(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("q"))).distinct()
    return q.withColumn("query_id", F.col("q")), items


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_RAW = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
_SEARCH = f"""q AS (SELECT DISTINCT q, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS nq FROM (SELECT split_part(p_name, ' ', 1) AS q FROM part UNION ALL SELECT upper(replace(p_name, ' ', '-')) FROM part) x),
n AS (SELECT DISTINCT p_name AS name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS nn FROM part), qt AS (SELECT *, {_TRI.format('nq')} AS tq, {_TRI.format(_RAW.format('q'))} AS rq FROM q), nt AS (SELECT *, {_TRI.format('nn')} AS tn, {_TRI.format(_RAW.format('name'))} AS rn FROM n),
s AS (SELECT q, name, nq, nn, len(list_intersect(tq, tn)) / CAST(len(tq) + len(tn) - len(list_intersect(tq, tn)) AS DOUBLE) AS sim, len(list_intersect(rq, rn)) / CAST(len(rq) + len(rn) - len(list_intersect(rq, rn)) AS DOUBLE) AS raw, list_has_all(string_split(nn, ' '), string_split(nq, ' ')) AS terms FROM qt, nt),
m AS (SELECT q AS query_id, p_partkey AS item_id, s.name, round(CASE WHEN nn = nq THEN 10000.0e0 ELSE 0 END + CASE WHEN starts_with(nn, nq) THEN 500.0e0 ELSE 0 END + CASE WHEN contains(nn, nq) THEN 250.0e0 ELSE 0 END + CASE WHEN terms THEN 120.0e0 ELSE 0 END + sim * 100.0e0 + raw * 40.0e0 - length(s.name) * 0.03e0 + ln(1 + recommendations_total) * 3.0e0, 6) AS score
 FROM s JOIN part ON p_name = s.name JOIN fx_signals g ON g.item_id = p_partkey WHERE contains(nn, nq) OR terms OR sim >= 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(name), lower(name), item_id) AS rnk FROM m WHERE score > 0)"""


@query("search_items", f"WITH {_SEARCH} SELECT query_id, item_id, name, score, CAST(rnk AS INT) AS rnk FROM r WHERE rnk <= 8")
def search_items(spark, sf):
    q, items = _search_inputs(spark, sf)
    return S.search_items(q, items, 8)


@query("search_topk", f"WITH {_SEARCH} SELECT query_id, item_id FROM r WHERE rnk <= 1")
def search_topk(spark, sf):
    q, items = _search_inputs(spark, sf)
    return S.search_items(q, items, 1).select("query_id", "item_id")


@query("resolve_titles", """WITH t AS (SELECT DISTINCT p_name AS title FROM part), i AS (SELECT s_suppkey AS item_id, p_name AS name FROM supplier JOIN part ON p_partkey = s_suppkey), m AS (SELECT title, item_id, name, row_number() OVER (PARTITION BY title ORDER BY (title = name) DESC, contains(title, name) OR contains(name, title) DESC, name, item_id) AS place FROM t JOIN i ON list_has_any(string_split(title, ' '), string_split(name, ' ')))
SELECT title, item_id, name, CAST(place AS INT) AS place FROM m WHERE place <= 10""")
def resolve_titles(spark, sf):
    p = R(spark, sf, "part")
    items = R(spark, sf, "supplier").join(p, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("item_id"), F.col("p_name").alias("name"))
    return S.resolve_titles(p.select(F.col("p_name").alias("title")).distinct(), items)


@query("connected_components", """WITH RECURSIVE s AS (SELECT source AS a, candidate AS b FROM fx_candidates UNION SELECT candidate, source FROM fx_candidates), reach(n, m) AS (SELECT a, a FROM s UNION SELECT s.b, r.m FROM reach r JOIN s ON s.a = r.n WHERE r.m < s.b) SELECT n AS node, min(m) AS component FROM reach GROUP BY n""")
def connected(spark, sf):
    return connected_components(I.candidates(spark, sf), "source", "candidate")


def _flat(df):
    return df.withColumns({c: F.array_join(c, "|") for c in ("member_tags", "anchor_tokens")})


@query("canon_v1")
def canon_v1(spark, sf):
    return _flat(C.canon_v1(I.raw_tags(spark, sf)))


@query("merge_surface_variants", f"WITH {GROUPS}, k AS (SELECT context, canon_tag AS norm, total_occurrences AS n, array_to_string(list_sort({tokens_sql('canon_tag')}), ' ') AS key, list_last({tokens_sql('canon_tag')}) AS head FROM groups_) SELECT context, norm, first_value(norm) OVER (PARTITION BY context, head, key ORDER BY n DESC, length(norm), norm) AS base FROM k")
def merge_surface_variants(spark, sf):
    return C.merge_surface_variants(C.collapse_normalized(I.raw_tags(spark, sf)).select("context", "norm", "n")).select("context", "norm", "base")


_WRAP = ", ".join(f"'{w}'" for w in __import__("tagloom.functions.profiles", fromlist=["V2"]).V2.wrappers)
_CORE = f"list_filter({tokens_sql('canon_tag')}, lambda t: t NOT IN ({_WRAP}))"


@query("canon_v2", f"""WITH {GROUPS}, c AS (SELECT *, CASE WHEN len({_CORE}) >= 2 THEN array_to_string({_CORE}, ' ') ELSE '' END AS core FROM groups_), big AS (SELECT context, core, sum(total_occurrences) AS t FROM c WHERE core <> '' GROUP BY context, core HAVING count(DISTINCT canon_tag) >= 2)
SELECT context, canon_tag, 'exact' AS pattern_type, total_occurrences FROM c WHERE NOT (member_count = 1 AND EXISTS (SELECT 1 FROM big WHERE big.context = c.context AND big.core = c.core)) UNION ALL SELECT context, core, 'concept_core', CAST(t AS INT) FROM big""")
def canon_v2(spark, sf):
    return C.canon_v2(_groups(spark, sf)).select("context", "canon_tag", "pattern_type", "total_occurrences")


def _letters(text):
    """An encoder that SQL can express: the fourth power of how often a text has each letter of a to z."""
    return F.transform(F.sequence(F.lit(97), F.lit(122)), lambda i: F.pow((F.length(text) - F.length(F.replace(text, F.chr(i), F.lit("")))).cast("double"), F.lit(4)))


@query("canon_v3", Q.CANON_V3)
def canon_v3(spark, sf):
    return _flat(C.canon_v3(_groups(spark, sf), _letters))


@query("canon_v4")
def canon_v4(spark, sf):
    return _flat(C.canon_v4(C.canon_v2(_groups(spark, sf))))


@query("canon_v5", Q.CANON_V5)
def canon_v5(spark, sf):
    return _flat(C.canon_v5(_groups(spark, sf), _letters))


@query("canon_v6", Q.CANON_V6)
def canon_v6(spark, sf):
    return _flat(C.canon_v6(_groups(spark, sf), _letters)).withColumns({"semantic_neighbors": F.array_join("semantic_neighbors", "|"), "family_confidence": F.round("family_confidence", 4)})


_BLOCK = f"""t AS (SELECT DISTINCT context, canon_tag, unnest({tokens_sql('canon_tag')}) AS token FROM groups_), d AS (SELECT context, token FROM t GROUP BY ALL HAVING count(*) BETWEEN 2 AND 200)"""


@query("blocked_self_join", f"WITH {GROUPS}, {_BLOCK} SELECT DISTINCT x.context, least(x.canon_tag, y.canon_tag) AS a, greatest(x.canon_tag, y.canon_tag) AS b FROM t x JOIN t y ON x.context = y.context AND x.token = y.token AND x.canon_tag < y.canon_tag JOIN d ON d.context = x.context AND d.token = x.token")
def blocked_self_join(spark, sf):
    from tagloom.functions.text import tokenize_tag

    g = _groups(spark, sf).withColumns({"rid": F.col("canon_tag"), "toks": tokenize_tag("canon_tag")})
    return C.blocked_self_join(g, 2, 200)


@query("similarity_theta_join", Q.SIMILAR)
def similarity_theta_join(spark, sf):
    from tagloom.functions.profiles import V5
    from tagloom.functions.text import normalize_tag

    rows = C.embedded(C.with_tokens(_groups(spark, sf), V5, False), normalize_tag("canon_tag"), _letters)
    names = rows.select("rid", "canon_tag")
    found = C.similar_pairs(C.blocked_self_join(rows), rows, 0.5, 0.3).join(names.toDF("a", "one"), "a").join(names.toDF("b", "two"), "b")
    return found.select("context", F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), F.round("sim", 6).alias("sim"))


@query("bucket_topk", f"WITH {GROUPS}, t AS (SELECT DISTINCT context, canon_tag, unnest({tokens_sql('canon_tag')}) AS token FROM groups_), f AS (SELECT context, token, count(*) AS df FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY df DESC, token) AS rnk FROM f) SELECT context, token, df, CAST(rnk AS INT) AS rnk FROM r WHERE rnk <= 10")
def bucket_topk(spark, sf):
    from tagloom.functions.text import tokenize_tag

    t = _groups(spark, sf).select("context", "canon_tag", F.explode(F.array_distinct(tokenize_tag("canon_tag"))).alias("token"))
    return C.bucket_topk(P.document_frequency(t, "canon_tag"), 10)


@query("neighbors_topk", f"SELECT source, candidate, CAST(rnk AS INT) AS rnk FROM (SELECT a.vec_id AS source, b.vec_id AS candidate, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rnk FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label) x WHERE rnk <= 5")
def neighbors_topk(spark, sf):
    return S.knn_join(_emb(spark, sf), 5, by="label").select("source", "candidate", "rnk")


@query("row_bucket_tokens", Q.ROW_BUCKETS)
def row_bucket_tokens(spark, sf):
    g = _groups(spark, sf)
    return C.row_bucket_tokens(g).join(g.select("canon_tag", F.xxhash64("context", "canon_tag").alias("rid")), "rid").select("context", "canon_tag", "token")


@query("family_anchor", Q.ANCHOR_OF_PREFIX)
def family_anchor(spark, sf):
    g = _groups(spark, sf)
    rows = g.withColumns({"rid": F.xxhash64("context", "canon_tag"), "component": F.substring("canon_tag", 1, 3)})
    return C.component_anchor(C.token_counts(g), rows)


@query("row_concrete_tokens", Q.CONCRETE)
def row_concrete_tokens(spark, sf):
    from tagloom.functions.profiles import V5

    return C.with_tokens(_groups(spark, sf), V5, True).select("context", "canon_tag", F.array_join("toks", "|").alias("tokens"))


@query("semantic_text", f"SELECT context, canon_tag, canon_tag || ' || ' || string_agg({norm_sql('tag')}, ' || ' ORDER BY tag) AS text FROM (SELECT *, row_number() OVER (PARTITION BY context, canon_tag ORDER BY tag) AS k FROM (SELECT context, tag, {norm_sql('tag')} AS canon_tag FROM fx_raw_tags) y WHERE tag <> canon_tag) x WHERE k <= 3 GROUP BY context, canon_tag")
def semantic_text(spark, sf):
    g = _groups(spark, sf)
    return g.where(F.size(F.filter("member_tags", lambda m: m != F.col("canon_tag"))) > 0).select("context", "canon_tag", C.semantic_text(3).alias("text"))


_MAP = f"mp AS (SELECT 'mechanics' AS context, tag AS norm_src, left(tag, 1) AS rep FROM (SELECT DISTINCT tag FROM fx_item_tags WHERE context = 'mechanics') x)"


def _mapping(spark, sf):
    from tagloom.functions.text import normalize_tag

    t = I.item_tags(spark, sf).where("context = 'mechanics'").select("tag").distinct()
    return t.select(F.lit("mechanics").alias("context"), normalize_tag("tag").alias("norm"), F.substring("tag", 1, 1).alias("rep"))


@query("canon_lookup_join", "SELECT item_id, context, CASE WHEN context = 'mechanics' THEN left(tag, 1) ELSE tag END AS tag, weight FROM fx_item_tags")
def canon_lookup_join(spark, sf):
    return C.canon_lookup_join(I.item_tags(spark, sf), _mapping(spark, sf)).select("item_id", "context", "tag", "weight")


@query("canonicalise_items", "SELECT item_id, context, CASE WHEN context = 'mechanics' THEN 'R' ELSE tag END AS tag, sum(weight) AS weight FROM fx_item_tags GROUP BY ALL")
def canonicalise_items(spark, sf):
    tags = I.item_tags(spark, sf)
    all_tags = tags.where("context = 'mechanics'").agg(F.array_sort(F.collect_set("tag")).alias("member_tags"))
    g = all_tags.select(F.lit("mechanics").alias("context"), F.lit("r").alias("canon_tag"), F.lit("R").alias("final_tag"), F.size("member_tags").alias("member_count"), F.lit(1).alias("total_occurrences"), "member_tags")
    return C.canonicalise_items(tags, g)


@query("member_group_join", f"WITH {GROUPS}, m AS (SELECT context, tag AS member, {norm_sql('tag')} AS canon_tag FROM fx_raw_tags) SELECT DISTINCT g.context, g.canon_tag, m.member FROM groups_ g LEFT JOIN m ON m.context = g.context AND m.canon_tag = g.canon_tag WHERE contains(g.canon_tag, 'bo') OR contains(m.member, 'bo')")
def member_group_join(spark, sf):
    g = _groups(spark, sf)
    m = g.select("context", "canon_tag", F.explode("member_tags").alias("member"))
    x = g.select("context", "canon_tag").join(m, ["context", "canon_tag"], "left")
    return x.where(F.contains("canon_tag", F.lit("bo")) | F.contains("member", F.lit("bo"))).dropDuplicates(["context", "canon_tag", "member"])


def _matched(spark, sf):
    tags, lists = I.item_tags(spark, sf), I.list_tags(spark, sf)
    return M.matched_tags_topk(I.candidate_lists(spark, sf), M.build_preferences(tags, lists), M.candidate_weights(tags, lists))


#: A user's requests; the last is for a tag that no item has.
_ASKED = [("mechanics", "1-URGENT", 30.0), ("mechanics", "2-HIGH", 20.0), ("narrative", "BUILDING", 25.0), ("vibe", "nothing", 40.0)]


@query("explain_match", f"""WITH {_PREFS}, {_OFFERS}, {_JOINED}, {_CONF}, {_SCORES}, mt AS (SELECT *, row_number() OVER (PARTITION BY source, candidate, context ORDER BY round(pref, 9) DESC, tag) AS k FROM joined WHERE kind <> 'genre'), f AS (SELECT source, candidate, context, tag, k FROM mt WHERE k <= CASE WHEN context IN ('identity', 'setting') THEN 4 ELSE 3 END),
b(context, tag, requested) AS (VALUES {', '.join(f"('{c}', '{t}', {w}e0)" for c, t, w in _ASKED)}), rise AS (SELECT * FROM (SELECT s.source, b.*, requested - coalesce(weight, 0) AS delta FROM (SELECT DISTINCT source FROM f) s CROSS JOIN b LEFT JOIN fx_item_tags i ON i.item_id = s.source AND i.context = b.context AND i.tag = b.tag) x WHERE delta > 1),
h AS (UNPIVOT (SELECT source, candidate, {', '.join(f'round(coalesce(o_{c}, 0), 9) AS {c}' for c in ['mechanics', 'narrative', 'vibe'])} FROM over_) ON mechanics, narrative, vibe INTO NAME context VALUE hit),
e AS (SELECT f.source, f.candidate, f.context, f.tag, requested, coalesce(hit, 0) AS hit, true AS exact, requested AS by_ FROM f JOIN rise r ON r.source = f.source AND r.context = f.context AND r.tag = f.tag LEFT JOIN h ON h.source = f.source AND h.candidate = f.candidate AND h.context = f.context
 UNION ALL SELECT f.source, f.candidate, f.context, f.tag, m.requested, hit, false, delta FROM f JOIN (SELECT source, context, max(requested) AS requested, max(delta) AS delta FROM rise GROUP BY ALL) m ON m.source = f.source AND m.context = f.context JOIN h ON h.source = f.source AND h.candidate = f.candidate AND h.context = f.context AND hit > 0 WHERE k = 1)
SELECT source, candidate, context, tag, requested, hit, exact FROM (SELECT *, row_number() OVER (PARTITION BY source, candidate ORDER BY exact DESC, by_ DESC, CASE WHEN exact THEN -hit END, context, tag) AS r FROM e) x WHERE r = 1""")
def explain_match(spark, sf):
    from tagloom.operators.views import asked_of, explain_lists

    tags, lists = I.item_tags(spark, sf), I.list_tags(spark, sf)
    asked = asked_of(I.candidate_lists(spark, sf).members.select("source"), spark.createDataFrame(_ASKED, "context string, tag string, requested double"), tags)
    limits = {c: M.MATCHED[c] for c in dict.fromkeys(c for c, *_ in _ASKED)}  # of the contexts of requests
    return explain_lists(I.candidate_lists(spark, sf), asked, M.build_preferences(tags, lists), M.candidate_weights(tags, lists), list(limits), limits)


@query("reason_chips", f"""WITH {_PREFS}, {_OFFERS}, {_JOINED}, mt AS (SELECT *, row_number() OVER (PARTITION BY source, candidate, context ORDER BY round(pref, 9) DESC, tag) AS k FROM joined WHERE kind <> 'genre'),
f AS (SELECT source, candidate, context, tag, k, count(*) OVER (PARTITION BY source, candidate, context) AS n FROM mt WHERE k <= CASE WHEN context IN ('identity', 'setting') THEN 4 ELSE 3 END),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, candidate ORDER BY o) AS r FROM (SELECT source, candidate, tag, min({{'c': context, 'k': k}}) AS o FROM f WHERE n >= 3 GROUP BY ALL) y) z WHERE r <= 5),
e AS (SELECT *, row_number() OVER (PARTITION BY source, candidate ORDER BY o) AS r FROM (SELECT source, candidate, tag, min({{'c': context, 'k': k}}) AS o FROM f GROUP BY ALL) y WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = y.source AND r.candidate = y.candidate AND r.tag = y.tag)),
p AS (SELECT DISTINCT source, candidate FROM f), s AS (SELECT source, candidate, string_agg(tag, '|' ORDER BY r) AS t FROM r GROUP BY ALL), o AS (SELECT source, candidate, string_agg(tag, '|' ORDER BY r) AS t FROM e WHERE r <= 4 GROUP BY ALL)
SELECT p.source, p.candidate, coalesce(s.t, '') AS reasons, coalesce(o.t, '') AS others FROM p LEFT JOIN s ON s.source = p.source AND s.candidate = p.candidate LEFT JOIN o ON o.source = p.source AND o.candidate = p.candidate""")
def reason_chips(spark, sf):
    from tagloom.operators.views import chips_of_rows as chips

    tags, lists = I.item_tags(spark, sf), I.list_tags(spark, sf)
    rows = M.matched_rows(I.candidate_lists(spark, sf), M.build_preferences(tags, lists), M.candidate_weights(tags, lists))
    return chips(rows, list(M.MATCHED)).withColumns({c: F.array_join(c, "|") for c in ("reasons", "others")})


from tagloom.operators.views import FEATURED  # noqa: E402

_FEATURED = ", ".join(f"({k + 1}, '{label}', '{context}', '{f}', {i}, {most})" for k, (label, context, fields, most) in enumerate(FEATURED) for i, f in enumerate(fields))


@query("featured_tag_groups", f"""WITH rules(place, label, context, field, part, most) AS (VALUES {_FEATURED}), t AS (SELECT item_id, field, tag, pos FROM fx_list_tags UNION ALL SELECT item_id, context, tag, pos FROM fx_ranked_tags),
o AS (SELECT item_id, place, label, r.context, most, tag, min({{'part': part, 'pos': pos}}) AS spot FROM t JOIN rules r ON r.field = t.field GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY item_id, place ORDER BY spot, tag) AS k FROM o)
SELECT item_id, place, label, context, string_agg(tag, '|' ORDER BY k) AS tags FROM k WHERE k <= most GROUP BY ALL""".replace("{{", "{").replace("}}", "}"))
def featured_tag_groups(spark, sf):
    from tagloom.operators.views import featured_tag_groups as featured

    tags = I.list_tags(spark, sf).select("item_id", "field", "tag", "pos").unionByName(I.ranked_tags(spark, sf).select("item_id", F.col("context").alias("field"), "tag", "pos"))
    return featured(tags).withColumn("tags", F.array_join("tags", "|"))


@query("item_profile", "SELECT p_partkey AS item_id, p_name AS name, p_type AS genre, count(*) AS n_tags FROM part JOIN fx_item_tags ON item_id = p_partkey GROUP BY ALL")
def item_profile(spark, sf):
    from tagloom.operators.views import item_profile as profile

    names = R(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    return profile(names, I.item_tags(spark, sf), I.list_tags(spark, sf)).select("item_id", "name", F.element_at("primary", 1).alias("genre"), F.size("vector_tags").cast("long").alias("n_tags"))


def _boosted(sql: str) -> str:
    """The scorer's expressions over preferences in which one tag has the place of all mechanics."""
    return re.sub(r"\b(joined|prefs|over_|tot|scored|final)\b", r"\1_b", sql)


_BOOSTED = f"prefs_b AS (SELECT item_id, kind, context, tag, pref FROM prefs WHERE context <> 'mechanics' UNION ALL SELECT DISTINCT item_id, 'vector', 'mechanics', '1-URGENT', 20.0e0/56*4 FROM fx_item_tags), {_boosted(_JOINED)}, {_boosted(_SCORES)}"
_FIRST = "SELECT source, candidate, CAST(rnk AS INT) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY total_score DESC, vector_score DESC, lower(name), candidate) AS rnk FROM {}) x WHERE rnk <= 5"


@query("boost_scenarios", f"WITH {_PREFS}, {_OFFERS}, {_JOINED}, {_CONF}, {_SCORES}, {_BOOSTED}, plain AS ({_FIRST.format('final')}), boosted AS ({_FIRST.format('final_b')}) SELECT coalesce(p.source, b.source) AS source, coalesce(p.candidate, b.candidate) AS candidate, p.rnk AS rnk_before, b.rnk AS rnk_after FROM plain p FULL JOIN boosted b ON b.source = p.source AND b.candidate = p.candidate")
def boost_scenarios(spark, sf):
    """The first candidates with and without one tag at 100."""
    args = (I.candidate_lists(spark, sf), I.item_tags(spark, sf), I.list_tags(spark, sf), I.axes(spark, sf), I.signals(spark, sf), R(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name")))
    plain = M.recommend_batch(*args, k=5, explained=False).select("source", "candidate", F.col("rnk").alias("rnk_before"))
    boosted = M.recommend_batch(*args, weights=M.Weights(boosts={"mechanics": {"1-URGENT": 100.0}}), k=5, explained=False).select("source", "candidate", F.col("rnk").alias("rnk_after"))
    return plain.join(boosted, ["source", "candidate"], "full")


_LISTS = "array_to_string(member_tags, '{0}') AS member_tags, pattern_type, array_to_string(anchor_tokens, '{0}') AS anchor_tokens"


@query("scan_group_csv", f"WITH {Q.FULL_GROUPS} SELECT context, canon_tag, final_tag, member_count, total_occurrences, {_LISTS.format('|')} FROM groups_")
def scan_group_csv(spark, sf):
    B.write_groups_csv(_groups(spark, sf), path := _fresh(spark, "groups"))
    return B.read_groups_csv(spark, path).withColumns({c: F.array_join(c, "|") for c in ("member_tags", "anchor_tokens")})


@query("sink_group_csv", f"WITH {Q.FULL_GROUPS} SELECT context, canon_tag, final_tag, CAST(member_count AS VARCHAR) AS member_count, CAST(total_occurrences AS VARCHAR) AS total_occurrences, {_LISTS.format(' | ')}, '0.5000' AS family_confidence FROM groups_")
def sink_group_csv(spark, sf):
    B.write_groups_csv(_groups(spark, sf).withColumn("family_confidence", F.lit(0.5)), path := _fresh(spark, "groups"))
    return spark.read.csv(path, header=True)


@query("groups_to_tables", f"WITH {Q.FULL_GROUPS} SELECT 'metadata' AS family, context, canon_tag, unnest(member_tags) AS member_tag FROM groups_")
def groups_to_tables(spark, sf):
    g, m = B.groups_to_tables(_groups(spark, sf))
    return g.select("group_id", "family", "context", "canon_tag").join(m, "group_id").drop("group_id")


@query("ranked_names", "SELECT p_partkey, p_name, CAST(row_number() OVER (PARTITION BY p_type ORDER BY trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), p_partkey) AS INT) AS rnk FROM part")
def ranked_names(spark, sf):
    w = W.partitionBy("p_type").orderBy(norm_search_text("p_name"), "p_partkey")
    return R(spark, sf, "part").select("p_partkey", "p_name", F.row_number().over(w).alias("rnk"))
