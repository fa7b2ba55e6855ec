"""Registered queries of the scalar functions and of weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.functions import weights as V
from tagloom.functions.profiles import PROFILES, concept_core, semantic_tokens
from tagloom.operators import tables as B
from tagloom.operators.recommend import COMPONENTS, CONTEXTS, DEFAULT_PERCENT, SIGNALS, VECTOR
from tagloom.queries_reports import norm_sql, tokens_sql
from tagloom.registry import query
from tagloom.sources import inputs as I

R = I.read


def _tags(spark, sf):
    return I.raw_tags(spark, sf).select("context", "tag")


def _simple(name, fn, sql, source="raw", column="tag"):
    """A query that applies one column function to a text column of a table."""

    def run(spark, sf):
        if source == "raw":
            return _tags(spark, sf).select("context", "tag", fn(F.col("tag")).alias("out"))
        key = {"pages": "page_id", "documents": "doc_id"}[source]
        return R(spark, sf, source).select(key, fn(F.col(column)).alias("out"))

    if source == "raw":
        full = f"SELECT context, tag, {sql} AS out FROM fx_raw_tags"
    else:
        full = f"SELECT {({'pages': 'page_id', 'documents': 'doc_id'})[source]}, {sql} AS out FROM {source}"
    query(name, full)(run)


_simple("norm_search_text", X.norm_search_text, "trim(regexp_replace(lower(tag), '[^a-z0-9]+', ' ', 'g'))")
_simple("norm_title", X.norm_title, "trim(regexp_replace(lower(tag), '\\s+', ' ', 'g'))")
_simple("tokenize_tag", lambda c: F.array_join(X.tokenize_tag(c), "|"), f"array_to_string({tokens_sql('tag')}, '|')")
_simple("normalize_tag", X.normalize_tag, norm_sql("tag"))
_simple("format_display", X.format_display, norm_sql("tag"))
_simple("head_token", X.head_token, f"list_last({tokens_sql('tag')})")
_simple("label_norm", X.label_norm, "trim(regexp_replace(translate(lower(trim(tag)), '_-', '  '), '\\s+', ' ', 'g'))")
_simple("first_non_empty", lambda c: X.first_non_empty(F.when(F.length(c) % 2 == 0, " "), F.when(F.length(c) % 3 == 0, c), F.lit("last")), "CASE WHEN length(tag) % 3 = 0 THEN tag ELSE 'last' END")
_simple("collapse_ws", X.collapse_ws, "trim(regexp_replace(text, '\\s+', ' ', 'g'))", "documents", "text")
_simple("strip_query", X.strip_query, "regexp_replace(url, '\\?.*$', '')", "pages", "url")
_simple("directory_url", X.directory_url, "regexp_extract(regexp_replace(url, '\\?.*$', ''), '^(https?://[^/]+/(?:.*/)?)[^/]*$', 1)", "pages", "url")
_simple("app_root_url", lambda c: X.app_root_url(F.concat(c, F.lit("/apps/12/x"))), "regexp_extract(regexp_replace(url || '/apps/12/x', '\\?.*$', ''), '^(.*/apps/\\d+/)', 1)", "pages", "url")
_simple("strip_tags_text", lambda c: F.length(F.regexp_replace(c, "<[^>]*>", "")), "CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS INT)", "pages", "html")
_simple("split_people", lambda c: F.array_join(X.split_people(F.concat_ws(", ", c, F.upper(c), F.lit(" "), F.lit("Ann"))), "|"), "tag || '|Ann'")
_simple("coerce_weight", lambda c: X.coerce_weight(F.concat_ws(" ", F.lit("w"), F.length(c), F.lit("x"))), "CAST(length(tag) AS INT)")

_WRAP2 = ", ".join(f"'{w}'" for w in PROFILES["v2"].wrappers)
_SYN = "list_transform({}, lambda t: CASE t WHEN 'contemporary' THEN 'modern' WHEN 'current' THEN 'modern' WHEN 'futuristic' THEN 'future' ELSE t END)"
_CORE = f"list_filter({_SYN.format(tokens_sql('tag'))}, lambda t: t NOT IN ({_WRAP2}))"
_simple("concept_core", concept_core, f"CASE WHEN len({_CORE}) >= 2 THEN array_to_string({_CORE}, ' ') ELSE '' END")
_DROP5 = ", ".join(f"'{w}'" for w in [*PROFILES["v5"].wrappers, *PROFILES["v5"].generic])
_simple("semantic_tokens", lambda c: F.array_join(semantic_tokens(c, PROFILES["v5"]), "|"), f"array_to_string(list_filter({tokens_sql('tag')}, lambda t: t NOT IN ({_DROP5}) AND length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$')), '|')")


def _pairs(spark, sf):
    t = _tags(spark, sf)
    return t.select("context", F.col("tag").alias("a")).join(t.select("context", F.col("tag").alias("b")), "context").where("a < b and substring(a, 1, 2) = substring(b, 1, 2)")


_PAIRSQL = "FROM fx_raw_tags x JOIN fx_raw_tags y ON x.context = y.context AND x.tag < y.tag AND left(x.tag, 2) = left(y.tag, 2)"


@query("token_jaccard", f"SELECT context, a, b, round(CASE WHEN i + u = 0 THEN 0 ELSE i / CAST(u AS DOUBLE) END, 6) AS j FROM (SELECT x.context, x.tag AS a, y.tag AS b, len(list_intersect(list_distinct({tokens_sql('x.tag')}), {tokens_sql('y.tag')})) AS i, len(list_distinct(list_concat({tokens_sql('x.tag')}, {tokens_sql('y.tag')}))) AS u {_PAIRSQL}) z")
def token_jaccard(spark, sf):
    return _pairs(spark, sf).select("context", "a", "b", F.round(X.token_jaccard(X.tokenize_tag("a"), X.tokenize_tag("b")), 6).alias("j"))


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("trigram_similarity", f"SELECT context, a, b, round(i / CAST(p + q - i AS DOUBLE), 6) AS s FROM (SELECT x.context, x.tag AS a, y.tag AS b, len(list_intersect({_TRI.format('x.tag')}, {_TRI.format('y.tag')})) AS i, len({_TRI.format('x.tag')}) AS p, len({_TRI.format('y.tag')}) AS q {_PAIRSQL}) z")
def trigram_similarity(spark, sf):
    return _pairs(spark, sf).select("context", "a", "b", F.round(X.trigram_similarity("a", "b"), 6).alias("s"))


@query("all_terms_match", f"SELECT x.context, x.tag AS a, y.tag AS b, list_has_all(string_split(trim(regexp_replace(lower(y.tag), '[^a-z0-9]+', ' ', 'g')), ' '), string_split(trim(regexp_replace(lower(x.tag), '[^a-z0-9]+', ' ', 'g')), ' ')) AS m {_PAIRSQL}")
def all_terms_match(spark, sf):
    return _pairs(spark, sf).select("context", "a", "b", X.all_terms_match("a", "b").alias("m"))


@query("parse_owner_range", "SELECT item_id, CASE WHEN item_id % 7 = 0 THEN NULL WHEN item_id % 3 = 0 THEN owners ELSE (owners + owners + item_id) // 2 END AS owners FROM fx_signals")
def parse_owner_range(spark, sf):
    return I.owner_text(spark, sf).select("item_id", B.parse_owner_range("owners_text").alias("owners"))


@query("parse_release_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS b, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS c FROM orders")
def parse_release_date(spark, sf):
    d = lambda f: F.date_format("o_orderdate", f)
    s = lambda c: B.parse_release_date(c).cast("string")
    either = F.when(F.col("o_orderkey") % 2 == 0, d("MMM d, yyyy")).otherwise(d("d MMM, yyyy"))
    return R(spark, sf, "orders").select("o_orderkey", s(either).alias("a"), s(d("MMM yyyy")).alias("b"), s(d("yyyy")).alias("c"))


@query("parse_languages", "SELECT s_suppkey, lower(n_name) AS key, n_name AS name, s_suppkey % 2 = 0 AS audio, false AS subtitles FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT s_suppkey, 'x & y', 'X & Y', false, true FROM supplier")
def parse_languages(spark, sf):
    from tagloom.operators.ingest import parse_languages as parse

    star = F.when(F.col("s_suppkey") % 2 == 0, F.lit("<strong>*</strong>")).otherwise("")
    html = F.concat(F.col("n_name"), star, F.lit(", "), F.lower("n_name"), F.lit("<br>X &amp; Y (subtitles), "))
    rows = R(spark, sf, "supplier").join(R(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", html.alias("html"))
    return parse(rows, "s_suppkey", "html")


@query("clean_suggestions", "SELECT p_partkey AS k, p_partkey AS item_id, p_name || ' & co' AS name FROM part")
def clean_suggestions(spark, sf):
    from tagloom.operators.ingest import clean_suggestions as clean

    html = F.concat(F.lit('<div><a href="/app/'), F.col("p_partkey"), F.lit('/x" class="m"><b>'), F.col("p_name"), F.lit(" &amp; co</b></a> and <a href='/about'>other</a></div>"))
    return clean(R(spark, sf, "part").select(F.col("p_partkey").alias("k"), html.alias("html")), "k", "html")


@query("title_match_score", f"SELECT x.context, x.tag AS a, y.tag AS b, x.tag = y.tag AS exact, contains(x.tag, y.tag) OR contains(y.tag, x.tag) AS part {_PAIRSQL}")
def title_match_score(spark, sf):
    a, b = X.norm_title("a"), X.norm_title("b")
    return _pairs(spark, sf).select("context", "a", "b", (a == b).alias("exact"), (F.contains(a, b) | F.contains(b, a)).alias("part"))


@query("asset_candidates", "SELECT page_id, regexp_extract(regexp_replace(url, '\\?.*$', ''), '^(https?://[^/]+/(?:.*/)?)[^/]*$', 1) || f AS url, CAST(k - 1 AS INT) AS pos FROM pages, (VALUES ('header.jpg', 1), ('logo.png', 2), ('hero.jpg', 3)) v(f, k)")
def asset_candidates(spark, sf):
    names = F.array(*map(F.lit, ["header.jpg", "logo.png", "hero.jpg"]))
    urls = F.transform(names, lambda n: F.concat(X.directory_url("url"), n))
    return R(spark, sf, "pages").select("page_id", F.posexplode(urls).alias("pos", "url"))


@query("to_weights_equal", "SELECT item_id, tag, CAST(100 // n + CASE WHEN k <= 100 % n THEN 1 ELSE 0 END AS INT) AS weight FROM (SELECT item_id, tag, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY tag) AS k FROM fx_item_tags WHERE context = 'structure_loop') x")
def to_weights_equal(spark, sf):
    t = I.item_tags(spark, sf).where("context = 'structure_loop'").groupBy("item_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return t.select("item_id", F.explode(V.to_weights_equal(F.col("tags"))).alias("w")).select("item_id", "w.tag", "w.weight")


_S = "s AS (SELECT item_id, context, tag, weight, round(weight * 100.0e0 / CAST(sum(CAST(weight AS DECIMAL(20,12))) OVER (PARTITION BY item_id, context) AS DOUBLE), 9) AS p FROM fx_item_tags)"


@query("largest_remainder_100", f"WITH {_S}, r AS (SELECT *, 100 - sum(floor(p)) OVER (PARTITION BY item_id, context) AS rest, row_number() OVER (PARTITION BY item_id, context ORDER BY round(p - floor(p), 9) DESC, weight DESC, tag DESC) AS k FROM s), o AS (SELECT item_id, context, tag, CAST(floor(p) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS INT) AS points FROM r) SELECT * FROM o WHERE points > 0")
def largest_remainder_100(spark, sf):
    return V.largest_remainder_100(I.item_tags(spark, sf), ["item_id", "context"]).select("item_id", "context", "tag", "points")


@query("round_to_100", f"WITH {_S}, b AS (SELECT *, round_even(p, 0) AS b FROM s), d AS (SELECT *, 100 - sum(b) OVER (PARTITION BY item_id, context) AS d FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, context ORDER BY (p - b) * sign(d) DESC, tag) AS k FROM d) SELECT item_id, context, tag, CAST(b + CASE WHEN k <= abs(d) THEN sign(d) ELSE 0 END AS INT) AS points FROM r")
def round_to_100(spark, sf):
    return V.round_to_100(I.item_tags(spark, sf), ["item_id", "context"], "tag", "weight").select("item_id", "context", "tag", "points")


@query("rebalance_100", """WITH v AS (SELECT item_id, context, tag, greatest(weight + CASE WHEN length(tag) % 2 = 0 THEN 3.0e0 ELSE -2.0e0 END, 0.0e0) AS v FROM fx_item_tags), t AS (SELECT *, CAST(sum(CAST(v AS DECIMAL(20,12))) OVER (PARTITION BY item_id, context) AS DOUBLE) AS t FROM v),
p AS (SELECT *, CASE WHEN t > 0 THEN floor(round(v * 100.0e0 / t, 9) + 0.5e0) ELSE 0 END AS p FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, context ORDER BY p DESC, tag) AS k, 100 - sum(p) OVER (PARTITION BY item_id, context) AS d FROM p) SELECT item_id, context, tag, CAST(p + CASE WHEN k = 1 AND t > 0 THEN d ELSE 0 END AS INT) AS points FROM r""")
def rebalance_100(spark, sf):
    t = I.item_tags(spark, sf).withColumn("boost", F.when(F.length("tag") % 2 == 0, 3.0).otherwise(-2.0))
    return V.rebalance_100(t, ["item_id", "context"], "tag", "weight").select("item_id", "context", "tag", "points")


def _profiles(spark, sf, defaults):
    """A weights profile for each supplier: the defaults shifted by its nation's key; those of nation 0 have none."""
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("v"), F.lit(i).alias("i")) for i, (k, v) in enumerate(defaults.items()))))
    rows = R(spark, sf, "supplier").select(F.col("s_suppkey").alias("profile_id"), "s_nationkey", keys.alias("k"))
    return rows.select("profile_id", "k.key", F.when(F.col("s_nationkey") == 0, 0.0).otherwise(F.col("k.v") + F.col("s_nationkey") * F.col("k.i")).alias("value"))


_KV = lambda d: ", ".join(f"('{k}', {float(v)}e0, {i})" for i, (k, v) in enumerate(d.items()))
_PROF = f"prof AS (SELECT s_suppkey AS profile_id, key, CASE WHEN s_nationkey = 0 THEN 0.0e0 ELSE v + s_nationkey * i END AS value FROM supplier, (VALUES {_KV(DEFAULT_PERCENT)}) d(key, v, i))"


@query("group_multipliers", f"WITH {_PROF}, g AS (SELECT *, key IN ({', '.join(repr(c) for c in VECTOR)}) AS vec, sum(value) OVER (PARTITION BY profile_id, key IN ({', '.join(repr(c) for c in VECTOR)})) AS t FROM prof) SELECT profile_id, key, round(CASE WHEN t > 0 THEN value / t * CASE WHEN vec THEN {len(VECTOR)} ELSE {len(SIGNALS)} END ELSE CASE key {' '.join(f'WHEN {k!r} THEN {v}e0' for k, v in CONTEXTS.items())} END END, 6) AS multiplier FROM g")
def group_multipliers(spark, sf):
    return V.group_multipliers(_profiles(spark, sf, DEFAULT_PERCENT)).withColumn("multiplier", F.round("multiplier", 6))


_COMP = {k: v * 100 for k, v in COMPONENTS.items()}


@query("component_weights", f"WITH prof AS (SELECT s_suppkey AS profile_id, key, CASE WHEN s_nationkey = 0 THEN 0.0e0 ELSE v + s_nationkey * i END AS value FROM supplier, (VALUES {_KV(_COMP)}) d(key, v, i)), g AS (SELECT *, sum(value) OVER (PARTITION BY profile_id) AS t FROM prof) SELECT profile_id, key, round(CASE WHEN t > 0 THEN value / t ELSE CASE key {' '.join(f'WHEN {k!r} THEN {v}e0' for k, v in COMPONENTS.items())} END END, 6) AS share FROM g")
def component_weights(spark, sf):
    return V.component_weights(_profiles(spark, sf, _COMP)).withColumn("share", F.round("share", 6))


@query("intent_presets", f"WITH i(intent, key, delta) AS (VALUES {', '.join(f'({i!r}, {k!r}, {v}e0)' for i, s, k, v in V.intent_rows() if s == 'context')}), {_PROF} SELECT profile_id, n.intent, prof.key, value + coalesce(delta, 0) AS value FROM prof CROSS JOIN (SELECT DISTINCT intent FROM i) n LEFT JOIN i ON i.intent = n.intent AND i.key = prof.key")
def intent_presets(spark, sf):
    rows = spark.createDataFrame(V.intent_rows(), "intent string, scope string, key string, delta double").where("scope = 'context'").drop("scope")
    every = _profiles(spark, sf, DEFAULT_PERCENT).crossJoin(F.broadcast(rows.select("intent").distinct()))
    return every.join(F.broadcast(rows), ["intent", "key"], "left").select("profile_id", "intent", "key", (F.col("value") + F.coalesce("delta", F.lit(0.0))).alias("value"))


@query("review_relevance", "SELECT item_id, round(CASE WHEN positive + negative > 0 THEN 0.72e0 * (positive * 100.0e0 / (positive + negative)) + 28.0e0 * least(log10(review_count + 1) / 5.0e0, 1.0e0) END, 6) AS relevance FROM fx_signals")
def review_relevance(spark, sf):
    return I.signals(spark, sf).select("item_id", F.round(V.review_relevance(F.col("positive"), F.col("negative"), F.col("review_count")), 6).alias("relevance"))


@query("describe_mix", "SELECT item_id, context, tag, CASE WHEN p >= 45 THEN 'dominant' WHEN p >= 25 THEN 'strong' WHEN p >= 12 THEN 'supporting' ELSE 'light' END AS mix FROM (SELECT item_id, context, tag, round(100.0e0 * weight / sum(weight) OVER (PARTITION BY item_id, context), 6) AS p FROM fx_item_tags) x")
def describe_mix(spark, sf):
    from tagloom.operators.recommend import percent_breakdown

    return percent_breakdown(I.item_tags(spark, sf), ["item_id", "context"], "weight").select("item_id", "context", "tag", V.describe_mix(F.round("percent", 6)).alias("mix"))


@query("cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf):
    e = R(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return e.select(F.col("vec_id").alias("a"), "embedding").join(b, "a").select("a", "b", F.round(V.cosine(F.col("embedding"), F.col("eb")), 4).alias("cos"))


@query("parse_boosts", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'mechanics' END AS context, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || '=x' END AS tag, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN NULL ELSE greatest(p_size - 10.0e0, 0.0e0) END AS value, p_partkey % 4 > 1 AS ok FROM part")
def parse_boosts(spark, sf):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("mechanics:"), "p_name", F.lit("=x=bad"))).otherwise(F.concat(F.lit("mechanics:"), "p_name", F.lit("=x="), F.col("p_size") - 10))
    return V.parse_boosts(R(spark, sf, "part").select("p_partkey", text.alias("boost"))).drop("boost")


@query("weight_entries", "SELECT p_partkey, p_name AS tag, CAST(p_size AS VARCHAR) AS weight FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, unnest([p_name, p_type]), NULL FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, p_name, NULL FROM part WHERE p_partkey % 3 = 2")
def weight_entries(spark, sf):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.to_json(F.create_map("p_name", "p_size"))).when(k == 1, F.to_json(F.array("p_name", "p_type"))).otherwise(F.col("p_name"))
    return V.weight_entries(R(spark, sf, "part").select("p_partkey", raw.alias("raw"))).drop("raw")


@query("coerce_json_list", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '|' || p_type ELSE '' END AS out FROM part")
def coerce_json_list(spark, sf):
    from tagloom.operators.ingest import coerce_json_list as coerce

    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(k == 1, F.to_json(F.array("p_name", F.lit(" "), "p_type"))).otherwise(F.lit("[bad"))
    return R(spark, sf, "part").select("p_partkey", F.array_join(coerce(raw), "|").alias("out"))


@query("coerce_json_map", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM part")
def coerce_json_map(spark, sf):
    from tagloom.operators.ingest import coerce_json_map as coerce

    raw = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.create_map("p_name", "p_size"))).otherwise(F.lit("{bad"))
    return R(spark, sf, "part").select("p_partkey", F.size(coerce(raw)).alias("n"))
