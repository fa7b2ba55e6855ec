"""SQL of the tag-grouping stages over the test tables, for the registered queries.

The tables hold none of the two-word phrases of the profiles, so that their
synonyms and dropped words are all that is written here. The encoder of the
registered queries is the fourth power of the number of times a text has each letter.
"""

from __future__ import annotations

from tagloom.functions.profiles import V3, V5, V6, Profile
from tagloom.operators.canon import FAMILY_TAGS
from tagloom.queries_reports import norm_sql, tokens_sql

FULL_GROUPS = f"""groups_ AS (SELECT context, canon_tag, canon_tag AS final_tag, CAST(count(*) AS INT) AS member_count, CAST(sum(n) AS INT) AS total_occurrences, list_sort(list_distinct(list(tag))) AS member_tags, 'exact' AS pattern_type, [split_part(canon_tag, ' ', 1)] AS anchor_tokens
 FROM (SELECT context, tag, n, {norm_sql('tag')} AS canon_tag FROM fx_raw_tags) x GROUP BY context, canon_tag)"""


def semantic_sql(c: str, profile: Profile) -> str:
    drop = ", ".join(f"'{w}'" for w in [*profile.wrappers, *profile.generic])
    case = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in profile.synonyms.items()) + " ELSE t END"
    extra = f" AND length(t) >= {profile.least_length}" + ("" if profile.digits else " AND NOT regexp_matches(t, '^[0-9]+$')")
    return f"list_filter(list_transform({tokens_sql(c)}, lambda t: {case}), lambda t: t NOT IN ({drop}){extra})"


def letters_sql(text: str) -> str:
    return f"list_transform(range(97, 123), lambda i: CAST(length({text}) - length(replace({text}, chr(CAST(i AS INT)), '')) AS DOUBLE) ** 4)"


def text_sql(examples: int, full: bool) -> str:
    shown = f"list_transform(list_slice(list_filter(member_tags, lambda m: m <> canon_tag), 1, {examples}), lambda m: {norm_sql('m')})"
    parts = [f"[{norm_sql('canon_tag')}]", shown] + (["[array_to_string(anchor_tokens, ' ')]"] if full else [])
    return f"array_to_string(list_filter(flatten([{', '.join(parts)}]), lambda p: p <> ''), ' || ')"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {both} / CAST(len({a}) + len({b}) - {both} AS DOUBLE) ELSE 0.0e0 END"


def edges_sql(buckets: str, least: str, most: int, cosine: float, jaccard: float, rows: str = "rows_") -> str:
    """pairs_ of rows that share a token of `buckets`(context, rid, token) held by `least` to `most` rows, and edges_ that are alike."""
    sim = "round(list_cosine_similarity(r.e, s.e), 9)"
    return f"""d_ AS (SELECT context, token FROM {buckets} GROUP BY ALL HAVING count(*) BETWEEN {least} AND {most}),
pairs_ AS (SELECT DISTINCT x.context, x.rid AS a, y.rid AS b FROM {buckets} x JOIN d_ ON d_.context = x.context AND d_.token = x.token JOIN {buckets} y ON y.context = x.context AND y.token = x.token AND x.rid < y.rid),
edges_ AS (SELECT p.context, a, b, {sim} AS sim FROM pairs_ p JOIN {rows} r ON r.rid = a JOIN {rows} s ON s.rid = b WHERE {sim} >= {cosine} AND {jaccard_sql('r.toks', 's.toks')} >= {jaccard})"""


COMPONENTS = """both_ AS (SELECT a, b FROM edges_ UNION ALL SELECT b, a FROM edges_),
reach(n, m) AS (SELECT rid, rid FROM rows_ UNION SELECT b, m FROM reach JOIN both_ ON a = n),
comp_ AS (SELECT n AS rid, min(m) AS component FROM reach GROUP BY n),
x_ AS (SELECT r.*, component, count(*) OVER (PARTITION BY r.context, component) AS size FROM rows_ r JOIN comp_ ON comp_.rid = r.rid)"""
_ANCHORS = """held_ AS (SELECT DISTINCT context, component, rid, unnest(toks) AS token FROM x_),
anchors_ AS (SELECT context, component, list(token ORDER BY token) AS anchors FROM (SELECT context, component, token FROM held_ GROUP BY ALL HAVING count(*) >= 2) y GROUP BY ALL)"""
_LEAVES = "CASE WHEN len(member_tags) > 0 THEN member_tags ELSE [canon_tag] END"
_LETTERS_OF_TAG = letters_sql("text")
_RID = "context || chr(31) || canon_tag AS rid"


def _rows(toks: str, text: str, where: str = "") -> str:
    return f"rows_ AS (SELECT *, {_LETTERS_OF_TAG} AS e FROM (SELECT *, {_RID}, list_sort(list_distinct({toks})) AS toks, {text} AS text FROM groups_ {where}) y)"


def _merged(pattern: str) -> str:
    """Rows that stay and the merged ones of accepted_(context, component, anchors, ...)."""
    columns = "context, canon_tag, final_tag, member_count, total_occurrences, array_to_string(member_tags, '|') AS member_tags, pattern_type, array_to_string(anchor_tokens, '|') AS anchor_tokens"
    return f"""SELECT {columns} FROM groups_ g WHERE NOT EXISTS (SELECT 1 FROM accepted_ a WHERE a.context = g.context AND a.canon_tag = g.canon_tag)
UNION ALL SELECT context, canon_tag, '' AS final_tag, CAST(len(m) AS INT), total_occurrences, array_to_string(m, '|'), '{pattern}', array_to_string(anchors, '|') FROM (
 SELECT context, component, list(canon_tag ORDER BY total_occurrences DESC, member_count DESC, length(canon_tag), lower(canon_tag), canon_tag)[1] AS canon_tag, CAST(sum(total_occurrences) AS INT) AS total_occurrences,
 list_sort(list_distinct(flatten(list({_LEAVES})))) AS m, any_value(anchors) AS anchors FROM accepted_ GROUP BY context, component) z"""


_TOKENS = "t_ AS (SELECT DISTINCT context, rid, unnest(toks) AS token FROM rows_)"
SIMILAR = f"WITH {FULL_GROUPS}, {_rows(semantic_sql('canon_tag', V5), norm_sql('canon_tag'))}, {_TOKENS}, {edges_sql('t_', '2', 200, 0.5, 0.3)} SELECT context, least(split_part(a, chr(31), 2), split_part(b, chr(31), 2)) AS a, greatest(split_part(a, chr(31), 2), split_part(b, chr(31), 2)) AS b, round(sim, 6) AS sim FROM edges_"
CANON_V3 = f"""WITH RECURSIVE {FULL_GROUPS}, {_rows(semantic_sql('canon_tag', V3), norm_sql('canon_tag'), "WHERE context NOT IN ('music_primary', 'music_secondary')")}, {_TOKENS}, {edges_sql('t_', '2', 200, 0.74, 0.5)}, {COMPONENTS}, {_ANCHORS},
accepted_ AS (SELECT x_.*, coalesce(anchors, []) AS anchors FROM x_ LEFT JOIN anchors_ ON anchors_.context = x_.context AND anchors_.component = x_.component WHERE size BETWEEN 2 AND 25 AND (size < 6 OR len(coalesce(anchors, [])) >= 2))
{_merged('semantic_bucket')}"""
_LEAF_TOKENS = f"flatten([{semantic_sql('canon_tag', V5)}, flatten(list_transform(member_tags, lambda m: {semantic_sql('m', V5)}))])"
CANON_V5 = f"""WITH RECURSIVE {FULL_GROUPS}, {_rows(_LEAF_TOKENS, text_sql(3, False))}, {_TOKENS}, {edges_sql('t_', "CASE context WHEN 'narrative' THEN 3 WHEN 'setting_tags' THEN 3 WHEN 'signature_tag' THEN 4 ELSE 2 END", 120, 0.79, 0.22)}, {COMPONENTS}, {_ANCHORS},
alike_ AS (SELECT a.context, a.component, CAST(sum(CAST({jaccard_sql('a.toks', 'b.toks')} AS DECIMAL(20,12))) AS DOUBLE) / count(*) AS j FROM x_ a JOIN x_ b ON a.context = b.context AND a.component = b.component AND a.rid < b.rid GROUP BY ALL),
cover_ AS (SELECT context, component, max(n) AS most FROM (SELECT context, component, token, count(*) AS n FROM held_ GROUP BY ALL) y GROUP BY ALL),
total_ AS (SELECT context, component, any_value(size) AS size, len(list_distinct(flatten(list({_LEAVES})))) AS total FROM x_ WHERE size >= 2 GROUP BY ALL),
good_ AS (SELECT t.context, t.component FROM total_ t JOIN alike_ a ON a.context = t.context AND a.component = t.component JOIN cover_ c ON c.context = t.context AND c.component = t.component WHERE j >= 0.22 AND most / CAST(size AS DOUBLE) >= 0.6 AND total <= 64),
accepted_ AS (SELECT x_.*, coalesce(anchors, []) AS anchors FROM x_ JOIN good_ ON good_.context = x_.context AND good_.component = x_.component LEFT JOIN anchors_ ON anchors_.context = x_.context AND anchors_.component = x_.component)
{_merged('v5_semantic')}"""
_V6_OF = f"flatten([flatten(list_transform(flatten([[canon_tag, final_tag], member_tags]), lambda m: list_distinct({semantic_sql('m', V6)}))), anchor_tokens])"
COUNTS = f"counts_ AS (SELECT context, rid, token, count(*) AS n FROM (SELECT context, {_RID}, unnest({_V6_OF}) AS token FROM groups_) y GROUP BY ALL)"
BUCKETS = f"""best_ AS (SELECT context, rid, token FROM (SELECT *, row_number() OVER (PARTITION BY context, rid ORDER BY n DESC, token) AS k FROM counts_ WHERE n >= 2) y WHERE k <= 3),
buckets_ AS (SELECT * FROM best_ UNION ALL SELECT context, rid, unnest(list_distinct(list_slice(CASE WHEN len(anchor_tokens) > 0 THEN anchor_tokens ELSE {semantic_sql('canon_tag', V6)} END, 1, 3))) FROM (SELECT *, {_RID} FROM groups_) g WHERE rid NOT IN (SELECT rid FROM best_))"""
_ANCHOR = f"""sums_ AS (SELECT x_.context, component, token, sum(n) AS n FROM counts_ JOIN x_ ON x_.rid = counts_.rid GROUP BY ALL HAVING sum(n) >= 2),
lead_ AS (SELECT context, component, list(token ORDER BY n DESC, token)[1] AS anchor FROM sums_ GROUP BY ALL),
first_ AS (SELECT context, component, list(anchor_tokens[1] ORDER BY canon_tag)[1] AS a1, list({semantic_sql('canon_tag', V6)}[1] ORDER BY canon_tag)[1] AS t1 FROM x_ GROUP BY ALL),
anchor_ AS (SELECT f.context, f.component, coalesce(anchor, a1, t1, '') AS anchor FROM first_ f LEFT JOIN lead_ l ON l.context = f.context AND l.component = f.component)"""
ROW_BUCKETS = f"WITH {FULL_GROUPS}, {COUNTS}, {BUCKETS} SELECT context, split_part(rid, chr(31), 2) AS canon_tag, token FROM buckets_"
ANCHOR_OF_PREFIX = f"WITH {FULL_GROUPS}, {COUNTS}, x_ AS (SELECT *, {_RID}, substr(canon_tag, 1, 3) AS component FROM groups_), {_ANCHOR} SELECT context, component, anchor FROM anchor_"
CONCRETE = f"WITH {FULL_GROUPS} SELECT context, canon_tag, array_to_string(list_sort(list_distinct({_LEAF_TOKENS})), '|') AS tokens FROM groups_"
_FAMILY = "CASE anchor " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FAMILY_TAGS.items()) + f" ELSE {norm_sql('anchor')} END"
CANON_V6 = f"""WITH RECURSIVE {FULL_GROUPS}, {COUNTS}, {BUCKETS}, rows_ AS (SELECT g.*, {_LETTERS_OF_TAG} AS e, coalesce(b.toks, []) AS toks FROM (SELECT *, {_RID}, {text_sql(4, True)} AS text FROM groups_) g LEFT JOIN (SELECT rid, list(token ORDER BY token) AS toks FROM counts_ GROUP BY rid) b ON b.rid = g.rid),
{edges_sql('buckets_', '2', 160, 0.68, 1e-12)}, {COMPONENTS}, {_ANCHOR},
sub_ AS (SELECT context, component, list(canon_tag ORDER BY total_occurrences DESC, member_count DESC, len({semantic_sql('canon_tag', V6)}), length(canon_tag), lower(canon_tag), canon_tag)[1] AS subfamily_tag FROM x_ GROUP BY ALL),
sure_ AS (SELECT e.context, component, max(sim) AS confidence FROM edges_ e JOIN x_ ON x_.rid = a GROUP BY ALL),
near_ AS (SELECT rid, string_agg(name, '|' ORDER BY k) AS names FROM (SELECT o.rid, x_.canon_tag AS name, row_number() OVER (PARTITION BY o.rid ORDER BY sim DESC, lower(x_.canon_tag), x_.canon_tag) AS k FROM (SELECT a AS rid, b AS other, sim FROM edges_ UNION ALL SELECT b, a, sim FROM edges_) o JOIN x_ ON x_.rid = other) y WHERE k <= 5 GROUP BY rid)
SELECT x_.context, canon_tag, final_tag, member_count, total_occurrences, array_to_string(member_tags, '|') AS member_tags, pattern_type, array_to_string(anchor_tokens, '|') AS anchor_tokens, anchor AS family_anchor, {_FAMILY} AS family_tag, subfamily_tag, round(coalesce(confidence, 0.0e0), 4) AS family_confidence, coalesce(names, '') AS semantic_neighbors
FROM x_ JOIN anchor_ ON anchor_.context = x_.context AND anchor_.component = x_.component JOIN sub_ ON sub_.context = x_.context AND sub_.component = x_.component LEFT JOIN sure_ ON sure_.context = x_.context AND sure_.component = x_.component LEFT JOIN near_ ON near_.rid = x_.rid"""
