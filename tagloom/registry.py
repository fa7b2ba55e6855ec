"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Derived inputs as SQL over the driver's tables; an oracle that names one gets it as a common table expression.
FIXTURES: dict[str, str] = {
    "fx_lines": """SELECT l_partkey AS item_id, o_orderpriority, c_mktsegment, l_returnflag || l_linestatus AS flag,
 n_name, r_name, l_quantity, l_returnflag, s_suppkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_item_tags": """SELECT item_id, 'mechanics' AS context, o_orderpriority AS tag, CAST(count(*) AS DOUBLE) AS weight FROM fx_lines GROUP BY item_id, o_orderpriority
UNION ALL SELECT item_id, 'narrative', c_mktsegment, CAST(count(*) AS DOUBLE) FROM fx_lines GROUP BY item_id, c_mktsegment
UNION ALL SELECT item_id, 'vibe', flag, CAST(count(*) AS DOUBLE) FROM fx_lines GROUP BY item_id, flag
UNION ALL SELECT item_id, 'structure_loop', n_name, CAST(count(*) AS DOUBLE) FROM fx_lines GROUP BY item_id, n_name""",
    "fx_ranked_tags": "SELECT item_id, context, tag, weight, CAST(row_number() OVER (PARTITION BY item_id, context ORDER BY weight DESC, tag) AS INT) AS pos FROM fx_item_tags",
    "fx_list_tags": """SELECT item_id, 'niche_anchors' AS field, tag, pos FROM fx_ranked_tags WHERE context = 'structure_loop' AND pos <= 3
UNION ALL SELECT item_id, 'identity_tags', tag, pos FROM fx_ranked_tags WHERE context = 'mechanics' AND pos <= 2
UNION ALL SELECT item_id, 'micro_tags', tag, pos FROM fx_ranked_tags WHERE context = 'vibe' AND pos <= 2
UNION ALL SELECT item_id, 'setting_tags', r_name, pos FROM (SELECT item_id, r_name, CAST(row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, r_name) AS INT) AS pos FROM fx_lines GROUP BY item_id, r_name) x WHERE pos <= 2
UNION ALL SELECT item_id, 'music_primary', tag, pos FROM fx_ranked_tags WHERE context = 'narrative' AND pos = 1
UNION ALL SELECT item_id, 'music_secondary', tag, pos FROM fx_ranked_tags WHERE context = 'narrative' AND pos = 2
UNION ALL SELECT p_partkey, 'signature_tag', p_name, 1 FROM part
UNION ALL SELECT p_partkey, 'genre.primary', p_type, 1 FROM part
UNION ALL SELECT p_partkey, 'genre.sub', p_brand, 1 FROM part
UNION ALL SELECT p_partkey, 'genre.sub_sub', p_name, 1 FROM part""",
    "fx_signals": """SELECT item_id, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS INT) AS positive,
 CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS negative,
 CAST(CASE WHEN item_id % 10 = 0 THEN 0 ELSE count(*) END AS INT) AS review_count,
 CAST(count(*) * 3 AS INT) AS recommendations_total,
 CAST(sum(l_quantity) AS BIGINT) AS owners, CAST(count(DISTINCT s_suppkey) AS INT) AS ccu FROM fx_lines GROUP BY item_id""",
    "fx_axes": """SELECT p_partkey AS item_id, CAST(p_size * 2 AS INT) AS challenge, CAST(p_partkey * 7 % 101 AS INT) AS complexity,
 CAST(p_partkey * 13 % 101 AS INT) AS pace, CAST(p_partkey * 29 % 101 AS INT) AS narrative_focus,
 CAST(p_partkey * 41 % 101 AS INT) AS social_energy, CAST(p_partkey * 53 % 101 AS INT) AS creativity FROM part""",
    "fx_reviews": """SELECT CAST(substr(source, 4) AS BIGINT) AS item_id, d.doc_id AS review_id, text,
 coalesce(toxic, 0) = 1 AS refunded, n_chars AS playtime_min FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id""",
    "fx_raw_tags": """SELECT context, tag, count(*) AS n FROM (
 SELECT CASE WHEN p_size <= 25 THEN 'niche_anchors' ELSE 'setting_tags' END AS context,
  CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' WHEN 2 THEN replace(p_name, ' ', '-')
   WHEN 3 THEN replace(p_name, ' ', '_') ELSE p_name || ' world' END AS tag FROM part) x GROUP BY context, tag""",
    "fx_owner_text": """SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'unknown' WHEN item_id % 3 = 0 THEN owners || ''
 ELSE owners || ' .. ' || (owners + item_id) END AS owners_text FROM fx_signals""",
    "fx_payload": """SELECT p_partkey AS item_id, '{"success":' || CASE WHEN p_partkey % 11 = 0 THEN 'false' ELSE 'true' END ||
 ',"data":{"name":"' || p_name || '","is_free":false,"release_date":{"date":"' ||
 CASE p_partkey % 5 WHEN 0 THEN 'Mar 5, 2019' WHEN 1 THEN '5 Mar, 2019' WHEN 2 THEN 'Mar 2019' WHEN 3 THEN '2019' ELSE 'soon' END ||
 '","coming_soon":false},"price_overview":{"final":' || p_size || '},"genres":[{"id":"1","description":"' || p_type ||
 '"},{"id":"2","description":"' || p_brand || '"},{"id":"3"}]}}' AS payload_json FROM part""",
    "fx_candidates": """SELECT source, candidate, rnk FROM (SELECT a.p_partkey AS source, b.p_partkey AS candidate,
 CAST(row_number() OVER (PARTITION BY a.p_partkey ORDER BY s.recommendations_total DESC, b.p_partkey) AS INT) AS rnk
 FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
 JOIN fx_signals s ON b.p_partkey = s.item_id) x WHERE rnk <= 300""",
}


def with_fixtures(sql: str) -> str:
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in FIXTURES and name not in need:
                visit(FIXTURES[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    sql = sql.strip()
    head = ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in need)
    recursive = bool(re.match(r"(?i)with\s+recursive\b", sql))
    own = re.sub(r"(?i)^with\s+(recursive\s+)?", "", sql) if re.match(r"(?i)with\b", sql) else None
    if not need:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}" + (f",\n{own}" if own is not None else f"\n{sql}")


def query(name: str, sql: str | None = None):
    """Registers a query under `name`, with its SQL where there is one."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_fixtures(sql)
        return f

    return wrap
