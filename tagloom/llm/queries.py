"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import chat, decontaminate, hard_negatives, jaccard_join, language_id, line_crf, media, merkle, packing, pii, secrets, token_counts, toxicity
from tagloom.llm.tables import held_out, table
from tagloom.plans.staging import stage

#: The key of the registered query; a deployment passes its own.
PII_SECRET = "tagloom-example-key"


#: A conversation of control strings that op2 formats with the others.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in CONTROL_CONVERSATION)
    own = spark.sql(f"SELECT * FROM VALUES {rows} AS v(conv_id, turn, role, text)")
    return chat.digests(chat.expand(turns.unionByName(own)))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, PII_SECRET, counted=True)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score_slim(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_stored(stage(media.store_texts(table(spark, sf_dir, "documents")), "media"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    told = lambda text: merkle.row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(F.col("doc_id").alias("id"), "source", told(F.col("text")).alias("leaf"), F.when(tampered, told(lower)).alias("given"))
    return merkle.manifest(leaves).withColumnRenamed("id", "doc_id")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.toxic_held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "worst_start", "worst_end")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_bin_slack_packing": op6_bin_slack_packing,
    "op7_media_columns": op7_media_columns,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_toxicity": op13_toxicity,
}

_TOLD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_SIDES = """coalesce(string_agg(h, '') OVER (PARTITION BY {0} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (PARTITION BY {0} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"""

#: SQL for the rows of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op11_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) x WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
 FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5""",
    "op12_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT *, {_TOLD.format("doc_id")} || {_TOLD.format("source")} || {_TOLD.format("lang")} || {_TOLD.format("n_chars")} AS head, list_reduce(list_prepend(4294967295::UBIGINT, flatten([[256 + ascii(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda c, x: xor((CASE WHEN x > 0 THEN xor(c, x - 256) ELSE c END) >> 1, ((CASE WHEN x > 0 THEN xor(c, x - 256) ELSE c END) & 1) * 3988292384)) AS crc FROM documents),
leaf AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM (
  SELECT doc_id, source, sha256(head || {_TOLD.format("text")}) AS leaf, sha256(head || {_TOLD.format("CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS given FROM d) x),
nodes AS (SELECT source, 0 AS lvl, pos, leaf AS h, n FROM leaf UNION ALL SELECT source, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // 16),
steps AS (SELECT source, lvl, pos, {_SIDES.format("source, lvl, pos // 16")} FROM nodes WHERE n > 1),
folded AS (SELECT rid, source, 0 AS lvl, pos, given AS h, '' AS proof FROM leaf UNION ALL SELECT rid, f.source, f.lvl + 1, f.pos // 16, sha256(before || h || after), proof || before || after FROM folded f JOIN steps s ON f.source IS NOT DISTINCT FROM s.source AND f.lvl = s.lvl AND f.pos = s.pos),
subs AS (SELECT source, lvl AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM subs UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 15) // 16 FROM tops WHERE n > 1 GROUP BY lvl, pos // 16),
rises AS (SELECT lvl, pos, {_SIDES.format("lvl, pos // 16")} FROM tops WHERE n > 1),
upper AS (SELECT rid, 0 AS lvl, s.pos, f.h, f.proof, subroot FROM folded f JOIN subs s ON f.source IS NOT DISTINCT FROM s.source AND f.lvl = s.height UNION ALL SELECT rid, u.lvl + 1, u.pos // 16, sha256(before || h || after), proof || before || after, subroot FROM upper u JOIN rises r ON u.lvl = r.lvl AND u.pos = r.pos)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, u.h AS folded_root, u.h = t.h AS verified FROM leaf JOIN upper u ON leaf.rid = u.rid JOIN tops t ON t.n = 1 AND t.lvl = u.lvl""",
}
