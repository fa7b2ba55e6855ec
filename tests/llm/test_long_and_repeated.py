"""Every corpus operator on texts of a megabyte and on a row that is there thousands of times."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import chat, decontaminate, jaccard_join, language_id, line_crf, media, packing, pii, token_counts
from tagloom.llm.tokens import piece_tokenizer, vocabulary, word_tokenizer

SF = "/root/testdata/sf0.001"
COPIES = 3000


def _texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    prose = " ".join(rng.choice(words) for _ in range(190_000))
    run = "".join(rng.choice("abcdefghij0123456789") for _ in range(1_000_000))
    lines = "\n".join(" ".join(rng.choice(words) for _ in range(6)) for _ in range(25_000))
    wide = "".join(rng.choice("é𝄞ß한 ") for _ in range(300_000))
    return {1: prose, 2: run, 3: lines, 4: wide, 5: "A short text that many rows share, word for word."}


TEXTS = _texts()


@pytest.fixture(scope="module")
def table(spark):
    """The long texts, and one row `COPIES` times."""
    df = spark.createDataFrame([(k, t) for k, t in TEXTS.items() if k != 5], "doc_id long, text string")
    many = spark.range(COPIES).select(F.lit(5).cast("long").alias("doc_id"), F.lit(TEXTS[5]).alias("text"))
    return df.unionByName(many).repartition(4)


@pytest.fixture(autouse=True)
def in_time():
    start = time.monotonic()
    yield
    assert time.monotonic() - start < 120


def test_language(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(table, language_id.train(docs)).groupBy("doc_id", "lang_pred").count().collect()
    assert {(r.doc_id, r["count"]) for r in rows} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, COPIES)} and all(r.lang_pred != "und" for r in rows)
    learned = language_id.train(table.withColumn("lang", F.when(F.col("doc_id") == 5, "xx").otherwise("yy")), sample_chars=2_000_000)
    assert set(learned.languages) <= {"xx", "yy"}


def test_chat_of_many_turns(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} <|im_end|>") for k in range(300)]
    rows += [(2, 0, "user", TEXTS[1]), (2, 1, "assistant", TEXTS[2])] + [(3, 0, "assistant", "same")] * 200
    got = {r.conv_id: r for r in chat.digests(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2, 3):
        turns = [(r, t) for i, _, r, t in rows if i == c]
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()


def test_pii(spark, table):
    marked = " ".join(f"u{k}@host{k % 50}.org {w}" for k, w in enumerate(TEXTS[1].split()[:20_000])) + " Mr John Smith. " + "Smith " * 5000
    df = table.unionByName(spark.createDataFrame([(6, marked)], "doc_id long, text string"))
    out = pii.replace_pii(df, "k", counted=True)
    rows = {r.doc_id: r for r in out.where("doc_id <> 5").collect()}
    assert rows[1].text == TEXTS[1] and rows[3].text == TEXTS[3]
    assert rows[6].n_email == 20_000 and rows[6].n_name == 5002 and "Smith" not in rows[6].text and len(set(re.findall(r"\S+@\S+", rows[6].text))) == 20_000
    assert out.where("doc_id = 5").groupBy("text").count().collect()[0]["count"] == COPIES


def test_near_duplicates(spark, table):
    near = TEXTS[1].split()
    near[5000] = "changed"
    df = table.unionByName(spark.createDataFrame([(7, " ".join(near))], "doc_id long, text string"))
    rows = jaccard_join.near_duplicates(df).groupBy("doc_id", "component_id", "n_links", "n_shingles").count().collect()
    got = {r.doc_id: (r.component_id, r.n_links, r["count"]) for r in rows}
    assert got == {1: (1, 1, 1), 7: (1, 1, 1), 2: (2, 0, 1), 3: (3, 0, 1), 4: (4, 0, 1), 5: (5, COPIES - 1, COPIES)}
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", TEXTS[1])]
    assert next(r.n_shingles for r in rows if r.doc_id == 1) == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})


def test_quality(spark, table):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = line_crf.train(docs, labels)
    rows = line_crf.score_slim(table, model).groupBy("doc_id", "score").count().collect()
    assert {(r.doc_id, r["count"]) for r in rows} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, COPIES)} and all(0 <= r.score <= 1 for r in rows)
    line_crf.train(table, spark.createDataFrame([(5, 1), (1, 0)], "doc_id long, quality int"), sample_chars=2_000_000)


def test_packing(table):
    tok = word_tokenizer(vocabulary("word_bpe_49k.json"))
    got = packing.pack(table).toPandas()
    for k, t in TEXTS.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == k].sort_values("start")
        want = [(s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]
        assert list(zip(mine.start, mine.length, mine.ids_crc32, strict=True)) == [x for x in want for _ in range(COPIES if k == 5 else 1)]
    size = got.sort_values(["sequence_id", "offset"])
    assert (size.groupby("sequence_id").length.cumsum() - size.length == size.offset).all() and size.groupby("sequence_id").length.sum().max() <= 2048


def test_media(table):
    rows = media.read_stored(media.store_texts(table)).groupBy("doc_id", "n_bytes", "payload_sha256").count().collect()
    want = set()
    for k, t in TEXTS.items():
        b = t.encode()
        want.add((k, len(b), hashlib.sha256(b + bytes(-len(b) % 64 if b else 64)).hexdigest(), COPIES if k == 5 else 1))
    assert {(r.doc_id, r.n_bytes, r.payload_sha256, r["count"]) for r in rows} == want


def test_decontamination(spark, table):
    rng = random.Random(3)
    item = "".join(rng.choice("qwertyuiopasdfghjkl ") for _ in range(150))
    planted = TEXTS[1][:700_000] + " " + item + " " + TEXTS[1][700_000:]
    df = table.unionByName(spark.createDataFrame([(8, planted), (9, (item + " ") * 3000)], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item), (2, item), (3, TEXTS[5])], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.benchmark_matches(df, bench).collect()}
    assert set(rows) == {(8, 1), (8, 2), (9, 1), (9, 2), (5, 3)}
    assert planted[rows[8, 1].start : rows[8, 1].stop].strip() == item.strip() and rows[8, 1].edits == 0
    assert decontaminate.drop_contaminated(df, bench).count() == 4


def test_token_counts(table):
    model = piece_tokenizer(vocabulary("piece_bpe_32k.model"))
    rows = {(r.doc_id, r.n_bytes, r.n_tokens): r["count"] for r in token_counts.token_counts(table).groupBy("doc_id", "n_bytes", "n_tokens").count().collect()}
    assert rows == {(k, len(t.encode()), len(model.encode(t))): COPIES if k == 5 else 1 for k, t in TEXTS.items()}
