"""Hard negatives against brute force; toxicity on held-out rows and planted texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import hard_negatives, toxicity
from tagloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def plain_mining(rows, is_anchor, low=80, high=100, k=5):
    """The rows of `mine` by its docstring, in plain loops."""
    kept = {(i, y, tuple(math.floor(256 * c) for c in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, y, v in kept:
        if not is_anchor(i):
            continue
        positives = sorted(((-dot(v, w), j) for j, z, w in kept if z == y and j != i))[:k]
        for s, j in positives:
            s = -s
            near = sorted((-dot(v, w), n) for n, z, w in kept if z != y and low * s <= 100 * dot(v, w) <= high * s)[:k]
            out += [(i, j, r + 1, n, s, -t) for r, (t, n) in enumerate(near)]
    return sorted(out)


def test_packed_products_are_exact():
    r = np.random.default_rng(1)
    for d, most_a, most_c in [(64, 256, 256), (64, 256, 3), (1, 1, 1), (3, 0, 5), (64, 5000, 5000), (64, 10**6, 300), (64, 300, 10**6), (16, 10**7, 10**7), (7, 2**40, 3), (5, 0, 0)]:
        a, c = r.integers(-most_a, most_a + 1, (7, d)), r.integers(-most_c, most_c + 1, (11, d))
        assert hard_negatives.packed_products(a, c).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in c] for p in a]
    with pytest.raises(ValueError):
        hard_negatives.packed_products(np.full((1, 4), 2**31), np.full((1, 4), 2**31))


@pytest.mark.parametrize("block_rows", [None, 7])
def test_mining_equals_plain_loops_on_odd_rows(spark, block_rows):
    r = random.Random(3)
    vector = lambda: [r.choice([-0.5, -0.25, 0.0, 0.125, 0.3, 0.5]) for _ in range(4)]  # noqa: E731  many ties
    rows = [(i, r.randrange(3), vector()) for i in range(120)]
    rows += [rows[0], rows[10], (10, 1, [0.5, 0.5, 0.5, 0.5]), (None, 1, vector()), (200, None, vector()), (210, 1, None), (220, 1, [0.1, None, 0.2, 0.3]), (230, 2, [math.nan, 0.1, 0.1, 0.1]), (240, 2, [math.inf, 0.1, 0.1, 0.1]), (250, 0, [0.5, 0.5]), (260, 1, []), (270, 2, [30.0, -20.0, 10.0, 5.0])]
    frame = spark.createDataFrame([(*x, "k", 5) for x in rows], "vec_id long, label int, embedding array<float>, key string, score int").repartition(3)
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, block_rows=block_rows)
    rows = [(i, y, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, y, v in rows]
    assert sorted(map(tuple, got.collect())) == plain_mining(rows, lambda i: i % 10 == 0)


def test_mining_of_few_or_no_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(100, 1, [1.0, 0.0])], [(100, 1, [1.0]), (101, 1, [1.0])], [(100, None, None)]):
        assert hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).count() == 0
    one = hard_negatives.mine(spark.createDataFrame([(100, 1, [1.0]), (101, 1, [1.0]), (3, 2, [0.9]), (4, 2, [0.1])], schema), F.col("vec_id") % 100 == 0)
    assert [tuple(x) for x in one.collect()] == [(100, 101, 1, 3, 256 * 256, 256 * 230)]


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_toxicity_of_held_out_rows(spark):
    got = QUERIES["op13_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    hit, toxic, english = got.predicted == 1, got.toxic == 1, got.lang == "en"
    # 305 toxic texts to learn from, a third of them in three languages with marks of their own.
    assert (hit & toxic).sum() >= 0.75 * toxic.sum() and (hit & toxic).sum() >= 0.9 * hit.sum() and (hit & toxic & english).sum() >= 0.85 * (toxic & english).sum()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()


def test_toxicity_of_long_and_misspelt_texts(spark, model):
    clean = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("toxic = 0 and lang = 'en'").orderBy("doc_id").limit(60).collect()]
    long = " ".join(clean)
    half = long[: len(long) // 2]
    texts = [long, f"{half} you worthless idiot, {long[len(half) :]}", "such an idiiot", "what a stupidd cloown"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [x.score >= 0.7 for x in got] == [False, True, True, True]
    assert "idiot" in texts[1][got[1].worst_start : got[1].worst_end]


def test_toxicity_of_odd_rows(spark, model):
    texts = [None, "", " \n", "### !!!", "a", "x" * 50_000, "é𝄞 ß " * 40, "idiot", "idiot", "\x00 idiot \x00"]
    frame = spark.createDataFrame([(k if k != 7 else None, t, 0.3, "k") for k, t in enumerate(texts)], "doc_id long, text string, score double, `odd.name` string").repartition(2)
    got = {(x.doc_id, x.worst_end): x.score for x in toxicity.score(frame, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert got[(0, 0)] == got[(1, 0)] == got[(2, 0)] == got[(3, 0)] < 0.7 and got[(None, 5)] == got[(8, 5)] == got[(9, 7)] >= 0.7
    empty = frame.limit(0)
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(x.score == pytest.approx(0.2, abs=0.01) for x in toxicity.score(frame, blank).collect())


def test_a_words_vectors_are_near_those_of_its_misspellings(model):
    near = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    word = model.word_vector("pathetic")
    assert near(word, model.word_vector("pathettic")) > 0.8 and near(word, model.word_vector("pathettic")) > near(word, model.word_vector("the"))


def test_quality_keeps_columns_of_clashing_and_dotted_names(spark):
    from tagloom.llm import line_crf

    model = line_crf.LineCrf(np.zeros(3 * len(line_crf.OWN) + 3), np.zeros((2, 2)), np.zeros(2), (1.0, 0.0), 0.9)
    docs = spark.createDataFrame([(1, "", 5, "x"), (2, "a line", 6, "y")], "doc_id long, text string, _quality int, `a.b` string")
    got = line_crf.keep_good(docs, model, 0.7)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "", 5, "x")]
