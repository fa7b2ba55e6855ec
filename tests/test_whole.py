"""Queries that once left out part of their work."""

from pyspark.sql import functions as F

from tagloom.all_queries import QUERIES
from tagloom.operators.ingest import clean_vectors
from tagloom.sources import inputs as I

SF = "/root/testdata/sf0.001"


def test_clean_vectors_cleans_all_contexts_and_weights(spark):
    got = QUERIES["clean_vectors"](spark, SF)
    want = I.item_tags(spark, SF).select("item_id", "context", "tag", F.col("weight").cast("int").alias("weight"))
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0
    assert {r.context for r in got.select("context").distinct().collect()} == set(I.VECTOR_CONTEXTS)
    odd = spark.createDataFrame([({"mechanics": {"a": "2", "b": "bad", "c": "0", "d": "-1"}, "region": {"e": "5"}},)], "v map<string,map<string,string>>")
    assert odd.select(clean_vectors(F.col("v"), I.VECTOR_CONTEXTS).alias("v")).first().v == {"mechanics": {"a": 2}}
