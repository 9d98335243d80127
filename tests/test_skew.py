"""Joins with hot keys, and the sieve."""

from pyspark.sql import functions as F

from tallyweave import skew
from tallyweave.operators import graph


def test_salted_join_is_the_inner_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    monkeypatch.setattr(skew, "SHARES", 20)
    many = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 3 == 0).cast("int")).alias("k"), F.lit("x").alias("k2"), "id")
    one = spark.createDataFrame([(k, "x", k * 10) for k in range(5)] + [(0, "y", 1)], "k long, k2 string, v int")
    counts = many.groupBy("k", "k2").agg(F.count("*").alias("n"))
    assert skew.hot_keys(counts, ["k", "k2"])
    want = sorted(map(tuple, many.join(one, ["k", "k2"]).collect()))
    for parts in (None, 3):
        got = skew.salted_join(many, one, ["k", "k2"], ["id"], counts, parts)
        assert got.columns == ["k", "k2", "id", "v"] and sorted(map(tuple, got.collect())) == want
    assert skew.salted_join(many.limit(0), one, ["k", "k2"], ["id"]).count() == 0


def test_sieve_loses_nothing(spark):
    rows = spark.range(-50, 5000).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v"))
    ids = spark.createDataFrame([(k,) for k in range(-50, 5000, 97)], "i long")
    got = {r.k for r in skew.sieve(rows, "k", ids).collect()}
    assert {r.i for r in ids.collect()} <= got and len(got) < 2000
    assert skew.sieve(rows, "k", ids.limit(0)).count() == 0
