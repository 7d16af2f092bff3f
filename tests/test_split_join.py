"""Joins on hub keys give the rows of a plain join, in slices of bounded size."""

import math

from pyspark.sql import functions as F

from standout.operators import graph


def test_hub_rows_equal_those_of_a_plain_join(spark):
    left = spark.range(900).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("doc"))
    left = left.unionByName(left.limit(40)).unionByName(spark.createDataFrame([(None, 1)], left.schema))
    right = spark.range(400).select(F.when(F.col("id") % 2 > 0, 1).otherwise(F.col("id") % 60).alias("k"), F.col("id").alias("src"))
    got = graph.split_join(left, right, "k", "doc", "src", most=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_relatedness_of_hubs_against_sets(spark, monkeypatch):
    monkeypatch.setattr(graph.split_join, "__defaults__", (16,))
    arcs = [(s * 7 - 300, d) for d in range(12) for s in range(200) if (s * (d + 3)) % (d + 2) < 2]
    links = spark.createDataFrame(arcs, "src long, dst long")
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(12) if a != b], "a long, b long")
    into = {d: {s for s, x in arcs if x == d} for d in range(12)}
    for r in graph.relatedness(pairs, links).collect():
        x, y = into[r["a"]], into[r["b"]]
        top = math.log2(max(len(x), len(y))) - math.log2(max(len(x & y), 1))
        small = max(1, min(len(x), len(y)))
        bottom = 0.001 if small == 5 else math.log2(5) - math.log2(small)
        assert abs(r["relatedness"] - top / bottom) < 1e-9
