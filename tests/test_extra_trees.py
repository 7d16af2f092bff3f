"""Extremely randomised trees: every node is rebuilt from the rows."""

import math

import pytest
from pyspark.sql import functions as F

from standout.operators import extra_trees

NAMES = ["a", "b", "same"]


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for i in range(400):
        a, b = (i * 37 % 101) / 10, (i * 53 % 97) / 10
        made.append((i, i % 7, a, b, 4.0, math.floor(a) * 2 + 0.05 * b))
    return spark.createDataFrame(made, "doc_id long, entity_id long, a double, b double, same double, grade double")


def test_nodes_are_those_of_their_rows(rows):
    model = extra_trees.train_extra_trees(rows, NAMES, numTrees=4, maxDepth=4, featureShare=1.0, minInstancesPerNode=5, bootstrap=False)
    nodes = {(n["tree"], n["node"]): n for n in model.nodes.collect()}
    table = rows.collect()

    def check(tree, number, members):
        node = nodes.pop((tree, number))
        assert node["rows"] in (len(members), 0.0) and len(members) >= 5
        assert node["value"] == pytest.approx(sum(r["grade"] for r in members) / len(members))
        if node["feature"] < 0:
            return
        values = [r[NAMES[node["feature"]]] for r in members]
        assert min(values) <= node["threshold"] < max(values)
        sides = [[r for r, v in zip(members, values) if v <= node["threshold"]], [r for r, v in zip(members, values) if v > node["threshold"]]]

        def error(part):
            mean = sum(r["grade"] for r in part) / len(part)
            return sum((r["grade"] - mean) ** 2 for r in part)

        assert node["gain"] == pytest.approx(error(members) - sum(map(error, sides)), abs=1e-6)
        for side, part in enumerate(sides):
            check(tree, node["left"] + side, part)

    for tree in range(4):
        check(tree, 0, table)
    assert not nodes  # every node is reached


def test_planted_feature_first_and_saved(spark, rows, tmp_path):
    model = extra_trees.train_extra_trees(rows, NAMES, numTrees=10, maxDepth=6)
    ranked = {r["name"]: (r["rank"], r["importance"]) for r in model.importances().collect()}
    assert ranked["a"][0] == 1 and ranked["a"][1] > 0.8 and ranked["same"] == (3, 0.0)
    out = model.transform(rows)
    mean = rows.agg(F.avg("grade")).first()[0]
    errors = out.agg(F.avg((F.col("estimate") - F.col("grade")) ** 2), F.avg((F.col("grade") - mean) ** 2)).first()
    assert errors[0] < 0.2 * errors[1]
    model.save(str(tmp_path / "trees"))
    again = extra_trees.ExtraTrees.load(spark, str(tmp_path / "trees"))
    assert sorted(again.transform(rows).collect()) == sorted(out.collect())


def test_edges(spark, rows):
    empty = extra_trees.train_extra_trees(rows.limit(0), NAMES, numTrees=2, maxDepth=2)
    assert [r["estimate"] for r in empty.transform(rows.limit(2)).collect()] == [None, None]
    flat = extra_trees.train_extra_trees(rows.withColumn("grade", F.lit(2.0)), NAMES, numTrees=2, maxDepth=2)
    assert flat.nodes.count() == 2 and {r["estimate"] for r in flat.transform(rows).collect()} == {2.0}
    with pytest.raises(ValueError):
        extra_trees.train_extra_trees(rows, NAMES, numTrees=50, maxDepth=16)


def test_tasks_send_one_row_for_a_node_and_gaps_have_sides(spark, rows):
    model = extra_trees.train_extra_trees(rows, ["a"], numTrees=3, maxDepth=1)
    root = {n["tree"]: n for n in model.nodes.where("node = 0").collect()}
    leaves = {(n["tree"], n["node"]): n["value"] for n in model.nodes.collect()}
    odd = spark.createDataFrame([(1, None), (2, float("nan"))], "id int, a double")
    left, right = (r["estimate"] for r in model.transform(odd).orderBy("id").collect())
    assert left == pytest.approx(sum(leaves[t, root[t]["left"]] for t in root) / 3)
    assert right == pytest.approx(sum(leaves[t, root[t]["left"] + 1] for t in root) / 3)
    times = F.array(*[F.lit(k).cast("tinyint") for k in (1, 0, 2)])
    held = rows.select(F.col("a").alias("x0"), F.col("grade").alias("y"), F.lit(1).alias("key"), times.alias("times")).repartition(2)
    sums = extra_trees._node_sums(held, model.nodes.where("node = 0"), 1, 0)
    assert "Generate" not in sums._jdf.queryExecution().executedPlan().toString()
    found = {r["tree"]: r for r in sums.collect()}
    whole = rows.agg(F.sum("grade").alias("s"), F.min("a").alias("lo"), F.max("a").alias("hi")).first()
    assert {t: r["n"] for t, r in found.items()} == {0: 400.0, 2: 800.0} and found[2]["s"] == pytest.approx(2 * whole["s"])
    assert found[0]["ends"][0] == (whole["lo"], whole["hi"])
