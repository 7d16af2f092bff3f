"""Written and re-read text formats, with lines that do not fit."""

from standout.sources import tables


def test_lines_that_do_not_fit_are_kept_as_they_are(spark, tmp_path):
    lines = ["1,2,3.0,0.5,[7, None]", "doc,entity,golden,estimate", "", "x,2,3,0.5,[1, 2]", "4,5,nan,None,[nan, 2]", "1,2,3.0,0.5,[7, 8, 9]"]
    path = str(tmp_path / "rows")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = {tuple(r) for r in tables.read_feature_rows(spark, path, ["a", "b"], corrupt="bad").collect()}
    sound = {(1, 2, 3.0, 0.5, 7.0, 0.0, None), (4, 5, 0.0, 0.0, 0.0, 2.0, None)}
    assert got == sound | {(None,) * 6 + (lines[i],) for i in (1, 2, 3, 5)}
    assert {tuple(r) + (None,) for r in tables.read_feature_rows(spark, path, ["a", "b"]).collect()} == sound


def test_judgements_and_runs_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, 3.0), (1, 8, 1.5), (2, 7, None)], "doc_id long, entity_id long, grade double")
    tables.write_qrels(rows.where("grade IS NOT NULL"), str(tmp_path / "qrels"))
    assert sorted(map(tuple, tables.read_qrels(spark, str(tmp_path / "qrels")).collect())) == [(1, 7, 3.0), (1, 8, 0.0)]
    tables.write_run(rows.withColumnRenamed("grade", "score"), str(tmp_path / "run"))
    spark.createDataFrame([("1 0 x",)], "value string").write.mode("append").text(str(tmp_path / "run"))
    got = tables.read_run(spark, str(tmp_path / "run"), corrupt="bad")
    assert {tuple(r) for r in got.collect()} == {(1, 7, 3.0, None), (1, 8, 1.5, None), (2, 7, 0.0, None), (None, None, None, "1 0 x")}
    empty = rows.limit(0)
    tables.write_run(empty.withColumnRenamed("grade", "score"), str(tmp_path / "none"))
    assert tables.read_run(spark, str(tmp_path / "none")).count() == 0
