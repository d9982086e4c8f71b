"""Untyped files, bad cells, model folders and staged tables."""

import os

from plantpulse import session
from plantpulse.operators.scorer import WeightedScorer
from plantpulse.sources import log, tables
from plantpulse.sources.models import ModelStore


def write(folder, text):
    folder.mkdir()
    (folder / "part.csv").write_text(text)
    return str(folder)


def test_unknown_columns_are_numbers_if_all_cells_are(spark, tmp_path):
    path = write(tmp_path / "a", "Timestamp;Power;Extra;note;empty\n2024-01-01 00:00:00;1.5;3;a;\n2024-01-01 01:00:00;;;4;\n")
    df = tables.read_csv(spark, path)
    assert dict(df.dtypes) == {"Timestamp": "timestamp", "Power": "double", "Extra": "double", "note": "string", "empty": "string"}
    assert [(r.Power, r.Extra, r.note) for r in df.collect()] == [(1.5, 3.0, "a"), (None, None, "4")]


def test_bad_cells_are_counted(spark, tmp_path):
    path = write(tmp_path / "a", "Timestamp;Power;Energy\nx;bad;1\n;2;\n;;oops\n;worse;NaN\n")
    assert {r.column: r.bad for r in tables.bad_cells(spark, path).collect()} == {"Timestamp": 1, "Power": 2, "Energy": 1}
    assert [r.Power for r in tables.read_csv(spark, path).collect()].count(None) == 3


def test_saving_again_keeps_the_files_of_older_readers(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    store = ModelStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1.0,)], "a double")
    first = store.save(Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="x")]).fit(df), "m", "k", {}, ["a"])
    second = store.save(Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="y")]).fit(df), "m", "k", {}, ["a"])
    assert first != second and os.path.exists(first)
    assert "y" in store.load("m")[0].transform(df).columns
    assert store.models().count() == 1


def test_staged_tables_can_be_dropped(spark):
    df = session.staged(spark.range(5))
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert df.count() == 5 and os.path.exists(folder)
    assert session.drop_staged(spark) > 0 and not os.path.exists(folder)
    assert session.drop_staged(spark) == 0


def test_weighted_scorer(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, -1.0)], "a double, b double")
    rows = WeightedScorer({"a": 1.0, "b": 2.0}, 0.0).transform(df).collect()
    assert [(r.prediction, round(float(r.probability[1]), 6)) for r in rows] == [(0.0, 0.5), (0.0, 0.5)]


def log_rows(spark, first, count, day=1):
    from datetime import datetime
    return spark.createDataFrame([(i, datetime(2024, 1, day + i % 3, i % 24)) for i in range(first, first + count)], "id long, ts timestamp_ntz")


def ids(spark, path):
    return sorted(r.id for r in log.read(spark, path).collect())


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log.append(log_rows(spark, 0, 30), path, writer="a", batch=1)
    assert not log.append(log_rows(spark, 0, 30), path, writer="a", batch=1)
    assert log.append(log_rows(spark, 30, 5), path, writer="a", batch=2)
    assert log.append(log_rows(spark, 40, 5), path, writer="b/..", batch="2024-01-01")
    assert log.append(log_rows(spark, 50, 1), path) and log.append(log_rows(spark, 50, 1), path)
    assert ids(spark, path) == [*range(35), *range(40, 45), 50, 50]
    plan = log.read(spark, path).filter("day = '2024-01-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and plan.count("day") > 1


def test_what_a_failed_append_left_is_not_read_and_is_replaced(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append(log_rows(spark, 0, 3), path, writer="a", batch=1)
    # files without a manifest: the job died before its commit
    log._write(log_rows(spark, 100, 7), f"{path}/data/commit={log.commit_name('a', 2)}", "ts")
    assert ids(spark, path) == [0, 1, 2]
    assert log.append(log_rows(spark, 10, 2), path, writer="a", batch=2)
    assert ids(spark, path) == [0, 1, 2, 10, 11]


def test_only_one_of_two_writers_of_a_commit_publishes(spark, tmp_path):
    path, name = str(tmp_path / "log"), log.commit_name("a", 1)
    assert log._publish(spark, path, name, []) and not log._publish(spark, path, name, [])
    assert [r.name for r in log.commits(spark, path).collect()] == [name]


def test_compaction_keeps_records_and_commits(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(6):
        log.append(log_rows(spark, 10 * k, 10), path, writer="a", batch=k)
    reader = log.read(spark, path)
    assert log.compact(spark, path) == 6 and len(log.live(spark, path)) == 1
    assert ids(spark, path) == list(range(60)) and reader.count() == 60
    assert not log.append(log_rows(spark, 0, 10), path, writer="a", batch=0)
    assert log.vacuum(spark, path) == 6 and log.vacuum(spark, path) == 0
    assert log.append(log_rows(spark, 60, 1), path, writer="a", batch=6)
    assert ids(spark, path) == list(range(61)) and log.compact(spark, path) == 2
    assert ids(spark, path) == list(range(61))


def test_a_model_of_a_run_is_saved_once(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    store = ModelStore(spark, str(tmp_path / "store"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="x")]).fit(spark.createDataFrame([(1.0,)], "a double"))
    paths = {store.save(model, "m", "k", {"v": float(k)}, ["a"], run="r1") for k in range(3)}
    assert len(paths) == 1 and [dict(r.metrics) for r in store.models().collect()] == [{"v": 0.0}]
    store.save(model, "m", "k", {"v": 9.0}, ["a"], run="r2")
    assert [dict(r.metrics) for r in store.models().collect()] == [{"v": 9.0}]


def test_types_of_cells(spark, tmp_path):
    path = write(tmp_path / "a", "flag;mixed;whole;big;part;words;digits;gaps;none\n"
                 "True;true;1;9223372036854775807;1;yes;1;true;\n"
                 "false;7; -2;9223372036854775808;;no;0;;\n")
    out = tables.read_csv(spark, path)
    assert dict(out.dtypes) == {"flag": "boolean", "mixed": "string", "whole": "bigint", "big": "double", "part": "double",
                                "words": "string", "digits": "bigint", "gaps": "string", "none": "string"}
    got = {tuple(r) for r in out.select("flag", "whole", "part", "digits", "gaps").collect()}
    assert got == {(True, 1, 1.0, 1, "true"), (False, -2, None, 0, None)}
