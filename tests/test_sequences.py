from __future__ import annotations

import datetime as dt
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.functions.stemming import stem  # noqa: F401
from corvine.operators.evaluation import answer_quality, exact_percentiles
from corvine.operators.sequences import alternating, anchored_limit, assign_once, nearest_rank, within_budget
from corvine.session import ship_package
from corvine.sources.files import append_version, read_json_lines, read_table_text, read_zip_members
from corvine.streaming.events import limited, run_latest, run_once, tumbling


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    ship_package(spark)


def test_anchored_limit(spark):
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, at(0), 1), (1, at(1), 2), (1, at(2), 3), (1, at(10), 4), (1, at(19), 5), (1, at(20), 6), (2, at(5), 7), (None, at(5), 8), (None, at(6), 9), (None, at(7), 10)]
    df = spark.createDataFrame(rows, "k long, t timestamp, id long")
    found = {r.id: r.is_allowed for r in anchored_limit(df, "k", "t", "id", 10, 2).collect()}
    assert found == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True, 9: True, 10: False}


def test_folds(spark):
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(["v", "v", "c", "c", "v"])], "k long, o long, r string")
    assert sorted((r.o, r.position) for r in alternating(df, "k", "o", "r", ("v", "c")).collect()) == [(0, 0), (2, 1), (4, 2)]
    items = spark.createDataFrame([("a", 1, 10, 5.0), ("a", 2, 11, 7.0), ("a", 3, 12, 4.0), ("b", 1, 13, 99.0)], "g string, o int, i long, p double")
    assert sorted((r.i, r.spent) for r in within_budget(items, "g", ["o"], "i", "p", 10).collect()) == [(10, 5.0), (12, 9.0)]


def test_assign_once_is_the_sequential_choice(spark):
    rng = random.Random(5)
    pairs = {(a, b): rng.randint(1, 9) / 10 for a in range(25) for b in rng.sample(range(18), 5)}
    taken, expected = set(), {}
    for left in range(25):
        options = sorted((-s, b) for (a, b), s in pairs.items() if a == left and b not in taken)
        if options:
            expected[left] = options[0][1]
            taken.add(options[0][1])
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "left long, right long, score double")
    assert {r.left: r.right for r in assign_once(df).collect()} == expected


def test_unique_assignment_looks_beyond_the_best_five(spark, tmp_path):
    """Seven documents that name the same seven wineries take one each."""
    from corvine.plans.sequences import unique_assignment

    names = ["Арфитук", "Дорвинласия", "Велмонт", "Гурзанский", "Церфиут", "Тамринский", "Колодезный"]
    spark.createDataFrame([(i, "winery", n) for i, n in enumerate(names)], "canon_id long, field string, canon_value string").write.parquet(str(tmp_path / "canonical_values.parquet"))
    spark.createDataFrame([(i, " ".join(names)) for i in range(7)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.left: r.right for r in unique_assignment(spark, str(tmp_path)).collect()} == dict(enumerate(sorted(names)))


def test_nearest_rank(spark):
    for values in ([5], list(range(10)), [3, 1, 2, 2, 9]):
        got = nearest_rank(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", 0.95).collect()[0].value
        assert got == sorted(values)[round(0.95 * (len(values) - 1))]
    assert nearest_rank(spark.createDataFrame([], "x double"), "x", 0.95).collect() == []


def test_answer_quality(spark):
    df = spark.createDataFrame([("a", "a", "x"), ("b", "c", "x"), ("d", None, "y"), (None, None, "y"), (None, "e", None)], "e string, p string, g string")
    rows = {r.part: r for r in answer_quality(df, "e", "p", F.col("g")).collect()}
    assert (rows["all"].n, rows["all"].n_right, rows["all"].precision, rows["all"].recall, rows["all"].accuracy) == (5, 1, 0.333333, 0.333333, 0.4)
    assert rows["y"].precision is None and rows["y"].f1 == 0.0 and rows["none"].n == 1


def test_streams(spark, tmp_path):
    rows = [(i % 3, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=7 * i), i, "v", 1.0) for i in range(60)]
    schema = "user_id long, ts timestamp, event_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    got = {r.row_id: r.is_allowed for r in run_once(limited(stream(), "user_id", "ts", "event_id", 60, 2)).collect()}
    want = {r.event_id: r.is_allowed for r in anchored_limit(spark.read.parquet(str(tmp_path / "e")), "user_id", "ts", "event_id", 60, 2).collect()}
    assert got == want
    counts = {r.start.minute: r.n for r in run_once(tumbling(stream(), "ts", "event_type", "1 minute", "1 second")).collect()}
    assert counts[0] == 9 and sum(counts.values()) < 60


def test_latest_holds_the_open_windows(spark, tmp_path):
    rows = [(dt.datetime(2025, 1, 1) + dt.timedelta(seconds=7 * i), "v", 1.0) for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = {r.start.minute: r.n for r in run_latest(tumbling(stream, "ts", "event_type", "1 minute", "1 hour"), ["start", "event_type"]).collect()}
    assert got == {m: sum(r[0].minute == m for r in rows) for m in range(7)}


def test_percentiles_against_a_sort(spark):
    rng = random.Random(2)
    groups = {"a": [rng.random() for _ in range(500)], "b": [1.0] * 40, "c": [rng.choice([0.0, 1e9, -3.5]) for _ in range(99)], None: [5.0, 7.0], "d": []}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    found = {r.g: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], {"p50": 0.5, "p95": 0.95}, cells=16).collect()}
    for g, vs in groups.items():
        if vs:
            assert found[g].n == len(vs) and np.allclose([found[g].p50, found[g].p95], np.percentile(vs, [50, 95]))
    assert "d" not in found or found["d"].p50 is None


def test_limited_stream_does_not_depend_on_chunks(spark, tmp_path):
    """One key in several Arrow chunks, latest rows first."""
    rows = [(1, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=7 * i), i) for i in reversed(range(60))]
    schema = "user_id long, ts timestamp, event_id long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        got = {r.row_id: r.is_allowed for r in run_once(limited(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), "user_id", "ts", "event_id", 60, 2)).collect()}
    finally:
        spark.conf.set(size, before)
    want = {r.event_id: r.is_allowed for r in anchored_limit(spark.read.parquet(str(tmp_path / "e")), "user_id", "ts", "event_id", 60, 2).collect()}
    assert got == want


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('\ufeff Slug ,Name\na," x\ny "\n ,""\n', encoding="utf-8")
    assert [tuple(r) for r in read_table_text(spark, str(tmp_path / "c.csv"), {"Slug": "slug", "Name": "name"}).collect()] == [("a", "x\ny"), (None, None)]
    with pytest.raises(ValueError, match="Missing"):
        read_table_text(spark, str(tmp_path / "c.csv"), {"Missing": "m"})
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": null}\n')
    assert [r.a for r in read_json_lines(spark, str(tmp_path / "j.jsonl"), T.StructType([T.StructField("a", T.LongType())])).collect()] == [1, None]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("фото/a.jpg", b"1")
        z.writestr("__MACOSX/x", b"2")
        z.writestr("d/.DS_Store", b"3")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    assert [(r.member, bytes(r.content)) for r in read_zip_members(spark, str(tmp_path / "a.zip")).collect()] == [("фото/a.jpg", b"1")]
    for run in (1, 2):
        append_version(spark.range(3), str(tmp_path / "v"), run)
    assert spark.read.parquet(str(tmp_path / "v")).where("run_id = 2").count() == 3


def test_recorded_run(spark, tmp_path):
    from corvine.sources.files import recorded_run

    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    assert recorded_run(spark.range(3), table, log, 1, "v1")
    assert not recorded_run(spark.range(9), table, log, 2, "v1")
    with pytest.raises(Exception):  # noqa: B017
        recorded_run(spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")), table, log, 3, "v2")
    assert recorded_run(spark.range(5), table, log, 4, "v2")
    assert sorted((r.run, r.status) for r in spark.read.json(log).collect()) == [(1, "succeeded"), (3, "failed"), (4, "succeeded")]


def test_positions(spark):
    from corvine.plans.projections import positions

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("position_of"))
    assert df.count() == positions(df, ["k"]).where("position = k").count()
    assert positions(df.limit(0), ["k"]).collect() == []
