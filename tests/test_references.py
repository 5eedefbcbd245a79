from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corvine.functions.text import picture_key, slug_key
from corvine.operators.references import Reference, Target, orphan_references, orphans_by_period

T = dt.datetime


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _case(spark, refs, targets):
    r = spark.createDataFrame(refs, "id long, t timestamp, slug string, key string, target string")
    t = spark.createDataFrame(targets, "slug string, seen timestamp, alive boolean, key string")
    return [Reference("refs", r, F.col("id"), F.col("t"), slug_key(F.col("slug")), "wine")], [Target("wine", t, slug_key(F.col("slug")), F.col("seen"), F.col("alive"))]


def test_states_and_key_forms(spark):
    day = lambda n: T(2025, 3, n)
    refs = [
        (1, day(5), " Good_Wine\u00a0", None, None), (2, day(5), "good--wine", None, None), (3, day(5), "gone", None, None), (4, day(1), "young", None, None), (5, day(5), "young", None, None),
        (6, day(5), "nowhere", None, None), (7, None, "nowhere", None, None), (8, None, "young", None, None), (9, day(5), "  ", None, None), (10, day(5), None, None, None), (6, day(5), "nowhere", None, None),
        (11, day(5), "undated", None, None), (12, day(5), "half", None, None),
    ]
    targets = [("good-wine", day(1), True, "x"), ("gone", day(1), False, None), ("GONE", day(2), False, None), ("young", day(3), True, None), ("young", day(9), None, None), (None, day(1), True, None), ("undated", None, True, None), ("half", day(1), False, None), ("half", day(2), None, None)]
    found = _rows(orphan_references(*_case(spark, refs, targets)))
    assert found == sorted([("refs", "2025-03", 3, "deleted"), ("refs", "2025-03", 4, "late"), ("refs", "2025-03", 6, "missing"), ("refs", "2025-03", 6, "missing"), ("refs", None, 7, "missing")], key=str)
    by = {r.period: r for r in orphans_by_period(*_case(spark, refs, targets)).collect()}
    assert (by["2025-03"].n_refs, by["2025-03"].n_missing, by["2025-03"].n_deleted, by["2025-03"].n_late) == (9, 2, 1, 1)
    assert by[None].n_refs == 2 and by[None].n_missing == 1


def test_empty_tables(spark):
    assert _rows(orphan_references(*_case(spark, [], []))) == []
    assert _rows(orphan_references(*_case(spark, [(1, None, "a", None, None)], []))) == [("refs", None, 1, "missing")]
    assert _rows(orphan_references(*_case(spark, [], [("a", None, True, None)]))) == []


def test_hot_key(spark):
    refs = spark.range(20_000).select(F.col("id"), F.lit(T(2025, 1, 1)).alias("t"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("slug"))
    t = spark.range(250).select(F.concat(F.lit("k"), "id").alias("slug"), F.lit(T(2024, 1, 1)).alias("seen"), F.lit(True).alias("alive"))
    out = orphan_references([Reference("r", refs, F.col("id"), F.col("t"), slug_key(F.col("slug")), "w")], [Target("w", t, slug_key(F.col("slug")), F.col("seen"), F.col("alive"))])
    expected = refs.where("slug = 'hot' or cast(substring(slug, 2) as int) >= 250").count()
    assert out.count() == expected and out.where("state <> 'missing'").count() == 0


def test_picture_keys(spark):
    names = ["../a/IMG_1.webp", "img 1_0123456789.PNG", " Img-1.jpg ", "C:\\x\\img_1.jpeg", "", " ", None, "бутылка 7.jpg", "Бутылка_7_ABCDEF0123.webp", "???.png", "x_123456789.jpg"]
    keys = [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(picture_key(F.col("n")).alias("k")).collect()]
    assert keys == ["img1", "img1", "img1", "img1", None, None, None, "бутылка7", "бутылка7", "", "x123456789"]
