from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corvine.functions.text import FILLERS, clean, is_real
from corvine.operators.catalog import duplicate_rows, first_attempt, first_wins, insert_ignore, page, shared, upsert
from corvine.operators.ranking import decide, distribution, only_value
from corvine.operators.vectors import neighbours


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "a", "z"), (4, "b", None), (5, "b", None)], "n long, k string, v string")
    rows = {r.k: r for r in first_wins(df, "k", "n", ["v"]).collect()}
    assert (rows["a"].v, rows["a"].n_rows, rows["a"].last_row, rows["a"].payload_differs) == ("x", 2, 3, True)
    assert (rows["b"].v, rows["b"].payload_differs) == (None, False) and None not in rows
    assert sorted((r.k, r.n, r.first_row) for r in duplicate_rows(df, "k", "n").collect()) == [("a", 1, 1), ("a", 3, 1), ("b", 4, 4), ("b", 5, 4)]


def test_upsert_keeps_and_reactivates(spark):
    old = spark.createDataFrame([("a", "1", 1, 1, True), ("b", "2", 1, 1, False), ("c", "3", 1, 1, True)], "k string, v string, first_seen int, updated int, is_active boolean")
    new = spark.createDataFrame([("a", None), ("b", "9"), ("d", "4")], "k string, v string")
    rows = {r.k: tuple(r)[1:] for r in upsert(old, new, "k", ["v"], 2).collect()}
    assert rows == {"a": (None, 1, 2, True), "b": ("9", 1, 2, True), "c": ("3", 1, 1, False), "d": ("4", 2, 2, True)}


def test_small_operators(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert sorted(r.k for r in insert_ignore(a, spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k long, v string"), ["k"]).collect()) == [1, 2, 3]
    assert {r.attempt for r in first_attempt([a.where("k > 9"), a]).collect()} == {2}
    assert page(a, [F.col("k")], 2, 1).collect()[0].total == 2 and page(a, [F.col("k")], 9, 5).collect() == []
    assert sorted(tuple(r) for r in shared(spark.createDataFrame([("s", "o"), ("s", "p"), ("t", "o"), ("t", "o"), (None, "o"), (None, "p")], "k string, o string"), "k", "o").collect()) == [("s", "o", 2), ("s", "p", 2)]


def test_blanks_and_fillers(spark):
    df = spark.createDataFrame([("\u00a0x\t",), ("",), (None,), (" N/A ",), ("Не указано",), ("—",), ("Нет-нет",)], "v string")
    assert [r.v for r in df.select(clean(F.col("v")).alias("v")).collect()][:3] == ["x", None, None]
    assert [r.v for r in df.select(is_real(F.col("v")).alias("v")).collect()] == [True, False, False, False, False, False, True]
    assert "tbd" in FILLERS


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m[7] = 0
    m[9] = m[8]
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)] + [(1000, None, 0)], "vec_id long, embedding array<double>, label int")
    norm = np.linalg.norm(m, axis=1)
    sims = np.round((m @ m.T) / np.outer(np.where(norm, norm, 1), np.where(norm, norm, 1)), 6)
    for within in (None, "label"):
        found: dict = {}
        for r in neighbours(df, df.where("vec_id % 50 = 0"), 4, within=within).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append(r.id)
        for q in range(0, 300, 50):
            allowed = [i for i in range(300) if i not in (q, 7) and (within is None or i % 3 == q % 3)]
            assert found[q] == sorted(allowed, key=lambda i: (-sims[q, i], i))[:4]


def test_distribution_and_decision(spark):
    c = spark.createDataFrame([("s", "a", 0.9), ("s", "a", 0.1), ("s", "b", 0.5), ("s", None, 0.7), ("t", "x", None), ("u", "x", 0.2)], "scan string, value string, score double")
    shares = {(r.scan, r.value): r.share for r in distribution(c, ["scan"], 0.1).collect()}
    assert shares[("s", "a")] > 0.98 and abs(shares[("s", "a")] + shares[("s", "b")] - 1) < 1e-6 and shares[("u", "x")] == 1 and ("t", "x") not in shares
    assert {(r.scan, r.value) for r in only_value(c, ["scan"]).collect()} == {("t", "x"), ("u", "x")}
    top = spark.createDataFrame([("s", "a", 0.80, None, 1), ("s", "b", 0.795, None, 2), ("t", "a", 0.9, "year", 3), ("t", "b", 0.5, None, 1), ("u", "a", 0.9, "year", 1)], "scan string, slug string, evidence double, kind string, rank int")
    rows = {r.scan: r for r in decide(top, "scan", "slug").collect()}
    assert (rows["s"].status, rows["s"].margin) == ("not_found", 0.005)
    assert (rows["t"].winner, rows["t"].status, rows["t"].margin) == ("b", "matched", 0.5)
    assert rows["u"].status == "not_found"
