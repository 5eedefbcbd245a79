from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corvine.operators.ranking import CARRIED, evidence, grapes_fit, identified, name_checks, ranked, seen_tokens


def test_label_words(spark):
    """A read word supports only the names' words that it matches best, against a plain version."""
    names = {"a": {"muskatel", "kelar"}, "b": {"muskat"}, "c": {"kelar"}}
    label = ["muskatel", "kelarr", "zzzzz"]
    sim = lambda t, q: 1.0 if t == q else (0.9 if len(t) >= 6 and q.startswith(t) and len(q) - len(t) > 2 else SequenceMatcher(None, t, q).ratio() if abs(len(t) - len(q)) <= 2 else 0.0)
    words = set().union(*names.values())
    supported = set()
    for q in label:
        best = max(sim(t, q) for t in words)
        if best >= 0.82:
            supported |= {t for t in words if sim(t, q) == best}
    n = spark.createDataFrame([("s", i, t) for i, ts in names.items() for t in ts], "scan string, slug string, token string")
    q = spark.createDataFrame([("s", w) for w in label], "scan string, query string")
    links = spark.createDataFrame([(t, w, sim(t, w)) for t in words for w in label if sim(t, w) >= 0.82], "token string, query string, similarity double")
    seen = seen_tokens(n, q, links, "scan", "slug")
    assert {(r.slug, r.token) for r in seen.where("seen").collect()} == {(i, t) for i, ts in names.items() for t in ts if t in supported}
    checks = {r.slug: (r.is_fully_read, r.n_against) for r in name_checks(seen, "scan", "slug").collect()}
    assert checks == {"a": (True, 0), "b": (False, 2), "c": (True, 1)}


def test_identified_and_grapes(spark):
    rows = [("v", 0.3, 0.0, False, True), ("vn", 0.1, 0.2, False, True), ("n", 0.0, 0.2, False, False), ("nf", 0.0, 0.2, True, True), ("nu", None, 0.2, None, True), ("none", None, None, True, False)]
    df = spark.createDataFrame(rows, "k string, visual double, name_share double, is_fully_read boolean, expected boolean")
    assert all(r.is_identified == r.expected for r in identified(df).collect())
    g = spark.createDataFrame([([["pinot", "noir"]], ["pinot"], False), ([["pinot"], ["syrah"]], ["syrah"], True), ([], [], True)], "s array<array<string>>, o array<string>, e boolean")
    assert all(r.x == r.e for r in g.select(grapes_fit(F.col("s"), F.col("o")).alias("x"), "e").collect())


def test_grape_checks_takes_every_grape_the_label_spells_out(spark, tmp_path):
    from corvine.plans.ranking import grape_checks

    grapes = ["Каберне", "Мерло", "Мальбек", "Рислинг", "Саперави"]
    rows = [("s", "name", 1, "Звезда", 0.9), ("s", "winery", 1, "Арфитук", 0.9), *(("s", "grape_varieties", i + 1, g, 0.9 - i / 10) for i, g in enumerate(grapes)), ("t", "name", 1, "Звезда", 0.9), ("t", "winery", 1, "Арфитук", 0.9), ("t", "grape_varieties", 1, "Мерло", 0.1)]
    spark.createDataFrame(rows, "scan_id string, field string, pos int, value string, score double").write.parquet(str(tmp_path / "field_candidates.parquet"))
    wines = [(1, "a", "Звезда", "Арфитук", None, "Красное", True, "Саперави"), (2, "b", "Звезда", "Арфитук", None, "Красное", True, "Пино Нуар")]
    spark.createDataFrame(wines, "row_id long, slug string, name string, winery string, region string, category string, is_active boolean, grape_varieties string").write.parquet(str(tmp_path / "catalog_wines.parquet"))
    found = {(r.scan_id, r.slug): r.fits for r in grape_checks(spark, str(tmp_path)).collect()}
    assert found == {("s", "a"): True, ("s", "b"): False, ("t", "a"): True, ("t", "b"): True}


def test_evidence_of_scans_with_many_readings(spark):
    """Many names meet few partners, few names many partners, and more other readings than go along; against a plain version."""
    regions = [f"r{i}" for i in range(CARRIED + 6)]
    reads = [("many", "name", f"n{i}", 0.01) for i in range(40)] + [("many", "winery", w, 0.4) for w in ("w1", "w2", "none")] + [("many", "region", r, 0.001 * i) for i, r in enumerate(regions)]
    reads += [("few", "name", "n0", 0.7), ("few", "winery", "w0", 1.0), ("few", "region", "r1", 0.5), ("few", "category", "c", 1.0), ("half", "name", "n0", 1.0)]
    wines = [(f"a{i}", f"n{i}", "w0", "r1", "c" if i % 2 else None) for i in range(60)] + [("b", "n0", "w0", None, None), ("c", "n3", "w1", "r69", "c"), ("d", "n3", "w1", "r0", None), ("e", "n99", "w1", "r1", "c"), ("f", None, "w1", "r1", "c")]
    shares = {(s, f, v): x for s, f, v, x in reads}
    expected = {
        (s, w[0]): round((0.2 * shares[s, "winery", w[2]] + 0.2 * shares[s, "name", w[1]] + 0.04 * shares.get((s, "region", w[3]), 0) + 0.03 * shares.get((s, "category", w[4]), 0)) / 1.37, 4)
        for s in ("many", "few", "half") for w in wines if (s, "winery", w[2]) in shares and (s, "name", w[1]) in shares
    }
    r = spark.createDataFrame(reads, "scan string, field string, value string, share double")
    i = spark.createDataFrame(wines, "slug string, name string, winery string, region string, category string")
    found = evidence(r, i, "scan", "slug").collect()
    assert len(found) == len(expected) == 4
    assert {(x.scan, x.slug): x.evidence for x in found} == expected


def _shuffled(df) -> int:
    """Rows that the plan of ``df`` shuffles."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("query", ["grape_checks", "rank_order", "verify_precedence", "evidence_fusion", "label_checks", "rank_decide", "recommend_related", "shortlist_union"])
def test_scored_items_are_not_shuffled(spark, tmp_path, monkeypatch, query):
    """30 scans read a pair that 400 items have: 12,000 scored items, of which each scan needs a few, or which are the result."""
    from corvine.plans import ranking

    rows = [(f"s{i}", f, 1, v, 0.9) for i in range(30) for f, v in (("name", "Звезда"), ("winery", "Арфитук"), ("category", "Красное"), ("grape_varieties", "Мерло"))]
    spark.createDataFrame(rows, "scan_id string, field string, pos int, value string, score double").write.parquet(str(tmp_path / "field_candidates.parquet"))
    wines = [(i, f"w{i:03}", "Звезда", "Арфитук", None, "Красное" if i % 2 else "Белое", True, "Саперави") for i in range(400)]
    spark.createDataFrame(wines, "row_id long, slug string, name string, winery string, region string, category string, is_active boolean, grape_varieties string").write.parquet(str(tmp_path / "catalog_wines.parquet"))
    moved = []
    cut = ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df: moved.append(_shuffled(df)) or cut(df))
    found = ranking.QUERIES[query](spark, str(tmp_path))
    moved.append(_shuffled(found))
    assert sum(moved) < 12_000
    assert found.count() == {"evidence_fusion": 12_000, "verify_precedence": 12_000, "shortlist_union": 12_000, "rank_decide": 30, "recommend_related": 90}.get(query, 150)


def test_first_items_without_pairs_that_cannot_hold_them(spark):
    shares = [("s", "winery", f"w{i}", s) for i, s in enumerate((0.6, 0.3, 0.1))] + [("s", "name", "n", 0.9), ("s", "name", "m", 0.1), ("s", "region", "r", 1.0), ("t", "winery", "w2", 1.0), ("t", "name", "m", 1.0)]
    shares = spark.createDataFrame(shares, "scan string, field string, value string, share double")
    rows = [(f"{w}{n}{i}", n, w, "r" if i == 1 else "q", None) for w in ("w0", "w1", "w2") for n in ("n", "m") for i in range(3)]
    items = spark.createDataFrame(rows, "slug string, name string, winery string, region string, category string")
    order = lambda df, k: sorted((r.scan, r["rank"], r.slug, r.evidence) for r in ranked(df, "scan", "slug", F.lit(False), k).collect())
    whole = evidence(shares, items, "scan", "slug")
    for k in (1, 3, 4, 7, 30):
        assert order(evidence(shares, items, "scan", "slug", first=k), k) == order(whole, k)
    # of the six pairs of the first scan the best read has three items, which no region brings another into reach of
    assert {r.slug[:-1] for r in evidence(shares, items, "scan", "slug", first=3).where("scan = 's'").collect()} == {"w0n"}


def test_rivals_of_the_same_names_count_as_many(spark):
    seen = spark.createDataFrame([("s", "a", "linea", True, 2), ("s", "b", "linea", True, 3), ("s", "b", "plus", True, 3)], "scan string, item string, token string, seen boolean, n long")
    assert {r.item: r.n_against for r in name_checks(seen, "scan", "item", "n").collect()} == {"a": 3, "b": 0}


def test_shortlist_takes_every_item_with_the_best_name(spark, tmp_path):
    from corvine.plans.ranking import shortlist_union

    wines = [(i, f"{n}{i}", n, w, True) for i, (n, w) in enumerate([("n", "w")] * 4 + [("m", "w")] * 4 + [("x", "v")])]
    spark.createDataFrame(wines, "row_id long, slug string, name string, winery string, is_active boolean").selectExpr("*", "'r' as region", "'c' as category").write.parquet(f"{tmp_path}/catalog_wines.parquet")
    reads = [("s", "name", 1, "n", 0.5), ("s", "name", 2, "m", 0.9), ("s", "winery", 1, "w", 0.9), ("t", "name", 1, "n", None), ("t", "winery", 1, "w", 0.9), ("u", "name", 1, "m", None), ("u", "name", 2, "n", 0.2), ("u", "winery", 1, "w", 0.9)]
    spark.createDataFrame(reads, "scan_id string, field string, pos int, value string, score double").write.parquet(f"{tmp_path}/field_candidates.parquet")
    found = [(r.scan_id, r.slug) for r in shortlist_union(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted([("s", f"m{i}") for i in range(4, 8)] + [("u", f"n{i}") for i in range(4)])


def test_label_checks_identify_by_name_and_picture(spark, tmp_path):
    """Pictures depend on the lengths of slugs: of one winery and year those of eight letters have nearly the whole share, those of three a faint one."""
    from corvine.plans.ranking import label_checks

    wines = [("wine0008", "Звезда, 2020", "Арфитук"), ("abc", "Парус, 2020", "Арфитук"), ("wine0009", "Звезда, 2020", "Бирюза"), ("xyz", "Мускат, 2020", "Бирюза"), ("oleg", "Олег", "Ом")]
    rows = [(i, *w, None, None, True, None) for i, w in enumerate(wines)]
    spark.createDataFrame(rows, "row_id long, slug string, name string, winery string, region string, category string, is_active boolean, grape_varieties string").write.parquet(str(tmp_path / "catalog_wines.parquet"))
    read = {
        "s": [("name", "Звезда", 0.9), ("winery", "Арфитук", 0.9), ("year", "2020", 0.9)],
        "t": [("winery", "Арфитук", 0.9), ("year", "2020", 0.9)],
        "u": [("name", "Парус", 0.2), ("winery", "Арфитук", 0.9), ("year", "2020", 0.9)],
        "v": [("grape_varieties", "Мускат", 0.9), ("winery", "Бирюза", 0.9), ("year", "2020", 0.9)],
        "w": [("name", "Олег", 0.9), ("winery", "Ом", 0.9)],
    }
    rows = [(s, f, 1, v, x) for s, fields in read.items() for f, v, x in fields]
    spark.createDataFrame(rows, "scan_id string, field string, pos int, value string, score double").write.parquet(str(tmp_path / "field_candidates.parquet"))
    found = {(r.scan_id, r.slug): (r.is_fully_read, r.n_against, r.is_identified) for r in label_checks(spark, str(tmp_path)).collect()}
    assert found == {
        ("s", "wine0008"): (True, 0, True), ("s", "abc"): (False, 1, False),
        # a clear picture identifies without a name, a faint one does not, but with a name that the label does not show
        ("t", "wine0008"): (False, 0, True), ("t", "abc"): (False, 0, False),
        ("u", "wine0008"): (False, 0, True), ("u", "abc"): (False, 0, True),
        # a faint picture is clear where the label contradicts the other
        ("v", "xyz"): (True, 0, True), ("v", "wine0009"): (False, 1, False),
        # a name of short words has a row, and none of its words is shown
        ("w", "oleg"): (False, 0, False),
    }


def test_first_items_of_all_fields(spark):
    """Readings of every field, pictures that rounding makes equal, scans without names or looks, and one with more readings than go along."""
    from random import Random

    from corvine.operators.verification import looked_evidence

    r = Random(3)
    pick = lambda c, n: f"{c}{r.randrange(n)}"
    wines = [(f"i{i:03}", pick("n", 5), pick("w", 3), pick("r", 4), pick("c", 3), str(r.randrange(2)), [pick("g", 5) for _ in range(r.randrange(3))], r.choice((0.0101, 0.0102, 0.01021, 0.012, round(r.random() / 50, 6)))) for i in range(400)]
    wines += [(f"x{i}", None, None, None, None, None, [], None) for i in range(2)] + [(f"y{i}", "n0", "w0", None, None, None, [], None) for i in range(4)]
    sizes = {"name": 5, "winery": 3, "region": 4, "category": 3, "year": 2, "grape_varieties": 5}
    shares, looks = [], []
    for i in range(30):
        for f, n in sizes.items():
            for k in r.sample(range(n), r.randrange(3)):
                shares.append((f"s{i}", f, str(k) if f == "year" else f"{f[0]}{k}", round(r.random(), 6)))
        if i % 5:
            looks.append((f"s{i}", pick("w", 3), str(r.randrange(2))))
    shares += [("many", "name", "n1", 0.4), ("many", "winery", "w1", 0.9)] + [("many", "region", f"r{i}", 0.001 * i) for i in range(CARRIED + 6)]
    looks.append(("many", "w1", "1"))
    s = spark.createDataFrame(shares, "scan string, field string, value string, share double")
    i = spark.createDataFrame(wines, "slug string, name string, winery string, region string, category string, year string, grapes array<string>, picture double")
    p = spark.createDataFrame(looks, "scan string, look_winery string, look_year string")
    order = lambda df, k: sorted((x.scan, x["rank"], x.slug, x.evidence, x.name_share) for x in ranked(df, "scan", "slug", F.lit(False), k).collect())
    whole = looked_evidence(s, p, i, "scan", "slug").cache()
    for k in (1, 5):
        few = looked_evidence(s, p, i, "scan", "slug", first=k)
        assert order(few, k) == order(whole, k)
        assert few.count() < whole.count()
    assert whole.select("scan").distinct().count() > 20
