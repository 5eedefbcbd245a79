from __future__ import annotations

import datetime as dt

import numpy as np

from corvine.llm.survivors import FIELDS, Survivors, fit_sources

COLUMNS = "row_id long, slug string, name string, category string, color string, region string, grape_varieties string, description string, winery string, source_image_filename string, source_row_no int, raw_record_count int, feed string, loaded_at timestamp, value string, claim long"


def _row(i, slug, feed=None, day=1, no=1, count=None, **fields):
    return (i, slug, *(fields.get(f) for f in FIELDS), no, count, feed, None if day is None else dt.datetime(2025, 1, day), "x", 7)


def _model(spark, rows):
    feeds = spark.createDataFrame([("producer", 5), ("crawler", 1)], "feed string, trust int")
    return Survivors(spark.createDataFrame(rows, COLUMNS), feeds)


def test_order_of_rows(spark):
    rows = [
        _row(1, "A-b", "crawler", 9, name="c", color="red", region="r1"), _row(2, " a__B", "producer", 1, name="p", color="N/A", region=None), _row(3, "a-b", None, 20, name="n", winery="w", color=" "), _row(4, "a-b", "producer", 1, no=0, name="q"),
        _row(5, "solo", "producer", name="s"), _row(6, None, name="x"), _row(7, " ", name="y"), _row(8, "ties", None, None, 3, None, name="a"), _row(9, "ties", None, None, 3, 0, name="b"), _row(10, "ties", "strange", None, 2, 0, name="c"),
        _row(11, "count", "crawler", 1, 1, 2, name="a"), _row(12, "count", "crawler", 1, 9, 3, name="b"), _row(13, "count", "crawler", 1, 1, None, name="c"), _row(14, "none", name="-"), _row(15, "none", name="unknown"),
    ]
    found = {(r.group_row_id, r.field): r.best_row_id for r in _model(spark, rows).records().collect()}
    assert found == {(1, "name"): 4, (1, "color"): 1, (1, "region"): 1, (1, "winery"): 3, (8, "name"): 10, (11, "name"): 12}


def test_empty_and_values(spark):
    assert _model(spark, []).records().collect() == []
    rows = [_row(1, "a", "producer", grape_varieties="Мерло, Сира"), _row(2, "a", "crawler", grape_varieties="Мерло"), _row(3, "a", "crawler", grape_varieties="[]")]
    values = {r.value: r.kept for r in _model(spark, rows).values().collect()}
    assert set(values) == {"мерло", "сира", "[]"} and values["мерло"]
    quality = {r.feed: r for r in _model(spark, rows).source_quality().collect()}
    assert set(quality) == {"producer", "crawler", None} and quality[None].n_facts == 0


def test_model_finds_the_qualities():
    rng = np.random.default_rng(2)
    sens, spec, n = np.array([0.9, 0.6, 0.8]), np.array([0.95, 0.9, 0.6]), 60_000
    truth = rng.random(n) < 0.5
    claims = np.where(truth[:, None], rng.random((n, 3)) < sens, rng.random((n, 3)) >= spec)
    masks, counts = np.unique((claims * [1, 2, 4]).sum(1), return_counts=True)
    patterns = [(int(m), 7, int(c)) for m, c in zip(masks, counts)]
    got_sens, got_spec, probability = fit_sources(patterns, 3, 300)
    assert np.abs(got_sens - sens).max() < 0.06 and np.abs(got_spec - spec).max() < 0.06
    assert dict(zip([p[0] for p in patterns], probability))[7] > 0.9


def test_planted_values_are_kept(spark):
    """Three sources of known quality over groups with planted true values: the model keeps true ones and drops most false ones, also several of one field."""
    rng = np.random.default_rng(5)
    rows, true, n = [], {}, 0
    for g in range(400):
        truth = {f"true{g}", f"also{g}"}
        for feed, right, wrong in (("producer", 0.95, 0.02), ("crawler", 0.9, 0.6), (None, 0.9, 0.1)):
            given = [v for v in sorted(truth) if rng.random() < right] + [f"false{g}" for _ in range(1) if rng.random() < wrong]
            n += 1
            rows.append(_row(n, f"g{g}", feed, grape_varieties=", ".join(given) or None, name="x"))
            true[f"g{g}"] = truth
    model = _model(spark, rows)
    first = {min(3 * g + 1, 3 * g + 3): f"g{g}" for g in range(400)}
    kept = {}
    for r in model.values().where("field = 'grape_varieties' and kept").collect():
        kept.setdefault(first[r.group_row_id], set()).add(r.value)
    hits = sum(len(kept.get(g, set()) & t) for g, t in true.items())
    wrong = sum(len(kept.get(g, set()) - t) for g, t in true.items())
    assert hits > 0.97 * 800 * 0.99 and wrong < 60
    summary = {r.group_row_id: r for r in model.records().where("field = 'grape_varieties'").collect()}
    assert all(r.n_kept == len(kept.get(first[i], ())) for i, r in summary.items())
    quality = {r.feed: (r.sensitivity, r.specificity) for r in model.source_quality().collect()}
    assert quality["crawler"][1] < 0.6 < 0.85 < quality["producer"][1]


def test_one_group_with_many_values(spark):
    """A third of all rows in one group, each with another text."""
    rows = [_row(i, "hot", "producer", day=1 + i % 20, name=f"n{i}", color="red") for i in range(300)] + [_row(1000 + i, f"s{i // 2}", "crawler", name="a") for i in range(600)]
    found = {(r.group_row_id, r.field): r for r in _model(spark, rows).records().collect()}
    assert found[0, "name"].n_values == 300 and found[0, "name"].best_row_id == 19 and found[0, "color"].n_values == 1
    assert len(found) == 302
