from __future__ import annotations

import pytest

from corvine.functions.tokens import fold_looks, line_strengths
from corvine.operators import labels
from corvine.operators.labels import explained, search, winery_first, without
from corvine.sources.files import publish, prune


def _values(spark, rows, names="value string, token string"):
    return spark.createDataFrame([(*r[:-1], w) for r in rows for w in r[-1].split()], names)


def _equal(spark, *frames):
    words = sorted({r[-1] for f in frames for r in f.select(f.columns[-1]).collect()})
    return spark.createDataFrame([(w, w, 1.0) for w in words], "token string, query string, similarity double")


def test_search_gates(spark):
    values = _values(spark, [("a b", "common rare1"), ("a c", "common rare2"), ("a d", "common rare3"), ("lone", "common")])
    ask = lambda text, **o: {r.value: r.score for r in search(values, _values(spark, [("q", text)], "query_id string, query string"), _equal(spark, values), [], **o).collect()}
    # one common word is not enough, unless single words are; a rare one is not rare among four values
    assert ask("common") == {} and set(ask("common", single=True)) == {"a b", "a c", "a d", "lone"}
    assert set(ask("common rare1")) == {"a b"} and ask("common rare1")["a b"] == 1.0
    assert ask("nothing") == {} and len(ask("common rare1 rare2 rare3", k=2)) == 2
    weak = spark.createDataFrame([("common",), ("rare1",)], "token string")
    assert ask("common rare1", weak=weak) == {} and set(ask("common rare1 rare2", weak=weak)) == {"a c"}


def test_excluded_words_and_explained(spark):
    values = _values(spark, [("x", "house line"), ("y", "house")])
    left = {(r.value, r.token) for r in without(values, spark.createDataFrame([("x", "house"), ("y", "house")], "value string, token string")).collect()}
    assert left == {("x", "line"), ("y", "house")}
    queries = _values(spark, [("q", "house line other")], "query_id string, query string")
    chosen = spark.createDataFrame([("q", "x")], "query_id string, value string")
    assert {r.query for r in explained(queries, chosen, values, _equal(spark, values)).collect()} == {"house", "line"}


def test_names_of_the_read_winery_come_first(spark):
    wineries = _values(spark, [("Alder Hill", "alder hill"), ("Brook End", "brook end")])
    names = _values(spark, [("Rosso", "rosso"), ("Rosso Extra", "rosso extra"), ("Hill Blend", "hill blend")])
    names_of = _values(spark, [("Alder Hill", "Rosso", "rosso"), ("Brook End", "Rosso Extra", "rosso extra"), ("Brook End", "Hill Blend", "hill blend")], "winery string, value string, token string")
    queries = _values(spark, [("p", "alder hill rosso extra"), ("r", "rosso extra")], "query_id string, query string")
    first, found = winery_first(wineries, names, names_of, queries, _equal(spark, wineries, names), spark.createDataFrame([], "token string"))
    assert {(r.query_id, r.value) for r in first.collect()} == {("p", "Alder Hill")}
    got = {(r.query_id, r.value): (r.score, r.rank) for r in found.collect()}
    # the word of the winery is used up, its own name leads with 1, the other winery's fuller match counts half
    assert got == {("p", "Rosso"): (1.0, 1), ("p", "Rosso Extra"): (0.5, 2), ("r", "Rosso Extra"): (1.0, 1)}


@pytest.mark.parametrize(
    ("text", "folded"),
    [("ΜΕΤΡ", "МЕТР"), ("Kaбepне", "Каберне"), ("BEKTOP", "BEKTOP ВЕКТОР"), ("UENA", "UENA VENA"), ("Ta3uK", "Ta3uK ТазиК"), ("PE3EPB", "PE3EPB РЕЗЕРВ"), ("2013", "2013"), ("  a   b ", "a b"), ("3има", "Зима"), ("33има", "33има"), ("", "")],
)
def test_folding(spark, text, folded):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(fold_looks(df.t)).first()[0] == folded


def test_strengths_of_lines(spark):
    df = spark.createDataFrame([("alc. 12,5 vol",), ("13 % alc 14",), ("alcove 15",), ("45 %",)], "t string")
    assert [r[0] for r in df.select(line_strengths(df.t)).collect()] == [[12.5], [13.0, 14.0], [], []]


def test_publish_replaces_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark.range(10).selectExpr("id", "cast(id % 3 as string) as archive"), path)
    publish(prune(spark.read.parquet(path), "archive", ["0", "1"]), path)
    assert spark.read.parquet(path).count() == 7
    with pytest.raises(Exception):
        publish(spark.range(3).selectExpr("raise_error('x') as id"), path)
    assert spark.read.parquet(path).count() == 7


def test_search_lists_few_of_a_common_word(spark, monkeypatch):
    """40 queries with the same two words, one of which 300 values have: each set of words is searched once, and no list is longer than what can be among the first k. Against a plain version."""
    import math

    told = {f"v{i:03}": {"common", f"own{i % 150}", *(["second"] if i % 100 == 7 else [])} for i in range(300)} | {f"x{i}": {f"other{i}"} for i in range(900)}
    values = _values(spark, [(v, " ".join(w)) for v, w in told.items()])
    asked = {f"q{i}": {"common", "second"} for i in range(40)} | {"r": {"own3", "common"}, "all": {"common", "second", *(f"own{i}" for i in range(70))}}
    queries = _values(spark, [(q, " ".join(w)) for q, w in asked.items()], "query_id string, query string")
    df = {}
    for w in (w for ws in told.values() for w in ws):
        df[w] = df.get(w, 0) + 1
    weight = {w: 1 + math.log((len(told) + 1) / (n + 1)) for w, n in df.items()}
    expected = {}
    for q, words in asked.items():
        pool = sum(weight[w] for w in words)
        raw = {v: sum(weight[w] for w in ws & words) ** 2 / pool / sum(weight[w] for w in ws) for v, ws in told.items() if len(ws & words) >= 2 or any(weight[w] >= 2 for w in ws & words)}
        for k, v in enumerate(sorted(raw, key=lambda v: (-round(raw[v], 9), v))[:10]):
            expected[q, v] = (round(raw[v], 4), k + 1)
    written, cut = [], labels.cut

    def counted(df):
        table = cut(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(labels, "cut", counted)
    links = _equal(spark, values)
    assert {(r.query_id, r.value): (r.score, r["rank"]) for r in search(values, queries, links, [], k=10).collect()} == expected
    # values with the common word are listed by their other words and ten of them by this one
    assert max(written) < 300 + 900 + 10 + 10 and written[-1] == 3 * 10


def test_few_queries_are_searched_in_all_partitions(spark, monkeypatch):
    """A short list of queries that meets many values is not left to one task."""
    values = _values(spark, [("w", "a b", "common rare1"), ("w", "a c", "common rare2")], "winery string, value string, token string")
    queries = spark.createDataFrame([("q", "w", "common")], "query_id string, winery string, query string")
    plans = []
    cut = labels.cut
    monkeypatch.setattr(labels, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    found = search(values, queries, _equal(spark, values.select("value", "token")), ["winery"], single=True).collect()
    assert {r.value for r in found} == {"a b", "a c"}
    assert "REPARTITION_BY_NUM" in plans[-1]
