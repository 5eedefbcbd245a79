from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from corvine.llm.canonical import THRESHOLD, decoration, judge, map_rows, map_values, omissions, tokens
from corvine.llm.spelling import cost, least_matching, osa, readings, skeleton

LIST = [
    (1, "winery", "Арфитук", "Дорвинласия Групп"), (2, "winery", "Шато Дольмар", None), (3, "winery", "Усадьба Дольмар", None), (4, "winery", "Белая Цапля", None), (5, "winery", "Белая Цапля Резерв", None), (6, "winery", "Velmont Hills", None),
    (7, "winery", "Тихий Яр", None), (8, "winery", "Гранитный Колодец", None), (101, "region", "Долина Асмары", None), (102, "region", "Тамринский полуостров", None), (103, "region", "Верхняя Пелагия", None), (104, "region", "Нижняя Пелагия", None), (105, "region", "Haut-Morvane", None),
]
MEANT = [
    ("winery", "АРФИТУК", 1), ("winery", "Афритук", 1), ("winery", "«Арфитукк»", 1), ("winery", "Arfituk", 1), ("winery", "Fhabner", 1), ("winery", "ООО «Арфитук»", 1), ("winery", "Арфитук, 0,75 л", 1), ("winery", "дорвинласия групп", 1), ("winery", "Арфитyк вино", 1),
    ("winery", "Velm0nt Hills", 6), ("winery", "Hills Velmont", 6), ("winery", "велмонт хиллс", 6), ("winery", "Velm. Hills", 6), ("winery", "Tikhij Iar", 7), ("winery", "Tuxuй Яp", 7), ("winery", "Белая Цапля резерв", 5), ("winery", "белая цапля", 4), ("winery", "Granitniy Kolodec", 8),
    ("winery", "Дольмар", -1), ("winery", "Гранитный Вокзал", -1), ("winery", "Импорт", -1), ("winery", "Долина Асмары", -1), ("winery", "н/д", -1), ("winery", "???", -1), ("region", "Асмары", 101), ("region", "дол. Асмары", 101), ("region", "Ljkbyf Fcvfhs", 101), ("region", "Россия, Долина Асмары", 101),
    ("region", "Тамринский п-ов", 102), ("region", "Пелагия нижняя", 104), ("region", "верхняя пелагuя", 103), ("region", "хаут-морване", 105), ("region", "Haut-Morvane / сухое", 105),
]

#: Decoration is learnt where it stands beside three different entries.
TEACHING = [("winery", f"{name}, {words}") for name in ("Velmont Hills", "Тихий Яр", "Гранитный Колодец") for words in ("ООО", "0,75 л", "вино")] + [
    ("region", f"{name} {words}") for name in ("Тамринский полуостров", "Верхняя Пелагия", "Haut-Morvane", "Долина Асмары") for words in ("россия", "/ сухое")
]


def _canon(spark, rows=LIST):
    return spark.createDataFrame(rows, "canon_id long, field string, canon_value string, alt_name string")


def test_meanings(spark):
    rows = [("t", i, f, v) for i, (f, v, _) in enumerate(MEANT)] + [("u", i, f, v) for i, (f, v) in enumerate(TEACHING)]
    df = spark.createDataFrame(rows, "src_table string, src_id long, field string, value string")
    found = {r.src_id: r.canon_id for r in map_rows(df, _canon(spark)).collect() if r.src_table == "t"}
    assert {MEANT[i][1]: c for i, c in found.items()} == {v: c for _, v, c in MEANT}


def test_blank_exact_repeated_empty(spark):
    schema = "src_table string, src_id long, field string, value string"
    rows = spark.createDataFrame([("t", 1, "winery", None), ("t", 2, "winery", "  "), ("t", 3, "winery", "Арфитук"), ("t", 4, "winery", "арфитук"), ("t", 4, "winery", "арфитук"), ("t", 5, None, "арфитук"), ("t", 6, "region", "x" * 50_000)], schema)
    assert sorted((r.src_id, r.canon_id) for r in map_rows(rows, _canon(spark)).collect()) == [(4, 1), (4, 1), (5, -1), (6, -1)]
    assert [r.canon_id for r in map_rows(rows.where("src_id = 4"), _canon(spark, [])).collect()] == [-1, -1]
    assert map_rows(rows.limit(0), _canon(spark)).collect() == []


def test_prefix_filter_loses_nothing(spark):
    """Every pair that the edit check takes and that is similar enough is found: against all pairs."""
    rng = random.Random(7)
    letters = "абвгдеиклмнорстуф"
    values = set()
    for _, field, name, _ in LIST:
        for _ in range(30):
            word = list(name)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(word))
                word[at : at + rng.randint(0, 1)] = rng.choice(letters)
            values.add((field, "".join(word)))
    expected = {}
    for field, value in values:
        for canon_id, f, name, alt in LIST:
            for listed in (name, alt):
                if f != field or not listed:
                    continue
                for r in readings(value):
                    for target in readings(listed):
                        a, b = set(tokens(r)), set(tokens(target))
                        if a and b and len(a & b) / len(a | b) >= THRESHOLD and cost(r, target) is not None:
                            expected.setdefault((field, value), set()).add(canon_id)
    df = spark.createDataFrame(sorted(values), "field string, value string")
    found = {(r.field, r.value): r.canon_id for r in map_values(df, _canon(spark)).collect()}
    assert set(expected) <= set(found)
    assert all(found[k] in v or found[k] == -1 for k, v in expected.items())


def test_short_names_without_their_kind(spark):
    canon = _canon(spark, [(1, "region", "Острова Мирт", None), (2, "region", "Побережье Фенты", None), (3, "region", "Долина Асмары", None), (4, "winery", "Церфиут", None), (5, "winery", "Velmont Hills", None)])
    meant = {("region", "Мирт"): 1, ("region", "Фенты"): 2, ("region", "о. Мирт"): 1, ("region", "п. Фенты"): 2, ("region", "Асмары"): 3, ("winery", "Целфнут"): 4, ("winery", "Цервиуг"): 4, ("winery", "V. Hills"): 5, ("region", "Мопс"): -1, ("region", "Острова"): -1}
    df = spark.createDataFrame(list(meant), "field string, value string")
    found = {(r.field, r.value): r.canon_id for r in map_values(df, canon).collect()}
    assert {k: found.get(k, -1) for k in meant} == meant


def _runs(text):
    return re.findall(r"[^\W_]+", text.lower())


def _learnt(values, names):
    """Decoration of each field and the words that may be left out of each listed name, by loops over everything."""
    extra, gone = {}, {}
    for field in ("winery", "region"):
        beside, bare = {}, {}
        for f, value in values:
            if f != field:
                continue
            read = _runs(value)
            full = _runs(re.sub(r"[^\W_]{1,3}\.", " ", value.lower()))
            bare[" ".join(full)] = bare.get(" ".join(full), 0) + (2 if full == read else 1)
            for canon_id, g, *listed in names:
                for own in (set(_runs(n)) for n in listed if n and g == field):
                    for word in set(read) - own if own <= set(read) else ():
                        beside.setdefault(word, set()).add(canon_id)
        extra[field] = {w for w, ids in beside.items() if len(ids) >= 3}
        rests = [(" ".join(ws[:i] + ws[i + 1 :]), c) for c, g, *listed in names for n in listed if n and g == field for ws in [_runs(n)] for i in range(len(ws)) if len(ws) > 1]
        clear = {rest for rest, _ in rests if len({c for r, c in rests if r == rest}) == 1}
        for _, g, *listed in names:
            for name in (n for n in listed if n and g == field):
                ws = _runs(name)
                left = {w for i, w in enumerate(ws) if " ".join(ws[:i] + ws[i + 1 :]) in clear and bare.get(" ".join(ws[:i] + ws[i + 1 :]), 0) > bare.get(w, 0)}
                gone[field, name] = frozenset(map(skeleton, left))
    return extra, gone


def test_learnt_words(spark):
    canon = _canon(spark)
    listed = canon.selectExpr("canon_id", "field", "explode(array(canon_value, alt_name)) as name").where("name is not null")
    values = {*TEACHING, ("winery", "ООО дом Тихий Яр"), ("region", "Асмары"), ("region", "дол. Асмары"), ("region", "Долина"), ("winery", "Цапля"), ("winery", "Белая"), ("winery", ""), (None, "ооо")}
    df = spark.createDataFrame(sorted(values, key=str), "field string, value string")
    found = {(r.field, r.word) for r in decoration(df, listed).collect()}
    assert found == {("winery", w) for w in ("ооо", "0", "75", "л", "вино")} | {("region", w) for w in ("россия", "сухое")}
    assert {(r.name, *r.gone) for r in omissions(df, listed).collect()} == {("Долина Асмары", skeleton("долина"))}


def test_many_words_in_any_order():
    """No bound on the words of a name: swapped words cost the same with six words as with two."""
    name = "северный берег старого озера у леса"
    swapped = "берег северный старого озера у леса"
    six, other = (" ".join(map(skeleton, t.split())) for t in (name, swapped))
    assert cost(other, six) == pytest.approx(0.01) == cost("kolodec granitni", "granitni kolodec")
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 6)
        table = [[rng.choice([0, 0.25, 1, 2, 3]) for _ in range(n)] for _ in range(n)]
        assert least_matching(table)[0] == pytest.approx(min(sum(table[i][p[i]] for i in range(n)) for p in permutations(range(n))))


def test_repeated_own_word(spark):
    """A word that is decoration and part of a listed name goes once."""
    canon = _canon(spark, [*LIST, (9, "winery", "Дом Фескари", None)])
    rows = [("winery", f"дом «{n}»") for n in ("Арфитук", "Тихий Яр", "Velmont Hills", "Дом Фескари")]
    found = {r.value: r.canon_id for r in map_values(spark.createDataFrame(rows, "field string, value string"), canon).collect()}
    assert found == {"дом «Арфитук»": 1, "дом «Тихий Яр»": 7, "дом «Velmont Hills»": 6, "дом «Дом Фескари»": 9}


def test_candidates_are_complete(spark):
    """Without a floor: exactly the pairs that the rule takes, against all pairs, with kinds left out, abbreviations and swaps."""
    rng = random.Random(11)
    names = [*LIST, (6, "region", "Острова Мирт", None), (7, "region", "Побережье Фенты", None), (8, "winery", "Церфиут", "Cerfiut")]
    values = set()
    for _, field, name, _ in names:
        for _ in range(25):
            words = name.split(" ")
            if len(words) > 1 and rng.random() < 0.4:
                words.pop(rng.randrange(len(words)))
            words = [w[: rng.randint(1, 3)] + "." if rng.random() < 0.2 else w for w in words]
            rng.shuffle(words)
            word = list(" ".join(words))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(word))
                if rng.random() < 0.4:
                    word[at : at + 2] = word[at : at + 2][::-1]
                else:
                    word[at : at + rng.randint(0, 1)] = rng.choice("абвгдеиклмнорстуф")
            values.add((field, "".join(word)))
    values = {v for v in values if v[1].strip()}
    extra, gone = _learnt(values, names)
    own = {f: {w for _, g, *listed in names for n in listed if g == f and n for w in _runs(n)} for f in ("winery", "region")}
    want = {}
    for field, value in values:
        near = {}
        for canon_id, f, name, alt in names:
            worn = frozenset(extra[field] & set(_runs(value)))
            found = [n for listed in (name, alt) if f == field and listed and (n := judge(value, listed, worn, worn & own[field], gone.get((field, listed), frozenset())))]
            if found:
                near[canon_id] = min(found)
        if near:
            best = [c for c, n in near.items() if n == min(near.values())]
            want[field, value] = best[0] if len(best) == 1 else -1
    df = spark.createDataFrame(sorted(values), "field string, value string")
    found = {(r.field, r.value): r.canon_id for r in map_values(df, _canon(spark, names)).collect()}
    assert len(want) > 100 and found == want


@pytest.mark.parametrize(("a", "b", "n"), [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "abd", 1), ("abc", "ab", 1), ("abc", "xyz", 3), ("", "ab", 2)])
def test_edits(a, b, n):
    assert osa(a, b, 5) == n and osa(a, b, 0) == min(n, 1)
