from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corvine.functions import tokens as T
from corvine.functions.stemming import stem
from corvine.operators.search import field_search, linked_tokens


def _map(spark, function, values):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(function(F.col("v")).alias("x")).collect()]


@pytest.mark.parametrize(("text", "level"), [("Вино ПОЛУСУХОЕ", "полусухое"), ("пино п.сл.", "полусладкое"), ("x-krasnoe-polusuhoe-13", "полусухое"), ("экстра брют", "экстра брют"), ("Игристое брют экстра брют", "экстра брют"), ("сухое и сладкое", None), ("", None), ("брют натюр", "брют натюр"), ("Сухой Лиман", "сухое")])
def test_sugar(spark, text, level):
    assert _map(spark, T.sugar_level, [text]) == [level]


def test_years(spark):
    texts = ["Пино 2019 и снова 2019", "2018 2019", "розлив 12.2019", "1861", "лот 20195", "(2020)", None]
    assert _map(spark, T.vintage, texts) == [2019, None, None, None, None, 2020, None]
    assert _map(spark, T.card_year, texts) == [2019, 2018, 2019, None, None, 2020, None]


def test_alcohol(spark):
    assert _map(spark, T.alcohol_contents, ["12,5 % и 13.5%", "0,75 л", "алк. 45 %", "14 об. x"]) == [[12.5, 13.5], [], [], [14.0]]


def test_words_and_keys(spark):
    assert _map(spark, T.words, ["Чёрный Жук, вино 2020 да"]) == [["chernyy", "zhuk"]]
    pairs = [("пино гри", "Pinot Gris"), ("сира", "Syrah"), ("вионье", "Viognier"), ("брют", "Brut")]
    for left, right in pairs:
        keys = [[r.k for r in spark.createDataFrame([(x,)], "x string").select(F.explode(T.raw_tokens(F.col("x"))).alias("t")).select(T.phonetic_key(F.col("t")).alias("k")).collect()] for x in (left, right)]
        assert keys[0] == keys[1], (left, right, keys)


def test_stable_hash(spark):
    def plain(s):
        h = 0
        for ch in s:
            h = (31 * h + ord(ch)) % 2**32
        return h

    values = ["", "a", "слаг-1", "x" * 500]
    assert _map(spark, T.stable_hash, values) == [plain(v) for v in values]


def test_stems():
    for group in (["виноградник", "виноградники", "винограднике"], ["дегустация", "дегустации", "дегустацией"], ["бутылка", "бутылки"], ["красивая", "красивый", "красивое"]):
        assert len({stem(w) for w in group}) == 1, group


def test_fuzzy_links_against_brute_force(spark):
    vocabulary = ["arfituk", "taskinezar", "dolmar", "veresk", "usadba", "usadbaring"]
    queries = ["arfitukk", "taskinzar", "dolmar", "dolmars", "usadb", "verezk", "usadbaringov", "zzz"]

    def similar(a, b):
        if b in vocabulary:
            return 1.0 if a == b else 0.0
        if a == b:
            return 1.0
        short, long = sorted((a, b), key=len)
        if len(long) - len(short) > 2:
            return 0.9 if len(short) >= 6 and long.startswith(short) else 0.0
        return 0.0 if len(short) < 5 else SequenceMatcher(None, a, b).ratio()

    expected = {(a, b) for a in vocabulary for b in queries if similar(a, b) >= 0.82}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "token string")
    found = {(r.token, r["query"]) for r in linked_tokens(frame(vocabulary), frame(queries)).collect()}
    assert found == expected


def test_field_search_needs_two_words_or_a_rare_one(spark):
    values = spark.createDataFrame([("a b", "a"), ("a b", "b"), ("a c", "a"), ("a c", "c"), ("a d", "a"), ("a d", "d")], "value string, token string")
    queries = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c")], "query_id long, token string")
    found = {(r.query_id, r.value) for r in field_search(values, queries, common=1.5).collect()}
    assert (1, "a b") not in found and {(2, "a b"), (3, "a c")} <= found


def test_fuzzy_links_of_swapped_and_misread_letters(spark):
    """Words of 5 to 14 letters with swapped, changed and lost letters, against all pairs; some share no three letters in a row."""
    rng = random.Random(3)
    known = ["usadba", "bodega", "kuvshin", "kruskivel", "gryada", "taman", "arfituk", "vinogradnik", "shampanskiye", "kolodets", "gornyy", "dolmarskaya", "konstantinov"]
    unknown = {"usdaba", "boedga", "kushvin", "krskviel", "grdyaa"}
    for word in known:
        for _ in range(60):
            letters = list(word)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(letters) - 1)
                kind = rng.randrange(3)
                if kind == 0:
                    letters[at : at + 2] = letters[at : at + 2][::-1]
                else:
                    letters[at : at + kind - 1] = rng.choice("abdegiklnorst")
            unknown.add("".join(letters))
    unknown -= set(known)
    expected = {(a, b) for a in known for b in unknown if abs(len(a) - len(b)) <= 2 and min(len(a), len(b)) >= 5 and SequenceMatcher(None, a, b).ratio() >= 0.82}
    grams = lambda w: {w[i : i + 3] for i in range(len(w) - 2)}
    assert sum(not grams(a) & grams(b) for a, b in expected) >= 5
    frame = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "token string")
    found = {(r.token, r["query"]) for r in linked_tokens(frame(known), frame(unknown)).collect()}
    assert found == expected
