from __future__ import annotations

import pytest

from corvine.operators.packed import explode_packed

CASES = [
    (None, []), ("", []), ("  \t", []), (",;|", []), ("Мерло", ["Мерло"]), (" Мерло , Сира;", ["Мерло", "Сира"]), ("a/b+c&d|e\tf\ng", list("abcdefg")), ("Мерло и Сира", ["Мерло", "Сира"]), ("Пино Нуар и Вионье и Гаме", ["Пино Нуар", "Вионье", "Гаме"]),
    ("Рислинг", ["Рислинг"]), ('"Мускат, белый"; Сира', ["Мускат, белый", "Сира"]), ('"Купаж ""Осень"""', ['Купаж "Осень"']), ('["a, b","c ""d"""]', ["a, b", 'c "d"']), (r'["x \"y\"", "z"]', ['x "y"', "z"]), ('{a,"b c",d}', ["a", "b c", "d"]), ("{}", []), ("[]", []),
    ("{a/b,c}", ["a/b", "c"]), ("Лозар (чёрный; старые лозы), Гаме", ["Лозар (чёрный; старые лозы)", "Гаме"]), ("Рислинг (49,5 %)", ["Рислинг (49,5 %)"]), ("Пино-Блан", ["Пино-Блан"]), ("Chasselas d'Or, Гаме 42%", ["Chasselas d'Or", "Гаме 42%"]),
    ('5" бочка, 7" бочка', ['5" бочка', '7" бочка']), ('"не закрыто, Гаме', ['"не закрыто', "Гаме"]), ("\ue0000\ue001,b", ["\ue0000\ue001", "b"]), ('"\ue0001\ue001", c', ["\ue0001\ue001", "c"]), ('" ", a', ["a"]), ("a,a", ["a", "a"]), ('"a" и "b, c"', ["a", "b, c"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, text, "clash", "clash") for i, (text, _) in enumerate(CASES)], "row_id long, packed string, pos string, grape string")
    found: dict[int, list] = {}
    for r in explode_packed(df, "row_id", "packed", "grape").orderBy("row_id", "pos").collect():
        found.setdefault(r.row_id, []).append((r.pos, r.grape))
    for i, (text, values) in enumerate(CASES):
        assert found.get(i, []) == list(enumerate(values, 1)), text


def test_brackets_in_brackets(spark):
    texts = {1: ("A (60%, old (a, b) vines), B", ["A (60%, old (a, b) vines)", "B"]), 2: ("A (1 (2 (3 (4, 5)))), B (x", ["A (1 (2 (3 (4, 5))))", "B (x"]), 3: ("A), (B, C)", ["A)", "(B, C)"])}
    found: dict[int, list] = {}
    for r in explode_packed(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "k long, v string"), "k", "v", "value").orderBy("k", "pos").collect():
        found.setdefault(r.k, []).append(r.value)
    assert found == {k: v for k, (_, v) in texts.items()}


def test_long_and_repeated(spark):
    long = ", ".join(f'"сорт {i}, клон"' for i in range(5000))
    huge = '"' + "x" * 200_000 + '", y'
    df = spark.createDataFrame([(1, long), (1, long), (2, huge)], "k long, v string")
    out = explode_packed(df, "k", "v", "value")
    assert out.where("k = 1").count() == 10_000
    assert [len(r.value) for r in out.where("k = 2").orderBy("pos").collect()] == [200_000, 1]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing(spark, rows):
    assert explode_packed(spark.createDataFrame(rows, "k long, v string"), "k", "v", "value").collect() == []
