from __future__ import annotations

from corvine.operators.rejects import CATALOG, OVERRIDES, load_kind, rejected_lines

CAT = "n,c,k,r,g,d,w,{},f"
LINES = [
    ("catalog", 1, "Название вина,Slug", None), ("catalog", 2, CAT.format("ok-slug_1"), None), ("catalog", 3, CAT.format(" ok ") + "\r", None), ("catalog", 4, CAT.format("Bad"), "invalid_value"), ("catalog", 5, CAT.format(""), "invalid_value"),
    ("catalog", 6, "a,b", "column_count"), ("catalog", 7, '"open,b,c', "bad_quoting"), ("catalog", 8, '"a"x,' + CAT.format("ok"), "bad_quoting"), ("catalog", 9, '"a" ,b', "bad_quoting"), ("catalog", 10, '5" x,c,k,r,g,d,w,ok,f', None),
    ("catalog", 11, '"a ""q"" b","c,c",k,r,g,"two\nlines",w,"ok",', None), ("catalog", 12, "", None), ("catalog", 13, None, None), ("catalog", 14, ",,,", None), ("catalog", 15, '"", ,""', None), ("catalog", 16, "n,c,k,r,g,d,w,ok,f,more", "column_count"),
    ("overrides", 2, "s,set,p.jpg,", None), ("overrides", 3, "s,set,,note", "invalid_value"), ("overrides", 4, "s,reject,,", None), ("overrides", 5, "s, confirm ,,", None), ("overrides", 6, "s,Set,p,", "invalid_value"), ("overrides", 7, "s,delete,p,", "invalid_value"),
    ("overrides", 8, "s,set,p", "column_count"), ("overrides", 9, 's,set,"p', "bad_quoting"), ("other", 2, "a,b", "column_count"), (None, 2, "a", "column_count"), ("overrides", None, "слаг,set,p,n", "invalid_value"),
]


def _df(spark, lines):
    return spark.createDataFrame([(i, k, n, text, "x", "y") for i, (k, n, text, _) in enumerate(lines)], "rec_id long, file_kind string, line_no int, raw_line string, reason string, cells string")


def test_reasons(spark):
    found = {r.rec_id: r.reason for r in rejected_lines(_df(spark, LINES)).collect()}
    assert found == {i: reason for i, (_, _, _, reason) in enumerate(LINES) if reason}


def test_loaded(spark):
    rows = {r.rec_id: r for r in load_kind(_df(spark, LINES), CATALOG).collect()}
    assert sorted(rows) == [1, 2, 9, 10]
    assert rows[10].name == 'a "q" b' and rows[10].category == "c,c" and rows[10].description == "two\nlines"
    assert sorted(r.rec_id for r in load_kind(_df(spark, LINES), OVERRIDES).collect()) == [16, 18, 19]


def test_empty_repeated_and_long(spark):
    assert rejected_lines(_df(spark, [])).collect() == []
    long = '"' + 'a""' * 100_000 + '",c,k,r,g,d,w,ok,f'
    df = spark.createDataFrame([(1, "catalog", 2, long), (1, "catalog", 3, "a,b"), (1, "catalog", 4, "a,b"), (None, "catalog", 5, "a")], "rec_id long, file_kind string, line_no int, raw_line string")
    assert sorted(((r.rec_id, r.reason) for r in rejected_lines(df).collect()), key=str) == [(1, "column_count"), (1, "column_count"), (None, "column_count")]
