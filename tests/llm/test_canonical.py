from collections import defaultdict

import regex

from skeinlake.llm import canonical as C
from skeinlake.session import table

from .canonical_brute import canon

def brute(rows):
    groups = defaultdict(list)
    for row, scope, text in rows:
        if text and regex.search(r"[\p{L}\p{Nd}]", text):
            groups[scope, canon(text)].append(row)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_found_equals_brute_force(spark, data):
    rows = table(spark, data.replace("0.001", "0.01"), "event_rows")
    got = {tuple(r) for r in C.copies_of(rows, "row_no", "text", ["session_uuid"]).collect()}
    assert got == brute([tuple(r) for r in rows.select("row_no", "session_uuid", "text").collect()])


def test_dress(spark):
    call = '[tool_use Edit] {"b": {"y": 1, "x": "A b"}, "a": [2, 1]}'
    same = [
        (1, "s", "Straße, ok!"), (2, "s", "STRASSE  OK"), (3, "s", call), (4, "s", '[tool_use Edit] {"a":[2,1],\n "b":{"x":"A b","y":1}}'),
        (5, "s", call.upper()), (6, "s", '[tool_use Edit] {"a": [1, 2], "b": {"x": "A b", "y": 1}}'),
        (7, "t", "Straße, ok!"), (8, None, "x1"), (9, None, "X 1."), (10, "s", "..."), (11, "s", "!!"), (12, "s", None), (13, "s", ""),
        (14, "s", "café"), (15, "s", "cafe"), (16, "s", "tool {b a}"), (17, "s", "tool {a b}"),
    ]
    df = spark.createDataFrame(same, "row_no long, session_uuid string, text string")
    got = {tuple(r) for r in C.copies_of(df, "row_no", "text", ["session_uuid"]).collect()}
    assert got == {(1, 2), (3, 4), (3, 5), (8, 9)}
    counts = {tuple(r) for r in C.collapse_copies(df, "row_no", "text", ["session_uuid"]).collect()}
    assert {(1, 2), (3, 3), (6, 1), (7, 1), (8, 2)} <= counts and sum(n for _, n in counts) == 13


def test_hot_group_long_text_clashing_columns_and_empty(spark):
    rows = [(i, "s", "word " * 3 if i % 3 else "lone%d" % i, "x", "y") for i in range(3000)] + [(9001, "s", "z" * 500_000, "", ""), (9002, "s", "Z" * 500_000 + "!", "", "")]
    df = spark.createDataFrame(rows, "row_no long, session_uuid string, text string, _h1 string, _id string")
    got = C.copies_of(df, "row_no", "text", ["session_uuid"]).collect()
    assert len(got) == 1999 + 1 and {r[0] for r in got} == {1, 9001}
    assert C.copies_of(df.limit(0), "row_no", "text", ["session_uuid"]).count() == 0


def test_fields_that_differ_in_case_only(spark):
    texts = ['[tool_use X] {"A":1,"a":2,"b":3}', '[tool_use X] {"b":3,"a":2,"A":1}', '[tool_use X] {"B":1,"a":2}', '[tool_use x] {"A":2,"b":1}']
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "row_no long, text string, s string")
    assert {tuple(r) for r in C.copies_of(df, "row_no", "text", ["s"]).collect()} == {(0, 1), (2, 3)}
