import random

import pytest

from siftwork.operators import badrows as B

GOOD = "Иванов Иван,8 (495) 123-45-67,112-233-445 95"


@pytest.mark.parametrize(
    "raw, reason",
    [
        (GOOD, None), ('"Иванов, Иван",NA,', None), ('"Иванов ""Ваня""", 74951234567 ,null', None), ('"Иванов\nИван",,None', None),
        ('"Иванов,8,1', "quoting"), ('Ива"нов,8,1', "quoting"), ('"Иванов" мл.,8,1', "quoting"), ("", "columns"), (None, "columns"), ("а,б", "columns"), ("а,,,", "columns"),
        (",74951234567,", "bad_name"), ("123,bad,bad", "bad_name"), ("Иванов,123,", "bad_phone"), ("Иванов,94951234567,", "bad_phone"), ("Иванов,,000-000-000 00", "bad_snils"), ("Иванов,,123-456-789 01", "bad_snils"), ("Иванов,,нет", "bad_snils"),
    ],
)
def test_reasons(raw, reason):
    assert B.parse_one(raw, ",").reason == reason


def test_location_and_recovery():
    text = 'Петров,,\n"Сломан,1,2\nИванов Иван,,112-233-445 95\nещё "один",,\nСидоров,84951234567,\n'
    got = B.Parser(text, ",").records()
    assert [(r.reason, r.start) for r in got] == [(None, 0), ("quoting", 9), (None, 21), ("quoting", 49), (None, 62)]
    assert got[1].error_pos == 9 and got[1].error_text == "unclosed quote"
    assert got[3].error_text == "quote inside an unquoted field"


def test_round_trip():
    import csv
    import io

    r = random.Random(1)
    rows = [["".join(r.choice('ab",; \nЯ') for _ in range(r.randrange(1, 9))) for _ in range(3)] for _ in range(300)]
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    assert [x.fields for x in B.Parser(out.getvalue(), ",").records()] == rows


def test_table(spark):
    lines = [
        (1, "p", 1, "﻿ФИО;Телефон;СНИЛС", 9), (2, "p", 2, "Иванов;8 495 123-45-67;112-233-445 95", 9), (3, "p", 3, GOOD, 9), (4, "p", None, None, 9), (5, "q", 2, GOOD, 9), (6, "q", 2, GOOD, 9),
        (7, None, 3, GOOD, 9), (8, "p", 4, "я" * 200_000, 9), (9, "p", 5, '"x;1;2\nИванов;;', 9),
    ]
    df = spark.createDataFrame(lines, "line_id long, path string, line_no long, raw_line string, _header int")
    got = {r.line_id: r for r in B.parse_lines(df).collect()}
    assert {k: r.reason for k, r in got.items()} == {2: None, 3: "columns", 4: "columns", 5: None, 6: None, 7: None, 8: "columns", 9: "quoting"}
    assert (got[2].phone, got[2].snils) == ("74951234567", "11223344595")
    assert [tuple(r) for r in got[9].recovered] == [("Иванов;;", "Иванов", None, None)]
    assert B.valid_rows(df).count() == 4 and B.bad_rows(df).count() == 4
    assert B.parse_lines(df.limit(0)).count() == 0


def test_hot_join_spreads(spark, monkeypatch):
    from siftwork import util

    monkeypatch.setattr(util, "BROADCAST_ROWS", 1)
    left = spark.range(500).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('k', id % 7) end as k")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    assert sorted(util.hot_join(left, right, "k", salt="id").select("id", "v").collect()) == sorted(left.join(right, "k", "left").select("id", "v").collect())


def test_recovered_records_are_loaded(spark):
    rows = [(1, "a", 1, "ФИО,Телефон,СНИЛС"), (2, "a", 2, '"Сломан,1,2\nИванов Иван,84951234567,112-233-445 95\nПетров,,'), (3, "a", 3, "Целый,,"), (4, "a", 4, None)]
    df = spark.createDataFrame(rows, "line_id long, path string, line_no long, raw_line string")
    got = sorted(tuple(r) for r in B.recovered_rows(df).collect())
    assert [g[:1] + g[4:] for g in got] == [(2, "Иванов Иван", "74951234567", "11223344595"), (2, "Петров", None, None)]
    assert B.recovered_rows(df.limit(0)).count() == 0 and [r.line_id for r in B.valid_rows(df).collect()] == [3]
