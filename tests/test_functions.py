import random
import re
import time

import pytest
from pyspark.sql import functions as F

from attesta.functions import json as J
from attesta.functions import text as T
from attesta.functions import values as V
from attesta.functions.matches import find_all, page_matches
from attesta.operators.extract import PHONE_PATTERNS


def apply(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.out for r in rows.select("i", make(F.col("t")).alias("out")).orderBy("i").collect()]


def test_tokenize(spark):
    cases = {"a ab abc I x y": {"ab", "abc"}, "hello-world_test": {"hello", "world", "test"},
             "helloéworld": {"hello", "world"}, "": set(), "A1 B22 the THE": {"a1", "b22", "the"}}
    assert [set(x) for x in apply(spark, list(cases), T.tokenize)] == list(cases.values())


def test_overlap(spark):
    pairs = [("hello world", "hello friend", 0.5), ("", "x yy", 0.0), ("a b", "a b", 0.0), ("one two", "two one", 1.0)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, d string, want double")
    got = rows.select("i", "want", T.overlap(T.tokenize(F.col("q")), T.tokenize(F.col("d"))).alias("s")).orderBy("i")
    assert all(r.s == r.want for r in got.collect())


def test_normalize_text(spark):
    cases = {"hello...world": "helloworld", "test-value": "test-value", "  A \t\n B ": "a b",
             "45 Maple Ave & Co": "45 maple ave  co", "x  y\x1fz": "x y z", "(x)": "x"}
    assert apply(spark, list(cases), T.normalize_text) == list(cases.values())


def test_normalize_date(spark):
    cases = {"1/5/2024": "2024-01-05", "Jan 15 2024": "2024-01-15", "15 January 2024": "2024-01-15",
             "2024/3/7": "2024-03-07", "12-31-1999": "1999-12-31", "not a date": None, "99/99/2024": "2024-99-99",
             "5 Sept 1990": None, "Jan151990": "1990-01-15", "MAY 5,\n1980": "1980-05-05", "on 2024-01-01": None}
    assert apply(spark, list(cases), V.normalize_date) == list(cases.values())


def test_normalize_phone(spark):
    cases = {"(555) 123-4567": ("15551234567", True), "+1 555-123-4567": ("15551234567", False),
             "5551234567": ("15551234567", True), "123": ("123", False)}
    assert [(p.digits, p.assumed) for p in apply(spark, list(cases), V.normalize_phone)] == list(cases.values())


@pytest.mark.parametrize("pattern", [r"\d+", r"[a-c]\s?\d", r"\b\w\w\b", r"\d\s+\d"])
def test_matches_and_lines_agree_with_a_plain_scan(spark, pattern):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aB1 2\nc\u0130") for _ in range(rng.randrange(60))) for _ in range(60)] + [""]
    scan = page_matches([pattern, "b"], True, ["c1", "b"], 5)
    want, got = [], apply(spark, texts + [None], scan)
    for text in texts:
        rows = []
        for tag, p in enumerate([pattern, "b"]):
            for m in re.finditer(p, text, re.I):
                left, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
                near = text.lower()[max(0, m.start() - 5):m.start()]
                rows.append((tag, m.group(0).strip(), text[left:len(text) if end < 0 else end].strip(), "c1" in near or "b" in near))
        want.append(rows)
    assert [[(m.tag, m.raw, r.lines[m.line], m.anchored) for m in r.found] for r in got] == want + [[]]


def test_a_page_twice_as_long_costs_about_twice():
    shapes = [re.compile(p) for p in PHONE_PATTERNS]
    spent = []
    for n in (2000, 4000, 8000):
        page = "\n".join(f"Tel: 613-555-{i % 10000:04d} and 5551234567, cell" for i in range(n))
        times = []
        for _ in range(3):
            start = time.perf_counter()
            found = find_all(page, shapes, ["tel", "cell"], 50)[0]
            times.append(time.perf_counter() - start)
        assert len(found) >= 2 * n
        spent.append(min(times))
    assert spent[1] < 3 * spent[0] and spent[2] < 3 * spent[1]


def test_json_needs_one_whole_value(spark):
    texts = ['{"a": 1}', '{"a": 1} x', "[1] , [2]", "1} x", "", "null", "[]", '"s"', "{", '{"a":1,"a":2}']
    kinds = apply(spark, texts, lambda t: F.coalesce(J.kind(J.parse(t)), F.lit("bad")))
    assert kinds == ["OBJECT", "bad", "bad", "bad", "bad", "VOID", "ARRAY", "STRING", "bad", "OBJECT"]
    assert apply(spark, texts[-1:], lambda t: J.member(J.parse(t), "a", "int")) == [2]


def test_given_values(spark):
    texts = ['""', '"0"', "0", "0.0", "1", "false", "true", "null", "[]", "[0]", "{}", '{"a":0}']
    got = apply(spark, texts, lambda t: J.is_given(J.parse(t)))
    assert got == [False, True, False, False, True, False, True, False, False, True, False, True]


def test_utc_text(spark):
    row = spark.range(1).select(T.utc_text(F.lit("2025-12-12 11:40:12.123456").cast("timestamp")).alias("t")).first()
    assert row.t == "2025-12-12T11:40:12.123456Z"
