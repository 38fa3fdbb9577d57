"""Radius joins, components, and queries with SQL, against brute force and SQL."""

from __future__ import annotations

import os
import random

import pytest

from pyspark.sql import functions as F

from quaver.llm import metric
from quaver.llm import queries as own
from tests.oracle import connection, rows

FOLDER = "/root/testdata/sf0.001"


def damerau(a: str, b: str) -> int:
    """Distance by the textbook recurrence."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, at = seen.get(b[j - 1], 0), last
            cost = a[i - 1] != b[j - 1]
            if not cost:
                last = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, at - 1] + (i - k - 1) + 1 + (j - at - 1))
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distances_to_pivots():
    """The distance to a long run of one letter is its length less the letter's count; a slip moves two of them at most, by one."""
    r = random.Random(0)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(60)]
    for c in "abc":
        assert all(damerau(t, c * 12) == 12 - t.count(c) for t in texts)
    for a in texts:
        for b in texts:
            if damerau(a, b) == 1:
                moved = [abs(a.count(c) - b.count(c)) for c in "abc"]
                assert max(moved) <= 1 and sum(moved) <= 2


def test_texts_at_distance_one_share_a_cell(spark):
    r = random.Random(2)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(1, 12)))
        k = r.randrange(len(a))
        pairs += [(a, a[:k] + a[k + 1 :]), (a, a[:k] + "é" + a[k + 1 :]), (a, a[:k] + "z" + a[k:]), (a, a[:k] + a[k : k + 2][::-1] + a[k + 2 :])]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.size(F.array_intersect(metric.cells(F.col("a")), metric.cells(F.col("b")))).alias("n"))
    assert df.filter("n = 0").count() == 0


def test_radius_pairs(spark):
    r = random.Random(1)
    base = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(60)]
    texts = set(base)
    for t in base:
        k = r.randrange(7)
        texts |= {t[:k] + t[k + 1 :], t[:k] + t[k + 1] + t[k] + t[k + 2 :], t[:k] + "z" + t[k + 1 :]}
    df = spark.createDataFrame([(t, "k") for t in sorted(texts)], "name string, kind string")
    got = {(x["name_a"], x["name_b"]) for x in metric.radius_pairs(df, "name", ["kind"]).collect()}
    assert got == {(a, b) for a in texts for b in texts if a < b and damerau(a, b) == 1}
    assert metric.radius_pairs(df.limit(0), "name", ["kind"]).count() == 0
    mixed = {(x["name_a"], x["name_b"]) for x in metric.radius_pairs(df, "name", ["kind"], longest=7).collect()}
    assert mixed == got
    split = {(x["name_a"], x["name_b"]) for x in metric.radius_pairs(df, "name", ["kind"], crowd=1).collect()}
    assert split == got


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["node"]: r["root"] for r in metric.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 63


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_same_as_sql(spark, name):
    got, want = own.queries()[name](spark, FOLDER).toPandas(), connection(FOLDER).sql(own.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
