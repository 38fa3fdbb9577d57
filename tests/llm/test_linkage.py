"""Match values against other ways to the optimum, and links that short or slipped names must not lose."""

from __future__ import annotations

import numpy as np
import pytest

from quaver.llm import linkage
from quaver.session import table


def loss(x, plus, minus):
    return (plus * (1 - x) ** 2 + minus * x**2).sum()


def one_entity(plus, minus):
    """Optimum of a single entity from its multiplier, by bisection."""
    low, high = 0.0, 2 * plus.max()
    value = lambda m: np.maximum(2 * plus - m, 0) / (2 * (plus + minus))
    if value(0.0).sum() <= 1:
        return value(0.0)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle).sum() > 1 else (low, middle)
    return value(high)


def test_one_entity():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = rng.integers(1, 7)
        plus, minus = rng.choice([1.5, 3.0, 4.0, 5.5, 7.1], n), rng.choice([0.5, 1.4, 2.1, 3.0, 5.0], n)
        x = linkage.solve(plus, minus, np.zeros(n, int), np.arange(n), np.zeros(n, int))
        assert np.abs(x - one_entity(plus, minus)).max() < 1e-3
    # weak rivals count: none is cut away before the optimum
    x = linkage.solve(np.array([1.5, 3.0, 4.0]), np.array([1.4, 0.5, 2.1]), np.zeros(3, int), np.arange(3), np.zeros(3, int))
    assert x.max() == pytest.approx(0.487, abs=1e-3)


def test_both_sides_share():
    """Feasible, and no feasible neighbour is better."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        left, right = (g.ravel() for g in np.mgrid[0:3, 0:3])
        plus, minus = rng.uniform(0.1, 6, 9), rng.uniform(0.1, 4, 9)
        x = linkage.solve(plus, minus, left, right, np.zeros(9, int))
        assert max(np.bincount(left, x).max(), np.bincount(right, x).max()) < 1 + 1e-3
        best = loss(x, plus, minus)
        for _ in range(300):
            y = np.clip(x + rng.normal(0, 0.05, 9), 0, None)
            y /= max(1.0, np.bincount(left, y).max(), np.bincount(right, y).max())
            assert loss(y, plus, minus) > best - 1e-2


def test_large_parts_give_the_same(spark):
    rng, rows = np.random.default_rng(5), []
    for part in range(4):
        rows += [(f"{part}-{e}", part * 10 + r, float(rng.uniform(0.5, 6)), float(rng.uniform(0.2, 3))) for e in range(4) for r in range(3) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "_entity string, record_id long, plus double, minus double")
    few, many = ({(r._entity, r.record_id): r.value for r in linkage.match_values(df, local).collect()} for local in (50_000, 5))
    assert few.keys() == many.keys() and len(few) == len(rows)
    assert max(abs(few[k] - many[k]) for k in few) < 0.02


FIELDS = "name string, artist string, year string, genre string, charter string, album string"


def match(spark, folders, records):
    left = spark.createDataFrame(folders, f"folder string, {FIELDS}")
    right = spark.createDataFrame(records, f"record_id long, {FIELDS}")
    groups = spark.createDataFrame([], "group_id long, ord long, folder string")
    names = spark.createDataFrame([("William", "Bill")], "given string, nickname string")
    return {r.folder: r.record_id for r in linkage.matched(left, right, groups, names).collect()}


def test_short_and_slipped_names(spark):
    rest = ("2001", "Rock", "x", "Some Album")
    acts = [("U2", "U2"), ("X", "X"), ("嵐", "嵐"), ("Selmirik Snaiixulish", "S. Snaixulish"), ("The Nusso Tholidnnonts", "Nusso Tholdinnonts"), ("Bill Barnwell", "William Barnwel"), ("JoeTanner", "Joe Taner")]
    folders = [(f"f{k}", f"Rusted Kingdom {k}", a, *rest) for k, (a, _) in enumerate(acts)]
    records = [(k, f"Rusted Kingdom {k}", b, *rest) for k, (_, b) in enumerate(acts)]
    assert match(spark, folders, records) == {f"f{k}": k for k in range(len(acts))}


def test_a_record_has_one_partner(spark):
    """A folder of an edition without a record leaves the other edition's record to its better partner."""
    folders = [("a", "Song", "The Act", "1999", "Rock", "x", "First"), ("b", "Song", "The Act", None, "Rock", None, None)]
    records = [(1, "Song", "The Act", "1999", "Rock", "x", "First")]
    assert match(spark, folders, records) == {"a": 1}


def test_missing_articles_and_artists(spark):
    """Articles may be missing from a title; where no artist is stated the album stands for it, and never the title alone."""
    folders = [("a", "Through Copper Carousel", "The Act", "1999", None, None, None), ("b", "Harbor and Bridge", None, "2001", None, "x", "Big Album"), ("c", "Lonely", "Unknown Artist", "2001", None, None, None)]
    records = [(1, "Through the Copper Carousel", "The Act", "1999", None, None, None), (2, "Harbor & Bridge", "Other Act", "2001", None, "x", "Big Album"), (3, "Lonely", "Third Act", "2001", None, None, None)]
    assert match(spark, folders, records) == {"a": 1, "b": 2}


def test_no_side_that_grows_is_broadcast(spark, monkeypatch):
    """Keys, texts and rows of both tables meet by shuffles; only the list of nicknames passes through the driver."""
    plans = []
    real = linkage.durable

    def seen(df):
        out = real(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(linkage, "durable", seen)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    left, right, groups, nicknames = (table(spark, "/root/testdata/sf0.001", t) for t in ("ini_fields", "records", "dupgroups", "nicknames"))
    found = linkage.candidates(linkage._read(left, "folder"), linkage._read(right, "record_id"), nicknames)
    seen(found)
    merged, sent = ([p.split("== Initial Plan ==")[0].count(f"{kind}Join") for p in plans] for kind in ("SortMerge", "BroadcastHash"))
    assert sent == [1, 1, 0] and merged[-1] >= 6
