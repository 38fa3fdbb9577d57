"""Searches that compare few pairs and still lose none."""

from __future__ import annotations

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from quaver.operators import align, duplicates, enrich


def names(n: int) -> list[str]:
    """Names of few different words, as in a library, with slips."""
    r = random.Random(7)
    words = ["the", "and", "quartet", "brothers", "harbor", "window", "meadow", "silver", "kind", "lorren", "velvet", "satellite"]
    out = set()
    for _ in range(n):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 14)))
        at = r.randrange(len(t))
        out |= {t, t[:at] + t[at + 1 :], t[:at] + "q" + t[at:], t[:at] + "é" + t[at + 1 :]}
    return sorted(out)


def test_similar_texts_are_all_found_by_few_keys(spark):
    """Also texts of many slips; a name of usual length had 250 keys before."""
    texts = names(60)
    got = {(x["a"], x["b"]) for x in duplicates.similar_texts(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 90.0).collect()}
    assert got == {(a, b) for a in texts for b in texts if a == b or SequenceMatcher(None, a, b).ratio() * 100 >= 90.0}
    assert max(len(t) for t in texts) > 90 > min(len(t) for t in texts)
    assert max(len(duplicates._other_keys(t, 90.0)) for t in texts if len(t) <= 22) < 60


def test_letters_never_rule_out_a_similar_pair(spark):
    """The bound by letters holds in Python and in the plan, and it leaves few of the other pairs."""
    texts = names(25)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", duplicates.letters("t").alias("bits"))
    left = [(r.a, r.b) for r in df.toDF("a", "_a").crossJoin(df.toDF("b", "_b")).filter(duplicates.may_share("a", "b", "_a", "_b", 85.0)).collect()]
    true = {(a, b) for a in texts for b in texts if SequenceMatcher(None, a, b).ratio() * 100 >= 85.0}
    assert true <= set(left) and len(left) < len(texts) ** 2 / 4
    rated = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").withColumn("r", duplicates.ratio_from(85.0)("a", "b")).filter("r >= 85")
    assert {(r.a, r.b): r.r for r in rated.collect()} == {(a, b): SequenceMatcher(None, a, b).ratio() * 100 for a, b in true}


def test_records_of_equal_texts_need_no_comparison(spark, monkeypatch):
    """What has an equal record takes the smallest one of them; only the rest is compared, and only where letters allow it."""
    records = [(k, "Blue Window" if k < 4 else f"Far Window {k}", "The Kind") for k in range(2, 40)] + [(50, "blue-window", "THE KIND"), (60, "東京", "東京")]
    folders = [("a", "Blue Window", "The Kind"), ("b", "Blue Windaw", "The Kind"), ("c", "Window", "Nobody"), ("d", "東京", "京都"), ("e", None, "The Kind"), ("a", "Far Window 99", "The Kind")]
    seen = []
    real = enrich.ratio_from
    monkeypatch.setattr(enrich, "ratio_from", lambda least: lambda a, b: seen.append((a, b)) or real(least)(a, b))
    got = enrich.records_by_name(spark.createDataFrame(folders, "folder string, name string, artist string"), spark.createDataFrame(records, "record_id long, name string, artist string"))
    assert {(r.folder, r.record_id, r.confidence) for r in got.collect()} == {("a", 2, 100.0), ("b", 2, round(SequenceMatcher(None, "blue windaw", "blue window").ratio() * 100, 6))}
    assert seen == [("a1", "a2"), ("n1", "n2")]


def test_matches_are_counted_without_rows(spark):
    """Lists give the same gates as matches row by row, with a drift and with times far apart; no plan joins landmarks with landmarks."""
    r = random.Random(11)
    marks = [(f"p{k}", r.randrange(60), r.randrange(3000)) for k in range(3) for _ in range(900)] + [("p0", 5, 40_000_000), ("q", 1, 7), ("x", 2, -5)]
    other = [(p, h, t - (13 if p != "p2" or t < 1500 else 40)) for p, h, t in marks if p != "x"]
    probe, reference = (spark.createDataFrame(rows, "id string, hash int, t int") for rows in (marks, other))
    lists = align.times(probe, "id").select(F.col("id").alias("pair"), "hash", F.col("ts").alias("tp")).join(align.times(reference, "id").select(F.col("id").alias("pair"), "hash", F.col("ts").alias("tr")), ["pair", "hash"])
    votes = align.matches(probe, reference, "id")
    for gates in ((1, 0.0, 0.0), (40, 2.0, 0.001)):
        want, got = ({tuple(x) for x in d.collect()} for d in (align.aligned(votes, *gates), align.aligned_lists(lists, *gates)))
        assert got == want
    assert {x[0] for x in align.aligned(votes, 40, 2.0, 0.001).collect()} == {"p0", "p1"}
    tps, trs = [np.array(x) for x in ([1, 5, 5, 9], [], [3], range(200))], [np.array(x) for x in ([0, 4], [1], [], range(300))]
    want = Counter(int(p - t) for a, b in zip(tps, trs, strict=True) for p in a for t in b if p < 150)
    for most, long in ((2, 10_000), (1 << 21, 10_000), (100, 5), (1 << 21, 1 << 30)):
        got = Counter()
        for d, n in align.differences(tps, trs, 150, most, long):
            got.update(dict(zip(d.tolist(), n.tolist(), strict=True)))
        assert got == want


def test_no_side_of_the_search_is_broadcast(spark, monkeypatch):
    """Keys and rows of the library meet by shuffles, also where they look small to the planner."""
    plans = []
    real = duplicates.durable

    def seen(df):
        out = real(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(duplicates, "durable", seen)
    rows = spark.createDataFrame([(k, f"{t} - {t}") for k, t in enumerate(names(20))], "ord int, name string")
    seen(duplicates.similar_pairs(duplicates.name_keys(rows, "ord", "name")))
    merged, sent = ([p.split("== Initial Plan ==")[0].count(f"{kind}Join") for p in plans] for kind in ("SortMerge", "BroadcastHash"))
    assert merged == [1, 2] and sent == [0, 0]


def test_no_side_of_the_groups_is_broadcast(spark, monkeypatch):
    """Links and what is known of each folder meet by shuffles in every round; the groups stay the same."""
    plans = []
    real = duplicates.durable

    def seen(df):
        out = real(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(duplicates, "durable", seen)
    pairs = spark.createDataFrame([(k, k + 1) for k in range(1, 6)] + [(10, 11), (10, 12), (11, 12)], "i long, j long")
    got = seen(duplicates.greedy_groups(pairs))
    assert {(r.leader, r.member) for r in got.collect()} == {(1, 1), (1, 2), (3, 3), (3, 4), (5, 5), (5, 6), (10, 10), (10, 11), (10, 12)}
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p for p in plans)
