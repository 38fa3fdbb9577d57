"""Slipped names of every length against all pairs."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from quaver.llm import spellings
from quaver.llm.acts import one_slip, read_act
from quaver.session import table

FOLDER = "/root/testdata/sf0.01"


def classes(spark, names):
    df = spark.createDataFrame([(n, 1) for n in names], "artist string, rows long")
    nick = spark.createDataFrame([("William", "Bill")], "given string, nickname string")
    return {r.artist: r.act for r in spellings.spelling_classes(df, "artist", nick).collect()}


def test_short_names(spark):
    act = classes(spark, ["Joe Tan", "Jeo Tan", "Muse", "Msue", "Tool", "Pool", "Ash", "Ahs", "Weezer", "Wezer", "Bill Barn", "William Barn"])
    same = [("Joe Tan", "Jeo Tan"), ("Muse", "Msue"), ("Weezer", "Wezer"), ("Bill Barn", "William Barn")]
    assert all(act[a] == act[b] for a, b in same)
    assert act["Tool"] != act["Pool"] and act["Ash"] != act["Ahs"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_recall_by_length(spark):
    """Every two readings one slip apart are in one class, whatever their length; given names of the list that differ stay apart."""
    charts, nick = table(spark, FOLDER, "charts"), table(spark, FOLDER, "nicknames")
    found = {r.artist: r.act for r in spellings.spelling_classes(spellings.acts_only(charts, "chart_hash", "artist", "title"), "artist", nick).collect()}
    known = {r.given.lower() for r in nick.collect()}
    read = {n: read_act(n) for n in found}
    cores = sorted({(a.kind, a.core, a.given) for a in read.values() if len(a.given) != 1 and len(a.core) >= spellings.SHORTEST})
    by = {(a.kind, a.core, a.given): found[n] for n, a in read.items()}
    seen, met = Counter(), Counter()
    for i, a in enumerate(cores):
        for b in cores[:i]:
            if a[0] == b[0] and a[1] != b[1] and abs(len(a[1]) - len(b[1])) <= 1 and one_slip(a[1], b[1]) and not (a[2] != b[2] and {a[2], b[2]} <= known):
                size = min(len(a[1]), len(b[1])) // 4 * 4
                seen[size] += 1
                met[size] += by[a] == by[b]
    print({size: (met[size], seen[size]) for size in sorted(seen)})
    assert sum(seen.values()) > 50 and all(met[size] >= 0.9 * seen[size] for size in seen)
