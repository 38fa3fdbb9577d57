"""Cases that an earlier cut of the candidates left out."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quaver.llm import linkage, metric, personal
from tests.llm.test_joins import damerau


def test_slip_keys(spark):
    r = random.Random(3)
    texts = {"".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(120)} | {"", "a"}
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "t string")
    for longest in (0, 5, 96):
        own, other = ({x["t"]: set(x["k"]) for x in df.select("t", metric.slip_keys(F.col("t"), side, longest).alias("k")).collect()} for side in (True, False))
        assert all(own[a] & other[b] for a in texts for b in texts if damerau(a, b) <= 1 and min(len(a), len(b)) >= 3 or a == b)


def test_linkage_meets_slips_in_the_artist(spark):
    pairs = [
        ("Selmirik Snaiixulish", "S. Snaixulish", "Rusted Kingdom"), ("N. Tholdinnonts", "The Nusso Tholidnnonts", "Burning Mirror"), ("WfssenBodel", "Wessen Bodel", "Cold Harbor"),
        ("Lo Derezolz", "Loska Derezols", "Green Door"), ("Ubx", "Ubz", "Long Road"), ("Solmarik Trent", "Solmarik Trend", "Nihgt"),
    ]
    fields = "artist string, name string, year string, genre string, charter string, album string"
    left = spark.createDataFrame([(f"f{i}", a, t.replace("Nihgt", "Night"), None, None, None, None) for i, (a, _, t) in enumerate(pairs)], "folder string, " + fields)
    right = spark.createDataFrame([(i, b, t, None, None, None, None) for i, (_, b, t) in enumerate(pairs)], "record_id long, " + fields)
    groups = spark.createDataFrame([], "group_id long, ord long, folder string")
    nick = spark.createDataFrame([("Loska", "Lo")], "given string, nickname string")
    got = {(r["folder"], r["record_id"]) for r in linkage.matched(left, right, groups, nick).collect()}
    assert got == {(f"f{i}", i) for i in range(len(pairs))}


def test_every_shape_of_a_name_is_proposed():
    text = 'Yesterday Colin Tambbydell and "Sven Ostmarch" came with K. Zwill; Viele Grüße / Bodil Trask\nHallo Joel Fenwick'
    found = {text[s:e] for kind, s, e, *_ in personal.spans(text) if kind == "name"}
    assert {"Colin Tambbydell", "Sven Ostmarch", "K. Zwill", "Bodil Trask", "Joel Fenwick"} <= found
    votes = {text[s:e]: v for _, s, e, v, *_ in personal.spans(text)}
    assert votes["Bodil Trask"][2] == 1 and votes["Sven Ostmarch"][2] == 0
    assert "G. Bramnewright" not in {x[0] for x in [("Nadia G. Bramnewright"[s:e],) for _, s, e, *_ in personal.spans("Nadia G. Bramnewright")]}


def test_a_name_is_found_without_list_or_fragment(spark):
    filler = [(i, f"Contact: Anna Lindvigny{i}, anna{i}@fretnet.example. The Blue Window has {i} notes. Broken Harbor drifts. Silent Meadow is fine.") for i in range(100, 160)]
    rows = [(1, "Blue Window is fine. Colin Tambbydell, colin.tambbydell@fretnet.example, has the stems.")]
    df = spark.createDataFrame(rows + filler, "doc_id long, text string")
    got = {(r["kind"], r["value"]) for r in personal.personal_values(df).collect() if r["doc_id"] == 1}
    assert got == {("email", "colin.tambbydell@fretnet.example"), ("name", "Colin Tambbydell")}
