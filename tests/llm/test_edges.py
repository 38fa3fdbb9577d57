"""Every training-data operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quaver.llm import best_copy, linkage, lookalike, packing, personal, same_entry, spellings, tokens, top_items

CHARTS = "chart_hash string, artist string, title string, last_seen long"
LONG = "na " * 20_000


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def clashing(df):
    """``df`` with columns of names that operators might use for themselves."""
    for name in ("_key", "_hash", "_text", "n", "field", "ids", "_x", "_salt", "_rank", "value", "copies", "act", "rows", "kind"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def charts(spark):
    rows = [
        ("a", "The Band", "A Song!", 1), ("b", "a  song", "the band", 2), ("c", "THE-BAND", "a song", None), ("c", "THE-BAND", "a song", None),
        ("d", "Thе Band", "A Song", 1), ("e", None, "A Song", 1), ("f", "!!!", "A Song", 1), ("g", "Bänd", "x", 1), ("h", "Band", "x", 1), (None, "The Band", "A Song", 1), ("i", "", "", 0), ("k", LONG, LONG, 1),
    ]
    return clashing(spark.createDataFrame(rows, CHARTS))


def test_same_entry(charts):
    pairs = found(same_entry.same_entry_pairs(charts, "chart_hash", "artist", "title"))
    assert pairs == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    entries = same_entry.canonical_entries(charts, "chart_hash", "artist", "title")
    assert sorted(r["copies"] for r in entries.collect()) == [1, 1, 1, 6]
    assert same_entry.same_entry_pairs(charts.limit(0), "chart_hash", "artist", "title").count() == 0


def test_collisions_are_told_apart(charts):
    weak = same_entry.canonical_entries(charts, "chart_hash", "artist", "title", digest="unhex('00')")
    assert sorted(r["copies"] for r in weak.collect()) == [1, 1, 1, 6]


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("Ｆｕｌｌ", "Full"), ("Café", "Café"), ("a​b", "ab"), ("a b", "a b"), ("Вand", "Band"), ("Oаk", "Oak"), ("ﬆone", "stone"), ("ｶﾞ", "ガ"), ("Рeля", "Реля"),
        ("Тино", "Тино"), ("été", "été"), ("a\tb  c", "a\tb  c"), ("“x” – y’s", "“x” – y’s"), ("ガ", "ガ"), ("", ""), ("👩‍🎤", "👩‍🎤"), ("Сара", "Сара"),
    ],
)
def test_ordinary(text, plain):
    assert lookalike.ordinary(text) == plain
    assert lookalike.ordinary(plain) == plain


def test_unusual_text(spark, charts):
    assert found(lookalike.unusual_text(charts, "chart_hash", ["artist", "title"]), "chart_hash", "field") == [("d", "artist")]
    assert lookalike.unusual_text(charts.limit(0), "chart_hash", ["artist"]).count() == 0
    looks = lookalike.equal_looks(charts, "chart_hash", ["artist"])
    assert found(looks, "skeleton", "spellings", "rows") == [("The Band", 2, 3)]


def test_top_items(spark):
    rows = [("c", f"v{i:03d}", i // 3, None, "approved" if i % 2 else "pending", i % 5, 0, i) for i in range(300)]
    rows += [("c", "v299", 999, None, "rejected", 1, 0, 9999), ("d", "x", None, None, "pending", None, 0, None), ("d", "x", None, None, "pending", None, 0, None), (None, "y", 1, None, "approved", 1, 0, 1), ("e", None, 1, None, "approved", 1, 0, 1)]
    df = clashing(spark.createDataFrame(rows, "chart_hash string, video_id string, votes int, start_ms long, status string, locked int, first_seen long, last_seen long"))
    got = top_items.best_videos(df)
    want = sorted((r for r in rows[:299] if r[4] == "approved"), key=lambda r: (-r[5], -r[2], r[1]))[:3]
    assert [r["video_id"] for r in got.filter("chart_hash = 'c'").orderBy("place").collect()] == [r[1] for r in want]
    assert got.count() == 6
    assert top_items.best_videos(df.repartition(7)).count() == 6 and top_items.best_videos(df.limit(0)).count() == 0
    wide = top_items.top_items(spark.range(1000).select(F.lit("g").alias("g"), "id", (F.col("id") % 10).alias("s")), "g", "id", [F.col("s")], 5, salts=3)
    assert [r["id"] for r in wide.orderBy("place").collect()] == [9, 19, 29, 39, 49]


def test_consensus():
    assert best_copy.consensus(["a b c", "a x c"], best_copy.by_trust([1, 2])) == 0
    assert best_copy.consensus(["a b c", "a x c"], best_copy.by_copies([1, 2])) == 1
    assert best_copy.consensus(["x"], [1.0]) == 0


def test_states(spark):
    cases = {"1999": True, ", 1999": True, "20xx": False, "????": False, "0": False, "0000": False, "88": True, "": False, " ": False, "N/A": False, "<unknown>": False, "(none)": False, ".": False, "<color=#FF0000>x</color>": True, "Unknown Pleasures": True, "TBD": False}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string")
    got = {r["x"]: r["s"] for r in df.select("x", best_copy.states(F.col("x")).alias("s")).collect()}
    assert got == {**cases, None: False}


def test_best_fields(spark):
    ini = spark.createDataFrame(
        [("a", "1999", None, "x", " ", "2024-01-01", "needs_review"), ("b", "2000", "Rock", "-", "Al", "2023-01-01", "confirmed_ok"), ("c", "2001", "Pop", "y", None, None, None)] + [(f"h{i}", str(1900 + i), "Ska", None, None, None, None) for i in range(90)],
        "folder string, year string, genre string, charter string, album string, at string, status string",
    ).withColumn("modified_at", F.to_timestamp("at"))
    groups = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "missing")] + [(2, i, f"h{i}") for i in range(90)], "group_id long, ord long, folder string")
    got = dict(((g, f), v) for g, f, v in found(best_copy.best_fields(clashing(groups), clashing(ini)), "group_id", "field", "value"))
    assert got == {(1, "year"): "2000", (1, "genre"): "Rock", (1, "charter"): "x", (1, "album"): "Al", (2, "year"): "1900", (2, "genre"): "Ska"}
    assert best_copy.best_fields(groups.limit(0), ini).count() == 0


def test_spellings(spark):
    names = ["Jemar Tambotox", "Tambotox, Jemar", "J. Tambotox", "Jemar Tabmotox", "JEMAR  TAMBOTOX", "Jem Tambotox", 'Jemar "Jem" Tambotox', "Jemar K. Tambotox", "Jem Tambottox", "Nenonda and the Skairkennils", "The Skairkennils & Nenonda", "Loska Derezols, The", "Th Loska Derezols", "Cura Kilvossath Project", "Cura Kilvossath Prj", "Catas Tambotox"]
    rows = [(f"h{i}", n, f"Song number {i} of love") for i, n in enumerate(names)] + [("s", "Song number 3 of love", "Jemar Tambotox"), ("n", None, "x"), ("e", " ", "x"), ("l", LONG, None)]
    charts = clashing(spark.createDataFrame(rows, "chart_hash string, artist string, title string"))
    nick = spark.createDataFrame([("Jemar", "Jem"), ("Catas", "Cat")], "given string, nickname string")
    pairs = set(found(spellings.spelling_pairs(charts, nick)))
    acts = [names[:9], names[9:11], names[11:13], names[13:15]]
    assert pairs == {(a, b) for act in acts for a in act for b in act if a < b}
    assert spellings.spelling_pairs(charts.limit(0), nick).count() == 0


def test_linkage(spark):
    ini = [("f1", "Blue Window", "The Loska Derezols", "1991", "Metal", "x", "Jungle"), ("f2", "Blue Windwo (Explicit)", "L. Derezols", None, None, None, "Jungle EP"), ("f3", "Blue Window", "Loska Derezols", "2010", None, None, None), ("f4", None, "x", None, None, None, None), ("f5", "Other", "Loska Derezols", "1991", None, None, None), ("f6", LONG, LONG, None, None, None, None), ("f7", "Blue Window", "Loska Derezols", None, None, None, None)]
    rec = [(1, "Blue Window", "The Loska Derezols", "1991", "Metal", "x", "Jungle"), (2, "Blue Window (Live)", "The Loska Derezols", "1991", "Metal", "x", "Jungle"), (3, "Blue Window - 2020 Remaster", "Derezols, Loska", "2010", "Metal", "z", "Harbor"), (4, None, None, None, None, None, None), (1, "Blue Window", "The Loska Derezols", "1991", "Metal", "x", "Jungle")]
    fields = "name string, artist string, year string, genre string, charter string, album string"
    left, right = clashing(spark.createDataFrame(ini, "folder string, " + fields)), clashing(spark.createDataFrame(rec, "record_id long, " + fields))
    # a record has one partner, so the two copies that share one are a group
    groups = spark.createDataFrame([(9, 0, "f3"), (9, 1, "f7"), (8, 0, "f1"), (8, 1, "f2")], "group_id long, ord long, folder string")
    nick = spark.createDataFrame([("Loska", "Lo")], "given string, nickname string")
    got = linkage.matched(left, right, groups, nick)
    assert found(got, "folder", "record_id") == [("f1", 1), ("f2", 1), ("f3", 3), ("f7", 3)]
    assert all(0.5 <= r["confidence"] <= 1 for r in got.collect())
    assert linkage.matched(left.limit(0), right, groups, nick).count() == 0


def test_simplex_values():
    import numpy as np

    z = linkage.solve(np.array([3.0, 3.0, 1.0, 2.0]), np.array([1.0, 1.0, 9.0, 0.0]), np.array([0, 0, 1, 2]), np.arange(4), np.array([0, 0, 1, 2]))
    assert abs(z[0] - 0.5) < 1e-3 and abs(z[1] - 0.5) < 1e-3 and abs(z[2] - 0.1) < 1e-3 and abs(z[3] - 1) < 1e-3


def test_packing(spark):
    sizes = [(i, n) for i, n in enumerate([0, 5, 5, 5, 6, 7, 3, 3, 25, 10, 10, None, 1])] + [(1, 5)]
    df = clashing(spark.createDataFrame(sizes, "doc_id long, n_tokens long"))
    kinds = spark.createDataFrame([("ten", 10), ("four", 4), (None, 5), ("bad", 0)], "container string, capacity int")
    got = packing.packed(df, kinds).toPandas()
    assert set(got["container"]) == {"ten", "four"}
    for kind, capacity in (("ten", 10), ("four", 4)):
        own = got[got["container"] == kind]
        size = own["token_to"] - own["token_from"]
        assert size.groupby(own["container_no"]).sum().max() <= capacity and (size >= 0).all()
        assert size.sum() == sum(n or 0 for _, n in sizes)
        whole = own[(size > 0) & (own["token_from"] == 0)]
        assert all(n <= capacity for n in size) and len(set(own["doc_id"])) == 13 and len(whole) == 12
    assert got[got["container"] == "ten"]["container_no"].nunique() <= 9
    assert packing.packed(df.limit(0), kinds).count() == 0


def test_plan_uses_everything():
    import random

    r = random.Random(1)
    for capacity in (16, 300, 2000):
        h = {}
        for _ in range(3000):
            n = min(capacity, 1 + int(r.expovariate(4 / capacity)))
            h[n] = h.get(n, 0) + 1
        plan, used = packing.plan(h, capacity), {}
        for parts, times in plan:
            assert sum(parts) <= capacity and times > 0
            for p in parts:
                used[p] = used.get(p, 0) + times
        assert used == h
        total = sum(k * v for k, v in h.items())
        assert sum(t for _, t in plan) <= -(-total // capacity) * 1.02 + 2


TEXT = """Best regards,
Hugo Zimviström
Flat 3, 12 Harlow Street, Quellhollow, ZX3 5JQ
07700 900123
Write to hugo.z@fretnet.example or hugo (at) drumnet (dot) test. Order 14400-555-90 never shipped. SSN 666-12-3456, please delete it from the form.
I tried Blue Window by The Loska Derezols on expert. Credits: stems by Holneshaw, Thomas, charted by xXabcXx. Use drums@0.51 in the mixer."""


def test_personal(spark):
    filler = [(i, f"Contact: Anna Lindvigny{i}, anna{i}@fretnet.example or call 07700 900{i:03d}. Ticket #{i}2345-22 is closed.") for i in range(100, 160)]
    rows = [(1, TEXT), (2, None), (3, ""), (4, "   "), (5, LONG), (6, TEXT)]
    df = clashing(spark.createDataFrame(rows + [(1000 + i, t) for i, t in filler], "doc_id long, text string"))
    got = [(k, v) for d, k, v in found(personal.personal_values(df), "doc_id", "kind", "value") if d == 1]
    assert sorted(got) == [
        ("address", "Flat 3, 12 Harlow Street, Quellhollow, ZX3 5JQ"), ("email", "hugo (at) drumnet (dot) test"), ("email", "hugo.z@fretnet.example"),
        ("id_number", "666-12-3456"), ("name", "Holneshaw, Thomas"), ("name", "Hugo Zimviström"), ("phone", "07700 900123"),
    ]
    text = {r["doc_id"]: r["text"] for r in personal.masked(df).collect()}
    assert text[2] is None and text[3] == "" and text[5] == LONG and len(text) == 66
    assert text[1].startswith("Best regards,\n[NAME]\n[ADDRESS]\n[PHONE]\nWrite to [EMAIL] or [EMAIL]. Order 14400-555-90") and "[ID_NUMBER]" in text[1]
    assert personal.personal_values(df.limit(0)).count() == 0


def test_token_edges(spark, tmp_path):
    pytest.importorskip("tiktoken")
    df = clashing(spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|>"), (4, LONG), (4, LONG)], "doc_id long, text string"))
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) > 1
    back = tokens.decoded(tokens.encoded(df.drop("n")), name="back").collect()
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert tokens.encoded(df.limit(0)).count() == 0
