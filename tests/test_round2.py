"""Agreement with demotion, naming, names from charts, lookups by name, reports and decisions, by hand and brute force."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quaver.operators import candidates, charts, consensus, duplicates, enrich, naming, palette
from quaver.session import shared_folder, table
from quaver.sources import ini

FOLDER = "/root/testdata/sf0.001"
VOTES = "seq long, chart_hash string, video_id string, client_id string, ip string, start_ms long"
MAPPINGS = "chart_hash string, video_id string, votes int, start_ms long, status string, locked int, first_seen long, last_seen long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def cast(video, first, n=3, chart="q"):
    return [(first + k, chart, video, f"{video}{k}", f"10.0.{ord(video[-1])}.{k}", 100 * k) for k in range(n)]


def test_the_later_quorum_demotes_the_earlier(spark):
    votes = spark.createDataFrame(cast("va", 1) + cast("vb", 10) + cast("vc", 20, 2), VOTES)
    none = spark.createDataFrame([], MAPPINGS)
    assert rows(consensus.with_status(consensus.tallies(votes), none), "video_id", "status") == [("va", "pending"), ("vb", "approved"), ("vc", "pending")]
    # one more vote for the first makes it the last that reached a quorum
    again = votes.union(spark.createDataFrame([(30, "q", "va", "late", "10.9.9.9", 5)], VOTES))
    assert rows(consensus.with_status(consensus.tallies(again), none), "video_id", "status") == [("va", "approved"), ("vb", "pending"), ("vc", "pending")]
    # a curator's lock keeps all others pending, and a rejected one stays rejected
    held = spark.createDataFrame([("q", "vc", 0, None, "approved", 1, 0, 0), ("q", "va", 0, None, "rejected", 1, 0, 0)], MAPPINGS)
    assert rows(consensus.with_status(consensus.tallies(again), held), "video_id", "status") == [("va", "rejected"), ("vb", "pending"), ("vc", "approved")]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_one_approved_video_of_a_chart(spark):
    held = consensus.with_status(consensus.tallies(table(spark, FOLDER, "votes")), table(spark, FOLDER, "mappings"))
    assert held.filter("status = 'approved' and locked = 0").groupBy("chart_hash").count().filter("count > 1").count() == 0


@pytest.mark.parametrize(
    ("path", "inside"),
    [("lib/Peer Review/a", False), ("lib/Songs_needs_review/a", True), ("lib/_NeedsReview/x", True), ("lib/needs review", False), ("lib/x_Duplicates_Review/a", True), ("lib/_underscored/a", False), ("", False)],
)
def test_review_folders(spark, path, inside):
    assert spark.createDataFrame([(path,)], "p string").select(naming.in_review(F.col("p"))).first()[0] is inside


def test_files_of_a_folder(spark):
    files = spark.createDataFrame([("a", n, 1) for n in ("song.ogg", "Guitar.MP3", "preview.ogg", "CROWD.opus", "b.flac", "notes.mid", "album.jpeg")] + [("b", "album_7.png", 1), ("c", "album.png", 1), ("c", "album_1.jpg", 1), ("d", "x.txt", 1)], "parent string, name string, length long")
    assert {r.parent: r.stems for r in naming.mixed_stems(files).collect()} == {"a": ["Guitar.MP3", "b.flac", "song.ogg"], "b": [], "c": [], "d": []}
    assert rows(naming.art_states(files), "parent", "status") == [("a", "ok"), ("b", "rename_candidate"), ("c", "needs_review"), ("d", "ok")]
    assert {r.parent: r.art for r in naming.chosen_files(files).collect()}["a"] == "album.jpeg"


def test_names_from_settings_chart_and_folder(spark):
    texts = [("x/Weezer - Jonas (Live)", None, None, None), ("x/b", " ", "ignored", '[Song]\n{\n Name = "One"\n artist=Two \n}\n[Other]\n{\n Name = "No"\n}'), ("x/c", "Three", "", '[Song]\n{\n Name = "One"\n}'), ("x/d", None, None, "[Song]\n{\n Artist = \"Only\"\n}")]
    df = charts.song_block(spark.createDataFrame(texts, "folder string, name string, artist string, text string"))
    got = {r.folder: (r.artist, r.title, r.said_by) for r in ini.with_names(df).collect()}
    assert got == {"x/Weezer - Jonas (Live)": (None, "Weezer - Jonas (Live)", "folder"), "x/b": ("Two", "One", "chart"), "x/c": (None, "Three", "settings"), "x/d": (None, "d", "folder")}


def test_quoted_fields_of_a_chart(spark):
    df = charts.song_fields(spark.createDataFrame([('NAME = "A b"\nartist = bare\nName = "later"',), (None,), ("",)], "text string"))
    assert [(r.chart_name, r.chart_artist) for r in df.collect()] == [("A b", None), (None, None), (None, None)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_records_by_name_miss_few(spark):
    """Of all pairs that reach the bound, by brute force, at least nine in ten folders get as good a record."""
    from difflib import SequenceMatcher

    from quaver.functions.text import normalize_lookup

    d = "/root/testdata/sf0.001"
    plain = lambda t, key: [tuple(r) for r in table(spark, d, t).filter("artist is not null and name is not null").select(key, normalize_lookup(F.col("artist")), normalize_lookup(F.col("name"))).collect()]
    left, right = plain("ini_fields", "folder"), plain("records", "record_id")
    ratio = lambda a, b: 100 * SequenceMatcher(None, a, b, autojunk=False).ratio()
    best = {}
    for folder, a1, n1 in left:
        for _, a2, n2 in right:
            if 2 * min(len(n1), len(n2)) >= 0.7 * (len(n1) + len(n2)) and ratio(n1, n2) >= 70 and (low := min(ratio(a1, a2), ratio(n1, n2))) >= 70:
                best[folder] = max(best.get(folder, 0), low)
    got = {r.folder: r.confidence for r in enrich.records_by_name(table(spark, d, "ini_fields"), table(spark, d, "records")).collect()}
    as_good = sum(got.get(f, 0) >= b - 0.01 for f, b in best.items())
    print(as_good, len(best), [f for f, b in best.items() if got.get(f, 0) < b - 0.01])
    assert as_good >= 0.9 * len(best) > 0


def test_report_of_duplicates(spark):
    copies = spark.createDataFrame(
        [(1, 0, "a", 10, True, ["diff_bass"]), (1, 1, "b", 20, True, ["diff_guitar"]), (1, 2, "c", 99, True, []), (2, 0, "d", 1, False, []), (2, 1, "e", 2, False, []), (3, 0, "f", 1, True, [])],
        "group_id long, ord long, folder string, score int, eligible boolean, has array<string>",
    )
    prints = spark.createDataFrame([("a", [5]), ("b", [5]), ("c", [-6]), ("d", [7]), ("e", [7]), ("f", [1])], "folder string, bits array<long>")
    got = {r.folder: (r.action, r.keeper, r.borrow) for r in duplicates.report(copies, prints).collect()}
    assert got == {"a": ("move", "b", "diff_bass"), "b": ("keeper", "b", ""), "c": ("not_confirmed", None, ""), "d": ("none_eligible", None, ""), "e": ("none_eligible", None, ""), "f": ("not_confirmed", None, "")}


def test_decisions(spark):
    cases = "ready boolean, converted boolean, stored string, has_sound boolean, local_ms long, source_id string, source_ms long, other_fits boolean"
    df = spark.createDataFrame([(False, False, None, True, 1, "s", 2, True), (True, True, None, True, 1, "s", 2, True), (True, False, "manual", True, 1, "s", 2, True), (True, False, None, True, 1, "s", 2, True), (True, False, None, False, 1, "s", 2, True), (True, False, None, None, None, None, 2, True), (True, None, None, True, None, "s", None, None)], cases)
    assert [(r.action, r.new_ms) for r in candidates.resynced(df).collect()] == [("none", None), ("none", None), ("skipped", None), ("from_local", 1), ("from_source", 2), ("mismatch_reported", None), ("unchanged", None)]
    dump = spark.createDataFrame([(False, False, True, "v", "a", False), (True, False, False, "v", "b,a", False), (True, True, True, "v", "z, a,z", True), (False, True, True, None, None, False)], "has_video boolean, converted boolean, writable boolean, source_id string, rejected string, has_art boolean")
    assert [(r.status, r.rejected, r.removes) for r in candidates.dumped(dump).collect()] == [("nothing_to_dump", "a", ""), ("failed", "b,a", ""), ("dumped", "a,v,z", "video.mp4,album.png"), ("dumped", "", "")]


def test_colours_and_stamps(spark):
    df = spark.createDataFrame([(1, 2, 3), (255, 0, 128), (0, 0, 0)], "r int, g int, b int").withColumn("x", palette.rgb_to_hls("r", "g", "b"))
    assert [r[0] for r in df.select(palette.hls_to_hex("x.h", "x.l", "x.s")).collect()] == ["#010203", "#ff0080", "#000000"]
    assert spark.range(1).select(enrich.stamp(F.timestamp_seconds(F.lit(0)))).first()[0] == "1970-01-01T00:00:00Z"


def test_shared_folder(spark):
    assert shared_folder(spark)
