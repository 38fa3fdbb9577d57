"""Operators against small cases worked out by hand."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.operators import align, backoff, candidates, charts, consensus, duplicates, enrich, frames, naming, palette, songbook
from quaver.sources import files, ini

VOTES = "seq long, chart_hash string, video_id string, client_id string, ip string, start_ms long, confidence double, artist string, title string, ts long"
MAPPINGS = "chart_hash string, video_id string, votes int, start_ms long, status string, locked int, first_seen long, last_seen long"


def vote(seq, chart, video, client, ip, start=100):
    return (seq, chart, video, client, ip, start, None, None, None, 1000 + seq)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_quorum_and_median(spark):
    v = table(spark, [vote(1, "q", "v", "a", "10.0.0.0", 100), vote(2, "q", "v", "b", "10.0.0.1", 101), vote(3, "q", "v", "c", "10.0.0.2", 102), vote(4, "s", "v", "a", "9.9.9.9", -3), vote(5, "s", "v", "b", "9.9.9.9", -2)], VOTES)
    assert found(consensus.tallies(v), "chart_hash", "sources", "start_ms") == [("q", 3, 101), ("s", 1, -2)]
    none = table(spark, [], MAPPINGS)
    assert found(consensus.with_status(consensus.tallies(v), none), "chart_hash", "status") == [("q", "approved"), ("s", "pending")]
    assert consensus.tallies(table(spark, [], VOTES)).count() == 0


def test_last_quorum_wins(spark):
    v = table(spark, [vote(i, "c", video, f"u{i}", f"1.1.1.{i}") for i, video in enumerate(["v1", "v1", "v1", "v2", "v2", "v2"])], VOTES)
    assert found(consensus.replay_winner(v), "chart_hash", "video_id") == [("c", "v2")]


def test_locked_sibling_blocks(spark):
    v = table(spark, [vote(i, "c", "v2", f"u{i}", f"1.1.1.{i}") for i in range(4)], VOTES)
    m = table(spark, [("c", "v1", 1, 0, "approved", 1, 0, 0)], MAPPINGS)
    assert found(consensus.with_status(consensus.tallies(v), m), "video_id", "status") == [("v2", "pending")]


def test_activity(spark):
    day, now = 86_400, 10_000_000
    p = table(spark, [("a", now - 3600, 1), ("b", now - 7200, 0), ("c", now - 3 * day, 1), ("d", now - 10 * day, 1), ("e", now - 40 * day, 0)], "client_id string, last_seen long, sharing int")
    assert tuple(consensus.activity_windows(p, now).first()) == (5, 2, 3, 4, 1, 2)
    assert tuple(consensus.activity_windows(p.limit(0), now).first()) == (0,) * 6


def test_queue(spark):
    m = table(spark, [("A", "v", 1, 0, "pending", 0, 0, 40), ("A", "w", 1, 0, "approved", 0, 0, 1), ("B", "v", 1, 0, "pending", 0, 0, 20), ("C", "v", 1, 0, "rejected", 0, 0, 30)], MAPPINGS)
    c = table(spark, [("B", "x", "y")], "chart_hash string, artist string, title string")
    assert [r["chart_hash"] for r in consensus.pending_queue(m, c).collect()] == ["C", "B"]
    assert consensus.pending_queue(m, c, 1).count() == 1


def test_songbook(spark):
    s = table(spark, [(1, "Sublime", "Santeria"), (2, "sublime", "santeria"), (3, "Sublime", "What I Got"), (4, " ", "x"), (5, "Éire", "y"), (6, None, "z")], "ord int, artist string, title string")
    book = songbook.entries(s, "ord")
    assert found(book, "artist", "title") == [("Sublime", "Santeria"), ("Sublime", "What I Got"), ("Éire", "y")]
    assert found(songbook.letters(songbook.artists(book)), "letter", "artists") == [("#", 1), ("S", 1)]


def test_outliers(spark):
    acts = table(spark, [("a", "A", 1, "a", "A"), ("b", "B", 1, "b", "B"), ("c", "C", 1, "c", "C"), ("d", "D", 9, "d", "D")], "artist_key string, artist string, songs long, sort_key string, letter string")
    row = songbook.stats(acts).first()
    assert row["mean"] == 3.0 and row["stdev"] == pytest.approx(3.4641016)
    assert found(songbook.outliers(acts), "artist") == [("D",)]
    assert songbook.outliers(acts, 3.0).count() == 0


def test_flow():
    assert [songbook.column_width(n) for n in (2, 3, 4)] == [328, 212, 154]
    one = lambda text, kind, width: 1
    items = [("letter", "A"), ("artist", "a")] + [("song", "s")] * 48 + [("artist", "b"), ("song", "t")]
    places = songbook.flow(items, measure=one)
    # the second artist and its first song move to the second column together
    assert places[-2][:2] == (0, 1) and places[-1] == (0, 1, 1)
    tall = songbook.flow([("letter", "A"), ("artist", "a"), ("song", "s")], measure=lambda t, k, w: 60 if k == "artist" else 1)
    assert len(tall) == 3


def test_layout_pages(spark):
    s = table(spark, [(i, a, t) for i, (a, t) in enumerate([("Abba", "One"), ("Blur", "Two"), ("9mm", "Three")])], "ord int, artist string, title string")
    placed = songbook.layout(songbook.entries(s, "ord"))
    assert found(placed.filter("kind = 'letter'"), "letter", "page") == [("#", 5), ("A", 3), ("B", 4)]
    toc = table(spark, [("Abba", 1), ("Nobody", 1)], "artist string, songs int")
    assert found(songbook.toc_pages(toc, placed), "artist", "page") == [("Abba", 3), ("Nobody", 3)]
    assert songbook.html_pages(placed).count() == 3


CHART = "[Song]\n{\n Name = \"A\"\n Resolution = 192\n}\n[SyncTrack]\n{\n%s\n}\n[ExpertSingle]\n{\n%s\n}\n"


def chart(spark, tempo, ticks, more=""):
    text = CHART % ("\n".join(f" {t} = B {b}" for t, b in tempo), "\n".join(f" {t} = N 0 0" for t in ticks)) + more
    return table(spark, [(1, text)], "id int, text string")


@pytest.mark.parametrize(
    ("tempo", "ticks", "nps"),
    [
        ([(0, 120000)], [0, 192, 384, 576], 2.0),
        ([(0, 120000), (384, 240000)], [0, 192, 384, 576], 2.4),
        ([(192, 120000)], [0, 192, 384], 2.0),
        ([(0, 120000)], [0], None),
        ([(0, 120000)], [0, 0, 0], None),
        ([(0, 0)], [0, 192], None),
        ([], [0, 192, 384], 2.0),
    ],
)
def test_density(spark, tempo, ticks, nps):
    row = charts.density(chart(spark, tempo, ticks), "id").first()
    assert (row["note_count"], row["nps"]) == (len(ticks), nps)


def test_chart_facts(spark):
    more = '[ExpertDrums]\n{\n 0 = N 32 0\n 9 = S 65 96\n}\n[Events]\n{\n 0 = E "lyric This"\n 5 = E soloend\n}\n[HardDoubleBass]\n{\n}\n'
    df = chart(spark, [(0, 120000)], [0, 1], more)
    assert dict(found(charts.instruments(df, "id"), "instrument", "present")) == {"guitar": 1, "bass": -1, "drums": 1, "keys": -1, "vocals": -1, "rhythm": -1, "guitarghl": -1}
    flags = charts.feature_flags(df, "id").first()
    assert (flags["has_lyrics"], flags["has_solos"], flags["has_open_notes"], flags["has_2x_kick"], flags["has_roll_lanes"]) == (True, False, False, True, True)
    assert charts.density(table(spark, [(1, "no chart")], "id int, text string"), "id").first()["note_count"] is None


def groups_of(spark, names):
    df = table(spark, list(enumerate(names)), "ord int, name string")
    return found(duplicates.greedy_groups(duplicates.similar_pairs(duplicates.name_keys(df, "ord", "name"))), "leader", "member")


def test_groups(spark):
    assert groups_of(spark, ["Weezer - My Name Is Jonas", "Weezer - My Name Is Jonas [dup2]"]) == [(0, 0), (0, 1)]
    assert groups_of(spark, ["3 Doors Down - Kryptonite (Live)", "3 Doors Down - Kryptonite", "Styx - Mr. Roboto"]) == []


def test_greedy_star(spark):
    pairs = table(spark, [(1, 2), (2, 3), (4, 5), (5, 6), (4, 6)], "i long, j long")
    assert found(duplicates.greedy_groups(pairs), "leader", "member") == [(1, 1), (1, 2), (4, 4), (4, 5), (4, 6)]


def test_keeper(spark):
    c = table(spark, [(1, 0, "a", 30, False, ["x"]), (1, 1, "b", 20, True, ["y"]), (1, 2, "c", 20, True, ["z"]), (2, 0, "d", 5, False, [])], "group_id int, ord int, folder string, score int, eligible boolean, has array<string>")
    kept = duplicates.keepers(c)
    assert found(kept, "group_id", "keeper") == [(1, "b")]
    assert found(duplicates.borrowable(c, kept), "folder", "borrow") == [("a", "x"), ("c", "z")]


def test_candidates(spark):
    c = table(spark, [("s", 0, "a", "x", 30.0, 200.0, False, None), ("s", 1, "b", "x lyrics", 200.0, 200.0, False, None), ("s", 2, "c", "x", None, 200.0, False, None), ("t", 0, "d", "x", 5.0, 200.0, False, None), ("u", 0, "e", "x", 200.0, 200.0, True, 480), ("u", 1, "f", "x", 200.0, 200.0, True, 1080)], "song_id string, idx int, video_id string, title string, duration double, chart_duration double, confirmed boolean, height int")
    order = candidates.ranked(c)
    assert found(order.filter("song_id = 's'"), "place", "video_id") == [(1, "b"), (2, "c"), (3, "a")]
    assert found(candidates.picked(order), "song_id", "video_id", "matched") == [("s", "b", False), ("t", None, False), ("u", "f", True)]
    assert candidates.allowed(c, table(spark, [("s", "a, b")], "song_id string, rejected string")).count() == 4


def test_alignment(spark):
    votes = table(spark, [("p", t, 203) for t in range(60)] + [("p", t, 30 * t) for t in range(60)] + [("q", t, 5) for t in range(39)], "pair string, tp int, delta int")
    row = align.offsets(votes).filter("pair = 'p'").first()
    assert (row["best"], row["votes"], row["rival"]) == (68, 60, 1)
    assert found(align.aligned(votes, 40, 10.0, 0.05), "pair", "start_ms") == [("p", -3248)]
    assert align.aligned(votes).count() == 0


def test_peaks():
    t = np.arange(8000 * 2) / 8000
    peaks = align.spectral_peaks((10000 * np.sin(2 * np.pi * 1000 * t)).astype("<i2"))
    assert peaks and {f for _, f in peaks} == {128}
    assert align.spectral_peaks(np.zeros(10, "<i2")) == []


def test_landmarks(spark):
    peaks = table(spark, [("a", t, t % 7) for t in range(0, 400, 10)], "id string, t int, f int")
    marks = align.landmarks(peaks, "id")
    assert marks.filter("t = 0").count() == 8 and marks.filter("t = 390").count() == 0


@pytest.mark.parametrize(("bits", "cell", "verdict"), [(0, 0, "static"), (2, 14, "static"), (2, 15, "near_static"), (3, 0, "near_static"), (10, 0, "near_static"), (11, 0, "video")])
def test_verdicts(spark, bits, cell, verdict):
    rows = [("v", k, 0, [0]) for k in range(5)] + [("v", 5, (1 << bits) - 1, [cell])]
    f = table(spark, rows, "video_id string, frame int, ahash long, grid array<int>")
    probe = table(spark, [("v", 60.0, None), ("short", 9.0, None), ("few", 60.0, 5)], "video_id string, duration double, bit_rate long")
    assert dict(found(frames.verdicts(f, probe), "video_id", "verdict")) == {"v": verdict, "short": "unknown", "few": "unknown"}


def test_backoff(spark):
    rows = [("zero", i, 0) for i in range(5)] + [("top", i, 3) for i in range(5)] + [("wild", i, 100000) for i in range(5)] + [("few", i, 1) for i in range(4)]
    got = dict(found(backoff.schedules(table(spark, rows, "k string, at int, d int"), "k", "d"), "k", "schedule"))
    assert got == {"zero": [1440, 5760, 17280, 34560], "top": [5760, 23040, 69120, 138240], "wild": [7200, 28800, 86400, 172800], "few": None}


def test_pace(spark):
    df = table(spark, [(["hit"] * 8,), (["throttled"] * 4,), (["skipped"],), ([],)], "o array<string>")
    assert [round(r[0], 3) for r in df.select(backoff.pace(F.col("o"))).collect()] == [0.7, 6.0, 1.0, 1.0]


def test_episodes(spark):
    df = table(spark, [("k", i, o) for i, o in enumerate(["ok", "stop", "stop", "ok", "stop"])], "k string, at int, o string")
    assert found(backoff.episodes(df, "k", "at", "o", "stop"), "started_at", "resolved_at", "stops") == [(1, 3, 2), (4, None, 1)]


def test_enrichment(spark):
    rows = table(spark, [("a",), ("b",), (None,)], "h string")
    assert found(enrich.not_done(rows, table(spark, [("a",), (None,)], "h string"), "h").filter("h is not null"), "h") == [("b",)]
    scored = enrich.with_scores(rows, table(spark, [("a", 5), ("a", 9)], "checksum string, score long"), "h")
    assert dict(found(scored.filter("h is not null"), "h", "high_score")) == {"a": 9, "b": None}


def test_fill(spark):
    rows = table(spark, [("f", " ", "Rock", None, "x")], "folder string, year string, genre string, charter string, album string")
    other = table(spark, [("f", "1999", "Pop", "bad;one", "y")], "folder string, year string, genre string, charter string, album string")
    row = enrich.filled(rows, other, "folder").first()
    assert (row["year"], row["genre"], row["charter"], row["album"], row["filled"]) == ("1999", "Rock", None, "x", "year")


def test_names(spark):
    f = table(spark, [("/l/a", "song.ini"), ("/l/a", "notes.chart"), ("/l/b", "song_2.ini"), ("/l/b", "notes.mid"), ("/l/c", "x.ini"), ("/l/c", "y.ini"), ("/l/d", "notes.mid"), ("/l/e", "song.ini")], "parent string, name string")
    assert dict(found(naming.chart_name_state(f), "parent", "status")) == {"/l/a": "ok", "/l/b": "id_suffixed", "/l/c": "ambiguous", "/l/d": "no_ini", "/l/e": "no_chart_file"}
    nested = table(spark, [("/l/a", "song.ini"), ("/l/a/deep", "song.ini"), ("/l/Songs_needs_review/x", "song.ini")], "parent string, name string")
    assert found(naming.song_folders(nested), "parent") == [("/l/a",)]


def test_free_names(spark):
    moves = table(spark, [("1", "X"), ("2", "X"), ("3", "Y")], "source string, name string")
    taken = table(spark, [("X",), ("X [dup2]",)], "name string")
    assert found(naming.free_names(moves, taken), "source", "target") == [("1", "X [dup3]"), ("2", "X [dup4]"), ("3", "Y")]


def test_palette(spark):
    px = table(spark, [("i", 255, 0, 0)] * 5 + [("i", 250, 0, 0)] * 3 + [("i", 0, 0, 255)] * 2, "image string, r int, g int, b int")
    assert found(palette.swatches(palette.census(px, "image"), "image"), "cover", "accent") == [("#FF0000", "#0000FF")]


def score_file(songs):
    out = b"\0\0\0\0" + struct.pack("<I", len(songs))
    for checksum, plays, parts in songs:
        out += bytes([len(checksum)]) + checksum.encode() + bytes([len(parts), plays]) + b"".join(struct.pack("<IBHHBBI", *p) for p in parts)
    return out


def test_scores():
    data = score_file([("ABCD", 1, [(0, 0, 70, 100, 3, 0, 44725)])])
    assert files.read_scores(data) == [("abcd", 1, "lead", "easy", 70, 100, 3, 44725)]
    assert files.read_scores(data[:-1]) == [] and files.read_scores(b"") == []


def test_files(spark, tmp_path):
    song = tmp_path / "lib" / "Artist - Title"
    song.mkdir(parents=True)
    (song / "song.ini").write_text("[Song]\r\nName = First\r\nname = Second\r\ndiff_guitar = 3\r\n", encoding="utf-8-sig")
    (song / "notes.mid").write_bytes(b"mid")
    (song / "scores.bin").write_bytes(score_file([("AB", 2, [(1, 3, 1, 2, 5, 0, 7)])]))
    listed = files.listing(spark, str(tmp_path / "lib"), content=True)
    assert found(listed, "name") == [("notes.mid",), ("scores.bin",), ("song.ini",)]
    assert files.content_hashes(listed).first()["chart_hash"].startswith("ch1:")
    assert found(files.scores(listed.filter("name = 'scores.bin'")), "checksum", "instrument", "score") == [("ab", "bass", 7)]
    texts = files.texts(listed.filter("name = 'song.ini'"))
    assert dict(found(ini.first_values(texts, "parent"), "name", "value"))["name"] == "First"
    assert dict(found(ini.section_values(texts, "parent"), "name", "value"))["name"] == "Second"


def test_set_values(spark):
    df = table(spark, [("[song]\r\nname = x\r\nodd  line\r\n",), ("[song]\nvideo_start_time = 5\n",), ("",)], "t string")
    got = [r[0] for r in df.select(files.set_values(F.col("t"), {"video_start_time": F.lit("-3000")})).collect()]
    assert got == ["[song]\r\nvideo_start_time = -3000\r\nname = x\r\nodd  line\r\n", "[song]\nvideo_start_time = -3000\n", "[song]\nvideo_start_time = -3000\n"]


def test_episode_log(spark):
    df = table(spark, [('[{"started_at": 1.0, "resolved_at": 2.0, "escalation_steps_used": 1}]',), ('{"episodes": [], "schedule": [1, 2]}',), ("broken",)], "text string")
    got = files.episode_log(df).collect()
    assert [(len(r["episodes"]), r["schedule"]) for r in got] == [(1, None), (0, [1, 2]), (0, None)]


def test_sinks(spark, tmp_path):
    rows = table(spark, [("b", 1), ("a", 2)], "label string, n int").orderBy("label")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    files.append_manifest(rows, str(tmp_path / "m"))
    files.append_manifest(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4


def test_partition_independence(spark):
    rows = [vote(i, f"c{i % 3}", f"v{i % 5}", f"u{i % 11}", f"1.1.{i % 4}.1", i) for i in range(200)]
    df = table(spark, rows, VOTES)
    once, other = (found(consensus.tallies(df.repartition(n)), "chart_hash", "video_id", "sources", "start_ms") for n in (1, 7))
    assert once == other


def test_similar_texts_complete(spark):
    import random
    from difflib import SequenceMatcher

    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 18))) for _ in range(40)]
    texts = sorted({t for b in base for t in (b, b[:-1], b[:3] + "z" + b[3:], b[1:], b[:5] + b[6:])})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(x["a"], x["b"]) for x in duplicates.similar_texts(df, "t", 90.0).collect()}
    want = {(a, b) for a in texts for b in texts if a == b or SequenceMatcher(None, a, b).ratio() * 100 >= 90.0}
    assert got == want


def test_catalog(spark):
    from quaver.operators import catalog

    s = spark.createDataFrame([("f1", "The A", True, "720p"), ("f2", "b", True, "..."), ("f3", "the C", False, "-")], "folder string, label string, has_video boolean, res string")
    assert [r["folder"] for r in catalog.view(s, "THE").collect()] == ["f1", "f3"]
    assert [r["folder"] for r in catalog.by_resolution(s, True).collect()] == ["f1", "f2", "f3"]
    assert found(catalog.unprobed(s), "folder") == [("f2",)] and found(catalog.search(s, "F3"), "folder") == [("f3",)]
    line = s.select(catalog.summary_line(F.create_map(F.lit("done"), F.lit(2), F.lit("bad"), F.lit(0)))).first()[0]
    assert line == "2 done"
