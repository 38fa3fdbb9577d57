"""Text and number functions on small tables of cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quaver.functions import numeric, text


def values(spark, cases, expression, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (text.normalize_lookup, {"  My Name-Is  Jonas! ": "my name is jonas", None: "", "東京": ""}),
        (text.strip_title_noise, {"Song (feat. Someone)": "Song", "Song - 2011 Remaster": "Song", "Song (2x Bass Pedal)": "Song", "(Live)": "(Live)", "Song": "Song", "": ""}),
        (text.clean_folder, {"A - B [dup3]": "A - B", "A - B [charter]": "A - B", "A": "A"}),
        (text.version_tag, {"Kryptonite (Live)": "live", "Kryptonite": None, "X (Remastered 2011)": "remastered"}),
        (text.title_kind, {"Official Lyric Video": "lyric", "Song Official HD Video": "official", "Full Band FC #1": "gameplay", "Song (audio)": "audio_only", "Song": "unknown", None: "unknown"}),
        (text.video_id_of, {"https://x/watch?v=abc&t=1": "abc", "plain": "plain"}),
        (text.sort_key, {'"Weird Al" Yankovic': 'weird al" yankovic', "’Til": "til"}),
        (text.html_escape, {"<a & 'b'>": "&lt;a &amp; &#x27;b&#x27;&gt;"}),
        (text.safe_value, {" ok ": "ok", "a;b": None, "": None, None: None, "x" * 300: "x" * 200}),
    ],
)
def test_text(spark, function, cases):
    assert values(spark, list(cases), function) == list(cases.values())


def test_letters(spark):
    assert values(spark, ["!i!", "3 doors", "#!", "éire", "zeta"], text.bucket_letter) == ["I", "#", "#", "#", "Z"]
    assert values(spark, ["éire"], lambda c: text.bucket_letter(c, strict=True)) == ["É"]


def test_folder_parts(spark):
    got = values(spark, ["Weezer - Jonas - Live", "Weezer -Jonas", "Weezer- Jonas", "Jonas"], text.folder_parts)
    assert [tuple(r) for r in got] == [("Weezer", "Jonas"), ("Weezer", "Jonas"), ("Weezer", "Jonas"), ("", "Jonas")]


def test_charted(spark):
    assert values(spark, ["-1", " 3 ", "x", None, "0"], text.is_charted) == [False, True, False, False, True]


def test_selection(spark):
    got = values(spark, ["1,3,5-8", "a", "9-2", "2,2,1", ""], lambda c: text.selection(c, F.lit(6)))
    assert got == [[1, 3, 5, 6], [1, 2, 3, 4, 5, 6], [], [1, 2], []]


def test_stem_role(spark):
    got = values(spark, ["vocals_1", "guitar_2400", "Song", "notes"], text.stem_role)
    assert [None if r is None else tuple(r) for r in got] == [("vocals_1", False), ("guitar", True), ("song", False), None]


def test_numbers(spark):
    assert values(spark, ["Duration: 0:03:20.5", "none"], numeric.duration_seconds) == [200.5, None]
    assert values(spark, ["12", "-3", "soon"], lambda c: numeric.retry_after(c, F.lit(0))) == [12.0, 0.0, None]
    cells = values(spark, [[1.0, 0.0, 0.0, 1.0]], numeric.average_hash, "array<double>")
    assert cells == [0b1001]
    assert values(spark, [7], lambda c: numeric.hamming(c.cast("long"), F.lit(4).cast("long")), "int") == [2]


def test_messages(spark):
    assert values(spark, ["HTTP Error 429: x", "Failed to load cookies", "x", None], text.error_kind) == ["throttled", "cookies", "other", None]
    assert values(spark, ["a b&c"], text.quoted) == ["a%20b%26c"]
