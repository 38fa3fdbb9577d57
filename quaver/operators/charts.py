"""Facts of timed note charts, from their text: sections, notes, tempo, instruments, features, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Instruments, the sections that hold them, and the order in which one section stands for a chart
INSTRUMENTS = ("guitar", "bass", "drums", "keys", "vocals", "rhythm", "guitarghl")
SUFFIXES = {"Single": "guitar", "DoubleBass": "bass", "DoubleRhythm": "rhythm", "Drums": "drums", "Keyboard": "keys", "GHLGuitar": "guitarghl"}
PRIORITY = ("ExpertSingle", "ExpertDoubleBass", "ExpertDrums", "ExpertDoubleRhythm", "ExpertKeyboard", "ExpertGHLGuitar")
FIVE_FRET = r"(Single|DoubleGuitar|DoubleBass|DoubleRhythm|Keyboard)$"
RESOLUTION, BPM = 192, 120.0

SECTION = r"(?s)\[(\w+)\]\s*\{(.*?)\}"
NOTE = r"(?m)^[ \t]*(\d+)[ \t]*=[ \t]*N[ \t]+(\d+)[ \t]+(\d+)[ \t\r]*$"
TEMPO = r"(?m)^[ \t]*(\d+)[ \t]*=[ \t]*B[ \t]+(\d+)[ \t\r]*$"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def song_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the quoted name, artist and charter of a chart: the first line of each anywhere in the text, in any case.

    A field that no line states is null, one stated as ``""`` is empty.
    """
    for field in ("name", "artist", "charter"):
        found = F.regexp_extract_all(text, F.lit(rf'(?im)^\s*{field}\s*=\s*"([^"]*)"'), F.lit(1))
        df = df.withColumn(f"chart_{field}", F.try_element_at(found, F.lit(1)))
    return df


def song_block(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``block_artist`` and ``block_title`` of the first [Song] block, quoted or bare; of repeated lines the last counts.

    The block ends where a line begins with a bracket. Blank values are null; a text without the block has neither.
    """
    body = F.regexp_extract(text, r"(?is)\[Song\](.*?)(?:\n\s*\[|\z)", 1)
    for field, name in (("artist", "block_artist"), ("name", "block_title")):
        said = F.regexp_extract_all(body, F.lit(rf"(?im)^[^\S\n]*{field}[^\S\n]*=([^\r\n]*)"), F.lit(1))
        # blanks, then quotes, then blanks again
        value = F.regexp_replace(F.try_element_at(said, F.lit(-1)), r'^\s+|\s+$', "")
        value = F.regexp_replace(F.regexp_replace(value, r'^"+|"+$', ""), r"^\s+|\s+$", "")
        df = df.withColumn(name, F.nullif(value, F.lit("")))
    return df


def sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each section: ``key``, ``pos`` (from 0), ``section``, ``body``. No shuffle."""
    pairs = F.arrays_zip(_all(F.col(text), SECTION, 1).alias("section"), _all(F.col(text), SECTION, 2).alias("body"))
    return df.select(key, F.posexplode(pairs).alias("pos", "_s")).select(key, "pos", F.col("_s.section").alias("section"), F.col("_s.body").alias("body"))


def notes(parts: DataFrame, key: str) -> DataFrame:
    """One row for each note line: ``key``, ``pos``, ``section``, ``tick``, ``type``, ``length``."""
    body = F.col("body")
    lines = F.arrays_zip(_all(body, NOTE, 1).alias("tick"), _all(body, NOTE, 2).alias("type"), _all(body, NOTE, 3).alias("length"))
    rows = parts.select(key, "pos", "section", F.explode(lines).alias("_n"))
    number = lambda c, t: F.col(f"_n.{c}").try_cast(t).alias(c)
    return rows.select(key, "pos", "section", number("tick", "long"), number("type", "int"), number("length", "long"))


def tempo(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Tempo changes of the whole text: ``key``, ``tick``, ``bpm``, with 120 at tick 0 where nothing is said there.

    Of several changes at one tick the last in the text counts. A tempo of zero is null.
    """
    lines = F.arrays_zip(_all(F.col(text), TEMPO, 1).alias("tick"), _all(F.col(text), TEMPO, 2).alias("raw"))
    said = df.select(key, F.posexplode_outer(lines).alias("_at", "_t")).select(key, "_at", F.col("_t.tick").try_cast("long").alias("tick"), (F.col("_t.raw").try_cast("long") / 1000.0).alias("bpm"))
    said = said.filter("tick is not null").groupBy(key, "tick").agg(F.max_by("bpm", "_at").alias("bpm"))
    start = df.select(key).distinct().join(said.filter("tick = 0").select(key), key, "left_anti").select(key, F.lit(0).cast("long").alias("tick"), F.lit(BPM).alias("bpm"))
    return said.unionByName(start).withColumn("bpm", F.nullif("bpm", F.lit(0.0)))


def resolution(text: Column) -> Column:
    """Ticks in a quarter note; 192 where the text says none."""
    said = F.regexp_extract(text, r"(?im)^[ \t]*Resolution[ \t]*=[ \t]*(\d+)[ \t\r]*$", 1).try_cast("long")
    return F.coalesce(said, F.lit(RESOLUTION).cast("long"))


def instruments(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each text and instrument: ``present`` is 1 with a note in any section of it, else -1.

    Works on the arrays of a row, without a shuffle. Vocals are never in such texts.
    """
    names, bodies = _all(F.col(text), SECTION, 1), _all(F.col(text), SECTION, 2)
    parts = F.arrays_zip(names.alias("n"), bodies.alias("b"))
    suffix = lambda n: F.regexp_extract(n, r"^(?:Easy|Medium|Hard|Expert)(\w+)$", 1)
    held = F.transform(F.filter(parts, lambda p: p["b"].rlike(NOTE)), lambda p: suffix(p["n"]))
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    found = F.transform(held, lambda s: F.try_element_at(table, s))
    rows = df.select(key, F.explode(F.array(*[F.lit(i) for i in INSTRUMENTS])).alias("instrument"), found.alias("_f"))
    return rows.select(key, "instrument", F.when(F.array_contains("_f", F.col("instrument")), 1).otherwise(-1).alias("present"))


def feature_flags(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Five flags of each text: lyrics and solos anywhere, open notes on five frets, double kick and rolls on drums."""
    parts = F.arrays_zip(_all(F.col(text), SECTION, 1).alias("n"), _all(F.col(text), SECTION, 2).alias("b"))
    line = lambda rest: rf"(?m)^[ \t]*\d+[ \t]*=[ \t]*{rest}"
    some = lambda where, what: F.exists(parts, lambda p: p["n"].rlike(where) & p["b"].rlike(line(what)))
    return df.select(
        key,
        F.col(text).rlike(line(r'E[ \t]+"?lyric[ \t]')).alias("has_lyrics"),
        F.col(text).rlike(line(r"E[ \t]+\"?solo\"?[ \t\r]*$")).alias("has_solos"),
        some(FIVE_FRET, r"N[ \t]+7[ \t]+\d+").alias("has_open_notes"),
        some("Drums$", r"N[ \t]+32[ \t]+\d+").alias("has_2x_kick"),
        some("Drums$", r"S[ \t]+6[56][ \t]+\d+").alias("has_roll_lanes"),
    )


def seconds_at(points: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``points`` (key, ``tick``, ``res``) with the ``seconds`` since the start: an as-of join with the tempo changes.

    Points and changes are one sorted stream: the last change before a point is carried to it, with the seconds
    that had passed by then. A null tempo makes the rest of its text null.
    """
    segment = Window.partitionBy(key).orderBy("tick")
    length = (F.lead("tick").over(segment) - F.col("tick")) * 60.0 / F.col("bpm")
    summed = changes.withColumn("_beat", length).withColumn("_bad", F.max(F.col("bpm").isNull()).over(segment.rowsBetween(Window.unboundedPreceding, 0)))
    summed = summed.withColumn("_passed", F.coalesce(F.sum("_beat").over(segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    marks = summed.select(key, "tick", F.lit(0).alias("_order"), F.struct("tick", "bpm", "_passed", "_bad").alias("_mark"), F.lit(None).cast("long").alias("res"))
    both = points.select(key, "tick", F.lit(1).alias("_order"), F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"), "res").unionByName(marks)
    run = Window.partitionBy(key).orderBy("tick", "_order").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_m", F.last("_mark", ignorenulls=True).over(run)).filter("_order = 1")
    passed = (F.col("_m._passed") + (F.col("tick") - F.col("_m.tick")) * 60.0 / F.col("_m.bpm")) / F.col("res")
    return held.select(key, "tick", F.when(~F.col("_m._bad"), passed).alias("seconds"))


def density(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``note_count`` and ``nps`` of the expert section that stands for the chart; null where there is none.

    Of repeated sections the last one counts. The count takes the first section by priority with a note, the
    rate the first with two; a span of no length has no rate.
    """
    parts = sections(df, key, text)
    last = parts.groupBy(key, "section").agg(F.max_by("body", "pos").alias("body"), F.max("pos").alias("pos"))
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("section"))
    rows = notes(last.withColumn("_k", place).filter("_k > 0").drop("_k"), key).withColumn("_k", place)
    counts = rows.groupBy(key, "_k").agg(F.count("*").alias("n"), F.min("tick").alias("lo"), F.max("tick").alias("hi"))
    by = F.struct("_k")
    chosen = counts.groupBy(key).agg(
        F.min_by("n", by).alias("note_count"),
        F.min_by(F.struct("n", "lo", "hi"), F.when(F.col("n") >= 2, F.col("_k"))).alias("_r"),
    )
    res = df.select(key, resolution(F.col(text)).alias("res"))
    ends = chosen.filter("_r is not null").join(res, key).select(key, "res", F.explode(F.array("_r.lo", "_r.hi")).alias("tick")).distinct()
    times = seconds_at(ends, tempo(df, key, text), key).groupBy(key).agg((F.max("seconds") - F.min("seconds")).alias("_span"), F.count_if(F.col("seconds").isNull()).alias("_bad"))
    rate = F.when((F.col("_span") > 0) & (F.col("_bad") == 0), (F.col("_r.n") - 1) / F.col("_span"))
    return df.select(key).join(chosen, key, "left").join(times, key, "left").select(key, "note_count", F.round(rate, 6).alias("nps"))
