"""The library as a table: views, searches, and checks of what a folder says against what its files say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions.text import blank, normalize_lookup
from quaver.operators.duplicates import ratio

LEAST = 85.0


def view(songs: DataFrame, term: str = "", mode: str = "all") -> DataFrame:
    """Songs whose label holds a term, with a video (``has``), without (``missing``), or all; in order of the label."""
    rows = songs.filter(F.lower("label").contains(term.lower()))
    if mode in ("has", "missing"):
        rows = rows.filter(F.col("has_video") == F.lit(mode == "has"))
    return rows.orderBy(F.lower("label"), "folder")


def search(songs: DataFrame, term: str) -> DataFrame:
    """Songs whose label or folder holds a term, without regard to case."""
    return songs.filter(F.lower(F.concat_ws(" ", "label", "folder")).contains(term.lower()))


def by_resolution(songs: DataFrame, descending: bool = False) -> DataFrame:
    """Songs in order of the number in front of their resolution; texts without one count as 0."""
    lines = F.coalesce(F.regexp_extract("res", r"^(\d+)", 1).try_cast("int"), F.lit(0))
    return songs.orderBy(lines.desc() if descending else lines.asc(), F.lower("label"), "folder")


def unprobed(songs: DataFrame) -> DataFrame:
    """Songs with a video whose resolution isn't known yet."""
    return songs.filter(F.col("has_video") & (F.col("res") == "..."))


def remaining(targets: DataFrame, left: DataFrame) -> DataFrame:
    """Targets that an interrupted run still has on its list and that have no video by now."""
    return targets.filter(~F.col("has_video")).join(left.select("folder").distinct(), "folder", "left_semi")


def verified(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """Whether artist and title of a chart are those of its settings: both similarities, rounded, reach ``least``."""
    same = lambda a, b: F.bround(ratio(normalize_lookup(F.col(a)), normalize_lookup(F.col(b)))).cast("int")
    rows = rows.withColumn("artist_ratio", same("chart_artist", "artist")).withColumn("title_ratio", same("chart_name", "title"))
    return rows.withColumn("ok", (F.col("artist_ratio") >= least) & (F.col("title_ratio") >= least))


def root_state(root: Column, is_song: Column, songs: Column) -> Column:
    """Whether a folder can be a library: it exists, is no song itself, and holds one at least."""
    return F.when(~root, "missing").when(is_song, "is_a_song").when(songs == 0, "no_songs").otherwise("ok")


def summary_line(counts: Column) -> Column:
    """A map of counts as a line of text, names in order, zeros left out."""
    held = F.array_sort(F.filter(F.map_entries(counts), lambda e: e["value"] > 0))
    return F.array_join(F.transform(held, lambda e: F.concat(e["value"].cast("string"), F.lit(" "), e["key"])), ", ")


def label(artist: Column, title: Column) -> Column:
    """``Artist - Title``, or the title alone."""
    return F.when(blank(artist), title).otherwise(F.concat(artist, F.lit(" - "), title))
