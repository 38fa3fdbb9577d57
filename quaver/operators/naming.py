"""Files of song folders: which ones they are, whether their names are right, and plans to put them right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.text import stem_role

# File names and extensions by what they mean, better ones first
AUDIO = ("ogg", "opus", "mp3", "wav")
VIDEO = ("video.mp4", "video.avi", "video.webm", "video.ogv")
ART = ("album.png", "album.jpg", "album.jpeg")
REVIEW = ("_needs_review", "_duplicates_review", "_needsreview", "_duplicatesreview")
REVIEW_ENDS = ("_needs_review", "_duplicates_review")
SOUND = ("ogg", "opus", "mp3", "wav", "m4a", "flac")
LEFT_OUT = ("preview", "crowd")
TOLERANCE = 2000


def _ext(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def _place(value: Column, words: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(w) for w in words]), value)


def in_review(path: Column) -> Column:
    """Whether any folder of a path is a review folder, by its whole name or one of two endings; other names with "review" aren't."""
    parts = F.split(F.lower(path), "/")
    return F.exists(parts, lambda p: p.isin(*REVIEW) | p.endswith(REVIEW_ENDS[0]) | p.endswith(REVIEW_ENDS[1]))


def song_folders(files: DataFrame) -> DataFrame:
    """Folders that hold a song, without those below another such folder: ``parent``.

    A folder is a song if it holds a settings file, chart, archive or known video. Ancestors are found by an
    anti-join over the prefixes of each path.
    """
    name = F.lower("name")
    marks = files.filter(~in_review(F.col("parent")) & (name.rlike(r"\.(ini|chart|mid|midi|sng)$") | name.isin(*VIDEO))).select("parent").distinct()
    parts = F.split("parent", "/")
    above = marks.select("parent", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_a")).filter("_a <> parent and _a <> ''")
    nested = above.join(marks.withColumnRenamed("parent", "_a"), "_a").select("parent").distinct()
    return marks.join(nested, "parent", "left_anti")


def chosen_files(files: DataFrame) -> DataFrame:
    """For each folder its settings file, audio, video, art, and the stem that tells the length.

    Audio is the first ``song*`` by extension and name, else the only audio file; the stem is ``song.*``, else
    the largest.
    """
    name, ext = F.lower("name"), _ext(F.col("name"))
    is_audio = ext.isin(*AUDIO)
    best = lambda cond, *order: F.min_by("name", F.when(cond, F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])))
    song = is_audio & name.startswith("song")
    return files.groupBy("parent").agg(
        best(ext == "ini", (name != "song.ini").cast("int"), F.col("name")).alias("ini"),
        F.coalesce(best(song, _place(ext, AUDIO), F.col("name")), F.when(F.count_if(is_audio) == 1, F.min(F.when(is_audio, F.col("name"))))).alias("audio"),
        best(name.isin(*VIDEO), _place(name, VIDEO)).alias("video"),
        best(name.isin(*ART), _place(name, ART)).alias("art"),
        best(is_audio, (F.regexp_extract(name, r"^(.*)\.[^.]+$", 1) != "song").cast("int"), -F.col("length"), F.col("name")).alias("stem"),
        F.count("*").alias("files"), F.sum("length").alias("size"),
    )


def chart_name_state(files: DataFrame) -> DataFrame:
    """State of each folder's settings and chart names: no_ini, ambiguous, no_chart_file, id_suffixed or ok, in this order."""
    name = F.lower("name")
    chart = name.rlike(r"^notes(_.*)?\.(chart|mid)$")
    row = files.groupBy("parent").agg(
        F.count_if(name.endswith(".ini")).alias("ini"), F.count_if(chart).alias("charts"),
        F.count_if(name == "song.ini").alias("ini_ok"), F.count_if(name.isin("notes.chart", "notes.mid")).alias("chart_ok"),
    )
    state = (
        F.when(F.col("ini") == 0, "no_ini")
        .when((F.col("ini") > 1) | (F.col("charts") > 1), "ambiguous")
        .when(F.col("charts") == 0, "no_chart_file")
        .when((F.col("ini_ok") == 0) | (F.col("chart_ok") == 0), "id_suffixed")
        .otherwise("ok")
    )
    return row.select("parent", state.alias("status"))


def stem_states(files: DataFrame) -> DataFrame:
    """State of each folder's audio stems: needs_review with two files of a role, rename_candidate with a numbered one, else ok."""
    stems = files.filter(_ext(F.col("name")).isin(*AUDIO)).withColumn("_r", stem_role(F.regexp_extract("name", r"^(.*)\.[^.]+$", 1))).filter("_r is not null")
    roles = stems.groupBy("parent", F.col("_r.role").alias("role")).agg(F.count("*").alias("n"), F.max(F.col("_r.numbered")).alias("numbered"))
    return roles.groupBy("parent").agg(F.when(F.max("n") > 1, "needs_review").when(F.max("numbered"), "rename_candidate").otherwise("ok").alias("status"), F.count("*").alias("roles"))


def mixed_stems(files: DataFrame) -> DataFrame:
    """For each folder the audio files that are mixed into the whole song, in order: no previews or crowd noise, nor the file ``probe``."""
    base = F.lower(F.regexp_extract("name", r"^(.*?)(?:\.[^.]*)?$", 1))
    kept = _ext(F.col("name")).isin(*SOUND) & ~base.isin(*LEFT_OUT)
    if "probe" in files.columns:
        kept &= ~F.coalesce(F.col("name") == F.col("probe"), F.lit(False))
    return files.groupBy("parent").agg(F.array_sort(F.collect_list(F.when(kept, F.col("name")))).alias("stems"))


def art_states(files: DataFrame) -> DataFrame:
    """State of each folder's cover: ok with one literal name or none, rename_candidate with one numbered name, needs_review with several."""
    art = F.lower("name").rlike(r"^album(_[0-9]+)?\.(png|jpg|jpeg)$")
    literal = F.lower("name").rlike(r"^album\.(png|jpg|jpeg)$")
    row = files.groupBy("parent").agg(F.count_if(art).alias("n"), F.count_if(literal).alias("_literal"))
    state = F.when(F.col("n") > 1, "needs_review").when((F.col("n") == 1) & (F.col("_literal") == 0), "rename_candidate").otherwise("ok")
    return row.select("parent", state.alias("status"), F.col("n").alias("covers"))


def audited(files: DataFrame, settled: DataFrame | None = None, verified: DataFrame | None = None) -> DataFrame:
    """``parent``, ``status``, ``detail`` of the whole audit of names: charts, stems and covers.

    skipped_sng where the song is an archive, skipped_settled where ``settled`` says confirmed_ok; needs_review where
    one of the three is in doubt, ``detail`` naming which; else confirmed_ok. Numbered chart names and stems are
    confirmed where ``verified`` (``parent``, ``ok``) says that what they hold is the song.
    """
    archive = files.groupBy("parent").agg((F.count_if(F.lower("name").endswith(".sng")) > 0).alias("_sng"))
    rows = archive.join(chart_name_state(files).withColumnRenamed("status", "_names"), "parent", "left")
    rows = rows.join(stem_states(files).select("parent", F.col("status").alias("_stems")), "parent", "left").join(art_states(files).select("parent", F.col("status").alias("_art")), "parent", "left")
    for other, name, column in ((settled, "_was", "status"), (verified, "_ok", "ok")):
        rows = rows.withColumn(name, F.lit(None)) if other is None else rows.join(other.select("parent", F.col(column).alias(name)), "parent", "left")
    sure = F.coalesce(F.col("_ok").cast("boolean"), F.lit(False))
    doubts = F.array_compact(
        F.array(
            F.when(~(F.col("_names").isin("ok") | ((F.col("_names") == "id_suffixed") & sure)), F.concat(F.lit("names: "), F.col("_names"))),
            F.when((F.col("_stems") == "needs_review") | ((F.col("_stems") == "rename_candidate") & ~sure), F.concat(F.lit("stems: "), F.col("_stems"))),
            F.when(F.col("_art") == "needs_review", F.lit("art: needs_review")),
        )
    )
    status = F.when(F.col("_sng"), "skipped_sng").when(F.col("_was") == "confirmed_ok", "skipped_settled").when(F.size(doubts) > 0, "needs_review").otherwise("confirmed_ok")
    return rows.select("parent", status.alias("status"), F.when(status == "needs_review", F.array_join(doubts, "; ")).otherwise("").alias("detail"))


def duration_state(rows: DataFrame) -> DataFrame:
    """Whether a measured length fits the stated one; without a stated length a MIDI chart fails and the song stem passes."""
    fits = F.abs(F.col("actual_ms") - F.col("expected_ms")) <= TOLERANCE
    ok = F.when(F.col("expected_ms").isNull(), F.col("kind") == "stem").when(F.col("actual_ms").isNull(), F.lit(False)).otherwise(fits)
    return rows.withColumn("ok", ok)


def free_names(moves: DataFrame, taken: DataFrame) -> DataFrame:
    """A free destination name for each move: its own, or with the first free copy number; ``source``, ``target``.

    Moves to one name are numbered in order of their source; names that exist push the numbers on.
    """
    order = Window.partitionBy("name").orderBy("source")
    held = taken.select(F.regexp_replace("name", r" \[dup\d+\]$", "").alias("_base"), F.coalesce(F.nullif(F.regexp_extract("name", r" \[dup(\d+)\]$", 1), F.lit("")).cast("int"), F.lit(1)).alias("_n"))
    used = held.groupBy("_base").agg(F.collect_set("_n").alias("_used"))
    rows = moves.withColumn("_k", F.row_number().over(order)).join(used, F.col("name") == F.col("_base"), "left")
    gone = F.array_sort(F.coalesce("_used", F.array().cast("array<int>")))
    # each taken number that isn't greater pushes the place on by one: a walk over the taken ones, whatever the place
    at = F.aggregate(gone, F.col("_k"), lambda n, taken: F.when(taken <= n, n + 1).otherwise(n))
    return rows.select("source", F.when(at == 1, F.col("name")).otherwise(F.concat("name", F.lit(" [dup"), at, F.lit("]"))).alias("target"))


def migration_plan(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """What a move of review folders would do: conflict where the destination exists, else would_move."""
    have = existing.select("name").distinct().withColumn("_there", F.lit(True))
    return sources.join(have, "name", "left").select("source", "name", F.when(F.col("_there"), "conflict").otherwise("would_move").alias("action"))
