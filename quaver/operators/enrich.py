"""Filling what is missing: lookups by content and by name, and only for rows that aren't done yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.text import blank, normalize_lookup, safe_value, strip_title_noise
from quaver.operators import charts
from quaver.operators.duplicates import letters, may_reach, may_share, ratio_from
from quaver.session import spread

FIELDS = ("year", "genre", "charter", "album")
MATCHED = ("name", "artist", "album", "genre", "year", "charter")
FLAGS = ("has_lyrics", "has_solos", "has_open_notes", "has_2x_kick", "has_roll_lanes")


def stamp(at: Column) -> Column:
    """A time as an ISO stamp in UTC, to the second."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.to_timestamp(at), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done: the first step of an incremental run, before any work."""
    return rows.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def with_scores(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """``rows`` with the best score over all parts of their content; null where there is none, never 0."""
    best = scores.groupBy(F.col("checksum").alias(key)).agg(F.max("score").alias("high_score"))
    return rows.join(best, key, "left")


def records_by_name(folders: DataFrame, records: DataFrame, least: float = 70.0) -> DataFrame:
    """The most similar record of each folder: ``folder``, ``record_id``, ``confidence``.

    Folders and records meet over the normalised title without notes, over a word of the artist, its beginning or its end with a
    word of the title, and over a word of the artist with the beginning of the title; they are compared by artist and name.
    The confidence is the lesser similarity. The smaller id wins among equals.
    """
    word = lambda text: F.filter(F.split(text, " "), lambda w: F.length(w) >= 3)
    at = lambda place, text: F.concat(F.lit(place), text)
    act, words = F.col("a"), word(F.col("n"))
    with_each = lambda place, part: F.transform(words, lambda w: F.concat(F.lit(place), part, F.lit("|"), w))
    crossed = F.flatten(F.transform(word(act), lambda part: F.transform(words, lambda w: F.concat(F.lit("w|"), part, F.lit("|"), w))))
    keys = F.array_distinct(F.concat(F.filter(F.array(at("t|", F.col("t"))), lambda k: k != "t|"), with_each("b|", F.substring(act, 1, 3)), with_each("e|", F.substring(act, -3, 3)), crossed, F.transform(word(act), lambda part: F.concat(F.lit("f|"), part, F.lit("|"), F.substring("n", 1, 4)))))
    read = lambda d, key: d.filter("artist is not null and name is not null").select(key, normalize_lookup(F.col("artist")).alias("a"), normalize_lookup(F.col("name")).alias("n"), normalize_lookup(strip_title_noise(F.col("name"))).alias("t"))
    left, right = read(folders, "folder").filter(F.size(keys) > 0), read(records, "record_id").filter(F.size(keys) > 0)
    # texts that read the same are compared once, however many rows hold them; none is more similar than an equal one, whose folders need no search
    ids = right.groupBy("a", "n").agg(F.min("record_id").alias("record_id"))
    whole = left.select("a", "n").distinct().join(spread(ids), ["a", "n"]).withColumn("confidence", F.lit(100.0))
    texts = lambda d, k: d.select("a", "n", "t").distinct().select(F.col("a").alias(f"a{k}"), F.col("n").alias(f"n{k}"), letters("a").alias(f"_a{k}"), letters("n").alias(f"_n{k}"), F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("_k"))
    met = texts(left.join(spread(ids), ["a", "n"], "left_anti"), 1).join(spread(texts(right, 2)), "_k")
    for c in ("a", "n"):
        # looked at where rows meet, before they are sent on
        met = met.filter(may_reach(f"{c}1", f"{c}2", least) & may_share(f"{c}1", f"{c}2", f"_{c}1", f"_{c}2", least))
    met = met.select("a1", "n1", "a2", "n2").distinct()
    rated = met.withColumn("_r", ratio_from(least)("a1", "a2")).filter(F.col("_r") >= least)
    rated = rated.withColumn("confidence", F.least("_r", ratio_from(least)("n1", "n2"))).filter(F.col("confidence") >= least)
    rated = rated.join(spread(ids.select(F.col("a").alias("a2"), F.col("n").alias("n2"), "record_id")), ["a2", "n2"]).select(F.col("a1").alias("a"), F.col("n1").alias("n"), "record_id", "confidence")
    best = lambda d, *by: d.groupBy(*by).agg(F.max_by("record_id", F.struct("confidence", -F.col("record_id"))).alias("record_id"), F.max("confidence").alias("confidence"))
    found = left.select("folder", "a", "n").join(spread(best(rated, "a", "n").unionByName(whole)), ["a", "n"])
    return best(found, "folder").select("folder", "record_id", F.round("confidence", 6).alias("confidence"))


def library_rows(songs: DataFrame, files: DataFrame, scores: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """The whole description of each song: what its chart holds, its files, its best score, the record found for it, and problems.

    ``songs`` has ``folder`` (unique), ``chart_hash``, ``mid_md5``, the chart's ``text`` (null without a chart), ``has_ini``, and
    ``song_length`` as written; ``files`` has ``parent`` and ``name``; ``found`` one row for each folder that a record was found
    for. Songs without a hash can't be told apart and give no row. Everything joins on the folder; the chart's facts come from one
    reading of its text.
    """
    known = songs.filter("chart_hash is not null")
    texts = known.filter("text is not null").select("folder", "text")
    held = charts.instruments(texts, "folder").groupBy("folder").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("instrument", "present")))).alias("instruments"))
    facts = held.join(charts.feature_flags(texts, "folder").select("folder", F.struct(*FLAGS).alias("features")), "folder").join(charts.density(texts, "folder").withColumnRenamed("nps", "avg_nps"), "folder")
    name = F.lower("name")
    listed = files.groupBy(F.col("parent").alias("folder")).agg(
        F.array_sort(F.collect_list(F.when(name.rlike(r"\.(ogg|mp3|wav|opus)$"), F.col("name")))).alias("stems"),
        (F.count_if(name.rlike(r"^album.*\.(png|jpg|jpeg)$")) > 0).alias("has_album_art"),
    )
    rows = with_scores(known.drop("text"), scores, "mid_md5").join(facts, "folder", "left").join(listed, "folder", "left")
    rows = rows.join(found.select("folder", F.struct(*[c for c in MATCHED if c in found.columns]).alias("chorus_match")), "folder", "left")
    length = F.col("song_length").try_cast("long")
    none = F.map_from_arrays(F.array(*[F.lit(i) for i in charts.INSTRUMENTS]), F.array(*[F.lit(-1)] * len(charts.INSTRUMENTS)))
    problems = F.array_compact(
        F.array(
            F.when(F.col("has_ini") & ~blank(F.col("song_length")) & length.isNull(), F.concat(F.lit("song.ini song_length '"), "song_length", F.lit("' is not numeric"))),
            F.when(~F.col("has_ini"), F.lit("no song.ini found")),
            F.when(F.col("features").isNull(), F.lit("no notes.chart found -- instrument/NPS/feature data unavailable")),
        )
    )
    return rows.select(
        "chart_hash", "folder", F.col("mid_md5").alias("notes_mid_md5"), F.when(F.col("has_ini"), length).alias("song_length_ms"),
        F.coalesce("instruments", none).alias("instruments"), "note_count", "avg_nps", F.coalesce("features", F.struct(*[F.lit(False).alias(f) for f in FLAGS])).alias("features"),
        F.coalesce("stems", F.array().cast("array<string>")).alias("stems"), F.coalesce("has_album_art", F.lit(False)).alias("has_album_art"), "high_score",
        problems.alias("problems"), "chorus_match", stamp(at).alias("last_updated"), F.lit("success").alias("status"),
    )


def filled(rows: DataFrame, values: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``rows`` whose blank fields take the safe value of ``values``; ``filled`` names the fields that did."""
    other = values.select(key, *[safe_value(F.col(f)).alias(f"_{f}") for f in fields])
    both = rows.join(spread(other), key, "left")
    names = F.array_compact(F.array(*[F.when(blank(F.col(f)) & F.col(f"_{f}").isNotNull(), F.lit(f)) for f in fields]))
    both = both.withColumn("filled", F.array_join(names, ","))
    for f in fields:
        both = both.withColumn(f, F.when(blank(F.col(f)), F.coalesce(F.col(f"_{f}"), F.col(f))).otherwise(F.col(f)))
    return both.drop(*[f"_{f}" for f in fields])


def fresh(cache: DataFrame, now: Column | int, days: int = 7) -> DataFrame:
    """Cached lookups younger than ``days``; a lookup that found nothing is kept like any other."""
    at = F.lit(now) if isinstance(now, int) else now
    return cache.filter(at - F.col("cached_at") < days * 86_400)


def merged_sidecar(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with new ones in their place: the sidecar after a run; rows of neither are never removed."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def first_by_content(rows: DataFrame, content: str, folder: str, force: bool = False) -> DataFrame:
    """One row for each content: that of the first folder, or of the last with ``force``."""
    order = F.col(folder).desc() if force else F.col(folder).asc()
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(content).orderBy(order))).filter("_k = 1").drop("_k")


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of counts: rows processed, rows with problems, and fields filled."""
    return rows.agg(F.count("*").alias("processed"), F.count_if(F.col("problem")).alias("problems"), F.coalesce(F.sum("n_filled"), F.lit(0)).alias("filled"))
