"""Ranking of candidate videos, and the choice among those that were measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.text import kind_rank, title_kind

EARLIER, LATER, GATED = 25, 150, 3


def plausible(duration: Column, chart: Column) -> Column:
    """Whether a duration fits a chart's; an unknown one passes."""
    return duration.isNull() | duration.between(chart - EARLIER, chart + LATER)


def allowed(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates whose video isn't in the comma list of rejected ids of their song."""
    ids = rejected.select("song_id", F.explode(F.split("rejected", ",")).alias("_v")).select("song_id", F.trim("_v").alias("video_id")).filter("video_id <> ''").distinct()
    return candidates.join(ids, ["song_id", "video_id"], "left_anti")


def ranked(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``tier``, ``kind`` and ``place``.

    Fitting durations come first, then unknown, then misfits; then the kind of the title; then the given order.
    Without a chart duration only kind and order count.
    """
    tier = F.when(F.col("chart_duration").isNull(), 0).when(F.col("duration").isNull(), 1).when(plausible(F.col("duration"), F.col("chart_duration")), 0).otherwise(2)
    rows = candidates.withColumn("tier", tier).withColumn("kind", title_kind(F.col("title")))
    order = Window.partitionBy("song_id").orderBy("tier", kind_rank(F.col("kind")), "idx", F.col("video_id").asc_nulls_first())
    return rows.withColumn("place", F.row_number().over(order))


def picked(order: DataFrame, height: int = 720, gated: int = GATED) -> DataFrame:
    """One video for each song: of the first confirmed ones the first that is high enough, else the highest.

    Without a confirmed one the best by rank, unless it is known not to fit: then null. Aggregates only.
    """
    tried = F.col("confirmed") & (F.col("place") <= gated)
    best = F.max_by("video_id", F.when(tried, F.struct((F.col("height") >= height).alias("a"), F.when(F.col("height") >= height, 0).otherwise(F.coalesce("height", F.lit(0))).alias("b"), (-F.col("place")).alias("c"))))
    first = F.min_by(F.struct("video_id", "tier"), "place")
    row = order.groupBy("song_id").agg(best.alias("_c"), first.alias("_f"), F.max(tried).alias("matched"))
    choice = F.when(F.col("matched"), F.col("_c")).when(F.col("_f.tier") < 2, F.col("_f.video_id"))
    return row.select("song_id", choice.alias("video_id"), F.coalesce("matched", F.lit(False)).alias("matched"))


def provenance(df: DataFrame) -> DataFrame:
    """Where an offset comes from; one set by hand is never overwritten."""
    said = F.when(F.col("stored") == "manual", "manual").when(F.col("measured_ms").isNotNull(), "measured").when(F.col("pooled_ms").isNotNull(), "community").otherwise("guess")
    ms = F.when(F.col("stored") == "manual", F.col("stored_ms")).otherwise(F.coalesce("measured_ms", "pooled_ms", F.lit(-3000)))
    return df.withColumn("source", said).withColumn("offset_ms", ms)


def acquisition(df: DataFrame) -> DataFrame:
    """What a run would do for each song: a decision table over what is known, without doing it."""
    step = (
        F.when(F.col("has_video"), "skip_existing")
        .when(F.col("marked"), "skip_marked")
        .when(F.col("pooled_id").isNotNull() & ~F.coalesce(F.array_contains("rejected", F.col("pooled_id")), F.lit(False)), "use_pooled")
        .when(F.col("ranked_id").isNotNull(), "use_search")
        .otherwise("none")
    )
    return df.withColumn("step", step)


def offset_after(df: DataFrame) -> DataFrame:
    """The offset that goes with the URL a download used: a measured one only if that URL is the one it was measured on.

    ``used_id``, ``measured_id``, ``measured_ms``, ``pooled_id`` and ``pooled_ms`` say what is known; ``offset_ms`` and ``source`` come
    out, a guess where neither fits. A still picture (``verdict`` static) takes the song's video away: ``outcome``.
    """
    of = lambda name: F.coalesce((F.col(f"{name}_id") == F.col("used_id")) & F.col(f"{name}_ms").isNotNull(), F.lit(False))
    source = F.when(of("measured"), "measured").when(of("pooled"), "community").otherwise("guess")
    ms = F.when(of("measured"), F.col("measured_ms")).when(of("pooled"), F.col("pooled_ms")).otherwise(-3000)
    outcome = F.when(F.col("used_id").isNull(), "none").when(F.col("verdict") == "static", "still_picture").otherwise("video")
    return df.withColumn("source", source).withColumn("offset_ms", ms).withColumn("outcome", outcome)


def resynced(df: DataFrame) -> DataFrame:
    """What a new synchronisation does for each song: ``action`` and the ``new_ms`` that it writes, null where it leaves the timing.

    Nothing where it isn't ready or the song has only a picture; an offset set by hand is left alone. Then the local video's
    own sound is tried, if it has any, then the known source; a search only reports whether another upload would fit.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    action = (
        F.when(~true("ready") | true("converted"), "none")
        .when(F.col("stored") == "manual", "skipped")
        .when(true("has_sound") & F.col("local_ms").isNotNull(), "from_local")
        .when(F.col("source_id").isNotNull() & F.col("source_ms").isNotNull(), "from_source")
        .when(true("other_fits"), "mismatch_reported")
        .otherwise("unchanged")
    )
    return df.withColumn("action", action).withColumn("new_ms", F.when(action == "from_local", F.col("local_ms")).when(action == "from_source", F.col("source_ms")))


def dumped(df: DataFrame) -> DataFrame:
    """What throwing away a song's video does: ``status``, the ``rejected`` list after it, and the files that go (``removes``).

    The source is rejected before anything is removed. A song without video or picture mark has nothing to dump; settings that
    can't be written to leave all as it was (failed). A source that isn't known can't be rejected.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(~true("has_video") & ~true("converted"), "nothing_to_dump").when(~true("writable"), "failed").otherwise("dumped")
    listed = F.when((status == "dumped") & F.col("source_id").isNotNull(), rejected_with(F.col("rejected"), F.col("source_id"))).otherwise(F.coalesce("rejected", F.lit("")))
    removes = F.array_join(F.array_compact(F.array(F.when(true("has_video"), "video.mp4"), F.when(true("converted") & true("has_art"), "album.png"))), ",")
    return df.withColumn("status", status).withColumn("rejected", listed).withColumn("removes", F.when(status == "dumped", removes).otherwise(""))


def used_titles(used: DataFrame, candidates: DataFrame) -> DataFrame:
    """``used`` with the title of its URL in the first place of the candidate list; ``-`` where it isn't listed."""
    first = candidates.groupBy("song_id", "video_id").agg(F.min_by("title", "idx").alias("title"))
    return used.join(first, ["song_id", "video_id"], "left").withColumn("title", F.coalesce("title", F.lit("-")))


def rejected_with(rejected: Column, video: Column) -> Column:
    """A comma list of rejected ids with one more, sorted, each once."""
    ids = F.filter(F.transform(F.split(F.coalesce(rejected, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
    return F.array_join(F.array_sort(F.array_union(ids, F.array(video))), ",")


def primary_first(primary: Column, urls: Column) -> Column:
    """A list of URLs with the primary one in front, and only there."""
    return F.concat(F.array(primary), F.array_remove(urls, primary))
