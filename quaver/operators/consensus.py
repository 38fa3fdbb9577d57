"""Crowd votes: one agreed answer for each item, and the questions that are asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.numeric import clamp, source_key
from quaver.functions.text import blank, strip

QUORUM = 3
DAY = 86_400
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"
CHART_HASH = r"^[A-Za-z0-9:._-]{1,128}$"


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in ``order`` (nulls first): an upsert replayed.

    The rows are aggregated, not sorted, so that a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order]))
    return df.groupBy(*keys).agg(last.alias("_row")).select(*keys, "_row.*")


def current_votes(votes: DataFrame) -> DataFrame:
    """The vote that stands of each client for each video: a vote delivered twice or cast again counts once."""
    held = latest_rows(votes, ["chart_hash", "video_id", "client_id"], ["seq"])
    return held.withColumn("source", source_key(F.col("ip"), F.col("client_id")))


def tallies(votes: DataFrame) -> DataFrame:
    """For each chart and video the number of different sources, the median start over all votes, and the last vote's ``last_seq``.

    The median of an even number of votes is cut towards zero.
    """
    counted = current_votes(votes).groupBy("chart_hash", "video_id")
    return counted.agg(F.countDistinct("source").alias("sources"), F.expr("cast(median(start_ms) as bigint)").alias("start_ms"), F.max("seq").alias("last_seq"))


def with_status(counts: DataFrame, mappings: DataFrame, quorum: int = QUORUM) -> DataFrame:
    """Tallies with the status that they lead to: a locked row keeps its own, a locked approved sibling blocks others.

    One video of a chart at most is approved by votes: each vote makes its video's status anew, and a video that is
    approved sends the others back to pending, so that of those with a quorum the one voted for last stays.
    """
    held = latest_rows(mappings, ["chart_hash", "video_id"], ["last_seen", "votes", "status", "locked"]).select("chart_hash", "video_id", F.col("status").alias("_was"), F.coalesce("locked", F.lit(0)).alias("locked"))
    locks = held.filter("locked = 1 and _was = 'approved'").groupBy("chart_hash").agg(F.count("*").alias("_n"), F.min("video_id").alias("_v"))
    both = counts.join(held, ["chart_hash", "video_id"], "left").join(locks, "chart_hash", "left")
    sibling = (F.col("_n") > 1) | (F.col("_v") != F.col("video_id"))
    both = both.withColumn("_may", (F.coalesce("locked", F.lit(0)) != 1) & (F.col("sources") >= quorum) & ~F.coalesce(sibling, F.lit(False)))
    # one row for each video by now, so that a hot chart is small
    last = both.filter("_may").groupBy("chart_hash").agg(F.max_by("video_id", F.struct(F.col("last_seq").isNotNull(), F.col("last_seq"), F.col("video_id"))).alias("_last"))
    both = both.join(last, "chart_hash", "left")
    stays = F.col("_may") & (F.col("video_id") == F.col("_last"))
    status = F.when(F.col("locked") == 1, F.col("_was")).when(stays, "approved").otherwise("pending")
    return both.select("chart_hash", "video_id", "sources", "start_ms", status.alias("status"), F.coalesce("locked", F.lit(0)).alias("locked"))


def replay_winner(votes: DataFrame, quorum: int = QUORUM) -> DataFrame:
    """The one approved video of each chart after all votes: of those with a quorum, the one voted for last.

    A video's status is made anew with each of its votes, so that the last vote for any video with a quorum wins.
    Both steps aggregate; a hot chart never meets in one task before it is a row for each video.
    """
    rows = votes.filter("seq is not null").withColumn("source", source_key(F.col("ip"), F.col("client_id")))
    pairs = rows.groupBy("chart_hash", "video_id").agg(F.countDistinct("source").alias("sources"), F.max("seq").alias("last_seq"))
    return pairs.filter(F.col("sources") >= quorum).groupBy("chart_hash").agg(F.max_by("video_id", F.struct("last_seq", F.col("video_id"))).alias("video_id"), F.max("last_seq").alias("last_seq"))


def resolve_best(mappings: DataFrame) -> DataFrame:
    """The mapping that is served for each chart: approved, locked first, then most votes, then the smaller id."""
    held = latest_rows(mappings, ["chart_hash", "video_id"], ["last_seen", "votes", "status", "locked"]).filter("status = 'approved'")
    order = Window.partitionBy("chart_hash").orderBy(F.coalesce("locked", F.lit(0)).desc(), F.coalesce("votes", F.lit(0)).desc(), "video_id")
    return held.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("chart_hash", "video_id", "start_ms", "votes")


def pending_queue(mappings: DataFrame, charts: DataFrame, most: int = 200) -> DataFrame:
    """Mappings to review, newest first: those not approved, of charts without an approved mapping, with their names."""
    approved = mappings.filter("status = 'approved'").select("chart_hash").distinct()
    waiting = mappings.filter("status is null or status <> 'approved'").join(approved, "chart_hash", "left_anti")
    named = waiting.join(charts.select("chart_hash", "artist", "title"), "chart_hash", "left")
    order = [F.col("last_seen").desc_nulls_last(), "chart_hash", "video_id", F.col("votes").desc_nulls_last(), F.col("status").asc_nulls_first(), F.col("locked").asc_nulls_first(), F.col("start_ms").asc_nulls_first()]
    return named.orderBy(*order).limit(most).select("chart_hash", "video_id", "votes", "status", "last_seen", "artist", "title")


def locked_siblings(mappings: DataFrame) -> DataFrame:
    """Mappings with another video of the same chart that is approved and locked."""
    locks = mappings.filter("locked = 1 and status = 'approved'").groupBy("chart_hash").agg(F.min("video_id").alias("_a"), F.max("video_id").alias("_b"))
    return mappings.join(locks, "chart_hash").filter("_a <> video_id or _b <> video_id").select("chart_hash", "video_id").distinct()


def activity_windows(pings: DataFrame, as_of: Column | int) -> DataFrame:
    """One row: clients in all, active in the last day, week and 30 days, and sharing in the last day and week.

    Bounds count as inside; an empty table gives zeros.
    """
    at = F.lit(as_of) if isinstance(as_of, int) else as_of
    since = lambda days: F.col("last_seen") >= at - days * DAY
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    sharing = F.col("sharing") == 1
    return pings.agg(
        F.count("*").alias("total"), n(since(1)).alias("active_24h"), n(since(7)).alias("active_7d"), n(since(30)).alias("active_30d"),
        n(since(1) & sharing).alias("sharing_24h"), n(since(7) & sharing).alias("sharing_7d"),
    )


def mapping_totals(mappings: DataFrame, charts: DataFrame, votes: DataFrame) -> DataFrame:
    """One row of counts over three tables; conditional counts share one pass over the mappings."""
    m = mappings.agg(F.count("*").alias("mappings"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "pending").alias("pending"))
    return m.crossJoin(charts.agg(F.count("*").alias("charts"))).crossJoin(votes.agg(F.count("*").alias("votes")))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows by status; null is a status of its own, written ``none``."""
    return df.groupBy(F.coalesce(F.col(status), F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


def daily_writes(votes: DataFrame, cap: int = 1000) -> DataFrame:
    """Votes of each address and UTC day, and how many are over the daily cap. Votes without an address don't count."""
    rows = votes.filter(~blank(F.col("ip")) & F.col("ts").isNotNull()).withColumn("day", F.floor(F.col("ts") / DAY).cast("long"))
    counts = rows.groupBy("ip", "day").agg(F.count("*").alias("writes"))
    return counts.withColumn("over", F.greatest(F.col("writes") - cap, F.lit(0).cast("long")))


def validated(votes: DataFrame, longest: int = 200) -> DataFrame:
    """Votes whose ids are well formed and whose texts are not too long, with the confidence kept within 0..1."""
    short = lambda c: F.coalesce(F.length(c) <= longest, F.lit(True))
    ok = F.col("video_id").rlike(VIDEO_ID) & F.col("chart_hash").rlike(CHART_HASH) & short("artist") & short("title")
    return votes.filter(ok).withColumn("confidence", clamp(F.col("confidence"), 0.0, 1.0))


def usable_answers(mappings: DataFrame, most_ms: int = 3_600_000) -> DataFrame:
    """Answers that a client accepts: approved, a well-formed id, a start of at most an hour either way."""
    return mappings.filter((F.col("status") == "approved") & F.col("video_id").rlike(VIDEO_ID) & (F.abs("start_ms") <= most_ms))


def merged_names(votes: DataFrame) -> DataFrame:
    """Each chart's artist and title as reported last, where a blank report doesn't overwrite one that states something."""
    said = lambda c: F.when(~blank(F.col(c)), strip(F.col(c)))
    last = lambda c: F.max_by(said(c), F.when(said(c).isNotNull(), F.struct("seq", said(c)))).alias(c)
    return votes.groupBy("chart_hash").agg(last("artist"), last("title"), F.max("ts").alias("last_seen"))
