"""Queries of the streaming operators, run to the end of what is there, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.operators.consensus import activity_windows
from quaver.plans.crowd import AS_OF, CURRENT
from quaver.plans.crowd import ORACLES as CROWD
from quaver.streaming import votes as op

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that map states need, for as long as a query runs; the session's own is set back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stream_curated(spark: SparkSession, folder: str) -> DataFrame:
    """Votes and the locked rows of the mappings as curators' decisions, the later one of a video standing."""
    decisions = op.stream(spark, folder, "mappings").filter("locked = 1 and status is not null").select("chart_hash", "video_id", F.coalesce("last_seen", F.lit(-1)).alias("seq"), F.col("status").alias("decision"))
    with rocks(spark):
        told = op.finish(op.curated(op.stream(spark, folder, "votes"), decisions), "update")
    return op.last_updates(told, ["chart_hash", "video_id"]).select("chart_hash", "video_id", "sources", "start_ms", "status", "locked")


def stream_consensus(spark: SparkSession, folder: str) -> DataFrame:
    with rocks(spark):
        told = op.finish(op.consensus(op.stream(spark, folder, "votes")), "update")
    return told.groupBy("chart_hash").agg(F.max_by("video_id", "last_seq").alias("video_id"), F.max("last_seq").alias("last_seq"))


def epoch(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.unix_seconds(column))


QUERIES = {
    "stream_consensus": stream_consensus,
    "stream_curated": stream_curated,
    "stream_pings": lambda s, d: activity_windows(op.finish(op.latest_pings(op.stream(s, d, "pings")), "complete"), AS_OF),
    "stream_write_days": lambda s, d: epoch(op.last_updates(op.finish(op.daily_writes(op.stream(s, d, "votes")), "update"), ["ip", "day"]), "day"),
    "stream_event_windows": lambda s, d: epoch(op.last_updates(op.finish(op.event_windows(op.stream(s, d, "events")), "update"), ["event_type", "start"]), "start"),
    "stream_sessions": lambda s, d: epoch(op.finish(op.user_sessions(op.stream(s, d, "events")), "complete"), "start"),
    "stream_enrich": lambda s, d: op.finish(op.first_contents(op.stream(s, d, "documents"))),
}

ORACLES = {
    "stream_consensus": CROWD["consensus_replay_winner"],
    "stream_curated": f"""WITH {CURRENT}, t AS (SELECT chart_hash, video_id, count(DISTINCT source) AS sources, CAST(trunc(median(start_ms)) AS BIGINT) AS start_ms, max(seq) AS last_seq FROM current WHERE seq IS NOT NULL GROUP BY ALL),
        d AS (SELECT chart_hash, video_id, status, coalesce(last_seen, -1) AS told, row_number() OVER (PARTITION BY chart_hash, video_id ORDER BY coalesce(last_seen, -1) DESC) AS k FROM mappings WHERE locked = 1 AND status IS NOT NULL),
        h AS (SELECT chart_hash, max_by(video_id, (told, video_id)) AS hand FROM d WHERE k = 1 AND status = 'approved' GROUP BY 1),
        l AS (SELECT d.chart_hash, d.video_id, d.status FROM d LEFT JOIN h USING (chart_hash) WHERE k = 1 AND (d.status <> 'approved' OR d.video_id = h.hand)),
        every AS (SELECT chart_hash, video_id FROM t UNION SELECT chart_hash, video_id FROM d),
        j AS (SELECT e.chart_hash, e.video_id, coalesce(t.sources, 0) AS sources, t.start_ms, t.last_seq, l.status AS fixed, h.hand,
                l.status IS NULL AND h.hand IS NULL AND coalesce(t.sources, 0) >= 3 AS may
              FROM every e LEFT JOIN t USING (chart_hash, video_id) LEFT JOIN l USING (chart_hash, video_id) LEFT JOIN h USING (chart_hash)),
        w AS (SELECT chart_hash, max_by(video_id, (last_seq, video_id)) AS win FROM j WHERE may GROUP BY 1)
        SELECT chart_hash, video_id, CAST(sources AS INTEGER) AS sources, start_ms, CASE WHEN fixed IS NOT NULL THEN fixed WHEN may AND video_id = win THEN 'approved' ELSE 'pending' END AS status,
            CAST((fixed IS NOT NULL)::INT AS INTEGER) AS locked FROM j LEFT JOIN w USING (chart_hash)""",
    "stream_pings": CROWD["client_activity_windows"],
    "stream_write_days": "SELECT ip, CAST(floor(ts / 86400.0) AS BIGINT) * 86400 AS day, count(*) AS writes FROM votes WHERE ts IS NOT NULL AND trim(ip) <> '' GROUP BY ALL",
    "stream_event_windows": """WITH e AS (SELECT event_type, value, CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 AS slot FROM events), w AS (SELECT event_type, value, slot AS start FROM e UNION ALL SELECT event_type, value, slot - 1800 FROM e)
        SELECT event_type, start, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, id""",
    "stream_enrich": "SELECT DISTINCT sha256(text) AS digest FROM documents WHERE text IS NOT NULL",
}
