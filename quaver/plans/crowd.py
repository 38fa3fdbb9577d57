"""Queries over the crowd's votes, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions import numeric
from quaver.functions.text import version_numbers
from quaver.operators import consensus as op
from quaver.session import table

AS_OF = 1_735_000_000

SOURCE = "CASE WHEN coalesce(trim(ip) <> '', false) THEN 'ip:' || substr(sha256(ip), 1, 16) ELSE 'cid:' || coalesce(client_id, '') END"
CURRENT = f"""current AS (
    SELECT *, {SOURCE} AS source FROM (
        SELECT *, row_number() OVER (PARTITION BY chart_hash, video_id, client_id
                                     ORDER BY seq DESC) AS k
        FROM (SELECT DISTINCT * FROM votes)) WHERE k = 1)"""
HELD = """held AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chart_hash, video_id
        ORDER BY last_seen DESC NULLS LAST, votes DESC NULLS LAST, status DESC NULLS LAST, locked DESC NULLS LAST) AS k FROM mappings) WHERE k = 1)"""


def votes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "votes")


def mappings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mappings")


QUERIES = {
    "vote_latest_per_key": lambda s, d: op.current_votes(votes(s, d)).select("chart_hash", "video_id", "client_id", "seq", "start_ms"),
    "vote_quorum": lambda s, d: op.tallies(votes(s, d)).drop("last_seq").withColumn("quorum", F.col("sources") >= op.QUORUM),
    "mapping_recompute": lambda s, d: op.with_status(op.tallies(votes(s, d)), mappings(s, d)),
    "consensus_replay_winner": lambda s, d: op.replay_winner(votes(s, d)),
    "resolve_best": lambda s, d: op.resolve_best(mappings(s, d)),
    "pending_queue": lambda s, d: op.pending_queue(mappings(s, d), table(s, d, "charts")),
    "locked_sibling_semi": lambda s, d: op.locked_siblings(mappings(s, d)),
    "client_activity_windows": lambda s, d: op.activity_windows(table(s, d, "pings"), AS_OF),
    "mapping_totals": lambda s, d: op.mapping_totals(mappings(s, d), table(s, d, "charts"), votes(s, d)),
    "status_counts": lambda s, d: op.status_counts(mappings(s, d)),
    "write_cap_daily": lambda s, d: op.daily_writes(votes(s, d), 3),
    "input_validation": lambda s, d: op.validated(votes(s, d)).select("seq", "chart_hash", "video_id", "confidence"),
    "usable_answers": lambda s, d: op.usable_answers(mappings(s, d)).select("chart_hash", "video_id", "start_ms", "last_seen"),
    "chart_names_merged": lambda s, d: op.merged_names(votes(s, d)),
    "source_key_hash": lambda s, d: votes(s, d).select("seq", numeric.source_key(F.col("ip"), F.col("client_id")).alias("source")).distinct(),
    "version_compare": lambda s, d: table(s, d, "pings").select("client_id", (version_numbers(F.col("app_version")) >= F.array(F.lit(1), F.lit(2))).alias("at_least_1_2")).filter("at_least_1_2 is not null"),
}

ORACLES = {
    "vote_latest_per_key": f"WITH {CURRENT} SELECT chart_hash, video_id, client_id, seq, start_ms FROM current",
    "vote_quorum": f"""WITH {CURRENT} SELECT chart_hash, video_id, count(DISTINCT source) AS sources, CAST(trunc(median(start_ms)) AS BIGINT) AS start_ms,
        count(DISTINCT source) >= 3 AS quorum FROM current GROUP BY ALL""",
    "mapping_recompute": f"""WITH {CURRENT}, {HELD},
        t AS (SELECT chart_hash, video_id, count(DISTINCT source) AS sources, CAST(trunc(median(start_ms)) AS BIGINT) AS start_ms, max(seq) AS last_seq FROM current GROUP BY ALL),
        j AS (SELECT t.*, h.status, coalesce(h.locked, 0) AS locked, coalesce(h.locked, 0) <> 1 AND t.sources >= 3
                AND NOT EXISTS (SELECT 1 FROM held o WHERE o.chart_hash = t.chart_hash AND o.video_id <> t.video_id AND o.locked = 1 AND o.status = 'approved') AS may
              FROM t LEFT JOIN held h ON h.chart_hash = t.chart_hash AND h.video_id = t.video_id)
        SELECT chart_hash, video_id, sources, start_ms, CAST(locked AS INTEGER) AS locked, CASE WHEN locked = 1 THEN status
            WHEN may AND NOT EXISTS (SELECT 1 FROM j o WHERE o.chart_hash = j.chart_hash AND o.may AND (o.last_seq, o.video_id) > (j.last_seq, j.video_id)) THEN 'approved' ELSE 'pending' END AS status
        FROM j""",
    # an independent route: every vote's running number of sources, then the last vote that leaves a quorum
    "consensus_replay_winner": f"""WITH v AS (SELECT *, {SOURCE} AS source FROM (SELECT DISTINCT * FROM votes WHERE seq IS NOT NULL)),
        f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY chart_hash, video_id, source ORDER BY seq) = 1 THEN 1 ELSE 0 END AS new FROM v),
        r AS (SELECT *, sum(new) OVER (PARTITION BY chart_hash, video_id ORDER BY seq) AS sofar FROM f)
        SELECT chart_hash, max_by(video_id, seq) AS video_id, max(seq) AS last_seq FROM r WHERE sofar >= 3 GROUP BY chart_hash""",
    "resolve_best": f"""WITH {HELD}, r AS (SELECT *, row_number() OVER (PARTITION BY chart_hash
            ORDER BY coalesce(locked, 0) DESC, coalesce(votes, 0) DESC, video_id) AS place FROM held WHERE status = 'approved')
        SELECT chart_hash, video_id, start_ms, votes FROM r WHERE place = 1""",
    "pending_queue": """SELECT m.chart_hash, m.video_id, m.votes, m.status, m.last_seen, c.artist, c.title
        FROM mappings m LEFT JOIN charts c USING (chart_hash)
        WHERE m.status IS DISTINCT FROM 'approved' AND NOT EXISTS (SELECT 1 FROM mappings a WHERE a.chart_hash = m.chart_hash AND a.status = 'approved')
        ORDER BY m.last_seen DESC NULLS LAST, m.chart_hash, m.video_id, m.votes DESC NULLS LAST, m.status ASC NULLS FIRST, m.locked ASC NULLS FIRST, m.start_ms ASC NULLS FIRST LIMIT 200""",
    "locked_sibling_semi": """SELECT DISTINCT chart_hash, video_id FROM mappings m WHERE EXISTS (
        SELECT 1 FROM mappings o WHERE o.chart_hash = m.chart_hash AND o.video_id <> m.video_id AND o.status = 'approved' AND o.locked = 1)""",
    "client_activity_windows": f"""SELECT count(*) AS total, count(*) FILTER (last_seen >= {AS_OF} - 86400) AS active_24h, count(*) FILTER (last_seen >= {AS_OF} - 604800) AS active_7d,
        count(*) FILTER (last_seen >= {AS_OF} - 2592000) AS active_30d, count(*) FILTER (last_seen >= {AS_OF} - 86400 AND sharing = 1) AS sharing_24h,
        count(*) FILTER (last_seen >= {AS_OF} - 604800 AND sharing = 1) AS sharing_7d FROM pings""",
    "mapping_totals": """SELECT (SELECT count(*) FROM mappings) AS mappings, (SELECT count(*) FROM mappings WHERE status = 'approved') AS approved,
        (SELECT count(*) FROM mappings WHERE status = 'pending') AS pending, (SELECT count(*) FROM charts) AS charts, (SELECT count(*) FROM votes) AS votes""",
    "status_counts": "SELECT coalesce(status, 'none') AS status, count(*) AS n FROM mappings GROUP BY 1",
    "write_cap_daily": r"""SELECT ip, CAST(floor(ts / 86400.0) AS BIGINT) AS day, count(*) AS writes, greatest(count(*) - 3, 0) AS over
        FROM votes WHERE regexp_replace(ip, '^\s+|\s+$', '', 'g') <> '' AND ts IS NOT NULL GROUP BY 1, 2""",
    "input_validation": """SELECT seq, chart_hash, video_id, greatest(0, least(1, confidence)) * (CASE WHEN confidence IS NULL THEN NULL ELSE 1 END) AS confidence FROM votes
        WHERE regexp_full_match(video_id, '[A-Za-z0-9_-]{11}') AND regexp_full_match(chart_hash, '[A-Za-z0-9:._-]{1,128}')
          AND coalesce(length(artist) <= 200, true) AND coalesce(length(title) <= 200, true)""",
    "usable_answers": """SELECT chart_hash, video_id, start_ms, last_seen FROM mappings WHERE status = 'approved'
        AND regexp_full_match(video_id, '[A-Za-z0-9_-]{11}') AND abs(start_ms) <= 3600000""",
    "chart_names_merged": r"""WITH v AS (SELECT chart_hash, seq, ts, regexp_replace(artist, '^[\s\x0b\x{00a0}\x{3000}\x{2000}-\x{200a}\x{202f}]+|[\s\x0b\x{00a0}\x{3000}\x{2000}-\x{200a}\x{202f}]+$', '', 'g') AS a,
            regexp_replace(title, '^[\s\x0b\x{00a0}\x{3000}\x{2000}-\x{200a}\x{202f}]+|[\s\x0b\x{00a0}\x{3000}\x{2000}-\x{200a}\x{202f}]+$', '', 'g') AS t FROM votes)
        SELECT chart_hash, max_by(nullif(a, ''), (seq, a)) FILTER (a <> '') AS artist, max_by(nullif(t, ''), (seq, t)) FILTER (t <> '') AS title, max(ts) AS last_seen FROM v GROUP BY 1""",
    "source_key_hash": f"SELECT DISTINCT seq, {SOURCE} AS source FROM votes",
    "version_compare": r"""SELECT client_id, [CAST(x AS INTEGER) FOR x IN regexp_extract_all(app_version, '(\d+)', 1)] >= [1, 2] AS at_least_1_2 FROM pings WHERE app_version IS NOT NULL""",
}
