"""Queries over whole songs and single readings that no other module asks for, and SQL with the same rows.

Patterns and lists are written out here once more, so that a slip in an operator's own doesn't pass on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions import numeric
from quaver.functions import text as fx
from quaver.operators import backoff, candidates, catalog, charts, duplicates, enrich, frames, naming, palette
from quaver.plans import library
from quaver.plans.crowd import AS_OF
from quaver.session import table
from quaver.sources import files, ini


def chart_songs(s: SparkSession, d: str) -> DataFrame:
    """Chart texts as song folders: every third has no settings name, so that the chart or the folder must say it."""
    rows = table(s, d, "documents").filter("source = 'chart_file' and text is not null")
    n = F.col("doc_id") % 3
    return rows.select(
        F.concat(F.lit("lib/song "), F.col("doc_id")).alias("folder"), "doc_id", "chart_hash", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"),
        F.when(n == 0, F.lit(" ")).when(n == 1, F.concat(F.lit(" Named "), F.col("doc_id"))).alias("name"), F.when(n == 1, F.lit("Someone")).alias("artist"),
    )


CHART_SONGS = """cs AS (SELECT 'lib/song ' || doc_id AS folder, doc_id, chart_hash, CASE WHEN doc_id % 5 <> 0 THEN text END AS text,
    CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' Named ' || doc_id END AS name, CASE WHEN doc_id % 3 = 1 THEN 'Someone' END AS artist FROM documents WHERE source = 'chart_file' AND text IS NOT NULL)"""


def paths(s: SparkSession, d: str) -> DataFrame:
    """Folders below review folders and below others that only look like them, by their length."""
    n = F.length("folder") % 7
    above = F.element_at(F.array(*[F.lit(x) for x in ("Songs", "Songs_needs_review", "Peer Review", "_NeedsReview", "needs review", "x_duplicates_review", "_duplicates")]), (n + 1).cast("int"))
    return table(s, d, "ini_fields").select("folder", F.concat(F.lit("lib/"), above, F.lit("/"), F.regexp_replace("folder", "/", "_")).alias("path"))


def song_files(s: SparkSession, d: str) -> DataFrame:
    """The made-up files of song folders with some more names: archives, covers, previews, a probe."""
    n = F.length("folder")
    more = F.array_compact(
        F.array(
            F.when(n % 13 == 0, "pack.sng"), F.when(n % 4 == 1, "album_12.png"), F.when(n % 10 == 3, "Album.JPG"), F.when(n % 3 == 2, "preview.ogg"),
            F.when(n % 2 == 1, "crowd.opus"), F.when(n % 6 == 5, "take.flac"), F.when(n % 7 == 2, "probe.m4a"), F.when(n % 5 == 4, "albumen.png"),
        )
    )
    extra = table(s, d, "ini_fields").select(F.col("folder").alias("parent"), F.explode(more).alias("name")).withColumn("length", F.lit(1).cast("long"))
    return library.stems(s, d).unionByName(extra).withColumn("probe", F.lit("probe.m4a"))


SONG_FILES = f"""{library.FILES}, sf AS (SELECT parent, name FROM files UNION ALL SELECT parent, unnest(list_filter([CASE WHEN n % 13 = 0 THEN 'pack.sng' END, CASE WHEN n % 4 = 1 THEN 'album_12.png' END,
    CASE WHEN n % 10 = 3 THEN 'Album.JPG' END, CASE WHEN n % 3 = 2 THEN 'preview.ogg' END, CASE WHEN n % 2 = 1 THEN 'crowd.opus' END, CASE WHEN n % 6 = 5 THEN 'take.flac' END, CASE WHEN n % 7 = 2 THEN 'probe.m4a' END,
    CASE WHEN n % 5 = 4 THEN 'albumen.png' END], lambda x: x IS NOT NULL)) FROM (SELECT folder AS parent, length(folder) AS n FROM ini_fields))"""


def settled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ini_fields").select(F.col("folder").alias("parent"), "status")


def checked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ini_fields").select(F.col("folder").alias("parent"), (F.length("folder") % 3 == 0).alias("ok"))


def prints(s: SparkSession, d: str) -> DataFrame:
    """A fingerprint of most copies: that of the group, or its opposite."""
    n = F.length("folder")
    bits = F.when(n % 7 == 0, F.lit(None)).when(n % 5 == 0, F.array(-1 - F.col("group_id"))).otherwise(F.array(F.col("group_id")))
    return table(s, d, "dupgroups").select("folder", bits.cast("array<bigint>").alias("bits"))


def described(s: SparkSession, d: str) -> DataFrame:
    """Whole rows of the library, from chart texts, their files, scores and records."""
    songs = chart_songs(s, d)
    n = F.col("doc_id")
    songs = songs.withColumn("has_ini", n % 4 != 0).withColumn("mid_md5", F.col("chart_hash")).withColumn("song_length", F.when(n % 6 == 1, "long").when(n % 6 == 2, "").otherwise((n * 1000).cast("string")))
    stems = songs.select(F.col("folder").alias("parent"), F.explode(F.array_compact(F.array(F.lit("song.ogg"), F.when(n % 2 == 0, "Guitar.ogg"), F.when(n % 3 == 0, "drums.mp3"), F.when(n % 5 == 1, "album.png"), F.lit("notes.chart")))).alias("name"))
    found = songs.filter(n % 2 == 1).select("folder", F.col("doc_id").alias("record_id")).join(table(s, d, "records"), "record_id").select("folder", *enrich.MATCHED)
    return enrich.library_rows(songs.drop("name", "artist"), stems, library.scores(s, d), found, F.timestamp_seconds(F.lit(AS_OF)))


def flat_described(s: SparkSession, d: str) -> DataFrame:
    rows = described(s, d)
    present = F.size(F.map_filter("instruments", lambda k, v: v == 1))
    return rows.select("folder", "chart_hash", "song_length_ms", present.alias("parts"), "note_count", "avg_nps", "features.*", F.array_join("stems", ",").alias("stems"), "has_album_art", "high_score", F.array_join("problems", ";").alias("problems"), F.col("chorus_match.name").alias("match_name"), F.col("chorus_match.charter").alias("match_charter"), "last_updated", "status")


def resync_cases(s: SparkSession, d: str) -> DataFrame:
    """Every case of a new synchronisation, from the mappings' numbers."""
    v, m = F.coalesce("votes", F.lit(0)), table(s, d, "mappings")
    return m.select(
        "chart_hash", "video_id", (v % 11 != 0).alias("ready"), (v % 7 == 3).alias("converted"), F.when(F.col("locked") == 1, "manual").alias("stored"), (v % 2 == 0).alias("has_sound"),
        F.when(v % 3 == 0, F.col("start_ms")).alias("local_ms"), F.when(F.col("status") != "rejected", F.col("video_id")).alias("source_id"), F.when(v % 5 < 2, F.col("start_ms") + 1).alias("source_ms"), F.when(v % 4 == 1, F.lit(True)).alias("other_fits"),
    )


def dump_cases(s: SparkSession, d: str) -> DataFrame:
    v, m = F.coalesce("votes", F.lit(0)), table(s, d, "mappings")
    return m.select("chart_hash", "video_id", (v % 3 != 0).alias("has_video"), (v % 4 == 0).alias("converted"), (v % 5 != 1).alias("writable"), F.when(F.col("status") != "pending", F.col("video_id")).alias("source_id"), F.when(v % 2 == 0, F.lit("zz, aa,zz")).alias("rejected"), (v % 8 == 0).alias("has_art"))


def used_cases(s: SparkSession, d: str) -> DataFrame:
    v, m = F.coalesce("votes", F.lit(0)), table(s, d, "mappings")
    return m.select("chart_hash", "video_id", F.when(v % 6 != 5, F.col("video_id")).alias("used_id"), F.when(v % 2 == 0, F.col("video_id")).otherwise("other").alias("measured_id"), F.col("start_ms").alias("measured_ms"), F.col("video_id").alias("pooled_id"), F.when(v % 3 == 0, F.lit(7).cast("long")).alias("pooled_ms"), F.when(v % 9 == 0, "static").otherwise("video").alias("verdict"))


def score_files(s: SparkSession, d: str) -> DataFrame:
    """One score file for each ping: a header, one song named by the client's digest, two parts."""
    hexed = lambda c, size: F.lpad(F.hex(c), 2 * size, "0")
    swapped = lambda c, size: F.concat(*[F.substring(hexed(c, size), 2 * k + 1, 2) for k in reversed(range(size))])
    n = F.ascii(F.substring("client_id", -1, 1))
    part = lambda p, score: F.concat(swapped(p, 4), hexed(F.lit(3), 1), swapped(F.lit(98), 2), swapped(F.lit(100), 2), hexed(F.lit(5), 1), hexed(F.lit(0), 1), swapped(score, 4))
    body = F.concat(F.lit("00000000"), swapped(F.lit(1), 4), hexed(F.lit(32), 1), F.hex(F.upper(F.md5("client_id"))), hexed(F.lit(2), 1), hexed(n % 200, 1), part(F.lit(0), n * 1000), part(F.lit(3), n * 77))
    # a file cut short has no rows at all
    return table(s, d, "pings").select(F.unhex(F.when(n % 4 == 0, F.substring(body, 1, 90)).otherwise(body)).alias("content"))


def contents(s: SparkSession, d: str) -> DataFrame:
    rows = chart_songs(s, d).filter("text is not null")
    name = F.element_at(F.array(F.lit("notes.chart"), F.lit("Notes.MID"), F.lit("notes.eof"), F.lit("song.ini")), (F.col("doc_id") % 4 + 1).cast("int"))
    return rows.select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 8)).alias("parent"), name.alias("name"), F.encode("text", "UTF-8").alias("content"), "doc_id")


def hashed_contents(s: SparkSession, d: str) -> DataFrame:
    # one file of a name in a folder
    rows = contents(s, d)
    first = rows.groupBy("parent", "name").agg(F.min_by("content", "doc_id").alias("content"))
    return files.content_hashes(first)


def known_rates(s: SparkSession, d: str) -> DataFrame:
    v, m = F.coalesce("votes", F.lit(0)), table(s, d, "mappings")
    media = m.select("chart_hash", "video_id", F.when(v % 2 == 0, "WEBM").otherwise("mp4").alias("container"), F.when(v % 3 == 0, "vp8").otherwise("vp9").alias("codec"), F.lit("30/1").alias("r_frame_rate"), F.when(v % 5 == 0, "30/1").otherwise("2997/100").alias("avg_frame_rate"))
    return frames.repair_verdicts(media).groupBy("problem").agg(F.count("*").alias("n"))


def hex_colours(s: SparkSession, d: str) -> DataFrame:
    c = library.colours(s, d).select("r", "g", "b").distinct().withColumn("x", palette.rgb_to_hls("r", "g", "b"))
    return c.select("r", "g", "b", palette.hls_to_hex("x.h", "x.l", "x.s").alias("hex"))


def searched(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "records").select("record_id", fx.quoted(F.concat_ws(" ", "artist", "name")).alias("query"))


QUERIES = {
    "metadata_chain": lambda s, d: ini.with_names(charts.song_block(chart_songs(s, d))),
    "chart_song_block": lambda s, d: charts.song_block(library.chart_texts(s, d)).select("doc_id", "block_artist", "block_title"),
    "review_folders": lambda s, d: paths(s, d).filter(naming.in_review(F.col("path"))).select("folder"),
    "mixed_stems": lambda s, d: naming.mixed_stems(song_files(s, d)).select("parent", F.array_join("stems", ",").alias("stems")),
    "art_states": lambda s, d: naming.art_states(song_files(s, d)),
    "naming_audit": lambda s, d: naming.audited(song_files(s, d), settled(s, d), checked(s, d)),
    "library_rows": flat_described,
    "dedupe_report": lambda s, d: duplicates.report(library.copies(s, d), prints(s, d)),
    "resync_plan": lambda s, d: candidates.resynced(resync_cases(s, d)).groupBy("action").agg(F.count("*").alias("n"), F.sum("new_ms").alias("ms")),
    "dump_plan": lambda s, d: candidates.dumped(dump_cases(s, d)).groupBy("chart_hash", "video_id", "status", "rejected", "removes").agg(F.count("*").alias("n")),
    "offset_of_url": lambda s, d: candidates.offset_after(used_cases(s, d)).groupBy("source", "outcome").agg(F.count("*").alias("n"), F.sum("offset_ms").alias("ms")),
    "score_rows": lambda s, d: files.scores(score_files(s, d)),
    "content_hashes": hashed_contents,
    "cache_fresh": lambda s, d: enrich.fresh(table(s, d, "pings").withColumn("cached_at", F.col("last_seen")), AS_OF, 7).select("client_id"),
    "iso_stamps": lambda s, d: table(s, d, "documents").select("doc_id", enrich.stamp(F.col("posted_at")).alias("stamp")),
    "hls_hex": hex_colours,
    "frame_repair": known_rates,
    "candidates_allowed": lambda s, d: candidates.allowed(library.offers(s, d).select("song_id", "video_id"), table(s, d, "mappings").filter("status = 'rejected'").groupBy(F.col("chart_hash").alias("song_id")).agg(F.array_join(F.sort_array(F.collect_set("video_id")), ", ").alias("rejected"))),
    "run_summary": lambda s, d: enrich.run_summary(library.exact_filled(s, d).select((F.col("filled") == "").alias("problem"), F.size(F.filter(F.split("filled", ","), lambda x: x != "")).alias("n_filled"))),
    "root_states": lambda s, d: table(s, d, "mappings").select("chart_hash", "video_id", catalog.root_state(F.col("status").isNotNull(), F.coalesce(F.col("locked") == 1, F.lit(False)), F.coalesce("votes", F.lit(0))).alias("state")).groupBy("state").agg(F.count("*").alias("n")),
    "summary_lines": lambda s, d: table(s, d, "mappings").groupBy("chart_hash").agg(catalog.summary_line(F.map_from_arrays(F.array(F.lit("pending"), F.lit("approved"), F.lit("none")), F.array(F.count_if(F.col("status") == "pending"), F.count_if(F.col("status") == "approved"), F.lit(0).cast("long")))).alias("line")),
    "retry_waits": lambda s, d: table(s, d, "mappings").select("votes").distinct().select("votes", numeric.retry_after(F.when(F.col("votes") % 2 == 0, F.col("votes").cast("string")).otherwise("Wed, 01 Jan 2025 00:00:10 GMT"), F.lit(1735689600)).alias("wait")),
    "probe_seconds": lambda s, d: table(s, d, "records").select("record_id", numeric.duration_seconds(F.concat(F.lit("x Duration: 01:"), F.lpad((F.col("record_id") % 60).cast("string"), 2, "0"), F.lit(":09.50, start"))).alias("seconds")),
    "backoff_waits": lambda s, d: table(s, d, "records").select("record_id", numeric.backoff(F.lit(1.5), (F.col("record_id") % 6).cast("int")).alias("wait")),
    "video_ids": lambda s, d: table(s, d, "mappings").select("chart_hash", fx.video_id_of(F.when(F.coalesce("votes", F.lit(0)) % 2 == 0, F.concat(F.lit("https://v.example/watch?t=1&v="), "video_id", F.lit("&x=2"))).otherwise(F.concat(F.lit("plain/"), F.col("video_id")))).alias("id")).distinct(),
    "error_kinds": lambda s, d: table(s, d, "documents").select("doc_id", fx.error_kind(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Sign in to confirm"))).when(F.col("doc_id") % 3 == 1, F.lit("HTTP Error 500")))  .alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "search_queries": searched,
    "urls_primary_first": lambda s, d: table(s, d, "mappings").filter("chart_hash is not null and video_id is not null").groupBy("chart_hash").agg(F.sort_array(F.collect_set("video_id")).alias("u"), F.max("video_id").alias("p")).select("chart_hash", F.array_join(candidates.primary_first(F.col("p"), F.col("u")), ",").alias("urls")),
    "settings_written": lambda s, d: library.ini_texts(s, d).select("doc_id", files.set_values(F.col("text"), {"charter": F.lit("new $1"), "video_start_time": F.lit("-3000")}).alias("text")).select("doc_id", F.md5("text").alias("digest")),
    "latest_first": lambda s, d: files.newest(table(s, d, "votes").filter("seq is not null").select("client_id", "seq").distinct(), ["client_id"], "seq", 3),
}

FIELD = lambda f: rf"""regexp_extract_all(body, '(?im)^[ \t]*{f}[ \t]*=([^\r\n]*)', 1)[-1]"""
BARE = lambda x: rf"""nullif(trim(trim(trim(regexp_replace({x}, '[\r\t]', '', 'g')), '"')), '')"""
BLOCK = lambda source: rf"""blk AS (SELECT *, regexp_extract(text, '(?is)\[Song\](.*?)(?:\n\s*\[|\z)', 1) AS body FROM {source}), said AS (SELECT * EXCLUDE (body), {BARE(FIELD('artist'))} AS block_artist, {BARE(FIELD('name'))} AS block_title FROM blk)"""
V = "coalesce(votes, 0)"

ORACLES = {
    "metadata_chain": f"""WITH {CHART_SONGS}, {BLOCK('cs')} SELECT folder, CASE WHEN trim(coalesce(name, '')) <> '' THEN artist WHEN block_title IS NOT NULL THEN block_artist END AS artist,
        CASE WHEN trim(coalesce(name, '')) <> '' THEN trim(name) WHEN block_title IS NOT NULL THEN block_title ELSE 'song ' || doc_id END AS title,
        CASE WHEN trim(coalesce(name, '')) <> '' THEN 'settings' WHEN block_title IS NOT NULL THEN 'chart' ELSE 'folder' END AS said_by FROM said""",
    "chart_song_block": f"WITH {library.TEXTS}, {BLOCK('c')} SELECT doc_id, block_artist, block_title FROM said",
    "review_folders": "SELECT folder FROM ini_fields WHERE length(folder) % 7 IN (1, 3, 5)",
    "mixed_stems": f"""WITH {SONG_FILES} SELECT parent, array_to_string(list_sort(coalesce(list(name) FILTER (regexp_matches(lower(name), '\\.(ogg|opus|mp3|wav|m4a|flac)$') AND lower(name) NOT IN ('preview.ogg', 'crowd.opus') AND name <> 'probe.m4a'), [])), ',') AS stems FROM sf GROUP BY parent""",
    "art_states": f"""WITH {SONG_FILES}, a AS (SELECT parent, count(*) FILTER (lower(name) IN ('album.jpg', 'album_12.png')) AS n, count(*) FILTER (lower(name) = 'album.jpg') AS whole FROM sf GROUP BY 1)
        SELECT parent, CASE WHEN n > 1 THEN 'needs_review' WHEN n = 1 AND whole = 0 THEN 'rename_candidate' ELSE 'ok' END AS status, n AS covers FROM a""",
    "naming_audit": f"""WITH {SONG_FILES}, g AS (SELECT parent, count(*) FILTER (name LIKE '%.ini') AS i, count(*) FILTER (name IN ('notes.chart', 'notes_4.mid')) AS c, count(*) FILTER (name = 'song.ini') AS io, count(*) FILTER (name = 'notes.chart') AS co,
            count(*) FILTER (name = 'pack.sng') > 0 AS sng, count(*) FILTER (lower(name) IN ('album.jpg', 'album_12.png')) > 1 AS art,
            count(*) FILTER (name IN ('guitar.ogg', 'guitar_12.ogg')) > 1 AS twice, count(*) FILTER (name IN ('guitar_12.ogg', 'vocals_77.opus')) > 0 AS numbered FROM sf GROUP BY 1),
        n AS (SELECT g.*, CASE WHEN i = 0 THEN 'no_ini' WHEN i > 1 OR c > 1 THEN 'ambiguous' WHEN c = 0 THEN 'no_chart_file' WHEN io = 0 OR co = 0 THEN 'id_suffixed' ELSE 'ok' END AS names, f.status AS was, length(f.folder) % 3 = 0 AS sure FROM g JOIN ini_fields f ON f.folder = g.parent),
        q AS (SELECT *, list_filter([CASE WHEN NOT (names = 'ok' OR names = 'id_suffixed' AND sure) THEN 'names: ' || names END,
            CASE WHEN twice THEN 'stems: needs_review' WHEN numbered AND NOT sure THEN 'stems: rename_candidate' END, CASE WHEN art THEN 'art: needs_review' END], lambda x: x IS NOT NULL) AS doubts FROM n),
        z AS (SELECT *, CASE WHEN sng THEN 'skipped_sng' WHEN was = 'confirmed_ok' THEN 'skipped_settled' WHEN len(doubts) > 0 THEN 'needs_review' ELSE 'confirmed_ok' END AS status FROM q)
        SELECT parent, status, CASE WHEN status = 'needs_review' THEN array_to_string(doubts, '; ') ELSE '' END AS detail FROM z""",
    "library_rows": f"""WITH {CHART_SONGS}, n AS ({library.ORACLES['note_count_nps']}), f AS ({library.ORACLES['chart_features']}), i AS (SELECT doc_id, count(*) FILTER (present = 1) AS parts FROM ({library.ORACLES['chart_instruments']}) GROUP BY 1),
        hs AS (SELECT chart_hash, max(CAST(votes AS BIGINT)) AS high_score FROM mappings WHERE votes IS NOT NULL GROUP BY 1)
        SELECT cs.folder, cs.chart_hash, CASE WHEN doc_id % 4 <> 0 AND doc_id % 6 NOT IN (1, 2) THEN doc_id * 1000 END AS song_length_ms, CASE WHEN text IS NULL THEN 0 ELSE parts END AS parts,
            CASE WHEN text IS NOT NULL THEN note_count END AS note_count, CASE WHEN text IS NOT NULL THEN nps END AS avg_nps,
            text IS NOT NULL AND has_lyrics AS has_lyrics, text IS NOT NULL AND has_solos AS has_solos, text IS NOT NULL AND has_open_notes AS has_open_notes, text IS NOT NULL AND has_2x_kick AS has_2x_kick, text IS NOT NULL AND has_roll_lanes AS has_roll_lanes,
            array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'Guitar.ogg' END, CASE WHEN doc_id % 3 = 0 THEN 'drums.mp3' END, 'song.ogg'], lambda x: x IS NOT NULL), ',') AS stems, doc_id % 5 = 1 AS has_album_art, high_score,
            array_to_string(list_filter([CASE WHEN doc_id % 4 <> 0 AND doc_id % 6 = 1 THEN 'song.ini song_length ''long'' is not numeric' END, CASE WHEN doc_id % 4 = 0 THEN 'no song.ini found' END,
                CASE WHEN text IS NULL THEN 'no notes.chart found -- instrument/NPS/feature data unavailable' END], lambda x: x IS NOT NULL), ';') AS problems,
            r.name AS match_name, r.charter AS match_charter, strftime(to_timestamp({AS_OF}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS last_updated, 'success' AS status
        FROM cs JOIN n USING (doc_id) JOIN f USING (doc_id) JOIN i USING (doc_id) LEFT JOIN hs USING (chart_hash) LEFT JOIN records r ON r.record_id = cs.doc_id AND doc_id % 2 = 1 WHERE cs.chart_hash IS NOT NULL""",
    "dedupe_report": f"""WITH {library.COPIES}, p AS (SELECT group_id, ord, folder, CASE WHEN length(folder) % 7 = 0 THEN NULL WHEN length(folder) % 5 = 0 THEN 1 ELSE 0 END AS side FROM dupgroups JOIN ini_fields USING (folder)),
        ref AS (SELECT group_id, arg_min(side, (ord, folder)) AS ref FROM p WHERE side IS NOT NULL GROUP BY 1), ok AS (SELECT p.group_id, p.folder FROM p JOIN ref USING (group_id) WHERE side = ref),
        sure AS (SELECT * FROM ok WHERE group_id IN (SELECT group_id FROM ok GROUP BY 1 HAVING count(*) > 1)),
        kept AS (SELECT group_id, arg_max(folder, (score, -ord)) AS keeper FROM copies JOIN sure USING (group_id, folder) WHERE eligible GROUP BY 1)
        SELECT c.group_id, c.folder, CASE WHEN s.folder IS NULL THEN 'not_confirmed' WHEN keeper IS NULL THEN 'none_eligible' WHEN keeper = c.folder THEN 'keeper' ELSE 'move' END AS action, c.score, CASE WHEN s.folder IS NOT NULL THEN keeper END AS keeper,
            CASE WHEN s.folder IS NOT NULL AND keeper <> c.folder THEN array_to_string(list_sort(list_filter(c.has, lambda x: NOT list_contains(k.has, x))), ',') ELSE '' END AS borrow
        FROM copies c LEFT JOIN sure s ON s.group_id = c.group_id AND s.folder = c.folder LEFT JOIN kept ON kept.group_id = c.group_id LEFT JOIN copies k ON k.group_id = c.group_id AND k.folder = keeper""",
    "resync_plan": f"""WITH a AS (SELECT CASE WHEN {V} % 11 = 0 OR {V} % 7 = 3 THEN 'none' WHEN locked = 1 THEN 'skipped' WHEN {V} % 6 = 0 AND start_ms IS NOT NULL THEN 'from_local'
            WHEN status <> 'rejected' AND video_id IS NOT NULL AND {V} % 5 < 2 AND start_ms IS NOT NULL THEN 'from_source' WHEN {V} % 4 = 1 THEN 'mismatch_reported' ELSE 'unchanged' END AS action, start_ms FROM mappings)
        SELECT action, count(*) AS n, CAST(sum(CASE action WHEN 'from_local' THEN start_ms WHEN 'from_source' THEN start_ms + 1 END) AS BIGINT) AS ms FROM a GROUP BY 1""",
    "dump_plan": f"""WITH a AS (SELECT *, CASE WHEN {V} % 3 = 0 AND {V} % 4 <> 0 THEN 'nothing_to_dump' WHEN {V} % 5 = 1 THEN 'failed' ELSE 'dumped' END AS s, CASE WHEN {V} % 2 = 0 THEN 'zz, aa,zz' ELSE '' END AS r, {V} AS v FROM mappings)
        SELECT chart_hash, video_id, s AS status, CASE WHEN s = 'dumped' AND status <> 'pending' AND video_id IS NOT NULL THEN array_to_string(list_sort(list_distinct(CASE WHEN r = '' THEN [video_id] ELSE ['zz', 'aa', video_id] END)), ',') ELSE r END AS rejected,
            CASE WHEN s <> 'dumped' THEN '' WHEN v % 3 <> 0 AND v % 8 = 0 THEN 'video.mp4,album.png' WHEN v % 3 <> 0 THEN 'video.mp4' WHEN v % 8 = 0 THEN 'album.png' ELSE '' END AS removes, count(*) AS n FROM a GROUP BY ALL""",
    "offset_of_url": f"""WITH a AS (SELECT CASE WHEN {V} % 6 <> 5 THEN video_id END AS used, CASE WHEN {V} % 2 = 0 THEN video_id ELSE 'other' END AS m, start_ms, {V} AS v, video_id FROM mappings),
        b AS (SELECT *, CASE WHEN coalesce(m = used AND start_ms IS NOT NULL, false) THEN 'measured' WHEN coalesce(video_id = used AND v % 3 = 0, false) THEN 'community' ELSE 'guess' END AS source FROM a)
        SELECT source, CASE WHEN used IS NULL THEN 'none' WHEN v % 9 = 0 THEN 'still_picture' ELSE 'video' END AS outcome, count(*) AS n, CAST(sum(CASE source WHEN 'measured' THEN start_ms WHEN 'community' THEN 7 ELSE -3000 END) AS BIGINT) AS ms FROM b GROUP BY ALL""",
    "score_rows": """SELECT md5(client_id) AS checksum, CAST(ascii(right(client_id, 1)) % 200 AS INTEGER) AS plays, p.instrument, 'expert' AS difficulty, 98 AS percent_numerator, 100 AS percent_denominator, 5 AS stars, CAST(ascii(right(client_id, 1)) * p.k AS BIGINT) AS score
        FROM pings CROSS JOIN (VALUES ('lead', 1000), ('3', 77)) p(instrument, k) WHERE ascii(right(client_id, 1)) % 4 <> 0""",
    "content_hashes": f"""WITH {CHART_SONGS}, b AS (SELECT 'p' || CAST(floor(doc_id / 8) AS BIGINT) AS parent, doc_id % 4 AS k, arg_min(text, doc_id) AS text FROM cs WHERE text IS NOT NULL GROUP BY ALL)
        SELECT parent, 'ch1:' || arg_min(sha256(text), k) AS chart_hash, max(CASE WHEN k = 1 THEN md5(text) END) AS mid_md5 FROM b WHERE k < 3 GROUP BY 1""",
    "cache_fresh": f"SELECT client_id FROM pings WHERE {AS_OF} - last_seen < 604800",
    "iso_stamps": "SELECT doc_id, strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM documents",
    "hls_hex": """WITH h AS (SELECT md5(text) AS h FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), c AS (SELECT DISTINCT substr(h, 1, 1) AS x, substr(h, 2, 1) AS y, substr(h, 3, 1) AS z FROM h)
        SELECT CAST(('0x' || x) AS INTEGER) * 17 AS r, CAST(('0x' || y) AS INTEGER) * 17 AS g, CAST(('0x' || z) AS INTEGER) * 17 AS b, '#' || x || x || y || y || z || z AS hex FROM c""",
    "frame_repair": f"SELECT CASE WHEN {V} % 2 = 0 AND {V} % 3 <> 0 THEN 'codec' WHEN {V} % 5 <> 0 THEN 'frame_rate' ELSE 'ok' END AS problem, count(*) AS n FROM mappings GROUP BY 1",
    "candidates_allowed": "SELECT DISTINCT chart_hash AS song_id, video_id FROM mappings m WHERE NOT EXISTS (SELECT 1 FROM mappings r WHERE r.chart_hash = m.chart_hash AND r.video_id = m.video_id AND r.status = 'rejected')",
    "run_summary": f"WITH f AS ({library.ORACLES['blank_fill']}) SELECT count(*) AS processed, count(*) FILTER (filled = '') AS problems, CAST(coalesce(sum(CASE WHEN filled = '' THEN 0 ELSE len(string_split(filled, ',')) END), 0) AS BIGINT) AS filled FROM f",
    "root_states": f"SELECT CASE WHEN status IS NULL THEN 'missing' WHEN locked = 1 THEN 'is_a_song' WHEN {V} = 0 THEN 'no_songs' ELSE 'ok' END AS state, count(*) AS n FROM mappings GROUP BY 1",
    "summary_lines": "SELECT chart_hash, concat_ws(', ', CASE WHEN count(*) FILTER (status = 'approved') > 0 THEN count(*) FILTER (status = 'approved') || ' approved' END, CASE WHEN count(*) FILTER (status = 'pending') > 0 THEN count(*) FILTER (status = 'pending') || ' pending' END) AS line FROM mappings GROUP BY 1",
    "retry_waits": "SELECT DISTINCT votes, CASE WHEN votes % 2 = 0 THEN greatest(0.0, CAST(votes AS DOUBLE)) ELSE 10.0 END AS wait FROM mappings",
    "probe_seconds": "SELECT record_id, 3600.0 + record_id % 60 * 60 + 9.5 AS seconds FROM records",
    "backoff_waits": "SELECT record_id, 1.5 * power(2, record_id % 6) AS wait FROM records",
    "video_ids": f"SELECT DISTINCT chart_hash, CASE WHEN {V} % 2 = 0 THEN video_id ELSE 'plain/' || video_id END AS id FROM mappings",
    "error_kinds": """SELECT CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN 'throttled' WHEN doc_id % 3 = 1 THEN 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1""",
    "urls_primary_first": "WITH u AS (SELECT chart_hash, max(video_id) AS p, list_sort(list_distinct(list(video_id))) AS l FROM mappings WHERE chart_hash IS NOT NULL AND video_id IS NOT NULL GROUP BY 1) SELECT chart_hash, array_to_string(list_prepend(p, l[:-2]), ',') AS urls FROM u",
    "search_queries": "SELECT record_id, replace(replace(url_encode(concat_ws(' ', artist, name)), '~', '%7E'), '%2A', '*') AS query FROM records",
    "settings_written": r"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?im)^([ \t]*charter[ \t]*[=:][ \t]*)[^\r\n]*', '\1new $1', 'g') AS text FROM documents WHERE source = 'ini_file' AND text IS NOT NULL)
        SELECT doc_id, md5(regexp_replace(text, '(?i)(\[song\][ \t]*)\n', CASE WHEN contains(text, E'\r\n') THEN E'\\1\r\nvideo_start_time = -3000\r\n' ELSE E'\\1\nvideo_start_time = -3000\n' END)) AS digest FROM a""",
    "latest_first": "SELECT client_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC) AS k FROM (SELECT DISTINCT client_id, seq FROM votes WHERE seq IS NOT NULL)) WHERE k <= 3",
}
