"""Queries of the songbook and of text functions, and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions import text as fx
from quaver.operators import songbook as op
from quaver.session import table

S = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"


def book(s: SparkSession, d: str) -> DataFrame:
    return op.entries(table(s, d, "charts"), "chart_hash")


def names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ini_fields").select("folder", "name", F.regexp_extract("folder", r"([^/]+)$", 1).alias("leaf"))


BOOK = f"""rows_ AS (SELECT {sql_strip('artist')} AS artist, {sql_strip('title')} AS title, chart_hash AS ord FROM charts),
    kept AS (SELECT * FROM rows_ WHERE artist <> '' AND title <> ''),
    names AS (SELECT lower(artist) AS artist_key, arg_min(artist, (ord, artist)) AS artist FROM kept GROUP BY 1),
    book AS (SELECT n.artist_key, lower(k.title) AS title_key, n.artist, arg_min(k.title, (k.ord, k.title)) AS title FROM kept k JOIN names n ON n.artist_key = lower(k.artist) GROUP BY 1, 2, 3),
    acts AS (SELECT artist_key, artist, count(*) AS songs, lower(regexp_replace(artist, '^["''‘’“”]+', '')) AS sort_key FROM book GROUP BY 1, 2),
    lettered AS (SELECT *, upper(regexp_extract(sort_key, '([\\p{{L}}\\p{{N}}])', 1)) AS f FROM acts),
    final AS (SELECT artist_key, artist, songs, sort_key, CASE WHEN regexp_full_match(f, '[A-Z]') THEN f ELSE '#' END AS letter FROM lettered)"""


def chain(c: str, patterns: list[str]) -> str:
    """SQL that strips each note where something is left."""
    for p in patterns:
        cut = sql_strip(f"regexp_replace({c}, '{p}', '', 'g')")
        c = f"CASE WHEN {cut} <> '' THEN {cut} ELSE {c} END"
    return c


NOTE_STEPS = [rf"(?i)\s*-\s*(?:{fx.DASH_WORDS})\b.*$", rf"(?i)\s*[(\[]\s*(?:{fx.NOTE_WORDS})\b[^)\]]*[)\]]\s*$", rf"(?i)\s*[(\[]\s*{fx.PEDAL}[^)\]]*[)\]]\s*$"]


def sql_noise(source: str, columns: str, c: str) -> str:
    """SQL steps from ``source`` with column ``c``, so that the text of each step is short."""
    return f"""s1 AS (SELECT {columns}, {chain(c, NOTE_STEPS[:1])} AS x FROM {source}), s2 AS (SELECT {columns}, {chain('x', NOTE_STEPS[1:2])} AS x FROM s1),
        s3 AS (SELECT {columns}, {chain('x', NOTE_STEPS[2:])} AS x FROM s2)"""


def any_of(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


KIND = f"""CASE WHEN {any_of(fx.GAMEPLAY)} OR regexp_matches(t, '{fx.GAMEPLAY_TOKEN}') THEN 'gameplay' WHEN {any_of(fx.LYRIC)} THEN 'lyric'
    WHEN {any_of(fx.AUDIO_ONLY)} THEN 'audio_only' WHEN {any_of(fx.OFFICIAL)} OR regexp_matches(t, '{fx.OFFICIAL_PHRASE}') THEN 'official' ELSE 'unknown' END"""

TITLES = "SELECT chart_hash, CASE hash_rank % 6 WHEN 0 THEN title || ' (Official HD Video)' WHEN 1 THEN title || ' Lyrics' WHEN 2 THEN title || ' Full Band FC #1' WHEN 3 THEN title || ' (audio)' ELSE title END AS title FROM (SELECT chart_hash, title, CAST(last_seen AS BIGINT) AS hash_rank FROM charts)"


def video_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles of charts with a marker chosen by the row, as uploads have them."""
    n = F.col("last_seen") % 6
    marker = F.when(n == 0, " (Official HD Video)").when(n == 1, " Lyrics").when(n == 2, " Full Band FC #1").when(n == 3, " (audio)").otherwise("")
    return table(s, d, "charts").select("chart_hash", F.concat("title", marker).alias("title"))


QUERIES = {
    "songbook_dedup": lambda s, d: book(s, d).select("artist", "title"),
    "songbook_stats": lambda s, d: op.stats(op.artists(book(s, d))).select("total_artists", "total_songs", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "threshold")]),
    "songbook_toc": lambda s, d: op.outliers(op.artists(book(s, d))),
    "songbook_letters": lambda s, d: op.letters(op.artists(book(s, d))),
    "songbook_layout": lambda s, d: op.layout(book(s, d)),
    "songbook_toc_pages": lambda s, d: op.toc_pages(op.outliers(op.artists(book(s, d))), op.layout(book(s, d))),
    "songbook_html": lambda s, d: op.html_pages(op.layout(book(s, d))),
    "normalize_text": lambda s, d: table(s, d, "charts").select("chart_hash", fx.normalize_lookup(F.col("artist")).alias("artist"), fx.normalize_lookup(F.col("title")).alias("title")),
    "strip_noise": lambda s, d: names(s, d).select("folder", fx.strip_title_noise(F.col("name")).alias("name")),
    "parse_folder": lambda s, d: names(s, d).select("folder", fx.folder_parts(F.col("leaf")).alias("p")).select("folder", "p.artist", "p.title"),
    "clean_folder": lambda s, d: names(s, d).select("folder", fx.clean_folder(F.col("leaf")).alias("leaf")),
    "version_tag": lambda s, d: table(s, d, "records").select("record_id", fx.version_tag(F.col("name")).alias("tag")),
    "title_kind": lambda s, d: video_titles(s, d).select("chart_hash", fx.title_kind(F.col("title")).alias("kind"), fx.kind_rank(fx.title_kind(F.col("title"))).alias("kind_rank")),
    "bucket_letter": lambda s, d: table(s, d, "charts").filter("artist is not null").select("chart_hash", fx.sort_key(F.col("artist")).alias("sort_key"), fx.bucket_letter(fx.sort_key(F.col("artist"))).alias("letter")),
    "search_label": lambda s, d: table(s, d, "ini_fields").filter("name is not null").select("folder", fx.search_label(F.col("artist"), F.col("name")).alias("label")),
    "html_escape": lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", F.md5(fx.html_escape(F.col("text"))).alias("digest")),
    "safe_values": lambda s, d: table(s, d, "ini_fields").select("folder", fx.safe_value(F.col("charter")).alias("charter"), fx.safe_value(F.col("album")).alias("album")),
    "catalog_filter_sort": lambda s, d: table(s, d, "ini_fields").filter(F.lower("name").contains("the")).withColumn("key", F.lower("name")).orderBy("key", "folder").select("folder", "key", F.coalesce(F.regexp_extract("year", r"^(\d+)", 1).try_cast("int"), F.lit(0)).alias("n")),
    "selection_parse": lambda s, d: table(s, d, "dupgroups").groupBy("group_id").agg(F.concat_ws(",", F.array_sort(F.collect_set((F.col("ord") + 1).cast("string"))), F.lit("2-3")).alias("text"), F.count("*").cast("int").alias("most")).select("group_id", F.array_join(fx.selection(F.col("text"), F.col("most")), " ").alias("picked")),
}

ORACLES = {
    "songbook_dedup": f"WITH {BOOK} SELECT artist, title FROM book",
    "songbook_stats": f"""WITH {BOOK} SELECT count(*) AS total_artists, CAST(coalesce(sum(songs), 0) AS BIGINT) AS total_songs, round(avg(songs), 6) AS mean,
        round(stddev_pop(songs), 6) AS stdev, round(avg(songs) + 1.5 * stddev_pop(songs), 6) AS threshold FROM final""",
    "songbook_toc": f"WITH {BOOK} SELECT artist, songs, letter FROM final WHERE songs > (SELECT avg(songs) + 1.5 * stddev_pop(songs) FROM final)",
    "songbook_letters": f"WITH {BOOK} SELECT letter, count(*) AS artists, CAST(sum(songs) AS BIGINT) AS songs FROM final GROUP BY 1",
    "normalize_text": "SELECT chart_hash, trim(regexp_replace(lower(coalesce(artist, '')), '[^a-z0-9]+', ' ', 'g')) AS artist, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS title FROM charts",
    "strip_noise": f"WITH {sql_noise('ini_fields', 'folder', 'name')} SELECT folder, {sql_strip(f'''regexp_replace(x, '(?i)\\b{fx.PEDAL}\\b', '', 'g')''')} AS name FROM s3",
    "clean_folder": r"""SELECT folder, regexp_replace(regexp_replace(regexp_extract(folder, '([^/]+)$', 1), '(?i)\s*[\[(]dup\d*[\])]\s*$', ''), '\s*\[[^\]]*\]\s*$', '') AS leaf FROM ini_fields""",
    "version_tag": rf"SELECT record_id, nullif(lower(regexp_extract(name, '(?i)\(\s*({fx.TAGS})\b[^)]*\)', 1)), '') AS tag FROM records",
    "title_kind": f"""WITH v AS ({TITLES}), k AS (SELECT chart_hash, lower(coalesce(title, '')) AS t FROM v), r AS (SELECT chart_hash, {KIND} AS kind FROM k)
        SELECT chart_hash, kind, CAST(list_position(['official', 'unknown', 'audio_only', 'lyric', 'gameplay'], kind) - 1 AS INTEGER) AS kind_rank FROM r""",
    "bucket_letter": r"""WITH k AS (SELECT chart_hash, lower(regexp_replace(artist, '^["''‘’“”]+', '')) AS sort_key FROM charts WHERE artist IS NOT NULL),
        f AS (SELECT *, upper(regexp_extract(sort_key, '([\p{L}\p{N}])', 1)) AS f FROM k) SELECT chart_hash, sort_key, CASE WHEN regexp_full_match(f, '[A-Z]') THEN f ELSE '#' END AS letter FROM f""",
    "search_label": f"""WITH c AS (SELECT folder, {sql_strip('artist')} AS a, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(name, '(2x Bass Pedal Expert+)', ''), '(2x Bass Pedal)', ''), '(RB3 version)', ''), '(Rh)', ''), 'RB3', ''), '\\(\\s*\\)', '', 'g'), '[\\s\\x0b]+', ' ', 'g')) AS t FROM ini_fields WHERE name IS NOT NULL)
        SELECT folder, concat_ws(' ', nullif(a, ''), t) AS label FROM c""",
    "html_escape": """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM documents WHERE text IS NOT NULL""",
    "safe_values": f"""SELECT folder, CASE WHEN {sql_strip('charter')} <> '' AND NOT regexp_matches(charter, '[\\[\\];#\\r\\n]') THEN substr({sql_strip('charter')}, 1, 200) END AS charter,
        CASE WHEN {sql_strip('album')} <> '' AND NOT regexp_matches(album, '[\\[\\];#\\r\\n]') THEN substr({sql_strip('album')}, 1, 200) END AS album FROM ini_fields""",
    "catalog_filter_sort": r"SELECT folder, lower(name) AS key, coalesce(TRY_CAST(regexp_extract(year, '^(\d+)', 1) AS INTEGER), 0) AS n FROM ini_fields WHERE contains(lower(name), 'the')",
    "selection_parse": "SELECT group_id, array_to_string(list_sort(list_distinct([x FOR x IN list_concat(list(ord + 1), [2, 3]) IF x <= count(*)])), ' ') AS picked FROM dupgroups GROUP BY 1",
}
