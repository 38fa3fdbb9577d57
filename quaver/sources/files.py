"""Files as tables: listings, contents by hash, sidecars, caches, logs, and what is written back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of parts and difficulties in a score file, by number
PARTS = {0: "lead", 1: "bass", 2: "rhythm", 7: "keys"}
DIFFICULTIES = ("easy", "medium", "hard", "expert")

SIDECAR = (
    "chart_hash string, folder string, notes_mid_md5 string, song_length_ms long, instruments map<string,int>, note_count int, avg_nps double, "
    "features struct<has_lyrics:boolean,has_solos:boolean,has_open_notes:boolean,has_2x_kick:boolean,has_roll_lanes:boolean>, stems array<string>, "
    "has_album_art boolean, high_score long, score_detail string, problems array<string>, "
    "chorus_match struct<name:string,artist:string,album:string,genre:string,year:string,charter:string>, last_updated string, status string"
)
EPISODE = "array<struct<started_at:double,resolved_at:double,escalation_steps_used:int>>"


def listing(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """Files below a folder: ``path``, ``parent``, ``name``, ``length``, ``modified_at``, and ``content`` if asked for.

    Without the content only the listing is read. An empty folder gives an empty table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    plain = F.regexp_replace("path", "^file:/+", "/")
    columns = [plain.alias("path"), F.regexp_extract(plain, r"^(.*)/[^/]*$", 1).alias("parent"), F.regexp_extract(plain, r"([^/]*)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified_at")]
    return files.select(*columns, *(["content"] if content else []))


def texts(files: DataFrame) -> DataFrame:
    """``path``, ``parent``, ``name``, ``text`` of listed contents, without a byte order mark; bad bytes are replaced."""
    return files.select("path", "parent", "name", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"))


def content_hashes(files: DataFrame) -> DataFrame:
    """``parent``, ``chart_hash``, ``mid_md5``: the hash of each folder's first chart file by priority, and of its MIDI notes."""
    order = F.array_position(F.array(*[F.lit(n) for n in ("notes.chart", "notes.mid", "notes.eof")]), F.lower("name"))
    rows = files.withColumn("_k", order).filter("_k > 0")
    digest = F.concat(F.lit("ch1:"), F.sha2("content", 256))
    return rows.groupBy("parent").agg(F.min_by(digest, "_k").alias("chart_hash"), F.max(F.when(F.lower("name") == "notes.mid", F.md5("content"))).alias("mid_md5"))


def read_scores(data: bytes) -> list[tuple]:
    """Rows of a score file: checksum, plays, part, difficulty, both parts of the percentage, stars, score.

    Little-endian: four bytes of header, a count, then for each song a length-prefixed checksum, the number of
    parts and of plays, and a record of each part. A file cut short or broken gives no rows at all.
    """
    rows, at = [], 8
    try:
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            size = data[at]
            checksum = data[at + 1 : at + 1 + size].decode("ascii").lower()
            if len(checksum) != size:
                return []
            parts, plays = data[at + 1 + size], data[at + 2 + size]
            at += 3 + size
            for _ in range(parts):
                part, level, top, bottom, stars, _flag, score = struct.unpack_from("<IBHHBBI", data, at)
                at += 15
                rows.append((checksum, plays, PARTS.get(part, str(part)), DIFFICULTIES[level] if level < len(DIFFICULTIES) else str(level), top, bottom, stars, score))
    except (struct.error, IndexError, UnicodeDecodeError):
        return []
    return rows


def scores(files: DataFrame) -> DataFrame:
    """One row for each song and part in the score files of a listing with contents."""
    names = ["checksum", "plays", "instrument", "difficulty", "percent_numerator", "percent_denominator", "stars", "score"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for c in batch["content"] for r in read_scores(bytes(c))], columns=names)

    return files.select("content").mapInPandas(read, "checksum string, plays int, instrument string, difficulty string, percent_numerator int, percent_denominator int, stars int, score long")


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """A sidecar of one object for each line; lines that can't be read or name no chart are left out."""
    return spark.read.schema(SIDECAR).option("mode", "PERMISSIVE").json(path).filter("chart_hash is not null")


def episode_log(df: DataFrame, text: str = "text") -> DataFrame:
    """``episodes`` and ``schedule`` of a log, which may be a bare list of episodes as it once was; broken text has none."""
    new = F.from_json(text, f"struct<episodes:{EPISODE},schedule:array<int>>")
    old = F.from_json(text, EPISODE)
    listed = F.ltrim(text).startswith("[")
    return df.withColumn("episodes", F.coalesce(F.when(listed, old).otherwise(new["episodes"]), F.array().cast(EPISODE))).withColumn("schedule", F.when(~listed, new["schedule"]))


def folder_status(folders: DataFrame, metas: DataFrame) -> DataFrame:
    """``folders`` with the status of their status file, null where there is none: null is a third state."""
    said = metas.select("parent", F.get_json_object("text", "$.chart_rename_status").alias("status"))
    return folders.join(said, "parent", "left")


def merged_meta(old: Column, new: Column) -> Column:
    """Two maps in one, the new values in place of the old."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)


def csv_rows(songs: DataFrame) -> DataFrame:
    """The columns of the library's CSV as texts, in order of the song's label; an unknown kind is left blank."""
    from quaver.functions.text import title_kind

    kind = title_kind(F.col("video_title"))
    dumped = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce("dumped", F.lit("")), r"[,\s]+"), lambda v: v != ""))), " ")
    return songs.orderBy(F.lower("label"), "folder").select(
        F.col("label").alias("Song"), F.coalesce("artist", F.lit("")).alias("Artist"), F.coalesce("title", F.lit("")).alias("Title"),
        F.when(F.col("has_video"), "yes").otherwise("no").alias("Has video"), F.coalesce("resolution", F.lit("-")).alias("Resolution"),
        F.coalesce(F.col("offset_ms").cast("string"), F.lit("")).alias("Offset (ms)"), F.coalesce("offset_source", F.lit("")).alias("Offset source"),
        F.when(F.col("video_title").isNull() | (kind == "unknown"), "").otherwise(kind).alias("Video kind"), F.coalesce("video_title", F.lit("")).alias("Video title"),
        F.coalesce("video_id", F.lit("")).alias("Video ID"), dumped.alias("Dumped videos"), F.col("folder").alias("Folder"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with headers, in their order; a byte order mark in front of the first column's name."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", "true").csv(path)


def write_sidecar(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; the commit of the job puts all of them in place at once."""
    rows.write.mode("overwrite").json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """More rows for a manifest of JSON lines."""
    rows.write.mode("append").json(path)


def set_values(text: Column, values: dict[str, Column], section: str = "song") -> Column:
    """A settings text with some values of a section set: lines that exist are changed, others put at its head.

    The rest stays as it is, byte by byte, line ends included. Null values change nothing.
    """
    for name, value in values.items():
        line = rf"(?im)^([ \t]*{name}[ \t]*[=:][ \t]*)[^\r\n]*"
        safe = F.regexp_replace(value, r"([\\$])", r"\\$1")
        end = F.when(text.contains("\r\n"), "\r\n").otherwise("\n")
        changed = F.regexp_replace(text, F.lit(line), F.concat(F.lit("$1"), safe))
        added = F.regexp_replace(text, F.lit(rf"(?i)^([\s\S]*?\[{section}\][ \t]*)(?:\r?\n|$)"), F.concat(F.lit("$1"), end, F.lit(f"{name} = "), safe, end))
        fresh = F.concat(F.lit(f"[{section}]"), end, F.lit(f"{name} = "), value, end, text)
        text = F.when(value.isNull(), text).when(text.rlike(line), changed).when(text.rlike(rf"(?i)\[{section}\]"), added).otherwise(fresh)
    return text


def newest(df: DataFrame, keys: list[str], at: str, most: int) -> DataFrame:
    """The latest ``most`` rows of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")
