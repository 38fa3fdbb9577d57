"""Settings texts (sections of ``key = value`` lines) read as rows, and names from where they are first stated."""

from __future__ import annotations

import configparser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.functions.text import blank, strip

LINE = r"(?m)^[ \t]*([^=\[\];#\r\n]+?)[ \t]*=[ \t]*([^\r\n]*?)[ \t\r]*$"


def first_values(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``name``, ``value`` of every key in any section, keys in lower case; of repeated keys the first counts."""
    lines = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(LINE), F.lit(1)).alias("n"), F.regexp_extract_all(F.col(text), F.lit(LINE), F.lit(2)).alias("v"))
    rows = df.select(key, F.posexplode(lines).alias("_at", "_l")).select(key, "_at", F.lower("_l.n").alias("name"), F.col("_l.v").alias("value"))
    return rows.groupBy(key, "name").agg(F.min_by("value", "_at").alias("value"))


def read_section(text: str | None, section: str = "song") -> dict[str, str]:
    """Keys of one section by the standard library's rules; of repeated keys the last counts; broken text gives none."""
    if not text:
        return {}
    parser = configparser.ConfigParser(strict=False, interpolation=None, allow_no_value=True)
    parser.optionxform = str.lower
    try:
        parser.read_string(text.lstrip("﻿"))
    except configparser.Error:
        return {}
    found = {}
    for s in parser.sections():
        if s.lower() == section:
            found.update({k: v or "" for k, v in parser[s].items()})
    return found


def section_values(df: DataFrame, key: str, text: str = "text", section: str = "song") -> DataFrame:
    """``key``, ``name``, ``value`` of one section, read by the standard library in Arrow batches."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def read(column: pd.Series) -> pd.Series:
        return pd.Series([read_section(t, section) for t in column], dtype=object)

    return df.select(key, F.explode(read(F.col(text))).alias("name", "value"))


def with_names(folders: DataFrame) -> DataFrame:
    """Artist and title of each folder: from its settings if they state a title, else from its chart if that does, else the folder's name.

    ``folders`` may have ``block_artist`` and ``block_title`` (see ``charts.song_block``). A folder's name is taken as it
    is, without an artist. A blank artist is null.
    """
    rows = folders
    for c in ("block_artist", "block_title"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    said = F.when(~blank(F.col("name")), "settings").when(~blank(F.col("block_title")), "chart").otherwise("folder")
    rows = rows.withColumn("said_by", said)
    by = lambda settings, chart, folder: F.when(F.col("said_by") == "settings", settings).when(F.col("said_by") == "chart", chart).otherwise(folder)
    artist = by(F.nullif(strip(F.col("artist")), F.lit("")), F.col("block_artist"), F.lit(None).cast("string"))
    title = by(strip(F.col("name")), F.col("block_title"), F.regexp_extract("folder", r"([^/]+)$", 1))
    return rows.select("folder", artist.alias("artist"), title.alias("title"), "said_by")
