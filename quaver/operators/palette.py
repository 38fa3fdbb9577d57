"""Cover and accent colours from a census of an image's colours."""

from __future__ import annotations

import colorsys

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HLS = T.StructType([T.StructField(c, T.DoubleType()) for c in "hls"])


@F.pandas_udf(HLS)
def rgb_to_hls(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Hue, lightness and saturation of colours with parts in 0..255."""
    return pd.DataFrame([colorsys.rgb_to_hls(x / 255, y / 255, z / 255) for x, y, z in zip(r, g, b, strict=True)], columns=list("hls"))


@F.pandas_udf(T.StringType())
def hls_to_hex(h: pd.Series, l: pd.Series, s: pd.Series) -> pd.Series:  # noqa: E741
    """The colour of a hue, lightness and saturation in 0..1 as ``#rrggbb``; parts are rounded half to even."""
    return pd.Series(["#" + "".join(f"{round(c * 255):02x}" for c in colorsys.hls_to_rgb(*x)) for x in zip(h, l, s, strict=True)])


def census(pixels: DataFrame, image: str) -> DataFrame:
    """Colours of each image with their weight: pixels times 0.05 plus 0.95 of the saturation."""
    counts = pixels.groupBy(image, "r", "g", "b").agg(F.count("*").alias("n")).withColumn("_c", rgb_to_hls("r", "g", "b"))
    return counts.select(image, "r", "g", "b", "n", F.col("_c.h").alias("hue"), (F.col("n") * (0.05 + 0.95 * F.col("_c.s"))).alias("weight"))


def swatches(colours: DataFrame, image: str, apart: float = 30.0) -> DataFrame:
    """Each image's heaviest colour, and as accent the heaviest whose hue is at least ``apart`` degrees away, else the second."""
    order = Window.partitionBy(image).orderBy(F.col("weight").desc(), "r", "g", "b")
    ranked = colours.withColumn("_k", F.row_number().over(order))
    hexed = F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in ("r", "g", "b")])
    cover = ranked.filter("_k = 1").select(image, F.col("hue").alias("_h"), hexed.alias("cover"))
    turn = F.abs(F.col("hue") - F.col("_h")) * 360
    rest = ranked.filter("_k > 1").join(cover, image).withColumn("_far", F.least(turn, 360 - turn) >= apart)
    accent = rest.groupBy(image).agg(F.coalesce(F.min_by(hexed, F.when(F.col("_far"), F.col("_k"))), F.min_by(hexed, "_k")).alias("accent"))
    return cover.join(accent, image, "left").select(image, "cover", F.coalesce("accent", "cover").alias("accent"))
