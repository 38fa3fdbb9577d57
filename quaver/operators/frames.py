"""Static pictures among videos: average hashes and cell changes over all pairs of a video's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.functions.numeric import average_hash, hamming, most_cell_change

STILL_BITS, NEAR_BITS, STILL_CELL = 2, 10, 14
SHORTEST, FEWEST, HIGH_RATE = 10.0, 6, 2_000_000


def hashes(frames: DataFrame, grid: str = "grid") -> DataFrame:
    """``frames`` with the average hash of their grid of up to 64 cells."""
    return frames.withColumn("ahash", average_hash(F.col(grid)))


def frame_pairs(frames: DataFrame, video: str = "video_id", frame: str = "frame") -> DataFrame:
    """Pairs of frames of a video, ``i`` < ``j``, with bits and cells of difference; videos are sampled to a few frames."""
    one = lambda n: frames.select(video, F.col(frame).alias(n), F.col("ahash").alias(f"h{n}"), F.col("grid").alias(f"g{n}"))
    return one("i").join(one("j"), video).filter("i < j").select(video, "i", "j", hamming(F.col("hi"), F.col("hj")).alias("bits"), most_cell_change(F.col("gi"), F.col("gj")).alias("cell"))


def verdicts(frames: DataFrame, probe: DataFrame, video: str = "video_id") -> DataFrame:
    """What each probed video is: unknown if short, video by its bit rate, unknown with few frames, else by its worst pair of frames."""
    worst = frame_pairs(frames, video).groupBy(video).agg(F.max("bits").alias("bits"), F.max("cell").alias("cell"))
    counts = frames.groupBy(video).agg(F.count("*").alias("frames"))
    rows = probe.join(counts, video, "left").join(worst, video, "left")
    few = (F.coalesce("frames", F.lit(0)) < FEWEST) | F.col("bits").isNull()
    verdict = (
        F.when(F.coalesce(F.col("duration") < SHORTEST, F.lit(True)), "unknown")
        .when(F.col("bit_rate") > HIGH_RATE, "video")
        .when(few, "unknown")
        .when((F.col("bits") <= STILL_BITS) & (F.col("cell") <= STILL_CELL), "static")
        .when(F.col("bits") <= NEAR_BITS, "near_static")
        .otherwise("video")
    )
    return rows.select(video, F.coalesce("frames", F.lit(0)).alias("frames"), "bits", "cell", verdict.alias("verdict"))


def repair_verdicts(media: DataFrame) -> DataFrame:
    """What is wrong with a video file: a codec that its container doesn't play, or a varying frame rate."""
    return media.withColumn("problem", F.when((F.lower("container") == "webm") & (F.lower("codec") != "vp8"), "codec").when(F.col("r_frame_rate") != F.col("avg_frame_rate"), "frame_rate").otherwise("ok"))
