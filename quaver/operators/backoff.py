"""Waits after throttling: schedules scaled by where past episodes ended, pacing, and episodes from outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEDULE = (3600, 14400, 43200, 86400)
FEWEST, KEPT, SHORTEST = 5, 50, 300


def recent(episodes: DataFrame, key: str, at: str, most: int = KEPT) -> DataFrame:
    """The latest episodes of each key."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), *[F.col(c).desc() for c in episodes.columns if c not in (key, at)])
    return episodes.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")


def schedules(episodes: DataFrame, key: str, depth: str, schedule: tuple[int, ...] = SCHEDULE) -> DataFrame:
    """A schedule for each key, scaled by the median depth against its own middle; null with too few episodes.

    Depths are kept within 0 and one past the end, which bounds growth; waits have a floor. Halves round to even.
    """
    top = len(schedule) - 1
    kept = F.greatest(F.lit(0), F.least(F.coalesce(F.col(depth).cast("int"), F.lit(0)), F.lit(top + 1)))
    rows = episodes.groupBy(key).agg(F.count("*").alias("episodes"), F.median(kept).alias("_m"))
    scaled = F.transform(F.array(*[F.lit(s) for s in schedule]), lambda s: F.greatest(F.lit(SHORTEST).cast("long"), F.bround(s * (F.col("_m") + 1) / (top / 2 + 1)).cast("long")))
    return rows.select(key, "episodes", F.when(F.col("episodes") >= FEWEST, scaled).alias("schedule"))


def pace(outcomes: Column) -> Column:
    """Pace after a list of outcomes: doubled (at most 6) by a throttle, eased by 0.7 (at least 0.5) after 8 clean hits.

    Skipped songs change nothing. The fold runs in the JVM over the array.
    """
    start = F.struct(F.lit(1.0).alias("pace"), F.lit(0).alias("streak"))

    def step(s: Column, o: Column) -> Column:
        slow = F.struct(F.least(s["pace"] * 2.0, F.lit(6.0)).alias("pace"), F.lit(0).alias("streak"))
        ease = F.struct(F.greatest(s["pace"] * 0.7, F.lit(0.5)).alias("pace"), F.lit(0).alias("streak"))
        on = F.struct(s["pace"].alias("pace"), (s["streak"] + 1).alias("streak"))
        return F.when(o == "throttled", slow).when(o != "hit", s).when(s["streak"] >= 7, ease).otherwise(on)

    return F.aggregate(outcomes, start, step, lambda s: s["pace"])


def episodes(outcomes: DataFrame, key: str, at: str, outcome: str, stop: str) -> DataFrame:
    """Runs of consecutive stops of each key: start, end (the first outcome after, null if open), and stops."""
    run = Window.partitionBy(key).orderBy(at)
    rows = outcomes.withColumn("_stop", F.col(outcome) == stop)
    rows = rows.withColumn("_new", (F.col("_stop") & ~F.coalesce(F.lag("_stop").over(run), F.lit(False))).cast("int"))
    rows = rows.withColumn("_ended", F.lead(at).over(run)).withColumn("_id", F.sum("_new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    held = rows.filter("_stop").groupBy(key, "_id").agg(F.min(at).alias("started_at"), F.max_by("_ended", at).alias("resolved_at"), F.count("*").alias("stops"))
    return held.drop("_id")
