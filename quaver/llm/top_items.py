"""Top N items within every group, by partition lower bounds.

Each local partition of a group (a salt of the item, so that a hot group is spread over many tasks) ranks
its own items. The local N-th best score is a valid lower bound of the group's N-th best: N items reach it.
The greatest local bound of a group filters its rows, and the few survivors are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.session import shuffle_width


def latest_state(df: DataFrame, keys: list[str], at: str, salt: str | None = None) -> DataFrame:
    """One row for each key: the one with the greatest ``at`` (null is oldest).

    Rows of equal ``at`` are told apart by all their columns, nulls first, so that the choice is repeatable.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(at)] + [F.col(c) for c in sorted(rest) if c != at]
    newest = F.max(F.struct(*[F.struct(c.isNotNull(), c) for c in order], F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(newest.alias("_m")).select(*keys, "_m._row.*")


def top_items(df: DataFrame, group: str, item: str, score: list[Column], n: int = 3, salts: int | None = None) -> DataFrame:
    """The ``n`` best rows of each group with their ``place``; higher scores first, then the smaller item.

    ``score`` columns are compared in order and must not be null; a null ``item`` comes last; a null group is
    a group of its own. Groups with fewer than ``n`` rows give fewer rows; an empty table gives none. Equal
    rows get different places.

    A group lies in parts (``salts`` hashes of the item), and each part keeps its own ``n`` best. The greatest
    n-th best of a group's parts is a small aggregate, one row for each group that has a full part. It is sent
    back only to the parts of groups that have several, where the rows lie already, so that rows below
    the bound go before the last exchange and no survivor is moved to meet it.
    """
    salts = salts or max(4, shuffle_width(df.sparkSession))
    best = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)])
    last = [F.col(item).isNull(), F.col(item)]
    rows = df.withColumn("_score", best).withColumn("_salt", F.pmod(F.xxhash64(F.col(item)), F.lit(salts)).cast("int"))
    local = Window.partitionBy(group, "_salt").orderBy(F.col("_score").desc(), *last)
    rows = rows.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= n)
    survivors = bounded(rows, group, n)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_score").desc(), *last)).cast("long")
    return survivors.withColumn("place", place).filter(F.col("place") <= n).drop("_score", "_salt", "_rank")


def bounded(rows: DataFrame, group: str, n: int) -> DataFrame:
    """``rows`` of the local best (``group``, ``_salt``, ``_rank``, ``_score``) that reach the greatest bound of their group."""
    bounds = rows.groupBy(F.col(group).alias("_g")).agg(F.max(F.when(F.col("_rank") == n, F.col("_score"))).alias("_bound"), F.collect_set("_salt").alias("_parts"))
    # a group in one part is cut to n rows already; a list of parts has at most ``salts`` numbers
    bounds = bounds.filter(F.col("_bound").isNotNull() & (F.size("_parts") > 1)).select("_g", "_bound", F.explode("_parts").alias("_part"))
    met = rows.join(bounds, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_salt") == F.col("_part")), "left")
    return met.filter(F.col("_bound").isNull() | (F.col("_score") >= F.col("_bound"))).drop("_g", "_part", "_bound")


def best_videos(mappings: DataFrame, n: int = 3) -> DataFrame:
    """``chart_hash``, ``place``, ``video_id``: the best mappings of each chart in their latest state.

    Only approved and pending rows take part; approved first, then locked, then votes (null counts as 0),
    then the smaller video_id in byte order.
    """
    held = mappings.select("chart_hash", "video_id", "status", "locked", "votes", "last_seen")
    now = latest_state(held, ["chart_hash", "video_id"], "last_seen").filter(F.col("status").isin("approved", "pending"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = [(F.col("status") == "approved").cast("int"), zero("locked"), zero("votes")]
    return top_items(now, "chart_hash", "video_id", score, n).select("chart_hash", "place", "video_id")
