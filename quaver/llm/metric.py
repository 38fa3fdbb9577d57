"""Radius joins of short texts in metric space, and connected components of their links.

The metric is the Damerau-Levenshtein distance (insertions, deletions, substitutions, swaps of neighbours). The
pivots are runs of one letter, one for each letter there is, longer than any text: the distance of a text to such a
pivot is the run's length less the number of times that the text has the letter, so that all these distances are
read off a text without computing one. By the triangle inequality texts at distance 1 differ by at most 1 in any of
them, and no slip changes more than two: a substitution moves two letters' counts, an insertion or deletion one, a swap none.

Pivots fall into four groups, and a cell of the metric space is a set of texts with equal distances to all pivots of
two groups. A text lies in six cells, one for each two groups; as one slip touches two groups at most, texts at
distance 1 share a cell, and no cell's border has to be crossed. Inside a cell the join is exact; a cell of many
texts is split by forms that two of its texts at distance 1 can't both miss.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.acts import one_slip
from quaver.session import durable


def within_one(a: Column, b: Column) -> Column:
    """Whether the Damerau-Levenshtein distance is 1 at most."""
    close = F.levenshtein(a, b, 2)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b,
    )
    return (close >= 0) & (close <= 1) | (close == 2) & (F.length(a) == F.length(b)) & swapped


@F.pandas_udf(T.BooleanType())
def one_slip_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow form of :func:`quaver.llm.acts.one_slip`, linear in the length."""
    return pd.Series([one_slip(x, y) for x, y in zip(a, b, strict=True)])


def _thirds(text: Column, n: Column) -> list[Column]:
    """Three pieces of a text as if it had length ``n``: from its start, from its middle (moved by up to one), from its end."""
    k = F.floor(n / 3).cast("int")
    rest = (n - 2 * k).cast("int")
    cut = lambda side, at, size: F.xxhash64(n, F.lit(side), F.substr(text, at, size))
    return [cut(0, F.lit(1), k), *[cut(1, k + 1 + move, k) for move in (-1, 0, 1)], cut(2, F.greatest(F.length(text) - rest + 1, F.lit(1)), rest)]


def slip_keys(text: Column, own: bool, longest: int = 96) -> Column:
    """Hashes of a text for one side (``own``) or the other: texts at a distance of 1 at most share one.

    Up to ``longest`` characters these are the text and its forms with one character taken out, from there on
    its thirds; a text of just that length has both.
    """
    n = F.length(text)
    less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))
    forms = F.transform(F.concat(F.array(text), less), lambda s: F.xxhash64(s))
    thirds = F.flatten(F.array(*[F.array(*_thirds(text, n + more)) for more in ((0,) if own else (-1, 0, 1))]))
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(F.when(n <= longest, forms).otherwise(none), F.when(n >= longest, thirds).otherwise(none)))


#: Groups of pivots, and the groups that one cell looks at.
GROUPS = 4
LOOKED_AT = tuple(combinations(range(GROUPS), 2))


def cells(text: Column, *within: Column) -> Column:
    """The six cells of a text: hashes of its letters in two groups of pivots, in order of letters, and of ``within``."""
    letters = F.array_sort(F.split(text, ""))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(GROUPS))
    key = lambda two: F.xxhash64(F.lit(f"{two}"), *within, F.array_join(F.filter(letters, lambda c: of(c).isin(*two)), ""))
    return F.array_distinct(F.array(*[key(two) for two in LOOKED_AT]))


def radius_pairs(names: DataFrame, text: str, within: list[str], crowd: int = 64, longest: int = 96) -> DataFrame:
    """Pairs of different rows with equal ``within`` columns and texts at a distance of 1: ``text_a`` < ``text_b``.

    ``names`` has one row for each text and ``within``. All pairs of a cell of at most ``crowd`` texts are compared;
    the texts of a larger one meet over their forms with at most one character taken out (of texts longer than
    ``longest`` over their thirds, see :func:`slip_keys`), so that no cell is compared as a whole however many
    texts share it. The metric then decides. Nothing is collected.
    """
    rows = names.select(*within, F.col(text).alias("_t"))
    placed = rows.select("*", F.explode(cells(F.col("_t"), *[F.col(w) for w in within])).alias("_cell"))
    held = durable(placed.withColumn("_n", F.count("*").over(Window.partitionBy("_cell"))).filter("_n > 1"))
    whole = F.array(F.lit(0).cast("long"))
    side = lambda t, own: held.select(*within, F.col("_t").alias(t), "_cell", F.explode(F.when(F.col("_n") <= crowd, whole).otherwise(slip_keys(F.col("_t"), own, longest))).alias("_form"))
    met = side("_a", True).join(side("_b", False), [*within, "_cell", "_form"])
    # the shape of a pair is looked at before its metric; a pair may come from several cells
    near = met.filter("_a <> _b and abs(length(_a) - length(_b)) <= 1").select(*within, F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    close = near.filter(F.when(F.greatest(F.length("_a"), F.length("_b")) <= longest, within_one(F.col("_a"), F.col("_b"))).otherwise(one_slip_of("_a", "_b")))
    return close.select(*within, F.col("_a").alias(f"{text}_a"), F.col("_b").alias(f"{text}_b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node) of each connected component of edges ``a`` - ``b``.

    Alternates the large-star and small-star steps, which keep the number of edges and halve long chains;
    the edges of each round are kept in the checkpoint folder and none of them reach the driver.
    """
    same = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = same(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # both stars see a node's neighbours in one place: its least one goes to each of them, and lists are never made
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        small = down.join(down.groupBy("a").agg(F.min("b").alias("_m")), "a")
        now = durable(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct("a", F.col("_m").alias("b")))).alias("_e")).select("_e.*").filter("a <> b").distinct())
        last, mark = mark, same(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
