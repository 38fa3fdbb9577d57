"""Variant spellings of names typed by people: all spellings of one act linked.

Spellings are read into parts (see ``acts``). Spellings meet where they share a key: the same letters, the
same parts in either order, the given name behind a nickname. Typing slips are found by an exact radius join
in metric space. The components of these links are the acts; a spelling with an initial joins the one act
that it can stand for.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.acts import Act, read_act
from quaver.llm.lookalike import plain_form
from quaver.llm.metric import components, radius_pairs
from quaver.session import durable

PARTS = T.StructType([T.StructField(c, T.IntegerType() if c == "words" else T.StringType()) for c in Act._fields])

#: Letters that the longer of two names must have before two neighbours in the wrong order, or any slip of one letter, are taken for the same name:
#: of names as short as these a letter more or less, or another, is most often another act.
SWAPPED, SHORTEST = 4, 6


@F.pandas_udf(PARTS)
def parts_of(column: pd.Series) -> pd.DataFrame:
    """Arrow form of :func:`quaver.llm.acts.read_act`; null reads as a text without letters."""
    return pd.DataFrame([read_act(t or "") for t in column], columns=list(Act._fields))


@F.pandas_udf(T.StringType())
def folded(column: pd.Series) -> pd.Series:
    """Skeleton in lower case, for words that are only counted."""
    return pd.Series([None if t is None else plain_form(t).casefold() for t in column], dtype=object)


# the planner may not read a name once for a filter and once more for the columns
parts_of, folded = parts_of.asNondeterministic(), folded.asNondeterministic()


def words(text: Column) -> Column:
    """Words of letters and digits of a folded text."""
    return F.filter(F.split(text, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def acts_only(df: DataFrame, key: str, artist: str, title: str) -> DataFrame:
    """``artist`` strings that name an act in one row at least, with the number of their ``rows``.

    A row's fields may have changed places. Each word is weighed by how often it stands in either field over
    all rows; a row is taken as swapped where its title reads more like an artist than its artist does.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(artist).alias("_artist"), F.col(title).alias("_title")).filter("_artist is not null")
    rows = rows.select("*", folded("_artist").alias("_fa"), folded("_title").alias("_ft"))
    rows = rows.select("_key", "_artist", "_title", F.array_distinct(words(F.col("_fa"))).alias("_wa"), F.array_distinct(words(F.col("_ft"))).alias("_wt"))
    rows = rows.withColumn("_wt", F.coalesce("_wt", F.array().cast("array<string>")))
    side = lambda c, s: F.transform(F.col(c), lambda w: F.struct(w.alias("word"), F.lit(s).alias("side")))
    rows = durable(rows.withColumn("_row", F.unhex(F.md5(F.concat_ws("\u001f", F.coalesce(F.col("_key").cast("string"), F.lit("")), "_artist", F.coalesce("_title", F.lit("\u001e")))))))
    seen = rows.select("_row", F.explode(F.concat(side("_wa", 1), side("_wt", -1))).alias("_x")).select("_row", "_x.word", "_x.side")
    counts = seen.groupBy("word").agg(F.sum(F.when(F.col("side") > 0, 1).otherwise(0)).alias("_a"), F.sum(F.when(F.col("side") < 0, 1).otherwise(0)).alias("_t"))
    # a row's own word counts half for either side, so that a word seen once says nothing
    weight = counts.select("word", F.log((F.col("_a") + 0.5) / (F.col("_t") + 0.5)).alias("_w"), (F.col("_a") + F.col("_t")).alias("_n")).filter("_n > 1")
    score = seen.join(weight, "word").groupBy("_row").agg(F.sum(F.col("side") * F.col("_w")).alias("_score"))
    held = rows.select("_row", "_artist").join(score, "_row", "left").filter(F.coalesce(F.col("_score"), F.lit(0.0)) >= 0)
    return held.groupBy("_artist").agg(F.count("*").alias("rows")).withColumnRenamed("_artist", artist)


def spelling_classes(names: DataFrame, name: str, nicknames: DataFrame, rows: str = "rows") -> DataFrame:
    """``name`` and ``act`` for each name with a letter or digit; equal acts have equal ``act``.

    ``names`` has one row for each name and its number of ``rows``; ``nicknames`` has ``given`` and
    ``nickname``. Names without a letter or digit are in no class. A null name is in none either.
    """
    spark_lower = lambda c: F.lower(F.col(c))
    nick = nicknames.select(spark_lower("nickname").alias("given"), spark_lower("given").alias("_full")).groupBy("given").agg(F.min("_full").alias("_full"))
    formal = nicknames.select(spark_lower("given").alias("given")).distinct().withColumn("_known", F.lit(True))
    read = names.filter(F.col(name).isNotNull()).select(F.col(name).alias("_name"), F.col(rows).alias("_rows"), parts_of(name).alias("_p")).select("_name", "_rows", "_p.*").filter("flat <> ''")
    read = read.join(nick, "given", "left").join(formal, "given", "left")
    tag = lambda *c: F.concat_ws("|", *c)
    initial = F.length("given") == 1
    read = read.withColumn("_core", tag("kind", "core"))
    keys = F.array_distinct(
        F.filter(
            F.array(
                F.col("_core"),
                tag(F.lit("="), "flat"),
                F.when(~initial & (F.col("given") != ""), tag("kind", "swapped")),
                F.when(F.col("_full").isNotNull() & ~F.col("_known").eqNullSafe(True), tag("kind", F.concat("_full", "surname"))),
            ),
            lambda k: k.isNotNull(),
        )
    )
    read = durable(read.withColumn("_keys", keys).withColumn("_initial", initial))
    shared = read.select(F.col("_core").alias("a"), F.explode("_keys").alias("b"))
    # slips: one letter, between names whose given names aren't two different ones of the reference list
    formal_core = F.when(F.col("_full").isNotNull() & ~F.col("_known").eqNullSafe(True), F.concat("_full", "surname"))
    cores = read.filter(~F.col("_initial")).select("kind", F.explode(F.array_compact(F.array("core", formal_core))).alias("core"), "given", "_known")
    full = cores.filter(F.length("core") >= SWAPPED).groupBy("kind", "core").agg(F.min(F.when(F.col("_known"), F.col("given"))).alias("_given"))
    close = radius_pairs(full.select("kind", "core"), "core", ["kind"])
    side = lambda s: full.select("kind", F.col("core").alias(f"core_{s}"), F.col("_given").alias(f"_g{s}"))
    close = close.join(side("a"), ["kind", "core_a"]).join(side("b"), ["kind", "core_b"])
    letters = lambda c: F.array_sort(F.split(c, ""))
    sure = (F.greatest(F.length("core_a"), F.length("core_b")) >= SHORTEST) | (letters("core_a") == letters("core_b"))
    close = close.filter("not coalesce(_ga <> _gb, false)").filter(sure)
    slips = close.select(tag("kind", "core_a").alias("a"), tag("kind", "core_b").alias("b"))
    found = components(shared.unionByName(slips).filter("a <> b"))
    placed = read.join(found.withColumnRenamed("node", "_core"), "_core", "left").withColumn("root", F.coalesce("root", "_core"))
    # initials: the act of that kind and surname whose given name begins so, the one with most rows if several
    placed = durable(placed.select("_name", "_rows", "kind", "given", "surname", "_initial", "_full", "root"))
    votes = placed.filter(~F.col("_initial") & (F.col("given") != ""))
    votes = votes.withColumn("_letter", F.explode(F.array_distinct(F.array(F.substring("given", 1, 1), F.substring(F.coalesce("_full", "given"), 1, 1)))))
    weighed = votes.groupBy("kind", "surname", "_letter", "root").agg(F.sum("_rows").alias("_n"))
    best = weighed.groupBy("kind", "surname", "_letter").agg(F.max_by("root", F.struct("_n", F.col("root"))).alias("_to"))
    short = placed.filter("_initial").select("kind", "surname", F.col("given").alias("_letter"), "root").join(best, ["kind", "surname", "_letter"])
    moved = short.groupBy("root").agg(F.min("_to").alias("_to"))
    return placed.join(moved, "root", "left").select(F.col("_name").alias(name), F.coalesce("_to", "root").alias("act"))


def spelling_pairs(df: DataFrame, nicknames: DataFrame, key: str = "chart_hash", artist: str = "artist", title: str = "title") -> DataFrame:
    """All pairs of different strings that name one act: ``artist_a`` < ``artist_b``.

    The pairs of an act are quadratic in its spellings by their definition; its rows are not, as each string
    is one row here. Blank strings and titles in the artist's place are in no pair.
    """
    classes = durable(spelling_classes(acts_only(df, key, artist, title), artist, nicknames))
    other = classes.select("act", F.col(artist).alias("artist_b"))
    return classes.select("act", F.col(artist).alias("artist_a")).join(other, "act").filter("artist_a < artist_b").select("artist_a", "artist_b")
