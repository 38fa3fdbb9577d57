"""Matching entities across two sources without keys, by soft logic.

Rules weigh partial, noisy attributes: similar artist and title speak for a match; year, album, charter and
genre speak for or against it; members of one known group of copies have the same partner (transitivity, a hard
rule: their variables are one, with the sum of their evidence); no entity and no record has more than one partner
(exclusivity on both sides). The rules are hinge losses over match variables in [0, 1], a convex problem that
alternating directions (ADMM) solve: each variable takes its own small step, then its copies on the entity's and
on the record's side agree on the simplexes there. The variables' values are the confidences.

The problem falls into parts that share no variable, the connected components of the pairs; parts of usual size are
brought together and solved many at a time, larger ones by the same steps as aggregations over the cluster.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.acts import without_accents
from quaver.llm.best_copy import states
from quaver.llm.lookalike import plain_form
from quaver.llm.metric import components, slip_keys, within_one
from quaver.llm.spellings import parts_of
from quaver.session import durable, spread

# Words that make a take another recording
TAKES = ("live", "acoustic", "remix", "demo", "instrumental", "extended", "unplugged", "karaoke")
# Words that a title may lack
LITTLE = frozenset(("the", "a", "an", "and", "n"))
#: Notes behind a name that leave the recording the same, without blanks and punctuation.
NOTE = re.compile(r"(feat|ft|featuring|with)\w*|.*remaster(ed)?.*|explicit|clean|.*edit|(album|single|original|full)version|.*basspedal\w*|fullband|h[dq]|deluxe\w*|officialvideo|officialaudio|lyrics?video|[ck]oop|expertplus")
TAIL = re.compile(r"(?:\s+(?:album version|single version|radio edit|explicit|2x bass pedal|full band|hd|hq|(?:\S+\s+)?remaster(?:ed)?|(?:feat|ft)\s+\S+))+$")
TITLE = T.StructType([T.StructField(c, T.StringType()) for c in ("core", "short", "take", "numbers")])

# Weights of the rules. Speaking for: target 1; against: target 0. The order of their sizes follows how much
# more often an agreement or difference was seen among pairs of equal albums than among pairs of different ones.
PRIOR, SIMILAR = 0.5, 1.5
#: Likeness of an artist that one side doesn't state; such pairs have the album in common.
NAMELESS = 0.5
YEAR_SAME, YEAR_NEAR, YEAR_DECADE, YEAR_APART = 1.5, 1.2, 0.6, 2.5
ALBUM_SAME, ALBUM_APART = 2.5, 2.0
CHARTER_SAME, CHARTER_APART = 1.5, 0.9
GENRE_SAME, GENRE_APART = 0.1, 0.1


@lru_cache(maxsize=100_000)
def read_title(text: str) -> tuple[str, str, str, str]:
    """Letters of a title without notes, those without articles too, the take it names (or empty), and its numbers in order."""
    plain = without_accents(plain_form(text).casefold()).replace("_", " ")
    take = ""

    def bracket(m: re.Match) -> str:
        nonlocal take
        inside = re.sub(r"[^\w]+", "", m[1])
        words = re.findall(r"\w+", m[1])
        if any(w in TAKES for w in words) or inside in TAKES:
            take = next((t for t in TAKES if t in words or t == inside), take)
            return " "
        return " " if NOTE.fullmatch(inside) else m[0]

    bare = re.sub(r"[(\[{]([^)\]}]*)[)\]}]", bracket, plain)
    head, dash, tail = bare.rpartition(" - ")
    if dash and head.strip() and (NOTE.fullmatch(re.sub(r"[^\w]+", "", tail)) or tail.strip() in TAKES):
        take = tail.strip() if tail.strip() in TAKES else take
        bare = head
    words = " ".join(re.findall(r"\w+", bare))
    while True:
        cut = TAIL.sub("", " " + words).strip()
        last = cut.rpartition(" ")
        if last[1] and last[2] in TAKES:
            take, cut = last[2], last[0]
        if cut == words or not cut:
            break
        words = cut
    # articles and "and" are left out by some who type a title; a title of nothing else keeps them
    short = "".join(w for w in words.split() if w not in LITTLE) or words.replace(" ", "")
    numbers = [w if w.isdigit() else {"ii": "2", "iii": "3", "iv": "4", "vi": "6"}.get(w, "") for w in re.findall(r"\d+|[^\W\d]+", words)]
    return words.replace(" ", ""), short, take, " ".join(n for n in numbers if n)


@F.pandas_udf(TITLE)
def title_of(column: pd.Series) -> pd.DataFrame:
    """Arrow form of :func:`read_title`; null reads as an empty title."""
    return pd.DataFrame([read_title(t or "") for t in column], columns=["core", "short", "take", "numbers"])


@F.pandas_udf(T.StringType())
def plain_of(column: pd.Series) -> pd.Series:
    """Letters and digits of a plain_form, without case and accents, without mark-up and what follows an album's name."""
    out = []
    for t in column:
        t = re.sub(r"<[^>]*>", "", without_accents(plain_form(t or "").casefold())).strip()
        t = re.sub(r"\s*[(\[](deluxe|expanded|special|bonus|explicit|remastered)[^)\]]*[)\]]\s*$|\s+ep$|^by\s+", "", t)
        out.append("".join(filter(str.isalnum, t)))
    return pd.Series(out, dtype=object)


# the planner may not read a title once for a filter and once more for the columns
title_of, plain_of = title_of.asNondeterministic(), plain_of.asNondeterministic()


def year_of(column: Column) -> Column:
    """Year as a number: four digits anywhere, else two alone, as years of this century or the last; else null."""
    four = F.regexp_extract(column, r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)", 1)
    two = F.regexp_extract(column, r"^\s*(\d\d)\s*$", 1)
    return F.when(four != "", four.cast("int")).when(two != "", two.cast("int") + F.when(two.cast("int") < 40, 2000).otherwise(1900))


def _read(df: DataFrame, key: str) -> DataFrame:
    """One side of the linkage with its attributes read."""
    stated = lambda c: F.when(states(F.col(c)), F.col(c))
    return df.select(
        F.col(key).alias("key"),
        parts_of(stated("artist")).alias("a"),
        title_of("name").alias("t"),
        year_of(F.when(states(F.col("year")), F.col("year"))).alias("year"),
        plain_of(stated("album")).alias("album"),
        plain_of(stated("charter")).alias("charter"),
        plain_of(stated("genre")).alias("genre"),
    ).filter("key is not null and t.core <> ''")


def _near(left: DataFrame, right: DataFrame, left_texts: Column, right_texts: Column, of: str) -> DataFrame:
    """Pairs of the numbers ``l<of>`` and ``r<of>`` that have a text of one place at most one slip apart."""

    def keyed(side: DataFrame, texts: Column, number: str, own: bool) -> DataFrame:
        each = side.select(F.col(of).alias(number), F.explode(texts).alias("_x")).select(number, "_x.place", "_x.text").distinct()
        return each.select(number, F.explode(slip_keys(F.col("text"), own)).alias("_h"), "place").select(number, F.xxhash64("place", "_h").alias("_h"))

    return keyed(left, left_texts, f"l{of}", True).join(spread(keyed(right, right_texts, f"r{of}", False)), "_h").select(f"l{of}", f"r{of}").distinct()


def _names(*forms: str, initials: str, all_of: str) -> Column:
    """Texts by which an artist is found: whole forms of the name, and the surname behind a first letter.

    Surnames meet only where one of the two sides has an initial: those with one have the place ``initials``,
    all have the place ``all_of``.
    """
    at = lambda place, text: F.struct(place.alias("place"), F.col(text).alias("text"))
    letter = F.substring("a.given", 1, 1)
    short = F.when(F.length("a.given") == 1, at(F.concat(F.lit(initials), letter), "a.surname"))
    every = F.when(F.length("a.given") > 0, at(F.concat(F.lit(all_of), letter), "a.surname"))
    return F.array_compact(F.array(*[at(F.lit("name"), f) for f in forms], short, every))


def candidates(left: DataFrame, right: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``folder`` and ``record_id`` with the evidence of every pair whose artists and titles may be the same.

    Complete: whatever the rules below accept is proposed. Artists and titles are first met as different texts,
    each on its own, over keys that no two texts at most one slip apart can miss; rows then join by equality on
    the artists and titles near their own, so that no rows meet for half a key.
    """
    nick = nicknames.select(F.lower("nickname").alias("_nick"), F.lower("given").alias("_full")).groupBy("_nick").agg(F.min("_full").alias("_full"))
    full = lambda d: d.join(nick, F.col("a.given") == F.col("_nick"), "left").withColumn("formal", F.concat(F.coalesce("_full", "a.given"), "a.surname")).drop("_nick", "_full")
    # numbers only propose: if two texts had the same one, the rules would still part them
    number = lambda d: d.withColumn("act", F.xxhash64("a", "formal")).withColumn("song", F.xxhash64("t"))
    left, right = durable(number(full(left))), durable(number(full(right)))
    artists = _near(left.filter("a.core <> ''"), right.filter("a.core <> ''"), _names("a.core", "a.swapped", "a.flat", "formal", initials="l", all_of="r"), _names("a.core", "a.flat", "formal", initials="r", all_of="l"), "act")
    title_text = F.array(*[F.struct(F.concat_ws("|", F.lit(form), "t.take", "t.numbers").alias("place"), F.col(f"t.{form}").alias("text")) for form in ("core", "short")])
    titles = _near(left, right, title_text, title_text, "song")
    near = left.select(F.col("key").alias("lk"), F.col("act").alias("lact"), F.col("song").alias("lsong")).join(spread(artists), "lact").join(spread(titles), "lsong")
    met = near.join(spread(right.select(F.col("key").alias("rk"), F.col("act").alias("ract"), F.col("song").alias("rsong"))), ["ract", "rsong"]).select("lk", "rk")
    # where a side states no artist, the album stands for it
    place = lambda d, n: d.filter("album <> ''").select(F.col("key").alias(f"{n}k"), F.col("song").alias(f"{n}song"), F.col("album").alias("_album"), (F.col("a.core") == "").alias(f"_{n}"))
    nameless = (place(left.filter("a.core = ''"), "l"), place(right, "r")), (place(left.filter("a.core <> ''"), "l"), place(right.filter("a.core = ''"), "r"))
    for one, other in nameless:
        met = met.unionByName(one.join(spread(titles), "lsong").join(spread(other), ["rsong", "_album"]).select("lk", "rk"))
    met = met.distinct()
    pairs = met.join(spread(left.select(F.col("key").alias("lk"), F.struct("a", "t", "year", "album", "charter", "genre", "formal").alias("l"))), "lk")
    pairs = pairs.join(spread(right.select(F.col("key").alias("rk"), F.struct("a", "t", "year", "album", "charter", "genre", "formal").alias("r"))), "rk")
    la, ra = F.col("l.a"), F.col("r.a")
    initial = lambda x, y: (F.length(x["given"]) == 1) & (x["given"] == F.substring(y["given"], 1, 1)) & within_one(x["surname"], y["surname"])
    artist = (
        F.when(la["core"] == ra["core"], 1.0)
        .when((la["swapped"] == ra["core"]) | (la["flat"] == ra["flat"]) | (F.col("l.formal") == F.col("r.formal")), 1.0)
        .when(within_one(la["core"], ra["core"]) | within_one(la["swapped"], ra["core"]) | within_one(la["flat"], ra["flat"]) | within_one(F.col("l.formal"), F.col("r.formal")), 0.9)
        .when(initial(la, ra) | initial(ra, la), 0.8)
        .otherwise(0.0)
    )
    kinds = (la["kind"] == ra["kind"]) | (la["words"] == 1) | (ra["words"] == 1) | (la["flat"] == ra["flat"])
    lt, rt = F.col("l.t"), F.col("r.t")
    slipped = lambda form: within_one(lt[form], rt[form]) & (F.length(lt[form]) >= 4)
    title = F.when((lt["core"] == rt["core"]) | (lt["short"] == rt["short"]), 1.0).when(slipped("core") | slipped("short"), 0.9).otherwise(0.0)
    unknown = (la["core"] == "") | (ra["core"] == "")
    pairs = pairs.withColumn("artist", F.when(unknown, NAMELESS).when(kinds, artist).otherwise(0.0)).withColumn("title", title)
    pairs = pairs.filter((F.col("artist") > 0) & (F.col("title") > 0) & (lt["take"] == rt["take"]) & (lt["numbers"] == rt["numbers"]))
    gap = F.abs(F.col("l.year") - F.col("r.year"))
    both = lambda c: (F.length(F.col(f"l.{c}")) > 0) & (F.length(F.col(f"r.{c}")) > 0)
    shorter, longer = F.least(F.length("l.album"), F.length("r.album")), F.greatest(F.length("l.album"), F.length("r.album"))
    begun = (shorter >= 4) & (F.substring("l.album", 1, 4) == F.substring("r.album", 1, 4)) & (F.when(F.length("l.album") <= F.length("r.album"), F.startswith("r.album", "l.album")).otherwise(F.startswith("l.album", "r.album")))
    album = (F.col("l.album") == F.col("r.album")) | ((longer >= 5) & within_one(F.col("l.album"), F.col("r.album"))) | begun
    equal = lambda c: F.col(f"l.{c}") == F.col(f"r.{c}")
    zero = F.lit(0.0)
    plus = (
        F.col("artist") * F.col("title") * SIMILAR
        + F.when(gap == 0, YEAR_SAME).when(gap <= 2, YEAR_NEAR).otherwise(zero)
        + F.when(both("album") & album, ALBUM_SAME).otherwise(zero)
        + F.when(both("charter") & equal("charter"), CHARTER_SAME).otherwise(zero)
        + F.when(both("genre") & equal("genre"), GENRE_SAME).otherwise(zero)
    )
    minus = (
        F.lit(PRIOR)
        # a slip in the tens is a slip of one key
        + F.when(gap == 10, YEAR_DECADE).when(gap > 2, YEAR_APART).otherwise(zero)
        + F.when(both("album") & ~album, ALBUM_APART).otherwise(zero)
        + F.when(both("charter") & ~equal("charter"), CHARTER_APART).otherwise(zero)
        + F.when(both("genre") & ~equal("genre"), GENRE_APART).otherwise(zero)
    )
    return pairs.select(F.col("lk").alias("folder"), F.col("rk").alias("record_id"), plus.alias("plus"), minus.alias("minus"))


def solve(plus: np.ndarray, minus: np.ndarray, left: np.ndarray, right: np.ndarray, part: np.ndarray, close: float = 1e-5, rounds: int = 5000, rho: float = 0.5) -> np.ndarray:
    """Match values: minimal sum of plus (1 - x)^2 + minus x^2, where no number of ``left`` and none of ``right`` has a sum over 1.

    ADMM with a copy of each variable for either side: the x-step is closed for each variable, each copy is
    projected on its side's capped simplexes, u gathers the differences. It ends when copies and variables agree
    to ``close``. ``part`` numbers the parts of the problem that share no variable; each is scaled on its own.
    """
    if not len(plus):
        return np.zeros(0)
    most = np.zeros(part.max() + 1)
    np.maximum.at(most, part, plus + minus)
    scale = np.maximum(most, 1e-9)[part]
    a, b = plus / scale, minus / scale
    sides = [(np.argsort(g, kind="stable"), g) for g in (left, right)]
    sides = [(order, g[order], np.flatnonzero(np.append(True, np.diff(g[order]) != 0))) for order, g in sides]
    alone = a / np.maximum(a + b, 1e-9)
    z, u = [alone.copy(), alone.copy()], [np.zeros(len(a)), np.zeros(len(a))]
    for _ in range(rounds):
        x = (2 * a + rho * (z[0] - u[0] + z[1] - u[1])) / (2 * a + 2 * b + 2 * rho)
        gap = 0.0
        for k, (order, group, start) in enumerate(sides):
            old = z[k]
            z[k] = np.empty(len(a))
            z[k][order] = _simplex((x + u[k])[order], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(group)))), start)
            u[k] += x - z[k]
            gap = max(gap, np.abs(x - z[k]).max(), rho * np.abs(z[k] - old).max())
        if gap < close:
            break
    return np.clip(x, 0.0, 1.0)


def _simplex(v: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Projection of each entity's values on {z >= 0, sum z <= 1}."""
    z = np.maximum(v, 0.0)
    if not len(v):
        return z
    over = np.add.reduceat(z, start) > 1.0
    if not over.any():
        return z
    order = np.lexsort((-v, owner))
    s = v[order]
    running = np.cumsum(s)
    first = np.append(0.0, running[start[1:] - 1])
    count = np.arange(len(v)) - start[owner] + 1
    cut = (running - first[owner] - 1.0) / count
    held = s > cut
    last = np.maximum.reduceat(np.where(held, np.arange(len(v)), start[owner]), start)
    return np.where(over[owner], np.maximum(v - cut[last][owner], 0.0), z)


#: Variables of one connected part of the problem that one task solves; larger parts are solved by rounds over the cluster.
LOCAL = 50_000


def match_values(summed: DataFrame, local: int = LOCAL) -> DataFrame:
    """``_entity``, ``record_id``, ``value`` for every pair with evidence (``plus``, ``minus``).

    Entities and records that are linked by pairs form parts. A part of at most ``local`` pairs is solved where it is
    brought together, many parts in step; any larger one by the same steps as joins and aggregations, so that no
    list of a hot song is ever held by one task.
    """
    pairs = durable(summed)
    edges = pairs.select(F.concat(F.lit("e"), "_entity").alias("a"), F.concat(F.lit("r"), F.col("record_id").cast("string")).alias("b"))
    # what is alone with its partner needs no search for its part
    degree = pairs.select("*", F.count("*").over(Window.partitionBy("_entity")).alias("_n")).select("*", F.count("*").over(Window.partitionBy("record_id")).alias("_m"))
    alone = degree.filter("_n = 1 and _m = 1").select("_entity", "record_id", (F.col("plus") / F.greatest(F.col("plus") + F.col("minus"), F.lit(1e-9))).alias("value"))
    tied = degree.filter("_n > 1 or _m > 1").drop("_n", "_m")
    parts = components(edges.join(spread(tied.select(F.concat(F.lit("e"), "_entity").alias("a")).distinct()), "a", "left_semi").unionByName(edges.join(spread(tied.select(F.concat(F.lit("r"), F.col("record_id").cast("string")).alias("b")).distinct()), "b", "left_semi")))
    placed = durable(tied.withColumn("node", F.concat(F.lit("e"), "_entity")).join(spread(parts), "node").drop("node"))
    sizes = placed.groupBy("root").agg(F.count("*").alias("_size"))
    small = placed.join(spread(sizes.filter(F.col("_size") <= local).select("root")), "root", "left_semi")
    lists = small.groupBy("root").agg(F.collect_list(F.struct("_entity", "record_id", "plus", "minus")).alias("_all"))
    key = dict(pairs.dtypes)["record_id"]

    @F.pandas_udf("array<double>")
    def values(entity: pd.Series, record: pd.Series, plus: pd.Series, minus: pd.Series) -> pd.Series:
        sizes = [len(p) for p in plus]
        if not sizes:
            return pd.Series([], dtype=object)
        part = np.repeat(np.arange(len(sizes)), sizes)
        number = lambda c: pd.factorize(pd.Series([(k, x) for k, xs in enumerate(c) for x in xs]))[0]
        x = solve(np.concatenate(plus.tolist()), np.concatenate(minus.tolist()), number(entity), number(record), part)
        return pd.Series(np.split(x, np.cumsum(sizes)[:-1]), dtype=object)

    solved = lists.withColumn("_x", values(F.col("_all._entity"), F.col("_all.record_id"), F.col("_all.plus"), F.col("_all.minus")))
    solved = solved.select(F.explode(F.arrays_zip("_all", "_x")).alias("_z")).select("_z._all._entity", F.col("_z._all.record_id").cast(key).alias("record_id"), F.col("_z._x").alias("value"))
    large = placed.join(sizes.filter(F.col("_size") > local).select("root"), "root", "left_semi")
    if not large.isEmpty():
        solved = solved.unionByName(solve_large(large))
    return alone.unionByName(solved)


def solve_large(pairs: DataFrame, close: float = 1e-3, rounds: int = 1000, rho: float = 0.5) -> DataFrame:
    """The steps of :func:`solve` as aggregations: ``_entity``, ``record_id``, ``value`` of pairs with their ``root``.

    A side's projection takes one number (``c``) off all its variables; each round makes one Newton step towards it
    from the last round's, by a sum and a count of the variables above it. No list is made.
    """
    scaled = pairs.join(pairs.groupBy("root").agg(F.max(F.col("plus") + F.col("minus")).alias("_s")), "root")
    a, b = F.col("plus") / F.col("_s"), F.col("minus") / F.col("_s")
    start, zero = a / F.greatest(a + b, F.lit(1e-9)), F.lit(0.0)
    sides = ("_entity", "record_id")
    now = durable(scaled.select(*sides, a.alias("a"), b.alias("b"), *[x.alias(f"{n}{k}") for k in (0, 1) for n, x in (("z", start), ("u", zero), ("c", zero))]))
    for _ in range(rounds):
        x = (2 * F.col("a") + rho * (F.col("z0") - F.col("u0") + F.col("z1") - F.col("u1"))) / (2 * F.col("a") + 2 * F.col("b") + 2 * rho)
        stepped = now.withColumn("x", x)
        moved, gaps = stepped, []
        for k, side in enumerate(sides):
            v, old = F.col("x") + F.col(f"u{k}"), F.col(f"c{k}")
            above = stepped.groupBy(side).agg(F.sum(F.when(v > old, v)).alias("_t"), F.count_if(v > old).alias("_c"))
            step = above.select(side, F.when(F.col("_c") > 0, F.greatest((F.col("_t") - 1) / F.col("_c"), zero)).otherwise(zero).alias(f"d{k}"))
            moved = moved.join(step, side)
            w = F.greatest(v - F.col(f"d{k}"), zero)
            gaps += [F.abs(F.col("x") - w), rho * F.abs(w - F.col(f"z{k}")), F.abs(F.col(f"d{k}") - old)]
            moved = moved.withColumn(f"w{k}", w)
        moved = moved.withColumn("_gap", F.greatest(*gaps))
        moved = moved.select(*sides, "a", "b", "x", "_gap", *[c for k in (0, 1) for c in (F.col(f"w{k}").alias(f"z{k}"), (F.col(f"u{k}") + F.col("x") - F.col(f"w{k}")).alias(f"u{k}"), F.col(f"d{k}").alias(f"c{k}"))])
        now = durable(moved)
        if now.agg(F.max("_gap")).first()[0] < close:
            break
    return now.select(*sides, F.greatest(F.least("x", F.lit(1.0)), zero).alias("value"))


def matched(left: DataFrame, right: DataFrame, groups: DataFrame, nicknames: DataFrame, least: float = 0.5) -> DataFrame:
    """``folder``, ``record_id``, ``confidence``: each folder's partner, where one reaches ``least``.

    Folders of one group have the same partner. Equal values fall to the smaller record. Rows without
    a title, and null keys, have no partner; those that state no artist have one only where the album is the same; repeated rows of a key are one. Every pair with evidence keeps its variable.
    """
    found = candidates(_read(left, "folder"), _read(right, "record_id"), nicknames)
    member = groups.select("folder", F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("_group")).filter("folder is not null and _group is not null").groupBy("folder").agg(F.min("_group").alias("_group"))
    evidence = found.groupBy("folder", "record_id").agg(F.max("plus").alias("plus"), F.max("minus").alias("minus"))
    named = evidence.join(spread(member), "folder", "left").withColumn("_entity", F.coalesce("_group", F.concat(F.lit("f"), "folder")))
    summed = named.groupBy("_entity", "record_id").agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))
    best = match_values(summed).groupBy("_entity").agg(F.max_by("record_id", F.struct(F.round("value", 4), -F.col("record_id"))).alias("record_id"), F.round(F.max("value"), 4).alias("confidence"))
    chosen = best.filter(F.col("confidence") >= least)
    folders = left.select("folder").filter("folder is not null").distinct().join(spread(member), "folder", "left")
    return folders.withColumn("_entity", F.coalesce("_group", F.concat(F.lit("f"), "folder"))).join(spread(chosen), "_entity").select("folder", "record_id", "confidence")
