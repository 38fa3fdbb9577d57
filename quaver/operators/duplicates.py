"""Duplicate folders by similar names: blocked fuzzy join, star groups, and the copy to keep."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import combinations, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.functions.text import clean_folder, folder_parts, is_charted, normalize_lookup, version_tag
from quaver.session import durable, spread

WIDTH = 4
ARTIST_LEAST, TITLE_LEAST = 90.0, 85.0
#: Characters from the most to the least frequent one; all others share their places with these.
LETTERS = " etaoinshrdlcumwfgypbvkjxqz0123456789"
#: Bits of a character's count, and longs that hold those of all characters.
LEVELS, LONGS = 6, 4
#: Slips up to which texts meet by their letters; more slips would part the letters into groups of hardly any.
FEW = 12

# The difficulty fields of parts, and the fields that describe a song
PARTS = (
    "diff_band", "diff_guitar", "diff_guitar_coop", "diff_rhythm", "diff_bass", "diff_drums", "diff_drums_real", "diff_keys",
    "diff_guitarghl", "diff_guitar_coop_ghl", "diff_rhythm_ghl", "diff_bassghl", "diff_vocals",
)
DESCRIPTION = ("year", "genre", "charter", "album")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts in percent (matching blocks, the order of the arguments counts)."""
    return pd.Series([100.0 if x == y else SequenceMatcher(None, x or "", y or "").ratio() * 100.0 for x, y in zip(a, b, strict=True)])


# the planner may not compare once for a filter and once more for the column
ratio = ratio.asNondeterministic()


@lru_cache(maxsize=100_000)
def letter_bits(text: str) -> int:
    """Counts of a text's characters, each as a run of that many bits (at most ``LEVELS``): texts differ in as many characters as these differ in bits, or more."""
    counts: dict[int, int] = {}
    for c in text:
        at = _place(c)
        counts[at] = counts.get(at, 0) + 1
    return sum(((1 << min(n, LEVELS)) - 1) << at * LEVELS for at, n in counts.items())


def _place(c: str) -> int:
    at = LETTERS.find(c)
    return at if at >= 0 else ord(c) % len(LETTERS)


def _signed(bits: int) -> list[int]:
    return [(x := bits >> 64 * k & 0xFFFFFFFFFFFFFFFF) - (x >> 63 << 64) for k in range(LONGS)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def letters(column: pd.Series) -> pd.Series:
    """:func:`letter_bits` in ``LONGS`` longs; null reads as an empty text."""
    return pd.Series([_signed(letter_bits(t or "")) for t in column], dtype=object)


letters = letters.asNondeterministic()


def may_share(a: str, b: str, bits_a: str, bits_b: str, least: float) -> Column:
    """Whether two texts can reach a similarity at all, by their :func:`letters`: an exact upper bound."""
    both = F.length(a) + F.length(b)
    apart = sum((F.bit_count(F.col(bits_a)[k].bitwiseXOR(F.col(bits_b)[k])) for k in range(LONGS)), F.lit(0))
    return 100.0 * (both - apart) >= least * both


def ratio_from(least: float) -> Callable:
    """:func:`ratio` where it reaches ``least``; 0 for texts whose letters already rule that out, which saves comparing them."""

    def one(x: str, y: str) -> float:
        both = len(x) + len(y)
        if 100.0 * (both - (letter_bits(x) ^ letter_bits(y)).bit_count()) < least * both:
            return 0.0
        return SequenceMatcher(None, x, y).ratio() * 100.0

    # the planner may not compare once for a filter and once more for the column
    return F.pandas_udf(lambda a, b: pd.Series([100.0 if x == y else one(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float), T.DoubleType()).asNondeterministic()


def name_keys(folders: DataFrame, ord: str, name: str) -> DataFrame:
    """``ord``, version tag, normalised artist and title, and the title's length bucket of each folder name."""
    cleaned = folders.select(F.col(ord).alias("ord"), clean_folder(F.col(name)).alias("_c"))
    parts = cleaned.select("ord", version_tag(F.col("_c")).alias("tag"), folder_parts(F.col("_c")).alias("_p"))
    keys = parts.select("ord", "tag", normalize_lookup(F.col("_p.artist")).alias("artist"), normalize_lookup(F.col("_p.title")).alias("title"))
    return keys.withColumn("bucket", F.floor(F.length("title") / WIDTH).cast("int"))


def may_reach(a: str, b: str, least: float) -> Column:
    """Whether two texts can reach a similarity at all, by their lengths: an exact upper bound."""
    la, lb = F.length(a), F.length(b)
    return (la + lb == 0) | (200.0 * F.least(la, lb) >= least * (la + lb))


def _slips(n: int, least: float) -> int:
    """Most characters by which a text of length ``n`` and any other of that similarity differ."""
    loss = 1 - least / 100
    longest = int(n * (1 + loss) / (1 - loss) + 1e-9)
    return int(loss * (n + longest) + 1e-9)


def _cuts(n: int, least: float) -> list[tuple[int, int]]:
    """Start and length of one more piece of a text of length ``n`` than it may have slips: one piece is left whole."""
    k = min(_slips(n, least) + 1, max(n, 1))
    ends = [n * i // k for i in range(k + 1)]
    return [(s, e - s) for s, e in pairwise(ends)]


def _partners(n: int, least: float) -> list[tuple[int, int]]:
    """Lengths that a text similar to one of length ``n`` may have, with the most characters by which the two then differ."""
    loss = 1 - least / 100
    lengths = range(int(n * (1 - loss) / (1 + loss)), int(n * (1 + loss) / (1 - loss)) + 2)
    return [(m, int(loss * (n + m) + 1e-9)) for m in lengths]


def _cells(text: str, least: float) -> list[str]:
    """Letters of a text in any two of two more groups of letters than it may have slips: a slip changes one group, so two stay as they are."""
    out = []
    for slips in sorted({d for _, d in _partners(len(text), least) if 0 < d <= FEW}):
        groups = [""] * (slips + 2)
        for c in sorted(text):
            turn, at = divmod(_place(c), slips + 2)
            groups[at if turn % 2 == 0 else slips + 1 - at] += c
        out += [f"{slips}/{i}/{j}/{groups[i]}/{groups[j]}" for i, j in combinations(range(slips + 2), 2)]
    return out


def _own_keys(text: str, least: float) -> list[str]:
    pieces = [f"{len(text)}|{i}|{text[s : s + m]}" for i, (s, m) in enumerate(_cuts(len(text), least))]
    return _cells(text, least) + (pieces if _slips(len(text), least) > FEW else [])


def _other_keys(text: str, least: float) -> list[str]:
    out = set()
    for n, slips in _partners(len(text), least):
        if slips <= FEW:
            continue
        for i, (s, m) in enumerate(_cuts(n, least)):
            # slips before a piece move it, and there are at most as many as it has pieces before it if it is the first whole one
            for at in range(max(0, s - i), min(len(text) - m, s + i) + 1):
                out.add(f"{n}|{i}|{text[at : at + m]}")
    return _cells(text, least) + sorted(out)


def similar_texts(df: DataFrame, text: str, least: float) -> DataFrame:
    """``a``, ``b``, ``ratio`` of all ordered pairs of different texts of that similarity, and of each text with itself.

    Complete: the letters fall into two more groups than similar texts can differ by characters, so that such texts
    have the same letters in two groups at least. Texts of many slips are cut into more pieces than these, so one
    piece stands in the other text near its place. Both meet by an equi-join of 64-bit hashes, of which equal ones
    only propose; what the counts of all letters rule out goes no further. Texts are compared once, however many rows hold them.
    """

    def keys(of: Callable[[str, float], list[str]]) -> Callable:
        return F.pandas_udf(lambda column: pd.Series([of(t, least) for t in column], dtype=object), T.ArrayType(T.StringType()))

    texts = df.select(F.col(text).alias("t")).filter("t is not null").distinct()
    side = lambda n, of: texts.select(F.col("t").alias(n), letters("t").alias(f"_{n}"), F.explode(keys(of)("t")).alias("_k")).select(n, f"_{n}", F.xxhash64("_k").alias("_k"))
    met = side("a", _own_keys).join(spread(side("b", _other_keys)), "_k").filter((F.col("a") < F.col("b")) & may_reach("a", "b", least) & may_share("a", "b", "_a", "_b", least)).select("a", "b").distinct()
    both = met.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_x")).select("_x.a", "_x.b")
    rated = both.withColumn("ratio", ratio("a", "b")).filter(F.col("ratio") >= least)
    return rated.unionByName(texts.select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(100.0).alias("ratio")))


def blocked_pairs(keys: DataFrame, exact_bound: bool = False) -> DataFrame:
    """Pairs ``i`` < ``j`` that are worth comparing by title: equal tags, similar artists, title buckets at most one apart.

    Artists are compared as distinct texts first, which leaves to the pairs of rows only their titles. With
    ``exact_bound`` every bucket that the length bound allows is compared, not only the neighbours, so that no
    pair is lost.
    """
    near = (
        F.sequence(F.floor(F.length("title") * 0.739 / WIDTH).cast("int"), F.floor(F.length("title") * 1.353 / WIDTH).cast("int"))
        if exact_bound
        else F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)
    )
    keys = keys.withColumn("_tag", F.coalesce("tag", F.lit("")))
    acts = durable(similar_texts(keys, "artist", ARTIST_LEAST)).withColumnRenamed("ratio", "artist_ratio")
    left = keys.select(F.col("ord").alias("i"), "_tag", F.col("artist").alias("a"), F.col("title").alias("t1"), F.explode(near).alias("_b")).join(spread(acts), "a")
    right = keys.select(F.col("ord").alias("j"), "_tag", F.col("artist").alias("b"), F.col("title").alias("t2"), F.col("bucket").alias("_b"))
    met = left.join(spread(right), ["b", "_tag", "_b"]).filter("i < j")
    return met.filter(may_reach("t1", "t2", TITLE_LEAST)).select("i", "j", "_tag", "t1", "t2", "artist_ratio")


def similar_pairs(keys: DataFrame, exact_bound: bool = False) -> DataFrame:
    """Blocked pairs whose titles are similar enough too: ``i``, ``j``, tag, and both ratios."""
    pairs = blocked_pairs(keys, exact_bound).withColumn("title_ratio", ratio_from(TITLE_LEAST)("t1", "t2")).filter(F.col("title_ratio") >= TITLE_LEAST)
    return pairs.select("i", "j", F.col("_tag").alias("tag"), "artist_ratio", "title_ratio")


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """``leader`` and ``member``: each folder joins the smallest earlier leader that it matches; leaders join nobody.

    A folder is a leader if no smaller neighbour is one, which settles in rounds from the smallest up: in each
    round folders whose smaller neighbours are all decided are decided. The rounds are joins on the matched pairs;
    no group is collected. Single folders are in no group.
    """
    edges = durable(pairs.select("i", "j").distinct())
    nodes = edges.select(F.col("i").alias("n")).unionByName(edges.select(F.col("j").alias("n"))).distinct()
    state = nodes.join(spread(edges.select(F.col("j").alias("n")).distinct()), "n", "left_anti").select("n", F.lit(True).alias("lead"))
    total = nodes.count()
    state = durable(state)
    while state.count() < total:
        open_ = nodes.join(spread(state.select("n")), "n", "left_anti")
        seen = edges.join(spread(open_.select(F.col("n").alias("j"))), "j", "left_semi").join(spread(state.withColumnRenamed("n", "i")), "i", "left")
        # absorbed as soon as one smaller neighbour leads; a leader once all smaller ones are known not to
        told = seen.groupBy(F.col("j").alias("n")).agg(F.max(F.coalesce("lead", F.lit(False))).alias("_hit"), F.count_if(F.col("lead").isNull()).alias("_unknown"))
        now = told.filter("_hit or _unknown = 0").select("n", (~F.col("_hit")).alias("lead"))
        state = durable(state.unionByName(now))
    leaders = state.filter("lead").select(F.col("n").alias("leader"))
    taken = edges.join(spread(leaders.withColumnRenamed("leader", "i")), "i", "left_semi").join(spread(leaders.withColumnRenamed("leader", "j")), "j", "left_anti")
    members = taken.groupBy(F.col("j").alias("member")).agg(F.min("i").alias("leader"))
    heads = members.select("leader").distinct().select("leader", F.col("leader").alias("member"))
    return members.select("leader", "member").unionByName(heads)


def copy_score(fields: Column, has_video: Column, clean_record: Column) -> Column:
    """Score of a copy from its map of fields: 10 for a video, 5 for a charted part, 2 for a field, 5 for a clean record."""
    charted = F.size(F.filter(F.array(*[F.lit(p) for p in PARTS]), lambda p: is_charted(F.try_element_at(fields, p))))
    filled = F.size(F.filter(F.array(*[F.lit(d) for d in DESCRIPTION]), lambda d: F.coalesce(F.try_element_at(fields, d) != "", F.lit(False))))
    return F.when(has_video, 10).otherwise(0) + 5 * charted + 2 * filled + F.when(clean_record, 5).otherwise(0)


def keepers(copies: DataFrame) -> DataFrame:
    """The best eligible copy of each group: highest score, the earliest among equals; no row if none is eligible."""
    best = F.max_by("folder", F.struct("score", -F.col("ord")))
    return copies.filter("eligible").groupBy("group_id").agg(best.alias("keeper"), F.max("score").alias("score"))


def borrowable(copies: DataFrame, kept: DataFrame) -> DataFrame:
    """Charted parts (and ``video``) that a copy has and its group's keeper lacks; copies without any give no row."""
    keeper = copies.join(kept.select("group_id", F.col("keeper").alias("folder")), ["group_id", "folder"]).select("group_id", F.col("folder").alias("keeper"), F.col("has").alias("_kept"))
    rest = copies.join(keeper, "group_id").filter("folder <> keeper")
    return rest.select("group_id", "folder", F.array_join(F.array_sort(F.array_except("has", "_kept")), ",").alias("borrow")).filter("borrow <> ''")


def charted_parts(fields: Column) -> Column:
    """The difficulty fields of a map that say their part exists."""
    return F.filter(F.array(*[F.lit(p) for p in PARTS]), lambda p: is_charted(F.try_element_at(fields, p)))


def confirmed(members: DataFrame, prints: DataFrame, least: float = 0.95) -> DataFrame:
    """Members whose fingerprint is at least ``least`` like that of their group's first member with one.

    ``prints`` has ``member`` and ``bits`` (array of long); the share of equal bits is compared.
    """
    held = members.join(prints, "member").filter("bits is not null")
    first = held.groupBy("leader").agg(F.min_by("bits", "member").alias("_ref"), F.min("member").alias("_first"))
    both = held.join(first, "leader")
    apart = F.aggregate(F.zip_with("bits", "_ref", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    share = 1 - apart / (64 * F.greatest(F.size("bits"), F.size("_ref")))
    return both.withColumn("similarity", share).filter(F.col("similarity") >= least).select("leader", "member", "similarity")


def report(copies: DataFrame, prints: DataFrame, least: float = 0.95) -> DataFrame:
    """One row for each copy of a candidate group: ``group_id``, ``folder``, ``action``, ``score``, ``keeper``, ``borrow``.

    ``copies`` has ``group_id``, ``ord``, ``folder``, ``score``, ``eligible`` and ``has``; ``prints`` has ``folder`` and
    ``bits``. A copy is confirmed by its print; groups with fewer than two confirmed copies stay as they are
    (``not_confirmed``), as do those of which no confirmed copy is eligible (``none_eligible``). In the others the best copy
    is the ``keeper``, other confirmed ones go (``move``), with what the keeper could borrow from them.
    """
    held = copies.join(prints, "folder").select(F.col("group_id").alias("leader"), F.struct("ord", "folder").alias("member"), "bits")
    same = confirmed(held.select("leader", "member"), held.select("member", "bits"), least)
    several = same.groupBy("leader").agg(F.count("*").alias("_n")).filter("_n > 1").select("leader")
    sure = same.join(several, "leader", "left_semi").select(F.col("leader").alias("group_id"), F.col("member.folder").alias("folder"), F.lit(True).alias("_sure"))
    taking_part = copies.join(sure, ["group_id", "folder"])
    kept = keepers(taking_part)
    rows = copies.select("group_id", "folder", "score").join(sure, ["group_id", "folder"], "left").join(kept.select("group_id", "keeper"), "group_id", "left")
    rows = rows.join(borrowable(taking_part, kept), ["group_id", "folder"], "left")
    action = (
        F.when(F.col("_sure").isNull(), "not_confirmed")
        .when(F.col("keeper").isNull(), "none_eligible")
        .when(F.col("keeper") == F.col("folder"), "keeper")
        .otherwise("move")
    )
    return rows.select("group_id", "folder", action.alias("action"), "score", F.when(F.col("_sure"), F.col("keeper")).alias("keeper"), F.coalesce("borrow", F.lit("")).alias("borrow"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")
