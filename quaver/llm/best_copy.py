"""Best representative of each duplicate group, field by field, by token-level consensus.

The stated values of a group are put in order of trust and aligned token by token, one after the other
(progressive alignment). Tokens vote in each column with their copy's weight, and the existing value closest
to the consensus is emitted: each copy has one vote (:func:`by_copies`) and the tokens decide. With weights that fall
by a factor of three from value to value (:func:`by_trust`) the most trusted outweighs all others together.

Where the best copy is asked for (:func:`best_fields`), no vote can change what it states, so none is held: its
value is taken by one aggregation.

Groups of any size are reduced in rounds: a group is cut into blocks of bounded size, each block yields its
representative, and the representatives meet in the next round. No task ever holds a whole group.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.session import durable

FIELDS = ("year", "genre", "charter", "album")

# Letters and digits of values that state nothing, in any field
STATES_NOTHING = [
    "0", "00000", "0000", "000", "blank", "empty", "na", "nan", "nil", "none", "notavailable", "notknown", "null",
    "tba", "tbd", "undefined", "unknown", "unknownalbum", "unknownartist", "unknowncharter", "unknowngenre",
    "unknownyear", "unspecified", "various",
]

TOKEN = re.compile(r"\w+|[^\w\s]")


def states(column: Column) -> Column:
    """Whether a value states something: not null, not blank, no stand-in for "not known".

    Mark-up around a value and the digits of a partly known year (``20xx``, ``19??``) do not make it state more.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(column, "<[^>]*=[^>]*>|</[^>]*>", "")), r"[^\p{L}\p{N}]+", "")
    vague = bare.isin(STATES_NOTHING) | bare.rlike("^[0-9]{1,3}x+$|^x{2,}$") | F.trim(column).rlike(r"^[0-9]{1,3}\?+$")
    return F.coalesce((F.length(bare) > 0) & ~vague, F.lit(False))


def align(columns: list[dict[str, float]], tokens: list[str], weight: float) -> list[dict[str, float]]:
    """Adds one more row of tokens to an alignment; a column maps tokens (``""`` for a gap) to weights."""
    n, m = len(columns), len(tokens)
    total = sum(columns[0].values()) if columns else 0.0
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        here = columns[i]
        for j in range(m - 1, -1, -1):
            score[i][j] = max(score[i + 1][j + 1] + here.get(tokens[j], 0.0), score[i + 1][j], score[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and score[i][j] == score[i + 1][j + 1] + columns[i].get(tokens[j], 0.0) and (tokens[j] in columns[i] or score[i][j] > max(score[i + 1][j], score[i][j + 1])):
            column, i, j = columns[i] | {tokens[j]: columns[i].get(tokens[j], 0.0) + weight}, i + 1, j + 1
        elif i < n and (j == m or score[i][j] == score[i + 1][j]):
            column, i = columns[i] | {"": columns[i].get("", 0.0) + weight}, i + 1
        else:
            column, j = {"": total, tokens[j]: weight}, j + 1
        out.append(column)
    return out


def consensus(values: list[str], weights: list[float]) -> int:
    """Index of the value closest to the consensus of ``values`` under their ``weights``; the earlier one on ties."""
    rows = [TOKEN.findall(v) for v in values]
    columns: list[dict[str, float]] = []
    for row, weight in zip(rows, weights, strict=True):
        columns = align(columns, row, weight)
    # all weights of a column sum to the same; the heaviest entry wins it, the earlier one on ties
    agreed = [max(c, key=c.get) for c in columns]
    agreed = [t for t in agreed if t]
    return min(range(len(rows)), key=lambda k: (_apart(rows[k], agreed), k))


def _apart(a: list[str], b: list[str]) -> int:
    """Edit distance of two token rows."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_trust(copies: list[int], ratio: float = 1 / 3) -> list[float]:
    """Weights that fall by ``ratio`` from each value to the less trusted next one, whatever their copies."""
    return [ratio**k for k in range(len(copies))]


def by_copies(copies: list[int]) -> list[float]:
    """A vote for each copy."""
    return [float(n) for n in copies]


def representatives(df: DataFrame, group: list[str], value: str, trust: list[Column], weigh: Callable[[list[int]], list[float]] = by_trust, block: int = 32) -> DataFrame:
    """One row for each group: its keys, the ``value`` of its representative, its ``copies`` and the ``stated`` copies of the group.

    ``trust`` columns order the rows, greatest first, nulls last; equal rows fall back to the smaller value.
    ``weigh`` turns the numbers of copies, in that order, into weights. Equal values of a group are one row that
    carries its number of copies from round to round, so that a value's votes are never lost. Rows with a null
    value are passed over; a group without any gives no row. A block holds about ``block`` values: they are
    spread by a hash over as many blocks as the group's count asks for, so the expected block is bounded
    whatever the size of the group. A value with more than half of the votes wins its block and every later one.
    """
    pick = F.pandas_udf(lambda lists, copies: pd.Series([consensus(list(v), weigh(list(n))) for v, n in zip(lists, copies, strict=True)]), T.IntegerType())
    order = F.struct(*[F.struct(t.isNotNull(), t) for t in trust])
    rows = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"), order.alias("_trust"))
    # equal values of a group are one row with the best trust; combined before the shuffle
    rows = rows.groupBy(*group, "_v").agg(F.max("_trust").alias("_trust"), F.count("*").alias("_n"))
    rows = rows.withColumn("_of", F.col("_n"))
    least_first = F.expr("array_sort(_all, (x, y) -> case when x._trust > y._trust then -1 when x._trust < y._trust then 1 when x._v < y._v then -1 when x._v > y._v then 1 else 0 end)")
    while True:
        sizes = rows.groupBy(*[F.col(g).alias(f"_of_{g}") for g in group]).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
        most = sizes.agg(F.max("_blocks")).first()[0] or 1
        if most > 1:
            # a null in a key column must meet itself
            same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
            rows = rows.join(sizes, same).select(*group, "_v", "_trust", "_n", "_of", F.pmod(F.xxhash64("_v", F.lit(most)), F.col("_blocks")).alias("_block"))
        else:
            rows = rows.withColumn("_block", F.lit(0))
        blocks = rows.groupBy(*group, "_block").agg(F.collect_list(F.struct("_trust", "_v", "_n")).alias("_all"), F.sum("_of").alias("_of")).withColumn("_all", least_first)
        chosen = blocks.withColumn("_best", F.when(F.size("_all") == 1, F.lit(0)).otherwise(pick(F.col("_all._v"), F.col("_all._n"))))
        rows = chosen.select(*group, F.expr("_all[_best]._v").alias("_v"), F.expr("_all[_best]._trust").alias("_trust"), F.expr("_all[_best]._n").alias("_n"), "_of")
        if most == 1:
            return rows.select(*group, F.col("_v").alias(value), F.col("_n").alias("copies"), F.col("_of").alias("stated"))
        rows = durable(rows)


def _stated(groups: DataFrame, copies: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Every value that a copy of a group states: ``group_id``, ``field``, ``value`` with what its trust follows from."""
    held = groups.select("group_id", "ord", "folder").join(copies.select("folder", "status", "modified_at", *fields), "folder")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return held.select("group_id", "ord", "status", "modified_at", each.alias("_x")).select("*", "_x.field", "_x.value").filter(states(F.col("value")))


def _trust() -> list[Column]:
    return [F.coalesce(F.col("status") == "confirmed_ok", F.lit(False)).cast("int"), F.col("modified_at"), -F.col("ord")]


def best_fields(groups: DataFrame, copies: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``group_id``, ``field``, ``value``: what each group's best copy states, exactly as written there.

    Copies with status confirmed_ok come first, then the later ``modified_at`` (null last), then the smaller
    ``ord``, then the smaller value. A group whose folders are unknown or state nothing in a field gives no row for it.
    """
    confirmed, modified, first = _trust()
    order = F.struct(-confirmed, modified.isNull(), -F.unix_micros(modified), first.isNull(), -first, "value")
    return _stated(groups, copies, fields).groupBy("group_id", "field").agg(F.min_by("value", order).alias("value"))


def agreed_fields(groups: DataFrame, copies: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``group_id``, ``field``, ``value``, ``copies``, ``stated``: the existing value closest to what all copies say.

    Every copy has one vote, token by token; ``copies`` of the ``stated`` ones have just this value. Trust decides
    between equally close values only.
    """
    return representatives(_stated(groups, copies, fields), ["group_id", "field"], "value", _trust(), by_copies)


def majority_fields(groups: DataFrame, copies: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Those of :func:`agreed_fields` whose value more than half of the stating copies have."""
    return agreed_fields(groups, copies, fields).filter("2 * copies > stated")
