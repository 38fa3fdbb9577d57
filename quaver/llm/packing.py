"""Filling containers of fixed capacity with items, by non-negative least squares on the histogram of sizes.

Shallow combinations of lengths that fill the capacity up to a window are enumerated; a non-negative least
squares fit says how often each is to be repeated so that the histogram is used up; the counts are rounded
down and what is left is packed greedily, longest first into the fullest container that has room. All of
that works on the histogram, whose size is bounded by the capacity and not by the number of items. Items
then find their containers by their rank among the items of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.session import durable, shuffle_width

#: Kinds of containers in one call; each gets its own plan on the driver.
MOST_KINDS = 1000

#: Capacity above which lengths are grouped for the fit, so that its cost doesn't grow with the capacity.
LEVELS = 256


def shapes(capacity: int, have: np.ndarray, window: int) -> np.ndarray:
    """Combinations of up to three of the lengths in ``have`` that sum to capacity - window .. capacity.

    Rows are padded with zeros and fall from left to right.
    """
    out = [np.stack([x, np.zeros_like(x), np.zeros_like(x)], 1) for x in [have[(have >= capacity - window) & (have <= capacity)]]]
    a, b = np.meshgrid(have, have, indexing="ij")
    pair = (a >= b) & (a + b >= capacity - window) & (a + b <= capacity)
    out.append(np.stack([a[pair], b[pair], np.zeros_like(a[pair])], 1))
    known = np.zeros(capacity + 1, bool)
    known[have] = True
    for gap in range(window + 1):
        c = capacity - gap - a - b
        triple = (a >= b) & (c <= b) & (c > 0)
        triple[triple] = known[c[triple]]
        out.append(np.stack([a[triple], b[triple], c[triple]], 1))
    return np.concatenate(out)


def fit(pieces: np.ndarray, have: np.ndarray, want: np.ndarray, steps: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that make the used lengths closest to ``want``.

    Weighted non-negative least squares, solved by projected gradients with momentum; short lengths weigh
    less, as they fill gaps anyway.
    """
    index = np.full(int(have.max()) + 1, len(have))
    index[have] = np.arange(len(have))
    index[0] = len(have)
    rows = index[pieces]
    scale = max(float(want.max()), 1.0)
    weight = np.append(np.sqrt(have / have.max()), 0.0)
    target = np.append(want / scale, 0.0) * weight
    used = lambda x: np.bincount(rows.ravel(), np.repeat(x, 3), len(have) + 1)
    x = np.zeros(len(pieces))
    y, t = x, 1.0
    # the greatest singular value, by a few power steps
    v = np.ones(len(pieces))
    for _ in range(12):
        u = used(v) * weight**2
        v = u[rows].sum(1)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    rate = 1.0 / (1.05 * norm)
    for _ in range(steps):
        gap = (used(y) * weight - target) * weight
        gap[-1] = 0.0
        new = np.maximum(0.0, y - rate * gap[rows].sum(1))
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / grown * (new - x), new, grown
    return x * scale


def plan(histogram: dict[int, int], capacity: int, window: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """Container contents and their repeat counts, using every item of ``histogram`` (length: count) once.

    Lengths over LEVELS steps are grouped by rounding up for the fit only. The repeats are rounded down and
    never use more items than there are; the rest goes, longest first, into the container with the least room
    that still takes it. The number of entries is bounded by a small multiple of the capacity.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, count in histogram.items():
        left[size] += count
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    step = max(1, -(-capacity // LEVELS))
    level = -(-np.arange(capacity + 1) // step)
    coarse = np.bincount(level, left)
    room = capacity // step
    have = np.flatnonzero(coarse[: room + 1])
    have = have[have > 0]
    pieces = shapes(room, have, window) if len(have) else np.zeros((0, 3), np.int64)
    open_bins: dict[int, list[list]] = {}

    def keep(parts: tuple[int, ...], count: int) -> None:
        free = capacity - sum(parts)
        open_bins.setdefault(free, []).append([parts, count])

    if len(pieces):
        counts = np.floor(fit(pieces, have, coarse[have])).astype(np.int64)
        members = [np.flatnonzero(level == k)[::-1] for k in range(room + 1)]
        # the most repeated first; each level hands out its longest items first
        for k in np.argsort(-counts, kind="stable"):
            todo = int(counts[k])
            if todo == 0:
                break
            while todo:
                parts, used = [], {}
                for need in pieces[k]:
                    if need:
                        size = next((int(s) for s in members[need] if left[s] > used.get(int(s), 0)), None)
                        if size is None:
                            break
                        parts.append(size)
                        used[size] = used.get(size, 0) + 1
                else:
                    times = min(todo, *(int(left[s]) // n for s, n in used.items()))
                    for s, n in used.items():
                        left[s] -= n * times
                    keep(tuple(parts), times)
                    todo -= times
                    continue
                break
    rooms = sorted(open_bins)
    for size in range(capacity - 1, 0, -1):
        count = int(left[size])
        while count:
            k = int(np.searchsorted(rooms, size))
            while k < len(rooms) and not open_bins[rooms[k]]:
                rooms.pop(k)
            if k == len(rooms):
                fits = capacity // size
                full, rest = divmod(count, fits)
                for parts, times in (((size,) * fits, full), ((size,) * rest, 1 if rest else 0)):
                    if times:
                        _open(open_bins, rooms, capacity, parts, times)
                break
            parts, times = open_bins[rooms[k]].pop()
            # as many of this length as one container takes
            deep = min(rooms[k] // size, max(1, count))
            taken = min(times, max(1, count // deep))
            if taken < times:
                open_bins[rooms[k]].append([parts, times - taken])
            _open(open_bins, rooms, capacity, parts + (size,) * deep, taken)
            count -= deep * taken
    for groups in open_bins.values():
        out += [(tuple(parts), int(times)) for parts, times in groups]
    return out


def _open(bins: dict[int, list[list]], rooms: list[int], capacity: int, parts: tuple[int, ...], times: int) -> None:
    free = capacity - sum(parts)
    if free not in bins or free not in rooms:
        heap_at = int(np.searchsorted(rooms, free))
        rooms.insert(heap_at, free)
    bins.setdefault(free, []).append([parts, times])


def slots(filled: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the items of each length go: ``size``, ``rank`` and ``container`` of the first, ``start`` in it.

    Containers are numbered from 0 in the order of the plan; an entry's containers are consecutive.
    """
    rows, taken, base = [], {}, 0
    for parts, times in filled:
        start = 0
        for size in parts:
            rows.append((size, taken.get(size, 0), base, start))
            taken[size] = taken.get(size, 0) + times
            start += size
        base += times
    return pd.DataFrame(rows, columns=["size", "rank", "container", "start"], dtype="int64").sort_values(["size", "rank"], ignore_index=True)


def ranked(items: DataFrame, keys: list[str], order: list[str], salts: int) -> DataFrame:
    """``items`` with ``_rank`` from 0 within ``keys``, without a task that holds a whole hot key.

    Rows are ranked within salted parts of a key; a part's offset is the running count of the parts before.
    """
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return salted.withColumn("_local", F.row_number().over(local) - 1).join(offsets, [*keys, "_salt"]).withColumn("_rank", F.col("_before") + F.col("_local")).drop("_salt", "_local", "_before")


def packed(sizes: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "n_tokens", window: int = 0) -> DataFrame:
    """Containers of each kind filled with the items: ``container``, ``container_no``, key, ``token_from``, ``token_to``.

    ``containers`` has ``container`` and ``capacity``; kinds are few and their capacity bounds what reaches the
    driver (one count for each length up to it). An item longer than the capacity is split into full containers
    and a rest, all others stay whole. ``token_to`` is exclusive. An item of no tokens takes no room and is put
    into container 0 with an empty range. A null size counts as 0; a null or non-positive capacity names no
    container, nor does a null name. Repeated keys are items of their own.
    """
    spark = sizes.sparkSession
    held = durable(sizes.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size")))
    kinds = containers.filter("capacity > 0 and container is not null").groupBy("container").agg(F.min("capacity").cast("long")).limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    every = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(c).cast("long").alias("_capacity")) for k, c in sorted(kinds)])
    split = F.sequence(F.lit(0).cast("long"), F.greatest((F.col("_size") - 1), F.lit(0)), F.col("_capacity"))
    if not kinds:
        every = F.expr("cast(array() as array<struct<container:string,_capacity:bigint>>)")
    pieces = held.withColumn("_kind", F.explode(every)).select("_key", "_size", "_kind.*").withColumn("_from", F.explode(split))
    pieces = pieces.withColumn("_length", F.least(F.col("_size") - F.col("_from"), F.col("_capacity")))
    empty = pieces.filter("_length = 0").select("container", F.lit(0).cast("long").alias("container_no"), F.col("_key").alias(key), F.lit(0).cast("long").alias("token_from"), F.lit(0).cast("long").alias("token_to"))
    full = pieces.filter("_length > 0")
    counts = full.groupBy("container", "_capacity", "_length").agg(F.count("*").alias("_n")).toPandas()
    tables = {}
    for (kind, capacity), own in counts.groupby(["container", "_capacity"], dropna=False):
        tables[kind] = slots(plan(dict(zip(own["_length"], own["_n"], strict=True)), int(capacity), window))
    shared = spark.sparkContext.broadcast(tables)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {k: (t["size"].to_numpy() * (1 << 40) + t["rank"].to_numpy(), t) for k, t in shared.value.items()}
        for batch in batches:
            for kind, own in batch.groupby("container", dropna=False):
                at, t = known[kind]
                k = np.searchsorted(at, own["_length"].to_numpy() * (1 << 40) + own["_rank"].to_numpy(), "right") - 1
                number = t["container"].to_numpy()[k] + own["_rank"].to_numpy() - t["rank"].to_numpy()[k]
                yield pd.DataFrame({"container": own["container"], "container_no": number, key: own["_key"], "token_from": own["_from"], "token_to": own["_from"] + own["_length"]})

    rows = ranked(full, ["container", "_length"], ["_key", "_from"], max(4, shuffle_width(spark)))
    kind_type, key_type = dict(containers.dtypes)["container"], dict(sizes.dtypes)[key]
    schema = f"container {kind_type}, container_no long, `{key}` {key_type}, token_from long, token_to long"
    return rows.select("container", "_key", "_from", "_length", "_rank").mapInPandas(place, schema).unionByName(empty)
