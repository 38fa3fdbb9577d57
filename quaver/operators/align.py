"""Alignment of fingerprints: landmarks of peaks, matches by landmark, and the histogram of offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.functions.numeric import landmark
from quaver.session import durable

# Frames that a landmark may span, landmarks of a peak, and the gates of an alignment
SPAN, FAN, BIN = 120, 8, 3
LEAST_VOTES, LEAST_SCORE, LEAST_SHARE, RIVAL, DRIFT = 40, 50.0, 0.05, 2.5, 4
HOP, RATE = 128, 8000
LEAD_LEAST, LEAD_MOST = -30.0, 90.0


def spectral_peaks(pcm: np.ndarray, frame: int = 1024, hop: int = HOP, share: float = 0.97) -> list[tuple[int, int]]:
    """(frame, frequency bin) of the local maxima of a spectrogram, in order of time.

    A peak is the greatest value within five frames and ten bins, above its frame's ``share`` quantile and a
    thousandth of the greatest of all.
    """
    if len(pcm) < frame:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), frame)[::hop]
    power = np.abs(np.fft.rfft(windows * np.hanning(frame).astype(np.float32), axis=1))
    high = power
    for axis, reach in ((0, 5), (1, 10)):
        pad = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
        high = np.lib.stride_tricks.sliding_window_view(np.pad(high, pad, mode="edge"), 2 * reach + 1, axis=axis).max(-1)
    kept = (power == high) & (power >= np.quantile(power, share, axis=1, keepdims=True)) & (power > power.max() * 1e-3)
    return list(zip(*(x.tolist() for x in np.nonzero(kept)), strict=True))


def peaks_of(df: DataFrame, key: str, pcm: str) -> DataFrame:
    """``key``, ``t``, ``f`` of the peaks of little-endian 16-bit samples; null and short signals have none."""

    @F.pandas_udf("array<struct<t:int,f:int>>")
    def find(column: pd.Series) -> pd.Series:
        return pd.Series([[] if b is None else [{"t": t, "f": f} for t, f in spectral_peaks(np.frombuffer(b[: len(b) // 2 * 2], "<i2"))] for b in column], dtype=object)

    return df.select(key, F.explode(find(F.col(pcm))).alias("_p")).select(key, "_p.t", "_p.f")


def landmarks(peaks: DataFrame, key: str, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """``key``, ``hash``, ``t``: each peak with the next ``fan`` peaks that come 1 to ``span`` frames later.

    Peaks of one frame are one row, so that the next ``fan`` rows hold the next ``fan`` peaks: a frame never looks at
    more than those, however wide ``span`` is.
    """
    at_once = peaks.groupBy(key, "t").agg(F.sort_array(F.collect_list("f")).alias("_fs"))
    first = F.struct("t", F.slice("_fs", 1, fan).alias("fs"))
    ahead = F.collect_list(first).over(Window.partitionBy(key).orderBy("t").rowsBetween(1, fan))
    rows = at_once.withColumn("_ahead", ahead)
    later = F.flatten(F.transform(F.filter("_ahead", lambda x: x["t"] <= F.col("t") + span), lambda x: F.transform(x["fs"], lambda f: F.struct(x["t"].alias("t"), f.alias("f")))))
    pairs = rows.select(key, "t", "_fs", F.slice(later, 1, fan).alias("_later")).select(key, "t", F.explode("_fs").alias("f"), "_later").select(key, "t", "f", F.explode("_later").alias("_n"))
    return pairs.select(key, landmark(F.col("f"), F.col("_n.f"), F.col("_n.t") - F.col("t")).alias("hash"), "t")


def matches(probe: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """``pair``, ``tp``, ``delta`` of equal landmarks of two recordings with the same ``key``; all of them, as a cap changes votes."""
    a = probe.select(F.col(key).alias("pair"), "hash", F.col("t").alias("tp"))
    b = reference.select(F.col(key).alias("pair"), "hash", F.col("t").alias("tr"))
    return a.join(b, ["pair", "hash"]).select("pair", "tp", (F.col("tp") - F.col("tr")).alias("delta"))


def offsets(votes: DataFrame) -> DataFrame:
    """One row for each pair: votes of the best bin, how it stands out, its share, its rival, its lead in seconds.

    Of equal bins the smallest wins. Near votes are those within one bin of the winner.
    """
    binned = votes.withColumn("bin", F.expr(f"cast(bround(delta / {BIN}.0D) as long)"))
    return _found(binned.groupBy("pair", "bin").agg(F.count("*").alias("n"), F.sum("delta").alias("s")))


def _found(bins: DataFrame) -> DataFrame:
    """:func:`offsets` from the ``n`` votes of each bin and their sum ``s``."""
    # bins of a pair are few, and a window over them reads the matches once where a self-join would read them twice
    pair = Window.partitionBy("pair")
    over = bins.select(
        "pair", "bin", "n", "s", F.max_by("bin", F.struct("n", -F.col("bin"))).over(pair).alias("best"), F.max("n").over(pair).alias("votes"),
        F.avg("n").over(pair).alias("_mean"), F.sum("n").over(pair).alias("all_votes"),
    )
    near = F.abs(F.col("bin") - F.col("best")) <= 1
    parts = over.groupBy("pair", "best", "votes", "all_votes", "_mean").agg(
        F.sum(F.when(near, F.col("n")).otherwise(0)).alias("near"), F.coalesce(F.max(F.when(~near, F.col("n"))), F.lit(0)).alias("rival"), F.sum(F.when(near, F.col("s"))).alias("_s")
    )
    return parts.select(
        "pair", "best", "votes", "all_votes", (F.col("votes") / F.col("_mean")).alias("score"), (F.col("near") / F.col("all_votes")).alias("share"),
        "rival", (F.col("_s") / F.col("near") * HOP / RATE).alias("lead"),
    )


def drifts(votes: DataFrame, found: DataFrame, least: int = LEAST_VOTES) -> DataFrame:
    """``pair`` and whether one half of its matched span has a best bin of its own, far from the pair's."""
    binned = votes.withColumn("bin", F.expr(f"cast(bround(delta / {BIN}.0D) as long)")).join(found.select("pair", "best"), "pair")
    ends = binned.filter("abs(bin - best) <= 1").groupBy("pair").agg(((F.min("tp") + F.max("tp")) / 2).alias("_mid"))
    halves = binned.join(ends, "pair").groupBy("pair", "best", (F.col("tp") < F.col("_mid")).alias("_early"), "bin").agg(F.count("*").alias("n"))
    return _drift(halves, least)


def _drift(halves: DataFrame, least: int) -> DataFrame:
    top = halves.groupBy("pair", "best", "_early").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("_bin"), F.max("n").alias("_n"))
    return top.groupBy("pair").agg(F.max((F.col("_n") >= least) & (F.abs(F.col("_bin") - F.col("best")) > DRIFT)).alias("drift"))


def aligned(votes: DataFrame, least: int = LEAST_VOTES, score: float = LEAST_SCORE, share: float = LEAST_SHARE) -> DataFrame:
    """Pairs that pass every gate, with the start in milliseconds and a confidence in 0..1."""
    found = offsets(votes)
    return _steady(_passing(found, least, score, share), drifts(votes, found, least))


def _passing(found: DataFrame, least: int, score: float, share: float) -> DataFrame:
    return found.filter((F.col("votes") >= least) & (F.col("score") >= score) & (F.col("share") >= share) & (F.col("rival") * RIVAL <= F.col("votes")) & F.col("lead").between(LEAD_LEAST, LEAD_MOST))


def _steady(ok: DataFrame, drift: DataFrame) -> DataFrame:
    steady = ok.join(drift, "pair", "left").filter(~F.coalesce("drift", F.lit(False)))
    return steady.select("pair", (-F.bround(F.col("lead") * 1000)).cast("long").alias("start_ms"), F.least(F.lit(1.0), F.col("share") / 0.25).alias("confidence"), "votes")


def times(marks: DataFrame, key: str) -> DataFrame:
    """``key``, ``hash`` and ``ts``, all times of a landmark in one list: as many numbers as landmarks, and no row for a match."""
    return marks.groupBy(key, "hash").agg(F.collect_list("t").alias("ts"))


def differences(tps: list[np.ndarray], trs: list[np.ndarray], before: float | None = None, most: int = 1 << 21, long: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each difference of a time of a list of ``tps`` (``before`` a time) and one of its partner in ``trs`` with how often it occurs.

    About ``most`` are at hand at once, so that one may come again. Lists of a product of ``long`` are taken one by one, shorter ones together.
    """
    sizes = np.array([len(r) for r in trs])
    owner = np.repeat(np.arange(len(tps)), [len(p) for p in tps])
    p, r = np.concatenate(tps).astype(np.int64), np.concatenate(trs).astype(np.int64)
    if before is not None:
        owner, p = owner[p < before], p[p < before]
    starts = np.cumsum(sizes) - sizes
    products = np.bincount(owner, minlength=len(tps)) * sizes
    ends = np.searchsorted(owner, np.arange(len(tps)), "right")
    for k in np.flatnonzero(products >= long):
        mine, theirs = p[ends[k - 1] if k else 0 : ends[k]], r[starts[k] : starts[k] + sizes[k]]
        for at in range(0, len(mine), step := max(1, most // len(theirs))):
            yield _counted(np.subtract.outer(mine[at : at + step], theirs).ravel())
    few = products[owner] < long
    p, owner = p[few], owner[few]
    each = sizes[owner]
    total = np.cumsum(each)
    at = 0
    while at < len(p):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = each[at:end]
        place = np.arange(n.sum()) + np.repeat(starts[owner[at:end]] - (np.cumsum(n) - n), n)
        if len(place):
            yield _counted(np.repeat(p[at:end], n) - r[place])
        at = end


def _counted(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = d.min()
    if d.max() - low > max(1 << 16, 4 * len(d)):
        return np.unique(d, return_counts=True)
    n = np.bincount(d - low)
    held = np.flatnonzero(n)
    return held + low, n[held]


def _binned(lists: DataFrame, until: str | None = None) -> DataFrame:
    """``pair``, ``bin``, ``n``, ``s`` of all matches of ``tp`` and ``tr``, or of those whose ``tp`` is before ``until``; matches are counted where their lists are and never become rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair, rows in batch.groupby("pair", sort=False):
                kept: list[tuple[np.ndarray, np.ndarray]] = []
                held = 0
                for d, n in differences(rows["tp"].tolist(), rows["tr"].tolist(), float(rows[until].iloc[0]) if until else None):
                    kept.append((d, n))
                    held += len(d)
                    if held > 1 << 22:
                        kept = [_summed(kept)]
                        held = len(kept[0][0])
                if kept:
                    d, n = _summed(kept)
                    yield pd.DataFrame({"pair": pair, "bin": np.rint(d / BIN).astype(np.int64), "n": n, "s": d * n}).groupby(["pair", "bin"], as_index=False).sum()

    kind = lists.schema["pair"].dataType.simpleString()
    parts = lists.select("pair", "tp", "tr", *([until] if until else [])).mapInPandas(count, f"pair {kind}, bin bigint, n bigint, s bigint")
    return parts.groupBy("pair", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    d, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    n = np.zeros(len(d), dtype=np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return d, n


@F.pandas_udf(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
def _near_span(tp: pd.Series, tr: pd.Series, best: pd.Series) -> pd.DataFrame:
    """First and last of the times ``tp`` that have a match within one bin of the best."""
    out: list[tuple[int | None, int | None]] = []
    for p, r, b in zip(tp, tr, best, strict=True):
        p, r = np.asarray(p, dtype=np.int64), np.sort(np.asarray(r, dtype=np.int64))
        low, high = BIN * (b - 1) - BIN // 2, BIN * (b + 1) + BIN // 2
        near = p[np.searchsorted(r, p - high, "left") < np.searchsorted(r, p - low, "right")]
        out.append((int(near.min()), int(near.max())) if len(near) else (None, None))
    return pd.DataFrame(out, columns=["lo", "hi"]).astype("Int64")


def aligned_lists(lists: DataFrame, least: int = LEAST_VOTES, score: float = LEAST_SCORE, share: float = LEAST_SHARE) -> DataFrame:
    """:func:`aligned` for ``pair``, ``tp`` and ``tr``: both recordings' times of a landmark, each as a list.

    Matches are as many as products of the lists' lengths, so they are counted into bins where they arise; what is
    sent on are bins. One half's bins are those of all less those of the other.
    """
    bins = durable(_binned(lists))
    ok = durable(_passing(_found(bins), least, score, share))
    near = lists.join(ok.select("pair", "best"), "pair").select("pair", "tp", "tr", "best", _near_span("tp", "tr", "best").alias("_e"))
    ends = ok.select("pair", "best").join(near.groupBy("pair").agg(((F.min("_e.lo") + F.max("_e.hi")) / 2).alias("_mid")), "pair")
    early = durable(_binned(lists.join(ends.select("pair", "_mid"), "pair"), "_mid").select("pair", "bin", F.col("n").alias("_n")))
    both = bins.select("pair", "bin", "n").join(ok.select("pair", "best"), "pair").join(early, ["pair", "bin"], "left")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("_early"), F.coalesce("_n", F.lit(0)).alias("n")), F.struct(F.lit(False).alias("_early"), (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"))))
    halves = both.select("pair", "best", "bin", sides.alias("_h")).select("pair", "best", "bin", "_h._early", "_h.n").filter("n > 0")
    return _steady(ok, _drift(halves, least))
