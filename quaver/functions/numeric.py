"""Number, hash, bit and array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, least: float, most: float) -> Column:
    """A value kept within two bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), value)))


def source_key(ip: Column, client: Column) -> Column:
    """Who a vote counts for: the hashed address where there is one, else the client."""
    return F.when(F.coalesce(F.trim(ip) != "", F.lit(False)), F.concat(F.lit("ip:"), F.substring(F.sha2(ip, 256), 1, 16))).otherwise(F.concat(F.lit("cid:"), F.coalesce(client, F.lit(""))))


def hamming(a: Column, b: Column) -> Column:
    """Number of different bits of two long values."""
    return F.bit_count(a.bitwiseXOR(b))


def average_hash(cells: Column) -> Column:
    """Bit set of the cells above the mean of up to 64 cells: bit i for cell i."""
    mean = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x) / F.size(cells)
    # powers of two are exact in a long up to bit 62; bit 63 is the sign
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    placed = F.transform(cells, lambda x, i: F.when(x > mean, bit(i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(placed, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def most_cell_change(a: Column, b: Column) -> Column:
    """Greatest absolute difference of two arrays, place by place."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def landmark(f1: Column, f2: Column, dt: Column) -> Column:
    """Two frequencies of ten bits and a distance of seven bits in one number."""
    ten, seven = F.lit(0x3FF), F.lit(0x7F)
    return f1.bitwiseAND(ten).bitwiseOR(F.shiftleft(f2.bitwiseAND(ten), 10)).bitwiseOR(F.shiftleft(dt.bitwiseAND(seven), 20))


def backoff(base: Column, step: Column) -> Column:
    """Exponential wait: base times two to the step."""
    return base * F.pow(F.lit(2.0), step)


def resume_at(now: Column, schedule: Column, step: Column) -> Column:
    """When to go on after the ``step``-th stop (from 0): the last wait of the schedule repeats."""
    return now + F.element_at(schedule, F.least(step + 1, F.size(schedule)))


def retry_after(text: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date; never below zero; null if it is neither."""
    seconds = F.coalesce(F.trim(text).try_cast("double"), (F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(text, r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))) - now).cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def duration_seconds(text: Column) -> Column:
    """Seconds of a ``Duration: H:M:S.s`` text; null where there is none."""
    part = lambda k: F.regexp_extract(text, r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", k)
    return F.when(part(1) != "", part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double"))
