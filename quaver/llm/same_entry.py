"""Duplicates hidden by formatting differences.

Two fields are canonicalized (look-alike characters, case, white space, punctuation), put in one order, and
hashed to 128 bits; copies are counted by hash with map-side combining. Every hash carries the least and the
greatest canonical text it stands for: where they differ the hash has collided, and those groups alone are
keyed by the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.lookalike import has_letters, letters_of
from quaver.session import durable

SEP = "\u001f"


def keyed(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Rows with letters or digits in both fields: ``key``, ``first``, ``second``, ``_text``, ``_hash``."""
    fields = df.select(F.col(key).alias("_key"), F.col(first).alias("_a"), F.col(second).alias("_b"))
    fields = fields.select("*", letters_of("_a").alias("_ka"), letters_of("_b").alias("_kb"))
    fields = fields.filter(has_letters(F.col("_ka")) & has_letters(F.col("_kb")))
    text = F.concat_ws(SEP, F.array_sort(F.array("_ka", "_kb")))
    return fields.withColumn("_text", text).withColumn("_hash", F.unhex(F.md5(text)))


def canonical_entries(df: DataFrame, key: str, first: str, second: str, digest: str = "_hash") -> DataFrame:
    """One row for each entry: ``entry`` (hex), a sample ``first`` and ``second``, ``copies`` (number of rows).

    The kept row is the one with the smallest ``key`` (byte order; null last). Rows without a letter or digit
    in either field belong to no entry. Partial counts shrink a hot entry to one row per task before the
    shuffle. ``digest`` names the hash column, which tests replace by a weak one to force collisions.
    """
    rows = keyed(df, key, first, second).withColumn("_digest", F.expr(digest))
    kept = F.min(F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_a").alias("a"), F.col("_b").alias("b")))
    counted = rows.groupBy("_digest").agg(kept.alias("_kept"), F.count("*").alias("copies"), F.min("_text").alias("_least"), F.max("_text").alias("_most"))
    clean = counted.filter("_least = _most").select(F.hex("_digest").alias("entry"), "_kept", "copies")
    collided = counted.filter("_least <> _most").select("_digest")
    apart = (
        rows.join(collided, "_digest", "left_semi")
        .groupBy("_text")
        .agg(kept.alias("_kept"), F.count("*").alias("copies"))
        .select(F.concat(F.upper(F.md5("_text")), F.upper(F.sha2("_text", 256))).alias("entry"), "_kept", "copies")
    )
    both = clean.unionByName(apart)
    return both.select("entry", F.col("_kept.k").alias(key), F.col("_kept.a").alias(first), F.col("_kept.b").alias(second), "copies")


def same_entry_pairs(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """All pairs of rows of one entry: ``hash_a`` < ``hash_b``, the keys of the two rows.

    Keys are those of one row; rows repeated as a whole count once, and keys whose rows stand for several entries give a
    pair for each entry that they share. The result is quadratic in the copies of an entry by its definition. The join is an equi-join on 128 bits
    that adaptive execution splits where an entry is hot; entries of one row are dropped by their count first,
    so that only duplicates are shuffled for it, and the text is compared after the hash.
    """
    # kept once, as both sides of the join and the counts read it
    # repeated rows of a key go before the join, which makes pairs, not after it
    rows = durable(keyed(df, key, first, second).select("_key", "_text", "_hash").filter("_key is not null").dropDuplicates(["_key", "_text"]))
    several = rows.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash")
    held = rows.join(several, "_hash", "left_semi")
    other = held.select(F.col("_key").alias("hash_b"), F.col("_text").alias("_other"), "_hash")
    pairs = held.withColumnRenamed("_key", "hash_a").join(other, "_hash").filter("hash_a < hash_b and _text = _other")
    return pairs.select("hash_a", "hash_b")
