"""Queries of the training-data operators over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import best_copy, linkage, lookalike, packing, personal, same_entry, spellings, tokens, top_items
from quaver.llm.oracles import ORACLES
from quaver.session import table, wide_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_entry.same_entry_pairs(wide_table(spark, folder, "charts"), "chart_hash", "artist", "title")


def p1_entries(spark: SparkSession, folder: str) -> DataFrame:
    return same_entry.canonical_entries(wide_table(spark, folder, "charts"), "chart_hash", "artist", "title")


def p2_matches(spark: SparkSession, folder: str) -> DataFrame:
    ini, records = (wide_table(spark, folder, t) for t in ("ini_fields", "records"))
    groups, nicknames = (table(spark, folder, t) for t in ("dupgroups", "nicknames"))
    return linkage.matched(ini, records, groups, nicknames)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_matches(spark, folder).select("folder", "record_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return best_copy.best_fields(table(spark, folder, "dupgroups"), table(spark, folder, "ini_fields"))


def p3_agreed(spark: SparkSession, folder: str) -> DataFrame:
    return best_copy.agreed_fields(table(spark, folder, "dupgroups"), table(spark, folder, "ini_fields"))


def p3_majority(spark: SparkSession, folder: str) -> DataFrame:
    return best_copy.majority_fields(table(spark, folder, "dupgroups"), table(spark, folder, "ini_fields"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_items.best_videos(table(spark, folder, "mappings"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.unusual_text(table(spark, folder, "charts"), "chart_hash", ["artist", "title"]).select("chart_hash", "field")


def p5_looks(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.equal_looks(table(spark, folder, "charts"), "chart_hash", ["artist", "title"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.spelling_pairs(wide_table(spark, folder, "charts"), table(spark, folder, "nicknames"))


def p6_acts(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling with the act it names and how many spellings the act has."""
    classes = spellings.spelling_classes(spellings.acts_only(wide_table(spark, folder, "charts"), "chart_hash", "artist", "title"), "artist", table(spark, folder, "nicknames"))
    sizes = classes.groupBy("act").agg(F.count("*").alias("spellings"))
    return classes.join(sizes, "act").select("artist", "act", "spellings")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(wide_table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.token_counts(wide_table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")
    return packing.packed(sizes, table(spark, folder, "containers"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_values(wide_table(spark, folder, "documents"))


def p9_masked(spark: SparkSession, folder: str) -> DataFrame:
    return personal.masked(wide_table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    """Every training-data query by its name."""
    own = [p1_found, p1_entries, p2_found, p2_matches, p3_found, p3_agreed, p3_majority, p4_found, p5_found, p5_looks, p6_found, p6_acts, p7_ids, p8_packed, p9_found, p9_masked]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express."""
    return dict(ORACLES)
