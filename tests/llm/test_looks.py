"""Skeletons against the Unicode library's own, ordinary forms, and groups of equal looks."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from quaver.llm import lookalike


def test_skeletons_are_those_of_the_public_table(spark):
    checker = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
    # what never shows is left out by this library, and mapped by that one
    every = [ch for ch in lookalike.prototypes() if lookalike._visible(ch) and unicodedata.category(ch) not in ("Zs", "Cf") and not lookalike.WIDTH.fullmatch(ch)]
    assert len(every) > 6000
    theirs = checker.getSkeleton("\n".join(every)).split("\n")
    assert [lookalike.skeleton(ch) for ch in every] == theirs


@pytest.mark.parametrize(("a", "b"), [("АВС", "ABC"), ("Ꮪong", "Song"), ("paypaI", "paypal"), ("rn", "m"), ("𝐇ello", "Hello"), ("ⅼ", "l"), ("ɡreat", "great"), ("Ｆｕｌｌ", "Full"), ("a​b", "ab"), ("a b", "a b"), ("é", "é")])
def test_equal_looks(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("ab", "ba"), ("é", "e"), ("Роща", "Poma"), ("", "a")])
def test_other_looks(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


@pytest.mark.parametrize(
    ("text", "plain"),
    [("Ꮪong", "Song"), ("𝐇ello", "Hello"), ("ɡreat", "great"), ("cɑt", "cat"), ("Нока (Remix)", "Нока (Remix)"), ("Рогра (Acoustic)", "Рогра (Acoustic)"), ("Işık", "Işık"), ("Ηeaνy Letter", "Heavy Letter"), ("Воrіn Polvakol", "Borin Polvakol"), ("Москвa", "Москва"), ("I am ill", "I am ill")],
)
def test_ordinary(text, plain):
    assert lookalike.ordinary(text) == plain
    assert lookalike._other(text) == (plain if plain != text else None)


def test_jvm_and_arrow_agree(spark):
    texts = [chr(o) for o in range(1, 128)] + ["rnm 10|Il", "", None, "Вand", "x" * 70_000 + "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lookalike.look(F.col("t")).alias("s"))
    assert all(r.s == (None if r.t is None else lookalike.skeleton(r.t)) for r in df.collect())


def test_groups(spark):
    df = spark.createDataFrame([(1, "АВС"), (2, "ABC"), (3, "ABC"), (4, "paypaI"), (5, "paypal"), (6, None), (7, "x")], "k int, t string")
    got = {(r.skeleton, r.spellings, r.rows) for r in lookalike.equal_looks(df, "k", ["t"]).collect()}
    assert got == {("ABC", 2, 3), ("paypal", 2, 2)}
