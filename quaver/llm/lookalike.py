"""Visually identical text with different characters: skeletons, ordinary forms and groups of equal looks.

A *skeleton* is that of the public look-alike table (Unicode Technical Standard 39): the text is decomposed,
every character is replaced by the prototype of its class, and the result is decomposed again. Texts look
alike where their skeletons are equal, ``paypaI`` and ``paypal`` as well as Cyrillic and Latin capitals.

The *ordinary form* is the member of a text's skeleton class that a person would have typed: look-alikes become
letters of the script of their word, full-width and styled forms become ordinary ones, exotic blanks become
plain ones, invisible characters go. Tabs, repeated blanks, typographic quotes and dashes are ordinary text
and stay, as do letters that only look alike inside one script (``I`` and ``l``). The *plain form* is the
ordinary form with compatibility characters made one, for comparing what texts say.

The table is read from the Unicode library that comes with Spark (``icu4j``), in any worker.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from functools import lru_cache

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE = "com/ibm/icu/impl/data/icudata/confusables.cfu"


@lru_cache(maxsize=1)
def prototypes() -> dict[str, str]:
    """The public look-alike table: each character that isn't its own prototype, and the prototype (may be empty).

    The file has a header of its own length, then the places and sizes of three parts: keys (code point in 24 bits,
    length of the prototype less one in 8), values (the prototype itself or where it begins), and UTF-16 text.
    """
    homes = [os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", "")]
    jars = [j for home in homes if home for j in sorted(glob.glob(os.path.join(home, "jars", "icu4j-*.jar")))]
    if not jars:
        raise FileNotFoundError(f"no icu4j jar with the look-alike table below any of {homes}")
    with zipfile.ZipFile(jars[0]) as jar:
        whole = jar.read(TABLE)
    data = whole[struct.unpack(">H", whole[:2])[0] :]
    keys_at, n_keys, values_at, n_values, text_at = struct.unpack(">5i", data[12:32])
    keys, values = struct.unpack(f">{n_keys}I", data[keys_at : keys_at + 4 * n_keys]), struct.unpack(f">{n_values}H", data[values_at : values_at + 2 * n_values])
    out = {}
    for key, value in zip(keys, values, strict=True):
        size, at = (key >> 24) + 1, text_at + 2 * value
        out[chr(key & 0xFFFFFF)] = chr(value) if size == 1 else data[at : at + 2 * size].decode("utf-16-be")
    return out


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    """The same for ``str.translate``."""
    return {ord(k): v for k, v in prototypes().items()}


#: Characters that never show: default-ignorable code points outside the format category.
IGNORABLE = "͏ᅟᅠ឴឵ㅤﾠ"

CLEAN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ıĴ-ſ‐-―‘-‟…]*")
WIDTH = re.compile(r"[ﬀ-ﬆ！-￯]+")
WORD = re.compile(r"[^\W_]+(?:[̀-゙゚ͯ]+[^\W_]*)*")

# Where the letters lie that people type in each script whose letters have look-alikes
TYPED = {"LATIN": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x137), (0x139, 0x17F), (0x218, 0x21B), (0x1E00, 0x1EFF)], "CYRILLIC": [(0x400, 0x45F), (0x490, 0x491)], "GREEK": [(0x386, 0x3CE)], "ARMENIAN": [(0x531, 0x556), (0x561, 0x586)]}


@lru_cache(maxsize=100_000)
def script(ch: str) -> str:
    """Script of a letter by its Unicode name; empty for what is no letter. Styled letters have the name of their style."""
    return unicodedata.name(ch, "").split(" ", 1)[0].split("-", 1)[0] if ch.isalpha() else ""


@lru_cache(maxsize=100_000)
def typed(ch: str) -> bool:
    """Whether a character is one that people type: any letter of a script without a list above, no styled one."""
    o, where = ord(ch), TYPED.get(script(ch))
    if where is not None:
        return any(lo <= o <= hi for lo, hi in where)
    return unicodedata.normalize("NFKC", ch) == ch


@lru_cache(maxsize=100_000)
def prototype(ch: str) -> str:
    """Prototype of one character, decomposed."""
    return unicodedata.normalize("NFD", prototypes().get(ch, ch))


@lru_cache(maxsize=1)
def _classes() -> dict[tuple[str, str, str], str]:
    """Prototype, script and category (capital or small letter) to the letter that people type for it."""
    out: dict[tuple[str, str, str], str] = {}
    for name, where in TYPED.items():
        for ch in (chr(o) for lo, hi in where for o in range(lo, hi + 1)):
            if script(ch) == name and len(unicodedata.normalize("NFD", ch)) == 1:
                out.setdefault((prototype(ch), name, unicodedata.category(ch)), ch)
    return out


@lru_cache(maxsize=100_000)
def as_in(ch: str, name: str) -> str:
    """The letter of script ``name`` that looks like ``ch``; ``ch`` itself where there is none."""
    look, style = prototype(ch), unicodedata.normalize("NFKC", ch)
    if len(style) == 1 and style != ch and script(style) == name and prototype(style) == look:
        return style
    found = _classes().get((look, name, unicodedata.category(ch)))
    if found is None and unicodedata.category(ch) not in ("Lu", "Ll") and len(look) == 1 and script(look) == name:
        found = look
    return found or ch


def _visible(text: str) -> str:
    """``text`` without what never shows; joiners stay where emoji or joining scripts need them."""
    out = []
    for i, ch in enumerate(text):
        if ch in IGNORABLE or unicodedata.category(ch) == "Cf" or "︀" <= ch <= "️":
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            if ch in "‌‍️" and before and _joins(before) and (ch == "️" or after and _joins(after)):
                out.append(ch)
            continue
        out.append(ch)
    return "".join(out)


def _joins(ch: str) -> bool:
    """Whether a joiner beside ``ch`` has a meaning: symbols, and the joining scripts."""
    o = ord(ch)
    return unicodedata.category(ch) in ("So", "Sk") or ch == "️" or 0x600 <= o < 0x900 or 0x900 <= o < 0xE00 or 0x1F000 <= o


@lru_cache(maxsize=100_000)
def _shared(ch: str, name: str) -> bool:
    """Whether a letter looks like one that people type in script ``name``; a small letter must do so as a capital too.

    The table also holds looser pairs of small letters, whose capitals differ; such letters prove their script.
    """
    other = as_in(ch, name)
    return other != ch and (unicodedata.category(ch) != "Ll" or as_in(ch.upper(), name) == other.upper())


def _scripts(word: str) -> tuple[dict[str, int], set[str]]:
    """Letters of each script in a decomposed word, and the scripts that a letter proves.

    A letter proves its script where it looks like none of the word's other scripts; in a word of one script other
    than Latin, like no Latin letter.
    """
    has: dict[str, int] = {}
    for ch in word:
        if name := script(ch):
            has[name] = has.get(name, 0) + 1
    others = set(has) if len(has) > 1 else {"LATIN"}
    sure = {script(ch) for ch in word if script(ch) and typed(ch) and not any(_shared(ch, name) for name in others & set(TYPED) - {script(ch)})}
    return has, sure


def _word(word: str, field: set[str]) -> str:
    """A decomposed word in letters of one script; ``field``: scripts that the field has for sure."""
    has, sure = _scripts(word)
    if not has:
        return word
    known = {name for name in has if name in TYPED}
    if len(has) == 1 and known:
        if known == {"LATIN"}:
            return "".join(ch if typed(ch) else as_in(ch, "LATIN") for ch in word)
        if not sure and "LATIN" in field and not (known & field):
            return "".join(as_in(ch, "LATIN") if script(ch) else ch for ch in word)
        return word
    # the script that a letter proves, Latin among several; else one that the field has, else the one with most letters
    proved = sure & known
    to = max(proved or known or {"LATIN"}, key=lambda name: (name == "LATIN" if proved else name in field, has.get(name, 0), name == "LATIN", name))
    return "".join(as_in(ch, to) if script(ch) not in ("", to) or not typed(ch) else ch for ch in word)


@lru_cache(maxsize=200_000)
def ordinary(text: str) -> str:
    """The text as it would be typed with ordinary characters; equal to ``text`` if that is ordinary already."""
    if CLEAN.fullmatch(text):
        return text
    plain = _spaced(text)
    words = [_scripts(m[0]) for m in WORD.finditer(plain)]
    field = {name for has, sure in words for name in (sure if len(has) > 1 or sure or "LATIN" not in has else has)}
    return unicodedata.normalize("NFC", WORD.sub(lambda m: _word(m[0], field), plain))


def _spaced(text: str) -> str:
    """``text`` decomposed, with plain blanks and ordinary width, and without what never shows."""
    plain = "".join(" " if unicodedata.category(ch) == "Zs" else ch for ch in _visible(text))
    return unicodedata.normalize("NFD", WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m[0]), plain))


@lru_cache(maxsize=200_000)
def skeleton(text: str) -> str:
    """What the text looks like: decomposed, every character replaced by its prototype, decomposed again."""
    return unicodedata.normalize("NFD", (text if text.isascii() else _spaced(text)).translate(_table()))


@lru_cache(maxsize=200_000)
def plain_form(text: str) -> str:
    """The ordinary form with compatibility characters made one."""
    plain = ordinary(text)
    if plain.isascii():
        return plain
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", plain))


@lru_cache(maxsize=200_000)
def letters(text: str) -> str:
    """Letters, digits and their accents of the plain form, without case: the key of equal entries."""
    plain = plain_form(text)
    if plain.isascii():
        return "".join(filter(str.isalnum, plain)).lower()
    plain = unicodedata.normalize("NFC", plain.casefold())
    return "".join(ch for ch in plain if ch.isalnum() or unicodedata.category(ch) == "Mn")


def _over(function, value: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else function(x) for x in value], dtype=object)


def _other(text: str) -> str | None:
    """The ordinary member of a text's skeleton class, where that is another text."""
    plain = ordinary(text)
    return plain if plain != text and skeleton(plain) == skeleton(text) else None


@F.pandas_udf(T.StringType())
def looked_through(value: pd.Series) -> pd.Series:
    """Arrow form: the ordinary text that looks like this one; null where this one is ordinary itself."""
    return _over(_other, value)


@F.pandas_udf(T.StringType())
def skeleton_of(value: pd.Series) -> pd.Series:
    """Arrow form of :func:`skeleton`; null stays null."""
    return _over(skeleton, value)


@F.pandas_udf(T.StringType())
def letters_of(value: pd.Series) -> pd.Series:
    """Arrow form of :func:`letters`; null stays null."""
    return _over(letters, value)


def _fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each row and field that holds a text: ``key``, ``field``, ``text``."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return df.select(F.col(key).alias(key), F.explode(each).alias("_x")).select(key, "_x.field", "_x.text").filter("text is not null")


def look(text: Column) -> Column:
    """Skeleton of a text column. That of plain ASCII is made inside the JVM; only other text goes through Arrow."""
    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    own = {k: v for k, v in prototypes().items() if k.isascii()}
    short = sorted(k for k, v in own.items() if len(v) == 1)
    made = F.translate(text, "".join(short), "".join(own[k] for k in short))
    for k in sorted(set(own) - set(short)):
        made = F.replace(made, F.lit(k), F.lit(own[k]))
    return F.when(ascii_only, made).otherwise(skeleton_of(F.when(~ascii_only, text)))


def unusual_text(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields whose text looks ordinary but holds other characters: ``key``, ``field``, ``text``, ``ordinary``.

    A text is one where the ordinary member of its skeleton class is another text. A scan and a projection, no
    shuffle. Null and blank fields give no row; a text of invisible characters only has the empty ordinary form
    and is a row. Rows with the same key stay apart. Columns other than those named are not read, so their names
    cannot clash.
    """
    # plain ASCII is decided inside the JVM; only the rest goes through Arrow
    odd = _fields(df, key, fields).filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    return odd.withColumn("ordinary", looked_through("text")).filter("ordinary is not null")


def equal_looks(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Groups of different texts with one skeleton: ``field``, ``skeleton``, ``spellings``, ``rows``.

    Counts are combined before the shuffle, first by text, then by skeleton; no group is collected.
    """
    texts = _fields(df, key, fields).groupBy("field", "text").agg(F.count("*").alias("n"))
    return (
        texts.withColumn("skeleton", look(F.col("text")))
        .groupBy("field", "skeleton")
        .agg(F.count("*").alias("spellings"), F.sum("n").alias("rows"))
        .filter("spellings > 1")
    )


# the planner may not put a copy of these into a filter beside the one in a projection
looked_through, skeleton_of, letters_of = (f.asNondeterministic() for f in (looked_through, skeleton_of, letters_of))


def has_letters(column: Column) -> Column:
    """Whether a key made by :func:`letters` holds anything; null holds nothing."""
    return F.coalesce(F.length(column) > 0, F.lit(False))
