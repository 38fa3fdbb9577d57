"""Reading the name of an act: its parts in one order, whatever the layout.

A name is read as a kind (the word for the sort of group, if it has one), a given name and a surname; both
``Surname, Given`` and ``Given Surname`` read alike, as do ``X and the Ys`` and ``The Ys and X``.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from quaver.llm.lookalike import letters, plain_form

# Words for sorts of groups, and short forms that their letters alone don't give away
KINDS = ("band", "brothers", "choir", "collective", "duo", "ensemble", "orchestra", "project", "quartet", "quintet", "sisters", "trio")
SHORT = {"4tet": "quartet", "qrt": "quartet", "qtet": "quartet", "5tet": "quintet", "srs": "sisters", "prj": "project", "bros": "brothers"}

TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*|[&+]")
NICK = re.compile(r"^(\S*\w\S*)\s+[\"“”'‘’(\[]\s*(\w[\w.]*)\s*[\"“”'‘’)\]]\s+(\S.*)$")
AND = {"and", "&", "+", "n", "und", "et", "y"}


class Act(NamedTuple):
    """A name as it was read; ``core`` has its letters in one order, ``swapped`` with the two names exchanged."""

    flat: str
    kind: str
    given: str
    surname: str
    core: str
    swapped: str
    words: int


@lru_cache(maxsize=50_000)
def kind_of(token: str) -> str:
    """The word for a sort of group that a token stands for, in full, short or with one slip; else empty."""
    if token in KINDS:
        return token
    if token in SHORT:
        return SHORT[token]
    for kind in KINDS:
        if len(token) >= 3 and token[0] == kind[0] and len(kind) >= 6:
            if kind.startswith(token):
                return kind
            rest = iter(kind)
            if len(token) >= 3 and all(ch in rest for ch in token) and not set(token[1:]) & set("aeiou"):
                return kind
        if len(kind) >= 6 and abs(len(token) - len(kind)) <= 1 and one_slip(token, kind):
            return kind
    return "ensemble" if token == "ensmbl" else ""


def one_slip(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours at most turns ``a`` into ``b``."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def without_accents(text: str) -> str:
    """``text`` without the accents of its letters; marks of other scripts stay."""
    if text.isascii():
        return text
    plain = re.sub("[\u0300-\u036f]+", "", unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", plain).replace("ø", "o").replace("ß", "ss")


def _is_the(tokens: list[str]) -> bool:
    return len(tokens) > 1 and (tokens[0] in ("the", "th", "teh", "hte") or len(tokens) > 2 and len(tokens[0]) in (3, 4) and one_slip(tokens[0], "the"))


@lru_cache(maxsize=200_000)
def read_act(text: str) -> Act:
    """The parts of a name. Text without letters gives an act of empty parts."""
    plain = " ".join(without_accents(plain_form(text).casefold()).replace("_", " ").split())
    flat = letters(text)
    bare = plain.strip(" .,;:?!-–—\"'“”‘’[](){}")
    nick = NICK.match(bare)
    if nick and nick[2] != "n":
        bare = f"{nick[1]} {nick[3]}"
    # "surname, given" and "names, the"
    left, comma, right = bare.partition(",")
    if comma and left.strip() and any(map(str.isalnum, right)) and any(map(str.isalnum, left)) and not right.strip(" .-").isdigit():
        bare = f"{right} {left}"
    tokens = TOKEN.findall(bare)
    if not tokens:
        return Act(flat, "", "", "", flat, flat, 0)
    words = len(tokens)
    led = _is_the(tokens)
    tokens = tokens[led:]
    middle = next((k for k in range(1, len(tokens) - 1) if tokens[k] in AND), 0)
    if middle:
        a, b = tokens[:middle], tokens[middle + 1 :]
        followed = len(b) > 1 and one_slip(b[0], "the")
        parts = ["".join(a), "".join(b[followed:])]
        if led and not followed:
            parts = parts[::-1]
        elif led == followed:
            by_end = parts[0].endswith("s") != parts[1].endswith("s")
            parts.sort(key=lambda p: (by_end and p.endswith("s"), p))
        return Act(flat, "and", parts[0], parts[1], "".join(parts), "".join(parts[::-1]), words)
    kind = ""
    if len(tokens) >= 3:
        for at in (-1, 0):
            if kind := kind_of(tokens[at]):
                tokens = tokens[:-1] if at else tokens[1:]
                break
    if len(tokens) > 2:
        tokens = [t for k, t in enumerate(tokens) if len(t) > 1 or k in (0, len(tokens) - 1)]
    if len(tokens) == 2 and len(tokens[1]) == 1 < len(tokens[0]):
        tokens = tokens[::-1]
    for known in KINDS:
        # a name typed without blanks
        if not kind and len(known) >= 6 and tokens[-1].endswith(known) and len(tokens[-1]) > len(known) + 3:
            tokens, kind = [*tokens[:-1], tokens[-1][: -len(known)]], known
    if len(tokens) == 1:
        core = tokens[0]
        core = core[3:] if core.startswith("the") and len(core) > 12 else core
        return Act(flat, kind, "", core, core, core, words)
    given, surname = tokens[0], "".join(tokens[1:])
    return Act(flat, kind, given, surname, given + surname, surname + given, words)
