"""Personal information inside free text: candidate spans, weak labelers, and a classifier trained from them.

General grammars propose spans: addresses of mail, digit groups that may be a phone or identity number, street
addresses by their words for ways in several languages, and every pair of words that is written like a name.
Labelers (format, list of given names, words before and behind, other personal pieces beside it, agreement with
addresses of mail) vote for, against or not at all. Three more labelers come from the whole corpus: how often the
spans with the same given name are vouched for by their context, and how often those in the same context, before
or behind, are vouched for by their given name. Expectation-maximisation over the counts of vote patterns estimates how each labeler
votes on real and on other spans, without any labelled text; a logistic span classifier is then trained on a
bounded sample of spans with the estimated probabilities as targets, and decides all spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.session import durable

KINDS = ("email", "phone", "id_number", "address", "name")
LABELERS = ("format", "gazetteer", "before", "behind", "beside", "echo", "against", "given", "around", "ahead")
#: Labelers that look at one text; the others count over all.
LOCAL_LABELERS = 7

# Common given names, without accents
GIVEN = frozenset(
    """
    adam agnes aiko alexander alice alvaro amelie amina ana andre andrea andres anna antonio astrid beatriz berenice
    boris bruno carla carlos carmen caroline cecile celine charlotte chloe christian claire clara claudia colin daniel
    darius david dennis diana diego dimitri dominik edith elena elias elisa emeka emil emily emma eric esther eva
    fabian farah fatima felix fiona florian francois frank gabriel george gisela giulia goran gordon grace gustav hannah
    hans harald hassan helena henrik hilde hiro hugo ida imani ines ingrid irene isabel ivan ivana jan jana jarek jasmin
    joel john jonas jorge jose josef juan julia julien jurgen karin karl katrin kenji kirsten klara kwame laura lea leila lena
    leon linda louis lucia luis luisa magda manuel marcus maria marie mario markus marta martin mateo matteo max
    mia michael miguel mireille mohammed monica nadia nicolas niklas nina noor olga olivia omar oscar owen pablo paula
    pedro peter petra pilar priya quentin rajesh rita robert rosa ruth samuel sandra sanna sara simon siobhan sofia sophie
    stefan steffen susanne sven svetlana tariq teresa thomas tilda tomas ursula uwe valerie vera victor viktor walter
    wanda wendy wilma xavier ximena yasmin yusuf yvonne zeynep zoe
    """.split()
)

# Words of several languages after which a person is named, without accents
TITLES = "mr mrs ms miss dr prof sir herr frau sr sra senor senora monsieur madame mme signor signora"
GREETINGS = "hi hello hey dear hallo liebe lieber hola querido querida estimado bonjour salut cher chere ciao caro olá привет здравствуйте"
CLOSINGS = "regards sincerely yours cheers best thanks again signed gruße gruß grußen grusse gruss grussen saludo saludos abrazo cordialement amicalement bisous saluti уважением"
ROLES = "name user owner holder contact organiser organizer drummer guitarist singer bassist driver landlord author witness witnesses attn recipient sender from reply mods admin note dad mom mum mother father brother sister wife husband son daughter friend neighbour neighbor colleague teacher boss"
VERBS = "ask asked call phone text meet met meeting tell told visit invite with see heiße heisse bin llamo soy appelle suis зовут спросите according laut selon segun preguntad pregunta demandez rückfragen ruckfragen"
LINKS = frozenset(f"{TITLES} {GREETINGS} {CLOSINGS} {ROLES} {VERBS}".split()) - {"user"}
#: Two words before a name, where the last alone says little.
PAIRS = frozenset("i am|name is|this is|holder is|my name|ruckfragen an|according to|registered to|invoice to|goes to|deliver to|c o|nombre de|nom de|d apres|lieu chez|ist bei|thanks again|and i".split("|"))
BEHIND = frozenset("wrote writes says said lives lived moved works worked called phoned asked told schrieb wohnt sagt escribio dijo vive ecrit habite".split())
#: Those after which a name in small letters is looked for.
STATED = regex.compile(r"(?i)(?<![^\W\d_])(?:(?:llamo|appelle|heiße|heisse|зовут|name is|i am|according to|holder is|laut|selon|según|owner|drummer|organi[sz]er)\s{1,2}|(?:contact|regards|signed|owner|reply-to|user)\W*[:,]\W{0,3}|担当は|名前は)")
SUFFIXES = ("さん", "様", "氏", "先生")
ENDINGS_BEFORE = ("担当は", "名前は", "連絡先は")

# What says that the words are a work, an act or a handle
WORKS = frozenset("charted charting chart charter prints artist title song album band video match scan track".split())
#: Words that begin no name: articles, pronouns, prepositions and the like.
FUNCTION = frozenset(
    """
    the a an this that these those no not my our your his her their its it he she we they you i is was are were be been has have had will would can in on at of for from with without and or but
    if when while who what where why how all any some every each only just also el los las un una unos unas mi tu su por para con sin en de del y o no que
    der die das den dem des ein eine einen mein meine meiner dein deine sein seine ihr ihre unser unsere und oder aber mit von bei nach auf im am zu le les du une mon ton son ma ta sa mes tes ses nous vous et ou mais
    avec pour dans sur à au aux il lo gli uno dei del di da per che как на по из для это мой
    monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag
    lunes martes miércoles jueves viernes sábado domingo lundi mardi mercredi jeudi vendredi samedi dimanche
    """.split()
)
ACTS = regex.compile(r"(?i)^\s*(?:orchestra|ensemble|quartet|quintet|trio|duo|project|collective|brothers|sisters|band|choir|and the|& the)\b")
KEY_LINE = regex.compile(r"(?i)(?:^|\n)[ \t;#>]*(?:artist|name|title|album|charter|genre)\s*=\s*\"?$")
LOW = str.maketrans("äáàâãåçéèêëíìîïñóòôöõøúùûüýğşıžœ", "aaaaaaceeeeiiiinoooooouuuuygsizo")

M = r"[\p{L}\p{M}]"
# letters of scripts that have capitals
C = r"[\p{Lu}\p{Ll}\p{M}]"
WORD = rf"\p{{Lu}}{C}+(?:['’]\p{{Lu}}{C}+)?(?:-\p{{Lu}}{C}+)*"
PARTICLES = r"(?:\s(?:van|von|de|del|della|di|da|dos|la|le|der|den|ten|ter|bin|al)){1,2}"
CAPS = rf"(?:{WORD}|\p{{Lu}}\.)(?:\s\p{{Lu}}\.)?(?:{PARTICLES})?\s{WORD}|{WORD},\s(?:{WORD}|\p{{Lu}}\.)(?:\s\p{{Lu}}\.)?"
ANY = rf"(?:{C}{{2,}}(?:-{C}+)?|{C}\.)(?:\s{C}\.)?\s{C}{{3,}}(?:-{C}+)*|{C}{{3,}}(?:-{C}+)*,\s(?:{C}{{2,}}|{C}\.)(?:\s{C}\.)?(?!{C})"
AFTER = rf"(?![\p{{Lu}}\p{{Ll}}\p{{M}}\d_]|[-'’]\p{{Lu}})"
PAIR = regex.compile(rf"(?<![\p{{Lu}}\p{{Ll}}\p{{M}}\d_.'’-])(?:{CAPS}){AFTER}")
TRIPLE = regex.compile(rf"(?<![\p{{Lu}}\p{{Ll}}\p{{M}}\d_.'’-]){WORD}\s{WORD}\s{WORD}{AFTER}")
SMALL = regex.compile(rf"(?<![\p{{Lu}}\p{{Ll}}\p{{M}}\d_.'’@-])(?:{ANY}){AFTER}")
TURNED = regex.compile(rf"(?r)(?<![\p{{Lu}}\p{{Ll}}\p{{M}}\d_.'’@-]){C}{{3,}}(?:-{C}+)*,\s{C}{{2,}}{AFTER}")
WORDS = regex.compile(rf"{M}+")
FOLLOW, AHEAD = regex.compile(rf"\s*({M}+)"), regex.compile(rf"([^\w]*)({M}+)?(?:\s({M}+|\d))?")
MIDDLE = regex.compile(rf"({WORD})\s$")

DOT = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\sdot\s)"
AT = re.compile(r"[@＠]|[(\[]\s?at\s?[)\]]|\sat\s(?=[\w-]{1,200}\sdot\s)")
# read from its end backwards, so that no length bounds it
LOCAL = regex.compile(r"(?r)(?<![\w.+@-])\w(?:[\w.+-]*\w)?")
LOCAL_DOT = regex.compile(r"(?r)(?<![\w.+@-])\w[\w+-]*(?:(?:\sdot\s|[(\[]dot[)\]])\w[\w.+-]*)+")
HOST = regex.compile(rf"[\w-]+(?:{DOT}[\w-]+)*{DOT}\p{{L}}{{2,}}(?![\w@])")

B = r"[  .  /-]"
EXT = r"(?:\s?(?:x|ext\.?|extension)\s?\d{1,5})?"
PHONE = regex.compile(rf"(?<![\w+.#-])(?<!\d[ ])(?:\((?:\+|00)\d{{1,3}}\){B}?|(?:\+|00)\d{{1,3}}{B}?)?(?:\(0\){B}?)?(?:\(\d{{1,5}}\)|\d+)(?:{B}?(?:\(\d{{1,5}}\)|\d+))*{EXT}(?![\w-]|\.\d)")
# Country codes of two digits; all others but 1 and 7 have three
CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
DATE = re.compile(r"(?:19|20)\d\d[-./ ][01]?\d[-./ ][0-3]?\d(?!\d)|[0-3]?\d[-./ ][01]?\d[-./ ](?:19|20)\d\d|\d{1,3}(?:\.\d{1,3}){3}$")
# Public formats of identity, tax, insurance and passport numbers
IDS = [
    r"\d{3}-\d{2}-\d{4}", r"\d{3} \d{2} \d{4}", r"\d{6}[-+]\d{4}", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    r"[A-Z]{1,2}\d{7,8}[A-Z]?", r"\d{8}-?[A-Z]", r"\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}", r"\d{2} \d{3} \d{3} \d{3}", r"[A-Z]-\d{7,8}(?:-[A-Z])?",
]
ID = regex.compile(r"(?<![\w.#/=-])(?<!\d[ ])(?:" + "|".join(IDS) + r")(?![\w-]|\.\d| \d)")

PLACE = rf"\p{{Lu}}{M}+(?:[ -]\p{{Lu}}{M}+)?"
ONE_PLACE = rf"\p{{Lu}}{M}+"
CITY = rf"\p{{Lu}}{M}+(?:[ -](?:\p{{Lu}}{M}+|de|la|le|sur|am|an der)){{0,3}}"
CODE = r"(?:[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?)"
GAP = r"(?:,\s{1,6}|\s?/\s|,?\s?\n[ \t>;#*-]{0,14}|,? {0,2}\n[ \t]{0,14})"
STREETS = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Terrace|Blvd|Boulevard|Drive|Dr|Court|Ct|Way|Square|Sq|Place|Pl|Crescent|Row)"
WAYS = r"(?:rue|avenue|boulevard|chemin|place|impasse|quai|allée|route|cours)"
FIRST = r"(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.|Paseo|Camino|Via|Viale|Piazza|Corso|Largo|Rua|Travessa|Ulica|ul\.|Улица|улица|ул\.|Проспект|проспект)"
ADDRESSES = [
    # number first, as in Britain and the United States
    rf"(?:(?:Flat|Apt|Unit|Suite|Apartment)\.? \w{{1,4}},\s)?\d{{1,5}}[a-z]?,? {PLACE}\s{STREETS}\b\.?(?:\s(?:N|S|E|W|NE|NW|SE|SW)\b)?(?:,?\s(?:Apt|Flat|Unit|Suite|#)\.? ?\w{{1,4}}\b)?(?:{GAP}{CITY}(?:(?:,\s{{1,3}}|\s{{1,3}}|{GAP}){CODE}\b)|(?:,\s{{1,6}}|\s/\s){ONE_PLACE}\b(?!\p{{L}}|['’])|{GAP}{CODE}\b)?",
    rf"P\.? ?O\.? ?Box \d+(?:{GAP}{CITY}(?:(?:,\s|\s){CODE}\b)|,\s{{1,6}}{ONE_PLACE})?",
    # street first, as in Germany
    rf"(?:(?:Am|An der|Im|Auf der|Zum) )?\p{{Lu}}{M}+(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm)\s\d+ ?[a-z]?\b(?:{GAP}\d{{4,5}}\s{ONE_PLACE}|,\s{{1,6}}{ONE_PLACE})?",
    # number and the word for the way, as in France
    rf"\d+(?: (?:bis|ter|quater))?,?\s(?i:{WAYS})\s(?:(?i:de la|des|du|de l['’]|de|d['’])\s?)?[\p{{L}}\p{{M}}-]+(?: \p{{Lu}}[\p{{L}}\p{{M}}-]+)?(?:{GAP}\d{{5}}\s{ONE_PLACE}|,\s{{1,6}}{ONE_PLACE})?",
    # the word for the way first, as in Spain, Italy and Russia
    rf"{FIRST}\s(?:(?i:de la|del|de los|de|dei|della|da) )?{PLACE},?\s(?:n[º°.]\s?|д\.\s?)?\d+[a-z]?(?:,\s\d+[º°ª]\s?\p{{L}}?)?(?:{GAP}\d{{5}}\s{ONE_PLACE}|,\s{{1,6}}{ONE_PLACE})?",
]
ADDRESS = regex.compile(r"(?<![\w/.-])(?:" + "|".join(ADDRESSES) + ")")

# Words before a piece of each kind
MAILS = regex.compile(r"(?i)(?:mail|reach me at|write to|to|cc|contact|[ &=:<,\"/à]|на|は|correo|oder|ou)\W*$")
CALLS = regex.compile(r"(?i)(?<![^\W\d_])(?:call|phone|tel|tél|fax|mobile|cell|ring|text me|whatsapp|number is|answer on|handy|unter|joindre au|appelez|telefon|teléfono|telefono|llamad|телефон|связи|звоните|電話|の件は|or|oder|ou|al|en el|au)[\s:.=(/]*(?:es|is|на|は|le)?[\s:(]*$")
PAPERS = regex.compile(r"(?i)(?<![^\W\d_])(?:licen[cs]e|ssn|passport|insurance|id|identity|health card|ausweis|steuernummer|personalausweis|documento|dni|nif|pasaporte|sécurité sociale|identité|carte|паспорт|инн|снилс|マイナンバー|番号|card)[\s:.=]*(?:は|：|is|es|est|lautet|no\.|number|nr\.|nummer lautet)?[\s:]*$")
GOODS = regex.compile(r"(?i)(?:order|serial|ticket|checksum|catalogue|catalog|number [a-z]{3}|build|version|score|video|tick|isbn|model|part no)\w*[\s#:.-]*$")
TRIPS = regex.compile(r"(?i)(?:near|at|to|is at|address|adresse|dirección|lives|lives in|livrer au|in|in der|bitte an|an|bei|chez|en|住所は|адрес|from)[\s:]*$")

# what a span of these kinds must hold, for a quick look at where the patterns are worth trying
DIGITS = re.compile(r"\d[\d()+.\-/    ]{5,}")
STREET = re.compile(rf"\b{STREETS}\b|Box \d|(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm)\s\d|\d,?\s(?:bis|ter|quater|(?i:{WAYS}))\b|\b{FIRST}\s")


#: Kind, start, end, the vote (1, 0 or -1) of each local labeler; of names also the given name and the contexts before and behind.
Span = tuple[str, int, int, tuple[int, ...], str, str, str]


def _around(pattern: regex.Pattern, sign: re.Pattern, text: str, words: int, after: int) -> Iterator[regex.Match]:
    """Matches of a pattern that hold a sign: from ``words`` words before it on.

    The window only says where matches may begin; one that reaches its end is read again without an end.
    """
    start = end = -1

    def within(start: int, end: int) -> Iterator[regex.Match]:
        at = start
        while found := pattern.search(text, at, min(end, len(text))):
            whole = pattern.match(text, found.start()) if found.end() > end - after // 2 else found
            yield whole or found
            at = max((whole or found).end(), found.start() + 1)

    for m in sign.finditer(text):
        first = m.start()
        for _ in range(words):
            first = max(text.rfind(" ", 0, first), text.rfind("\n", 0, first), 0)
        if end >= 0 and first <= end:
            end = m.end() + after
            continue
        if end >= 0:
            yield from within(start, end)
        start, end = max(first, end, 0), m.end() + after
    if end >= 0:
        yield from within(start, end)


@lru_cache(maxsize=200_000)
def _low(word: str) -> str:
    return word.lower().translate(LOW)


def _near(text: str, start: int, end: int, wide: int = 46) -> tuple[str, str]:
    return text[max(0, start - wide) : start], text[end : end + wide]


def _name_parts(value: str) -> tuple[str, str]:
    """Given name or initial and surname of a matched name, folded."""
    a, comma, b = value.partition(",")
    words = _low(value.replace(",", " ").replace(".", " ")).split()
    if len(words) < 2:
        return "", ""
    if comma:
        given = _low(b.replace(".", " ")).split()
        return (given[0] if given else ""), _low(a).strip()
    return words[0], words[-1]


def dialled(value: str) -> int:
    """1 where digits are grouped and counted like a phone number of some country, -1 for dates and the like, else 0."""
    digits = "".join(filter(str.isdigit, regex.sub(rf"(?<=\d){EXT}$|\(0\)", "", value)))
    if DATE.match(value) or not 7 <= len(digits) <= 15:
        return -1
    groups = regex.findall(r"\d+", value)
    # only the last group, or a lone one, is long
    if any(len(g) > 5 for g in groups[:-1]):
        return 0
    bare = value.lstrip("(")
    if bare.startswith(("+", "00")):
        rest = digits.removeprefix("00")
        size = 1 if rest[:1] in "17" else 2 if rest[:2] in CODES else 3
        return 1 if rest[:1] != "0" and 7 <= len(rest) - size <= 12 and len(groups[0].removeprefix("00")) in (size, len(digits.removeprefix("00"))) else -1
    if digits[0] == "0":
        return 1 if 9 <= len(digits) <= 12 else 0
    plain = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    return 1 if len(plain) == 10 and plain[0] > "1" else 0


CLOSING, ROLE, TITLE = frozenset(CLOSINGS.split()), frozenset(ROLES.split()), frozenset(TITLES.split())
STOP = regex.compile(r"[.!?]\s+\p{Lu}?|\n\s*\n")
ENDED = regex.compile(r"[.!?\n][^:]*$")
MARKS = regex.compile(r"[\w\s]+")


def _linked(before: str) -> tuple[bool, str]:
    """Whether the words before a span announce a person, and those words themselves."""
    found = list(WORDS.finditer(before))[-3:]
    if not found:
        return False, MARKS.sub("", before)[-2:]
    words, gap = [_low(m[0]) for m in found], before[found[-1].end() :]
    pair = " ".join(words[-2:])
    context = pair + ("" if not gap or gap.isspace() else "|" + "".join(sorted(set(MARKS.sub("", gap))))[:4])
    if words[-1].endswith(ENDINGS_BEFORE):
        return True, context
    if ENDED.search(gap) and words[-1] not in CLOSING and not (gap.startswith(".") and words[-1] in TITLE):
        return False, context
    return words[-1] in LINKS or pair in PAIRS or ":" in gap and not ROLE.isdisjoint(words), context


def spans(text: str) -> list[Span]:
    """Candidate spans of a text."""
    out: list[Span] = []
    mails, taken = [], []
    free = lambda s, e: not any(s < b and a < e for a, b in taken)
    for at in AT.finditer(text):
        at_start, at_end = at.span()
        # one blank on either side may belong to it
        at_start -= text[at_start - 1 : at_start].isspace()
        at_end += text[at_end : at_end + 1].isspace()
        right = HOST.match(text, at_end)
        local = right and ((LOCAL_DOT.match(text, 0, at_start) if "dot" in right[0] else None) or LOCAL.match(text, 0, at_start))
        if not local:
            continue
        start, end = local.start(), right.end()
        value, before = text[start:end], text[max(0, start - 46) : start]
        plain = "@" in value and " " not in value
        mails.append(_low(regex.sub(r"\W+", ".", local[0])))
        out.append(("email", start, end, (1, int(plain), int(MAILS.search(before) is not None), 0, 0, 0, 0), "", "", ""))
        taken.append((start, end))
    for m in _around(ADDRESS, STREET, text, 9, 150):
        s, e = m.start(), m.end() - m[0].endswith(".")
        before, after = _near(text, s, e, 70)
        coded = regex.search(CODE + r"|\b\d{5}\b", m[0]) is not None
        line = regex.search(r"\n[ \t>;#*]*$", before) is not None
        out.append(("address", s, e, (1, int(coded), int(TRIPS.search(before) is not None or line), 0, 0, int("," in m[0] or "\n" in m[0]), 0), "", "", ""))
        taken.append(m.span())
    for kind, pattern, good in (("id_number", ID, PAPERS), ("phone", PHONE, CALLS)):
        for m in _around(pattern, DIGITS, text, 2, 24):
            s, e = m.span()
            before, after = _near(text, s, e)
            digits = list(filter(str.isdigit, m[0]))
            if not free(s, e) or len(set(digits)) < 2:
                continue
            shape = dialled(m[0]) if kind == "phone" else 1
            if shape < 0:
                continue
            ours, other = good.search(before) is not None, (CALLS if kind == "id_number" else PAPERS).search(before) is not None
            bad = GOODS.search(before) is not None or (other and not ours)
            line = regex.search(r"(?:^|\n)[ \t>;#*-]*$", before) is not None
            out.append((kind, s, e, (shape, 0, int(ours and not bad), 0, int(line), 0, -int(bad)), "", "", ""))
            taken.append((s, e))
    return out + names(text, mails, taken)


def names(text: str, mails: list[str], taken: list[tuple[int, int]]) -> list[Span]:
    """Candidate spans that are written like names: a given name or initial and a surname in either order.

    With capitals any such pair is one; in small letters those with a listed given name, or behind words that
    state a name.
    """
    found: dict[tuple[int, int], bool] = {}
    for m in PAIR.finditer(text, overlapped=True):
        if m[0][1] == ".":
            # a middle initial begins no name of its own
            middle = MIDDLE.search(text, max(0, m.start() - 40), m.start())
            if middle and _low(middle[1]) not in LINKS:
                continue
        found[m.span()] = True
    for m in TRIPLE.finditer(text, overlapped=True):
        first, second = _low(m[0]).split()[:2]
        if first in GIVEN and second in GIVEN:
            found[m.span()] = True
    for w in WORDS.finditer(text):
        if _low(w[0]) in GIVEN:
            for m in (SMALL.match(text, w.start()), TURNED.match(text, 0, w.end())):
                if m and m.span() not in found and m[0][0].islower() and (_name_parts(m[0])[1] not in GIVEN or "," in m[0]):
                    found[m.span()] = False
    for link in STATED.finditer(text):
        m = SMALL.match(text, link.end())
        if m and m.span() not in found:
            found[m.span()] = False
    out = []
    for (s, e), cased in sorted(found.items()):
        if any(s < b and a < e for a, b in taken):
            continue
        value, (before, after) = text[s:e], _near(text, s, e)
        given, surname = _name_parts(value)
        first = _low(WORDS.search(value)[0])
        # a word that announces a person is no part of the name
        if first in LINKS and first not in GIVEN or any(len(w) > 1 and w.lower() in FUNCTION for w in (WORDS.search(value)[0], WORDS.findall(value)[-1])):
            continue
        linked, context = _linked(before)
        words = context.partition("|")[0].split()
        quoted = before[-1:] in "\"“«'" and after[:1] in "\"”»'" and before[-1:] != ""
        work = (bool(words) and not linked and (words[-1] in WORKS or words[-1] == "by" and words[0] in WORKS)) or (quoted and not linked) or ACTS.match(after) is not None or KEY_LINE.search(before) is not None or (words[-1:] == ["the"] and before[-1:] == " ")
        follow = FOLLOW.match(after)
        behind = after.startswith(SUFFIXES) or (follow is not None and _low(follow[1]) in BEHIND)
        beside = any(0 <= a - e <= 12 and not STOP.search(text, e, a) or 0 <= s - b <= 12 and not STOP.search(text, b, s) for a, b in taken)
        echo = len(surname) > 2 and any(_plain(surname.split("-")[0]) in mail for mail in mails)
        votes = (int(cased) - 1, int(given in GIVEN), int(linked), int(behind), int(beside), int(echo), -int(work))
        out.append(("name", s, e, votes, given if len(given) > 1 else "", context, _ahead(after)))
    return out


def _ahead(after: str) -> str:
    """What follows a span: the next two words, of the second only its kind where it is a number or has a capital."""
    m = AHEAD.match(after)
    gap = "".join(sorted(set(MARKS.sub("", m[1]))))[:3]
    second = m[3] or ""
    return " ".join(filter(None, [gap, _low(m[2] or ""), "0" if second.isdigit() else "A" if second[:1].isupper() else _low(second)]))


def _plain(word: str) -> str:
    return "".join(ch for ch in word if ch.isascii() and ch.isalnum())


SIZE = 1 << 15
CAPITALS, SMALLS, GROUPS, MARKED = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{Ll}+"), regex.compile(r"\d+"), regex.compile(r"[\p{L}\p{M}]+|[^\s\p{L}\d]")
NEAR_BEFORE, NEAR_BEHIND = regex.compile(r"\p{Lu}\S*\s$"), regex.compile(r"\s\p{Lu}")


def spoken_for(votes: tuple[int, ...]) -> int:
    """1 where more labelers speak for a span than against it, 0 where only one that counts over all texts does, else -1."""
    score = 2 * sum(votes[:LOCAL_LABELERS]) + sum(votes[LOCAL_LABELERS:])
    return (score > 1) - (score < 1)


def features(kind: str, value: str, before: str, after: str, votes: tuple[int, ...]) -> list[int]:
    """Hashed features of a span: its votes, shape, endings and the words around it."""
    shape = CAPITALS.sub("A", SMALLS.sub("a", value if kind == "name" else GROUPS.sub(lambda m: str(len(m[0])), value)))[:24]
    words = [_low(w) for w in MARKED.findall(before)[-3:]]
    next_words = [_low(w) for w in MARKED.findall(after[:24])[:2]]
    found = [kind, f"{kind}|{shape}", *(f"{kind}|v{k}={v}" for k, v in enumerate(votes)), *(f"{kind}|b={w}" for w in words[-2:]), f"{kind}|bb={' '.join(words[-2:])}", f"{kind}|bbb={' '.join(words)}", *(f"{kind}|n={w}" for w in next_words[:1]), f"{kind}|nn={' '.join(next_words)}"]
    if kind == "name":
        given, surname = _name_parts(value)
        found += [f"g={given if len(given) > 1 else '.'}", *(f"e{k}={surname[-k:]}" for k in (2, 3, 4, 5)), f"s={surname[:4]}", f"w={surname}", f"script={ord(surname[0]) // 128 if surname and ord(surname[0]) > 0x24F else 0}"]
        found += [f"pc={NEAR_BEFORE.search(before) is not None}", f"nc={NEAR_BEHIND.match(after) is not None}"]
    return [zlib.crc32(f.encode()) % SIZE for f in found]


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability that a span with a pattern of votes is real, by expectation-maximisation.

    Labelers are taken as independent given the truth. For real and for other spans each labeler has its own shares
    of votes for, against and none, all of them estimated; silence where a labeler mostly speaks tells something as
    well. The start is the majority of the votes, which also stays as one more vote that is right nine times in ten:
    that fixes which side is the real one, and keeps a kind whole whose spans are all real.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    side = np.array([spoken_for(p) for p, _ in patterns])
    q, anchor = 0.5 + 0.4 * side, side * np.log(9)
    cast = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    # two votes' worth of belief that labelers are better than a guess
    belief = np.array([[1.0, 2.0, 0.2], [0.2, 2.0, 1.0]])
    for _ in range(rounds):
        mass = np.stack([(1 - q) * n, q * n])
        shares = np.einsum("sp,plv->slv", mass, cast) + belief[:, None, :]
        shares /= shares.sum(2, keepdims=True)
        prior = (mass.sum(1) + 1) / (mass.sum() + 2)
        log = np.log(prior)[:, None] + np.einsum("plv,slv->sp", cast, np.log(shares))
        q = 1 / (1 + np.exp(-np.clip(log[1] - log[0] + anchor, -30, 30)))
    return {p: float(x) for (p, _), x in zip(patterns, q, strict=True)}


def train(rows: list[list[int]], target: np.ndarray, share: np.ndarray, rounds: int = 12, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic classifier over hashed features for soft targets, by adaptive gradient steps.

    ``share`` says for how many spans each row stands.
    """
    w, g = np.zeros(SIZE), np.full(SIZE, 1e-6)
    order = np.arange(len(rows))
    for turn in range(rounds):
        np.random.default_rng(turn).shuffle(order)
        for batch in np.array_split(order, max(1, len(order) // 256)):
            if not len(batch):
                continue
            owner = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            flat = np.concatenate([rows[i] for i in batch])
            score = np.bincount(owner, w[flat], len(batch))
            gap = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target[batch]) * share[batch]
            step = np.bincount(flat, gap[owner], SIZE) / len(batch) + 1e-6 * w
            g += step**2
            w -= rate * step / np.sqrt(g)
    return w


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every candidate span: ``key``, ``kind``, ``start``, ``stop`` (code points), ``value``, ``before``, ``after``, ``votes``, ``given``, ``context``, ``ahead``, ``form``."""
    kind = dict(df.dtypes)[key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["_key"], batch["_text"], strict=True):
                rows += [(k, n, s, e, t[s:e], *_near(t, s, e), list(v), g, c, a, "initial" if n == "name" and not g else "") for n, s, e, v, g, c, a in spans(t)]
            yield pd.DataFrame(rows, columns=["_key", "kind", "start", "stop", "value", "before", "after", "votes", "given", "context", "ahead", "form"])

    held = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    return held.mapInPandas(find, f"_key {kind}, kind string, start int, stop int, value string, before string, after string, votes array<int>, given string, context string, ahead string, form string")


def with_corpus_votes(found: DataFrame, often: int = 8) -> DataFrame:
    """Spans of :func:`candidates` with the three votes that count over all texts.

    The given name's vote follows the share of its spans whose context speaks for them, that of the words before and of the
    words behind the share of their spans whose given name or mail address does: for where it is three times the share of all names, against
    where at least ``often`` spans have a quarter of it at most. Only names and contexts with a vote are joined back;
    the empty ones, of other kinds and of initials, have none.
    """
    vote = lambda k: F.element_at("votes", k + 1)
    named = found.filter("kind = 'name'").select("given", "context", "ahead", ((F.greatest(vote(2), vote(3), vote(5)) > 0) & (vote(6) == 0)).cast("int").alias("_by_context"), ((F.greatest(vote(1), vote(5)) > 0) & (vote(6) == 0)).cast("int").alias("_by_name"))
    base = named.agg(F.avg("_by_context").alias("c"), F.avg("_by_name").alias("n")).first()

    def voted(by: str, support: str, share: float, name: str) -> DataFrame:
        counted = named.filter(F.col(by) != "").groupBy(by).agg(F.count("*").alias("_n"), F.sum(support).alias("_k"))
        rate = F.col("_k") / F.col("_n")
        votes = F.when((F.col("_k") >= 2) & (rate >= min(3 * share, 0.5)), 1).when((F.col("_n") >= often) & (rate <= share / 4), -1)
        return counted.select(by, votes.alias(name)).filter(F.col(name).isNotNull())

    held = found.join(voted("given", "_by_context", base["c"] or 0.0, "_given"), "given", "left").join(voted("context", "_by_name", base["n"] or 0.0, "_around"), "context", "left").join(voted("ahead", "_by_name", base["n"] or 0.0, "_ahead"), "ahead", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return held.withColumn("votes", F.concat("votes", F.array(zero("_given"), zero("_around"), zero("_ahead")))).drop("given", "context", "ahead", "_given", "_around", "_ahead")


def personal_spans(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 40_000, least: float = 0.5) -> DataFrame:
    """Pieces of personal information: ``key``, ``kind``, ``start``, ``stop``, ``value``, ``probability``.

    Null, empty and blank texts have none. Spans of one kind don't overlap: the more probable wins, then the
    longer, then the earlier. Vote patterns are counted over all spans; ``sample`` bounds the spans of each kind
    the classifier is fitted on, of those that labelers speak for and of the others, those of least hash;
    each stands for its share of all. Every span is decided by it. What reaches the driver is one row for each
    vote pattern (at most 3^10 of a kind) and the sample.
    """
    found = durable(with_corpus_votes(durable(candidates(df, key, text))))
    counts = found.groupBy("kind", "form", "votes").agg(F.count("*").alias("n")).collect()
    # initials can't be in the list of given names, so their labelers are another matter
    real = {(k, form): reliabilities(sorted((tuple(r["votes"]), r["n"]) for r in counts if (r["kind"], r["form"]) == (k, form))) for k in KINDS for form in ("", "initial")}
    rows, target, share = [], [], []
    summed = lambda at, size: F.aggregate(F.slice("votes", at, size), F.lit(0), lambda a, v: a + v)
    in_favour = 2 * summed(1, LOCAL_LABELERS) + summed(LOCAL_LABELERS + 1, len(LABELERS)) > 0
    for k in KINDS:
        for side in (True, False):
            total = sum(r["n"] for r in counts if r["kind"] == k and (spoken_for(tuple(r["votes"])) >= 0) == side)
            if not total:
                continue
            some = found.filter((F.col("kind") == k) & (in_favour == side)).orderBy(F.xxhash64("value", "before", "after"), "_key", "start").limit(sample).select("value", "before", "after", "votes", "form").collect()
            for r in some:
                votes = tuple(r["votes"])
                rows.append(features(k, r["value"], r["before"], r["after"], votes))
                target.append(real[k, r["form"]][votes])
                share.append(total / len(some))
    weights = train(rows, np.array(target), np.array(share)) if rows else np.zeros(SIZE)
    shared = found.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def decide(kind: pd.Series, value: pd.Series, before: pd.Series, after: pd.Series, votes: pd.Series) -> pd.Series:
        w = shared.value
        score = [float(w[features(k, v, b, a, tuple(x))].sum()) for k, v, b, a, x in zip(kind, value, before, after, votes, strict=True)]
        return pd.Series(1 / (1 + np.exp(-np.clip(score, -30, 30))))

    # not deterministic to the planner, which else scores every span once for the filter and once for the column
    decide = decide.asNondeterministic()
    scored = found.withColumn("probability", decide("kind", "value", "before", "after", "votes")).filter(F.col("probability") >= least)

    # a document's spans lie in one task already when they are found; they are few
    grouped = scored.groupBy("_key", "kind").agg(F.collect_set(F.struct("start", "stop", "value", "probability")).alias("_spans"))

    @F.pandas_udf("array<struct<start:int,stop:int,value:string,probability:double>>")
    def disjoint(lists: pd.Series) -> pd.Series:
        return pd.Series([_apart(x) for x in lists], dtype=object)

    kept = grouped.select("_key", "kind", F.explode(disjoint("_spans")).alias("_s"))
    return kept.select(F.col("_key").alias(key), "kind", "_s.*")


def _apart(found: list[dict]) -> list[dict]:
    """Spans that don't overlap, better ones first."""
    kept: list[dict] = []
    for s in sorted(found, key=lambda s: (-round(s["probability"], 3), s["start"] - s["stop"], s["start"])):
        if all(s["stop"] <= k["start"] or k["stop"] <= s["start"] for k in kept):
            kept.append(s)
    return kept


def personal_values(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``kind``, ``value``: each different piece of personal information of a document once."""
    return personal_spans(df, key, text).select(key, "kind", "value").distinct()


def masked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text`` with every piece replaced by its kind in brackets, the rest as it was.

    One row for each row of ``df`` with a unique key; null texts stay null. Overlapping pieces of different
    kinds become one placeholder, of the kind that begins first.
    """
    marks = personal_spans(df, key, text).groupBy(key).agg(F.collect_list(F.struct("start", "stop", "kind")).alias("_marks"))

    @F.pandas_udf("string")
    def mask(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or m is None else put(t, m) for t, m in zip(texts, lists, strict=True)], dtype=object)

    both = df.select(key, text).join(marks, key, "left")
    return both.select(key, mask(F.col(text), F.col("_marks")).alias(text))


def put(text: str, marks: list[dict]) -> str:
    """``text`` with placeholders at the marks."""
    out, at = [], 0
    for m in sorted(marks, key=lambda m: (m["start"], -m["stop"])):
        if m["start"] < at:
            at = max(at, m["stop"])
            continue
        out += [text[at : m["start"]], f"[{m['kind'].upper()}]"]
        at = m["stop"]
    return "".join([*out, text[at:]])
