"""Text functions as column expressions: they stay inside the JVM and take part in whole-stage code.

Every function takes and returns columns; a null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space around a text, as a Java character class.
BLANK = r"[\s\x0b\x1c-\x1f\u0085   -     　]"

# Words that open a note behind a title
NOTE_WORDS = r"feat\.?|ft\.?|featuring|live|radio\s*edit|acoustic|explicit|clean|single\s*version|album\s*version|remix|remaster(?:ed)?(?:\s*\d{2,4})?"
DASH_WORDS = r"feat\.?|ft\.?|featuring|live|radio\s*edit|single\s*version|album\s*version|remaster(?:ed)?(?:\s*\d{2,4})?|\d{2,4}\s*remaster"
PEDAL = r"(?:\d+\s*x\s+)?(?:bass\s+)?pedal(?:\s*\d+\s*x)?(?:\s*(?:expert|hard|medium|easy|normal|plus|\+))?"
TAGS = r"live|acoustic|remix|cover|demo|instrumental|unplugged|remaster(?:ed)?|extended|radio edit"
SEARCH_NOISE = ("(2x Bass Pedal Expert+)", "(2x Bass Pedal)", "(RB3 version)", "(Rh)", "RB3")

# Markers of the kinds of video titles, the strongest kind first
GAMEPLAY = (
    "guitar hero", "rock band", "rockband", "clone hero", "rocksmith", "playthrough", "play through", "gameplay", "sightread",
    "sight read", "chart preview", "custom chart", "drum chart", "note chart", "notes chart", "expert+", "expert +", "100% fc",
    "full combo", "beat saber", "full band", "expert guitar", "expert bass", "expert drums", "expert vocals", "pro drums",
    "pro guitar", "harmonies",
)
GAMEPLAY_TOKEN = r"\b(rbn\d*|rb[123]|gh[1235]|fc\s*#?\d*|dc\d+)\b"
LYRIC = ("lyric", "karaoke", "sing along", "singalong", "sing-along")
AUDIO_ONLY = ("official audio", "full album", "audio only", "(audio)", "[audio]", "visualizer", "visualiser")
OFFICIAL = ("music video", "promovideo", "promo video", "officialvideo")
OFFICIAL_PHRASE = r"official\s+(?:\w+\s+){0,2}(?:video|clip)"
KIND_ORDER = ("official", "unknown", "audio_only", "lyric", "gameplay")

# Reserved roles of audio stems
ROLES = (
    "preview", "song", "guitar", "rhythm", "bass", "keys", "crowd", "drums", "drums_1", "drums_2", "drums_3", "drums_4",
    "vocals", "vocals_1", "vocals_2", "vocals_explicit", "vocals_explicit_1", "vocals_explicit_2",
)


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def blank(text: Column) -> Column:
    """Whether a text is null or only white space."""
    return F.coalesce(strip(text) == "", F.lit(True))


def normalize_lookup(text: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one blank; null gives the empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def strip_title_noise(text: Column) -> Column:
    """Title without trailing notes (dash notes, bracket notes, pedal notes), each kept if nothing else is left.

    A pedal note inside the title goes last, even if nothing is left.
    """
    for note in (rf"\s*-\s*(?:{DASH_WORDS})\b.*", rf"\s*[(\[]\s*(?:{NOTE_WORDS})\b[^)\]]*[)\]]\s*", rf"\s*[(\[]\s*{PEDAL}[^)\]]*[)\]]\s*"):
        # one pattern that leaves alone what would be nothing but the note keeps the expression small
        text = strip(F.regexp_replace(text, rf"(?i)^(?!{note}$)(\s*\S.*?){note}$", "$1"))
    return strip(F.regexp_replace(text, rf"(?i)\b{PEDAL}\b", ""))


def folder_parts(name: Column) -> Column:
    """Struct of ``artist`` and ``title`` of a folder name.

    The first " - " parts them, else a single " -", else a single "- "; else all of it is the title.
    """
    count = lambda sep: F.size(F.split(name, sep)) - 1
    halves = lambda sep: F.split(name, sep, 2)
    parts = F.when(name.contains(" - "), halves(" - ")).when(name.contains(" -") & (count(" -") == 1), halves(" -")).when(name.contains("- ") & (count("- ") == 1), halves("- "))
    artist = F.coalesce(strip(F.element_at(parts, 1)), F.when(name.isNotNull(), F.lit("")))
    title = F.coalesce(strip(F.element_at(parts, 2)), name)
    return F.struct(strip_title_noise(artist).alias("artist"), strip_title_noise(title).alias("title"))


def clean_folder(name: Column) -> Column:
    """Folder name without a trailing copy number, then without one trailing bracket."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\s*[\[(]dup\d*[\])]\s*$", ""), r"\s*\[[^\]]*\]\s*$", "")


def version_tag(name: Column) -> Column:
    """The first word for another version in round brackets, in lower case; else null."""
    return F.nullif(F.lower(F.regexp_extract(name, rf"(?i)\(\s*({TAGS})\b[^)]*\)", 1)), F.lit(""))


def title_kind(title: Column) -> Column:
    """What a video title says it is: gameplay, lyric, audio_only, official or unknown, the first that fits."""
    low = F.lower(F.coalesce(title, F.lit("")))
    some = lambda words: _any(low, words)
    return (
        F.when(some(GAMEPLAY) | low.rlike(GAMEPLAY_TOKEN), "gameplay")
        .when(some(LYRIC), "lyric")
        .when(some(AUDIO_ONLY), "audio_only")
        .when(some(OFFICIAL) | low.rlike(OFFICIAL_PHRASE), "official")
        .otherwise("unknown")
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def kind_rank(kind: Column) -> Column:
    """Place of a kind in the order of preference; 1 for a kind that isn't known."""
    place = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), kind) - 1
    return F.when(place >= 0, place).otherwise(1).cast("int")


def sort_key(text: Column) -> Column:
    """Lower case without leading quotes, straight or curly."""
    return F.lower(F.regexp_replace(text, "^[\"'‘’“”]+", ""))


def bucket_letter(key: Column, strict: bool = False) -> Column:
    """The capital of the first letter of a sort key; '#' for digits and where there is no letter or digit.

    A first letter outside A-Z falls to '#', so that no artist is lost; with ``strict`` it keeps its own letter.
    """
    first = F.upper(F.regexp_extract(key, r"([\p{L}\p{N}])", 1))
    if strict:
        return F.when((first == "") | first.rlike(r"^\p{Nd}$"), "#").otherwise(first)
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def is_charted(value: Column) -> Column:
    """Whether a difficulty field says that the part exists: a whole number other than -1."""
    return F.coalesce(strip(value).try_cast("int") != -1, F.lit(False))


def video_id_of(url: Column) -> Column:
    """The v parameter of a URL, else the URL as it is."""
    found = F.regexp_extract(url, r"[?&]v=([^&]+)", 1)
    return F.when(found != "", found).otherwise(url)


def stem_role(stem: Column) -> Column:
    """Struct of a stem's ``role`` and whether its name carries a number; a reserved name wins. Null if neither."""
    low = F.lower(stem)
    role = F.regexp_extract(low, rf"^({'|'.join(ROLES)})_([0-9]+)$", 1)
    return (
        F.when(low.isin(*ROLES), F.struct(low.alias("role"), F.lit(False).alias("numbered")))
        .when(role != "", F.struct(role.alias("role"), F.lit(True).alias("numbered")))
        .otherwise(F.lit(None))
    )


def html_escape(text: Column) -> Column:
    """Text with the five special characters of HTML written out."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def version_numbers(version: Column) -> Column:
    """The numbers of a version text in order; arrays compare as versions do."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))


def search_label(artist: Column, title: Column) -> Column:
    """Artist and title for a search: fixed noise, empty brackets and repeated blanks taken out."""
    for noise in SEARCH_NOISE:
        title = F.replace(title, F.lit(noise), F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_replace(title, r"\(\s*\)", ""), r"\s+", " "))
    return F.concat_ws(" ", F.when(~blank(artist), strip(artist)), title)


def safe_value(text: Column, longest: int = 200) -> Column:
    """A value that may be written into a settings file, stripped and cut to ``longest``; else null."""
    ok = ~blank(text) & ~text.rlike(r"[\[\];#\r\n]")
    return F.when(ok, F.substring(strip(text), 1, longest))


def selection(text: Column, most: Column) -> Column:
    """Sorted numbers of a selection such as ``1,3,5-8`` within 1..most; ``a`` selects all."""
    part = F.split(F.regexp_replace(text, r"\s+", ""), ",")

    def numbers(p: Column) -> Column:
        low = F.regexp_extract(p, r"^(\d+)(?:-(\d+))?$", 1).try_cast("int")
        high = F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)(?:-(\d+))?$", 2), F.lit("")).try_cast("int"), low)
        return F.when(low.isNotNull() & (low <= high), F.sequence(low, F.least(high, F.greatest(low, most)))).otherwise(F.array().cast("array<int>"))

    some = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(part, numbers)), lambda n: (n >= 1) & (n <= most))))
    every = F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.when(F.lower(F.trim(text)).isin("a", "all"), every).otherwise(some)


# Texts of errors by what they mean
THROTTLED = ("sign in to confirm", "you're not a bot", "not a bot", "http error 429", "too many requests")
LOCKED = ("failed to decrypt with dpapi", "failed to load cookies")


def error_kind(message: Column) -> Column:
    """What an error message means: throttled, cookies or other; null for no message."""
    low = F.lower(message)
    return F.when(_any(low, THROTTLED), "throttled").when(_any(low, LOCKED), "cookies").when(low.isNotNull(), "other")


def quoted(value: Column) -> Column:
    """A value for a query string, blanks as %20."""
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
