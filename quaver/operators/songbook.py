"""The printed songbook: unique entries, letters, outliers, and pages."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.text import blank, bucket_letter, html_escape, sort_key, strip
from quaver.session import durable

# Fixed values of the page, in pixels
CAPACITY, GAP, PAGE, PADDING = 900, 20, 816, 52.8
LETTER_HEIGHT, ARTIST_LINE, ARTIST_MARGIN, SONG_LINE, SONG_INDENT = 78, 17, 9, 16, 25
FIRST_PAGE = 3


def entries(songs: DataFrame, ord: str) -> DataFrame:
    """Unique (artist, title) pairs without regard to case, in the spelling that comes first by ``ord``.

    Rows without artist or title are left out. The spelling of an artist is the first over all of its titles.
    """
    rows = songs.filter(~blank(F.col("artist")) & ~blank(F.col("title"))).select(strip(F.col("artist")).alias("artist"), strip(F.col("title")).alias("title"), F.col(ord).alias("_ord"))
    rows = rows.withColumn("artist_key", F.lower("artist")).withColumn("title_key", F.lower("title"))
    first = lambda c: F.min_by(c, F.struct("_ord", F.col(c)))
    pairs = rows.groupBy("artist_key", "title_key").agg(first("title").alias("title"), F.min(F.struct("_ord", F.col("artist"))).alias("_a"))
    # both sides of the join are these pairs, which are far fewer than the rows
    pairs = durable(pairs)
    names = pairs.groupBy("artist_key").agg(F.min("_a").alias("_first"))
    return pairs.join(names, "artist_key").select("artist_key", "title_key", F.col("_first.artist").alias("artist"), "title")


def artists(book: DataFrame) -> DataFrame:
    """Titles of each artist, its sort key and its letter."""
    counts = book.groupBy("artist_key").agg(F.min("artist").alias("artist"), F.count("*").alias("songs"))
    return counts.withColumn("sort_key", sort_key(F.col("artist"))).withColumn("letter", bucket_letter(F.col("sort_key")))


def stats(acts: DataFrame, k: float = 1.5) -> DataFrame:
    """One row: artists, titles, mean and population deviation of titles by artist, and the threshold of the outliers."""
    row = acts.agg(F.count("*").alias("total_artists"), F.coalesce(F.sum("songs"), F.lit(0)).alias("total_songs"), F.coalesce(F.avg("songs"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("songs"), F.lit(0.0)).alias("stdev"))
    return row.withColumn("threshold", F.col("mean") + k * F.col("stdev"))


def outliers(acts: DataFrame, k: float = 1.5) -> DataFrame:
    """Artists with more titles than the threshold, in alphabetical order. The one-row statistics are broadcast."""
    acts = durable(acts)
    return acts.crossJoin(F.broadcast(stats(acts, k).select("threshold"))).filter("songs > threshold").orderBy("sort_key", "artist_key").select("artist", "songs", "letter")


def letters(acts: DataFrame) -> DataFrame:
    """Artists and titles by letter, A to Z, then '#'."""
    return acts.groupBy("letter").agg(F.count("*").alias("artists"), F.sum("songs").alias("songs")).orderBy(F.col("letter") == "#", "letter")


def column_width(columns: int = 3, margin: float = 0.9) -> int:
    """Width of a column for a number of columns and a binding margin in inches."""
    return math.floor((PAGE - margin * 96 - PADDING - GAP * (columns - 1)) / columns)


def plain_lines(text: str, kind: str, width: float) -> int:
    """Lines of a text in a font of fixed width."""
    return max(1, math.ceil(len(text) * (8.0 if kind == "artist" else 7.5) / width))


def flow(items: list[tuple[str, str]], columns: int = 3, margin: float = 0.9, measure: Callable[[str, str, float], int] = plain_lines) -> list[tuple[int, int, int]]:
    """Page, column and place in it (from 0) of each item of one letter, in order; items are (kind, text).

    A letter starts a page. An artist moves on together with the first title if both don't fit into what is
    left of the column but would fit into an empty one.
    """
    width = column_width(columns, margin)
    height = []
    for kind, text in items:
        if kind == "letter":
            height.append(LETTER_HEIGHT)
        elif kind == "artist":
            height.append(measure(text, kind, width) * ARTIST_LINE + ARTIST_MARGIN)
        else:
            height.append(measure(text, kind, width - SONG_INDENT) * SONG_LINE)
    out, column, place, room = [], 0, 0, CAPACITY
    for i, (kind, _) in enumerate(items):
        need = height[i]
        if kind == "artist" and i + 1 < len(items) and items[i + 1][0] == "song" and height[i] + height[i + 1] <= CAPACITY:
            need = height[i] + height[i + 1]
        if need > room or height[i] > room:
            column, place, room = column + 1, 0, CAPACITY
        out.append((column // columns, column % columns, place))
        place += 1
        room -= height[i]
    return out


def layout(book: DataFrame, columns: int = 3, margin: float = 0.9) -> DataFrame:
    """Every artist and title with its page, column and place.

    Letters start pages, so each is laid out by itself and the pages are numbered by a running sum over the
    letters, of which there are at most 27. A letter's pages depend on each other, which makes a letter the
    unit of work.
    """
    acts = artists(book).select("artist_key", "letter", "sort_key")
    rows = book.join(acts, "artist_key").select("letter", "sort_key", "artist_key", "artist", "title", sort_key(F.col("title")).alias("_t"), "title_key")

    def place(letter: pd.DataFrame) -> pd.DataFrame:
        letter = letter.sort_values(["sort_key", "artist_key", "_t", "title_key"])
        items = [("letter", letter["letter"].iloc[0])]
        for artist, own in letter.groupby(["sort_key", "artist_key"], sort=False):
            items.append(("artist", own["artist"].iloc[0]))
            items += [("song", t) for t in own["title"]]
            del artist
        places = flow(items, columns, margin)
        return pd.DataFrame({"letter": letter["letter"].iloc[0], "kind": [k for k, _ in items], "text": [t for _, t in items], "leaf": [p for p, _, _ in places], "col": [c for _, c, _ in places], "pos": [n for _, _, n in places]})

    # letters with no artist don't appear; '#' comes last
    placed = rows.groupBy("letter").applyInPandas(place, "letter string, kind string, text string, leaf int, col int, pos int")
    order = Window.orderBy(F.col("letter") == "#", "letter").rowsBetween(Window.unboundedPreceding, -1)
    pages = placed.groupBy("letter").agg((F.max("leaf") + 1).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    return placed.join(F.broadcast(pages), "letter").select((F.col("_before") + F.col("leaf") + FIRST_PAGE).cast("int").alias("page"), "col", "pos", "letter", "kind", "text")


def toc_pages(toc: DataFrame, placed: DataFrame) -> DataFrame:
    """Outliers with the page where the artist first stands; the first page if it stands nowhere."""
    first = placed.filter("kind = 'artist'").groupBy(F.col("text").alias("artist")).agg(F.min("page").alias("_p"))
    return toc.join(first, "artist", "left").select("artist", "songs", F.coalesce("_p", F.lit(FIRST_PAGE)).alias("page"))


def html_pages(placed: DataFrame) -> DataFrame:
    """One row for each page: its markup, columns and places in order."""
    line = F.concat(F.lit("<div class=\""), F.col("kind"), F.lit("\">"), html_escape(F.col("text")), F.lit("</div>"))
    cells = F.array_sort(F.collect_list(F.struct("col", "pos", line.alias("html"))))
    return placed.groupBy("page").agg(cells.alias("_c")).select("page", F.array_join("_c.html", "\n").alias("html"))
