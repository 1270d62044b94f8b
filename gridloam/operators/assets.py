"""Figures and tables of documents: registry, lookup, ranking, and tables from HTML.

An asset is (source, type, page, idx, caption, page_text, text, text_rows).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloam.functions.text import table_text, tokens

MOST_IMAGES, MOST_TABLES, LEAST_SIDE = 20, 30, 150
#: Words that say nothing about what a figure or table shows.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "and", "or", "for", "to", "is", "are",
    "what", "does", "show", "from", "this", "that", "it", "me", "give", "open",
    "explain", "describe", "detail", "paper", "literature", "document",
)


def counts(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, figures, tables) of every source, 0 where it has none."""
    n = assets.groupBy("source").agg(F.count_if(F.col("type") == "figure").alias("figures"), F.count_if(F.col("type") == "table").alias("tables"))
    return sources.select("source").distinct().join(n, "source", "left").select("source", F.coalesce("figures", F.lit(0)).alias("figures"), F.coalesce("tables", F.lit(0)).alias("tables"))


def capped(assets: DataFrame, images: int | None = MOST_IMAGES, tables: int | None = MOST_TABLES) -> DataFrame:
    """The first figures and tables of each source, as many as asked for; None keeps all."""
    w = Window.partitionBy("source", "type").orderBy("page", "idx")
    all_ = F.lit(1 << 62)
    most = F.when(F.col("type") == "table", all_ if tables is None else F.lit(tables)).otherwise(all_ if images is None else F.lit(images))
    return assets.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def by_number(assets: DataFrame, kind: str, number: int) -> DataFrame:
    """The assets with that number, or on that page."""
    return assets.where(F.col("page") == number) if kind == "page" else assets.where((F.col("type") == kind) & (F.col("idx") == number)).orderBy("source").limit(1)


def registry(images: DataFrame, tables: DataFrame) -> DataFrame:
    """Figures and tables in one table."""
    return images.unionByName(tables, allowMissingColumns=True)


def records(assets: DataFrame, source: str | None = None, kind: str | None = None) -> DataFrame:
    """The assets of a source, of a type, or both."""
    out = assets if source is None else assets.where(F.col("source") == source)
    return out if kind is None else out.where(F.col("type") == kind)


def listed(assets: DataFrame, rows: int = 4) -> DataFrame:
    """Each asset as a line: type, number, page, source and caption, and the first rows of a table's text."""
    preview = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, rows), "\n")
    head = F.format_string("%s %d | p.%d | %s", F.initcap("type"), F.col("idx"), F.col("page"), F.col("source"))
    caption = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit(": "), F.col("caption"))).otherwise("")
    body = F.when(preview != "", F.concat(F.lit("\n"), preview)).otherwise("")
    return assets.select("source", "type", "page", "idx", F.concat(head, caption, body).alias("line"))


def of_document(assets: DataFrame, query: str, words: dict[str, str]) -> DataFrame:
    """Assets of the document that a question means by one of the words (word to a part of the source's name)."""
    part = next((p for w, p in words.items() if w in query.lower()), None)
    return assets if part is None else assets.where(F.lower("source").contains(part.lower()))


def new_only(found: DataFrame, known: DataFrame) -> DataFrame:
    """Assets of sources that aren't registered yet."""
    return found.join(known.select("source").distinct(), "source", "left_anti")


def keywords(query: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(query)), F.array(*[F.lit(w) for w in STOP_WORDS]))


#: How a question names a table, a figure or a page, before the next of them, and any of them at all.
NAMED = (("table", r"table\s*(\d+)"), ("figure", r"fig(?:ure)?\.?\s*(\d+)"), ("page", r"(?:page|p\.?)\s*(\d+)"))
ASSET_WORDS = ("fig", "table", "image", "page")
#: How a question numbers an image file, and how such a file's name does.
IMAGE_NUMBER = r"\b(?:fig(?:ure)?|table|image|img|chart)[\s_-]*(\d+)\b"
IMAGE_NAME = r"(?:img|image|fig|table|p\d+_(?:img|table))_?0*"


def relevant(assets: DataFrame, query: str, k: int = 3) -> DataFrame:
    """The assets that a question means, with a score.

    A numbered table is looked up first, then a numbered figure, then a page: all with that number, of that type if there
    are any. A question that speaks of a figure, table, image or page without finding one gets none. Any other gets the k
    best by the words that it has in common with the caption and the source (three each) and the page's text (one each),
    and none without such words; a question of stop words alone gets the first k.
    """
    q = query.lower()
    order = ["source", "page", "idx"]
    kind, number = next(((kind, int(m[1])) for kind, p in NAMED if (m := re.search(p, q))), (None, None))
    if kind == "page":
        return assets.where(F.col("page") == number).withColumn("score", F.lit(1)).orderBy(*order)
    if kind:
        hits = assets.where(F.col("idx") == number).withColumn("score", F.when(F.col("type") == kind, 2).otherwise(1))
        best = hits.agg(F.max("score").alias("best"))  # one row
        return hits.join(F.broadcast(best)).where("score = best").drop("best").orderBy(*order)
    if any(w in q for w in ASSET_WORDS):
        return assets.withColumn("score", F.lit(0)).where("false")
    words = [w for w in dict.fromkeys(re.findall("[a-z0-9]+", q)) if w not in STOP_WORDS]
    if not words:
        return assets.withColumn("score", F.lit(0)).orderBy(*order).limit(k)
    asked = F.array(*[F.lit(w) for w in words])
    common = lambda *c: F.size(F.array_intersect(asked, tokens(F.concat_ws(" ", *c))))
    score = 3 * common("caption", "source") + common("page_text")
    return assets.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), *order).limit(k)


def ranked_images(images: DataFrame, query: str, k: int = 3) -> DataFrame:
    """Image files (name) by a question: 10 for its number after the name of its sort, 5 for the sort, 2 for each word.

    Words are those of four characters or more, as often as the question has them, anywhere in the name; a question of
    tables is for names with "table", any other for those with "img" or "fig".
    """
    q, name = query.lower(), F.lower("name")
    number = re.search(IMAGE_NUMBER, q)
    numbered = name.rlike(f"{IMAGE_NAME}{int(number[1])}\\b") if number else F.lit(False)
    sort = name.contains("table") if re.search(r"\btables?\b", q) else name.contains("img") | name.contains("fig")
    score = F.when(numbered, 10).otherwise(0) + F.when(sort, 5).otherwise(0)
    for w in re.findall(r"\w{4,}", q):
        score = score + F.when(name.contains(w), 2).otherwise(0)
    return images.withColumn("score", score).orderBy(F.desc("score"), "name").limit(k)


def collisions(assets: DataFrame) -> DataFrame:
    """(type, idx, sources): numbers that more than one source uses, where a question must say which."""
    return assets.groupBy("type", "idx").agg(F.countDistinct("source").alias("sources")).where("sources > 1")


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.open, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.tables.append([r for r in self.open.pop() if r])

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html", most: int | None = None) -> DataFrame:
    """(key, idx, text_rows, text) of each HTML table with at least two rows; the first ones of a page if `most` is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, h in zip(pdf[key], pdf[html], strict=True):
                p = _Tables()
                p.feed(h or "")
                out += [(k, i + 1, rows) for i, rows in enumerate([t for t in p.tables if len(t) >= 2][:most])]
            yield pd.DataFrame(out, columns=[key, "idx", "text_rows"])

    found = pages.select(key, html).mapInPandas(run, f"{key} long, idx int, text_rows array<array<string>>")
    return found.withColumn("text", table_text(F.col("text_rows")))
