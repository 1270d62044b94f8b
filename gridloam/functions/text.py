"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def words(text: Column) -> Column:
    """What lies between white space of any kind, Unicode's too."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def source_key(name: Column) -> Column:
    """A file name without extension, its marks as single spaces, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, r"\.(?i:pdf|docx|txt|md)$", ""), r"[_\-\s]+", " ")))


def source_title(name: Column) -> Column:
    return F.initcap(source_key(name))


def base_name(path: Column) -> Column:
    """The last part of a path with either kind of slash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def named_files(text: Column) -> Column:
    """Base names of the files that a text mentions, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)([\w\-./\\]+\.(?:pdf|docx|txt|md))"), F.lit(1)), lambda p: base_name(p)))


def table_text(rows: Column) -> Column:
    """Rows of cells as lines of `a | b`."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")), "\n")


def table_like(text: Column) -> Column:
    """Whether a text looks like a table: three bars, three tabs, or a numbered table."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (count("|") >= 3) | (count("\t") >= 3) | text.rlike(r"(?i)\bTable\s+\d+")


def asset_type(query: Column) -> Column:
    """What a question asks for: a table before a figure before a page."""
    q = F.lower(query)
    return F.when(q.rlike(r"\b(table|tab\.?)\s*\d+"), "table").when(q.rlike(r"\b(figure|fig\.?|image)\s*\d+"), "figure").when(q.rlike(r"\bpage\s*\d+"), "page")


def asset_number(query: Column) -> Column:
    """The number of the table, figure or page that a question asks for."""
    q = F.lower(query)
    found = [F.regexp_extract(q, p, 1) for p in (r"\b(?:table|tab\.?)\s*(\d+)", r"\b(?:figure|fig\.?|image)\s*(\d+)", r"\bpage\s*(\d+)")]
    return F.coalesce(*[F.when(f != "", f.cast("int")) for f in found])


def citations(answer: Column) -> Column:
    """Sources that an answer names in square brackets, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(?:Source:\s*)?([^\]]+?)\]"), F.lit(1)))


def sanitised(query: Column) -> Column:
    """A question without quotes and backticks."""
    return F.trim(F.translate(query, "\"'`", ""))


def questions_of(text: Column) -> Column:
    """The parts of a text between question marks that have five characters or more."""
    return F.filter(F.transform(F.split(text, r"\?"), lambda p: F.trim(p)), lambda p: F.length(p) >= 5)


def file_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), path)


def fixed(value: Column, places: int = 8, sign: bool = False) -> Column:
    """A number with that many decimals, and its sign if asked."""
    return F.format_string(f"%{'+' if sign else ''}.{places}f", value.cast("double"))


def encoded(content: Column) -> Column:
    """Bytes as base64."""
    return F.base64(content)
