"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, sequence_id long"


def documents(spark):
    """Nulls, empty and very long texts, repeated rows, special tokens, odd white space, clashing extra columns."""
    long = "word and Another, thing. " * 3000
    texts = ["", None, "Hello  world\n\n x", "don't 're <|endoftext|> stop<|startoftext|>", "日本語 テキスト é́ ﬁ  　a\tb", long, "x" * 3000, " lead and trail ", "same text here", "same text here", "12 345 6.7 !!! ..", "\x00\x01 zero", "👍🏽 emoji 👨‍👩‍👧", "a" + " " * 50 + "b"]
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t), 1.0, "x", 3) for i, t in enumerate(texts)]
    rows += [rows[2], (None, "no id at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)
