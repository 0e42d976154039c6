"""Text expressions."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def doc_text(title: str = "title", summary: str = "summary") -> Column:
    """Title and summary with one space between, trimmed; nulls count as empty."""
    return F.trim(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(summary), F.lit(""))))


def unescape_basic(text: Column) -> Column:
    """The five XML entities and the blank, in an order that decodes each once."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def unescape_all(text: Column) -> Column:
    """Every character reference."""

    def decode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, StringType())(text)


def clean_text(text: Column | str, unescape=unescape_basic) -> Column:
    """Without tags, then with entities decoded, then with white space collapsed and trimmed."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")), r"\s+", " "))


def squish(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def fold_key(text: Column) -> Column:
    """Lower case without the eight kinds of space that a reader may type."""
    return F.lower(F.translate(text, " \t\r\n\x0b\x0c\u00a0\u3000", ""))


def grams2(text: Column | str) -> Column:
    """The set of pairs of neighbouring characters over letters and digits alone."""
    text = F.col(text) if isinstance(text, str) else text
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")
    n = F.length(s) - 1
    spots = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substr(s, i, F.lit(2))))


def ascii_only(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")
