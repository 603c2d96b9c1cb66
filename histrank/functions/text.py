"""Cleaning of titles and descriptions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean_text(x: Column) -> Column:
    """Text without tags and the two common entities, white space collapsed; null becomes empty."""
    x = F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def clean_sentence(x: Column, limit: int = 2000) -> Column:
    """Cleaned text that ends in exactly one full stop; empty if it is longer than the limit."""
    text = F.regexp_replace(clean_text(x), r"[.]*$", "")
    return F.when((text == "") | (F.length(text) >= limit), F.lit("")).otherwise(F.concat(text, F.lit(".")))


def longest_part(parts: Column, default: Column) -> Column:
    """The longest non-blank part, ties to the smaller text; default if there is none."""
    filled = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    ordered = F.array_sort(F.transform(filled, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    return F.coalesce(F.get(ordered, F.lit(0))["p"], default)


def price(x: Column) -> Column:
    """The number in a price text; 0 if it is none."""
    return F.coalesce(F.replace(F.replace(x, F.lit("$"), F.lit("")), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def flat_categories(nested: Column) -> Column:
    """The categories of all levels joined by commas, less those with a closing span; null lists give an empty text."""
    kept = F.filter(F.transform(F.flatten(nested), lambda c: F.trim(c)), lambda c: ~F.contains(c, F.lit("</span>")))
    return F.coalesce(F.array_join(kept, ","), F.lit(""))


def image_urls(images: Column) -> Column:
    """Of each image (hi_res, large, thumb) the first address that isn't empty."""
    return F.transform(images, lambda i: F.coalesce(F.nullif(i["hi_res"], F.lit("")), F.nullif(i["large"], F.lit("")), i["thumb"]))


def drop_words(text: Column, key: Column, share: float) -> Column:
    """text less about `share` of its words, chosen by a hash of key and position, so the same on every run."""
    def code(i: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(":"), i.cast("string")), 256), 1, 8), 16, 10).cast("bigint")

    words = F.transform(F.split(text, " ", -1), lambda w, i: F.struct(w.alias("w"), code(i).alias("c")))
    return F.array_join(F.transform(F.filter(words, lambda x: x["c"] > int(share * 2**32)), lambda x: x["w"]), " ")


@F.pandas_udf(StringType())
def _unescape(x: pd.Series) -> pd.Series:
    return x.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def clean_text_unescaped(x: Column) -> Column:
    """Text without tags, all entities resolved, white space of Unicode collapsed; null becomes empty."""
    return F.trim(F.regexp_replace(_unescape(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", "")), r"(?U)\s+", " "))
