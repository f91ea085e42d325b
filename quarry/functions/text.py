"""Column functions: text, truncation and small formats. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, runs of anything but letters, digits and _ as one space."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(normalized(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def without(tokens: Column, stopwords: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stopwords)) if stopwords else tokens


def truncated(x: Column, digits: int) -> Column:
    """A number of 0 or more, cut to so many decimals."""
    return F.floor(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def snapped(x: Column, digits: int) -> Column:
    """The same, but what rounding has left a hair below a step counts as on it: sums in any order are cut alike."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(1e-6)) / F.lit(10.0**digits)


def as_bool(text: Column) -> Column:
    return F.lower(text).isin("yes", "true", "t", "1")


def flat_index(col: Column, row: Column, items: Column | int) -> Column:
    """Place of a cell in a matrix laid out row by row."""
    return col + row * items


def token_line(stem: Column, cnt: Column, tf: Column, idf: Column, tf_idf: Column) -> Column:
    return F.format_string("%-20s count: %3d  tf: %.5f  idf: %.5f  tf-idf: %.5f", stem, cnt, tf, idf, tf_idf)


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))
