"""Scalar functions that differ from Spark's built-ins of the same name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_empty(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def first_line(c: Column) -> Column:
    return F.split_part(strip(c), F.lit("\n"), F.lit(1))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def url_quote(c: Column) -> Column:
    """Percent-encoding that keeps "/" and writes blanks as %20."""
    e = F.url_encode(c)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def two_decimals(c: Column) -> Column:
    """Half-even rounding to two places, as text."""
    return F.replace(F.format_number(F.bround(c, 2), 2), F.lit(","), F.lit(""))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0.0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def first_arg_max(a: Column) -> Column:
    """1-based place of the largest element; the first on ties."""
    return F.array_position(a, F.array_max(a)).cast("int")


def file_stem_id(path: Column) -> Column:
    """All digits of a file's stem joined, or the stem itself where there is none."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    digits = F.regexp_replace(stem, r"\P{Nd}", "")
    return F.when(digits == "", stem).otherwise(digits)


def version_number(prefix: Column) -> Column:
    """The number of a versioned prefix such as "X12.10/"; -1 where there is none."""
    return F.coalesce(F.regexp_extract(prefix, r"\.(\d+)/$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
