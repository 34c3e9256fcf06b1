"""Article ids: typed unevenly, equal when their numbers are equal."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def article_key(col: Column | str) -> Column:
    """The number in a typed id, without leading zeros; null where there is no digit.

    >>> "PMID: 0012" and "[12]" give "12"; null, "" and "n/a" give null; "000" gives "0".
    """
    digits = F.regexp_extract(F.col(col) if isinstance(col, str) else col, r"([0-9]+)", 1)
    bare = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return F.when(bare != "", bare)


#: The same in the oracle's dialect.
ARTICLE_KEY_SQL = "nullif(regexp_replace(regexp_extract({0}, '([0-9]+)', 1), '^0+([0-9])', '\\1'), '')"
