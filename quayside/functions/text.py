"""String predicates and guarded casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accepted shapes -------------------------------------------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
UNSIGNED_18_DIGITS = r"\A[0-9]{1,18}\z"
ISO_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
OPERATION_ID = r"\A[a-z][a-z0-9_]{0,63}\z"
# One part of a path: no separators, and neither the folder itself nor the one above.
PATH_PART = r"\A(?!\.{1,2}\z)[^/\\]+\z"
IDENTIFIER = r"\A[A-Za-z_][A-Za-z0-9_]*\z"
XML_FILE = r"(?i)\.xml\z"


def missing(column: Column | str) -> Column:
    """NULL, empty, or nothing but (Unicode) white space. Trimming stops at the first other character, which
    costs less than a pattern."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNull() | (F.ltrim(column, F.lit(WHITE_SPACE)) == "")


def full_match(column: Column, pattern: str) -> Column:
    """Whole-value match; NULL never matches. ``pattern`` carries its own \\A and \\z."""
    return F.coalesce(column.rlike(pattern), F.lit(False))


def strict_quantity(column: Column) -> Column:
    """1 to 18 ASCII digits as LONG, everything else NULL; the guard keeps the ANSI cast from failing."""
    return F.when(full_match(column, UNSIGNED_18_DIGITS), column.cast("long"))


def iso_date(column: Column) -> Column:
    """True for a real calendar date written as YYYY-MM-DD."""
    return full_match(column, ISO_DATE) & F.try_to_date(column, "yyyy-MM-dd").isNotNull()


def safe_segment(column: Column) -> Column:
    """True where a value may be one part of a path."""
    return full_match(column, PATH_PART)


def long_or_null(total: Column, limit: int) -> Column:
    """Decimal total as LONG where it fits."""
    return F.when(total <= F.lit(limit), total.cast("long"))


def backoff_seconds(delay: Column, factor: Column, attempt: Column, ceiling: Column) -> Column:
    """Delay before the attempt after ``attempt``: grows by ``factor`` and stops at ``ceiling``."""
    return F.least(ceiling, delay * F.pow(factor, attempt - F.lit(1)))


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root``, whatever the scheme prefix Spark reports."""
    bare = F.regexp_replace(path, r"\A[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    tail = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    clean = "/" + tail.strip("/") + "/"
    return F.when(bare.startswith(clean), F.substring(bare, len(clean) + 1, 1 << 30)).otherwise(bare)
