"""String cleanup and deterministic key helpers (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes for ASCII text; Spark's trim() only
# removes spaces, so both layers strip this set explicitly.
WHITESPACE = " \t\n\r\f\u000b"

KEY_SEPARATOR = "||"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col: str | Column) -> Column:
    """Remove leading/trailing whitespace (space, tab, newline, CR, FF, VT)."""
    return F.btrim(_c(col), F.lit(WHITESPACE))


def blank_to_null(col: str | Column) -> Column:
    """Stripped value, or NULL when nothing is left."""
    s = strip_ws(col)
    return F.when(s != "", s)


def token_to_null(col: str | Column, tokens) -> Column:
    """Stripped value, or NULL when it is blank or one of ``tokens``."""
    s = strip_ws(col)
    return F.when(~s.isin(list(tokens)), s)


def norm(col: str | Column) -> Column:
    """Normalised name part: stripped and lower-cased."""
    return F.lower(strip_ws(col))


def surrogate_id(key: Column) -> Column:
    """sha-256 hex of a path key; NULL key gives NULL id."""
    return F.when(key.isNotNull(), F.sha2(key, 256))
