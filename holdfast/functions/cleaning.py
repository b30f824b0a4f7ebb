"""Column expressions that turn raw columns into typed features. All of them stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The characters str.strip() removes, in code point order.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed pattern: a decimal number, with an exponent or not, between spaces and control characters.
NUMBER = r"^[\x00-\x20]*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?[\x00-\x20]*$"
# Fixed pattern: runs of characters that are no letter, digit or underscore in any script.
NON_WORD = r"[^\p{L}\p{N}_]+"


def _column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_boolean(column: ColumnOrName, true_value: Any = 1, null_safe: bool = False) -> Column:
    """True where the flag equals ``true_value``; NULL stays NULL, or with ``null_safe`` is compared as a value."""
    flag = _column(column)
    return flag.eqNullSafe(F.lit(true_value)) if null_safe else flag == F.lit(true_value)


def map_category(column: ColumnOrName, mapping: Mapping[Any, Any], default: Any = None) -> Column:
    """Replace each category by its value; unmapped categories and NULL become ``default``."""
    if not mapping:
        raise ValueError("map_category needs at least one category")
    source = _column(column)
    result: Column | None = None
    for category, value in mapping.items():
        step = source == F.lit(category)
        result = F.when(step, F.lit(value)) if result is None else result.when(step, F.lit(value))
    return result if default is None else result.otherwise(F.lit(default))


def blank(column: ColumnOrName) -> Column:
    """True for an empty or spaces-only string; NULL for NULL."""
    return F.length(F.trim(_column(column))) == 0


def clean_numeric(column: ColumnOrName, blank_value: float = 0.0) -> Column:
    """String to double: blanks become ``blank_value``, text that is no number becomes NULL."""
    source = _column(column)
    return F.when(blank(source), F.lit(float(blank_value))).otherwise(to_number(source))


def to_number(column: ColumnOrName) -> Column:
    """String to double, NULL for text that is no decimal number.

    The cast alone would also take suffixes (``12d``), hexadecimal floats, and the names of NaN and infinity; none of
    these is an amount, so they are NULL. Looking first also spares the cast of words, which fails by an exception.
    """
    source = _column(column)
    return F.when(source.rlike(NUMBER), source.try_cast("double"))


def finite(value: Column) -> Column:
    """The number, or NULL where it is NaN or infinite."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def assign_value(column: ColumnOrName, mask: Column, value: Any) -> Column:
    """``value`` where the mask is true, the old value where it is false or NULL."""
    return F.when(mask, value if isinstance(value, Column) else F.lit(value)).otherwise(_column(column))


def strip_whitespace(column: ColumnOrName) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(_column(column), F.lit(WHITESPACE))


def sanitise(column: ColumnOrName) -> Column:
    """Replace every run of non-word characters by one underscore."""
    return F.regexp_replace(_column(column), NON_WORD, "_")
