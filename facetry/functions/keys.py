"""Scalar expressions for keys and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The full-width digits and the ASCII digits they stand for.
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def feature_number(key: Column) -> Column:
    """The integer a feature key spells, else NULL.

    Read are plain and zero-padded digits, full-width digits, surrounding white space,
    a prefix of letters with an optional ``_`` or ``-`` (``f22``, ``feature_22``,
    ``F-0022``) and a fraction of zeros (``22.0``). Anything else (null, empty, ``-``,
    ``n/a``, ``nan``, ``1.5``) has no number.
    """
    plain = F.translate(key, WIDE_DIGITS, DIGITS)
    digits = F.regexp_extract(plain, r"^\s*(?:[A-Za-z]+[_\- ]?)?(\d+)(?:\.0*)?\s*$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def usable(weight: Column) -> Column:
    """``weight`` with NaN read as NULL."""
    return F.when(~F.isnan(weight), weight)
