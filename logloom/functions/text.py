"""Text predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space when testing for blank.
_NOT_BLANK = r"[^\t\n\x0B\f\r\x{FEFF}\x{2028}\x{2029}\p{Zs}]"
_BLANK_ON_DRIVER = re.compile(
    "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]*"
)


def has_text(value: Column) -> Column:
    """True if some character is not white space."""
    return value.rlike(_NOT_BLANK)


def is_blank(text: str) -> bool:
    """The opposite of :func:`has_text`, for an argument."""
    return _BLANK_ON_DRIVER.fullmatch(text) is not None


def escape_like(term: str) -> str:
    """Make every character of ``term`` stand for itself in a LIKE pattern."""
    return re.sub(r"([\\%_])", r"\\\1", term)


def contains_ignoring_case(value: Column, term: str) -> Column:
    """True if the term is in the text, character for character but for case."""
    return F.lower(value).contains(F.lower(F.lit(term)))
