"""JSON values held as VARIANT: kinds, keys, and how a value reads as text."""

from __future__ import annotations

import math
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.timestamps import let

_NUMERIC = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def kind(value: Column) -> Column:
    """Type name of a variant, e.g. ``STRING``, ``BIGINT``, ``OBJECT<...>``."""
    return F.schema_of_variant(value)


def is_number(kind_name: Column) -> Column:
    return kind_name.rlike(_NUMERIC)


def is_absent(value: Column) -> Column:
    """True for a missing key and for a JSON null."""
    return value.isNull() | F.is_variant_null(value)


def empty_object() -> Column:
    return F.parse_json(F.lit("{}"))


def member(value: Column, key: str, as_type: str = "variant") -> Column:
    """Value of one key of an object, whatever characters the key has.

    A path goes straight to the key and lets a scan read just that key; only a key
    with both kinds of quotes has no path.
    """
    for quote in "'\"":
        if quote not in key:
            return F.try_variant_get(value, f"$[{quote}{key}{quote}]", as_type)
    found = value.try_cast("map<string,variant>").getItem(F.lit(key))
    return F.try_variant_get(found, "$", as_type)


# --- flat attribute objects ---------------------------------------------------

_FLAT, _FLAT_INEXACT, _NOT_FLAT = 0, 1, 2


def field_values(value: str) -> Column:
    """The values of an object's fields; NULL if it is not an object."""
    return F.expr(f"map_values(try_cast({value} AS MAP<STRING, VARIANT>))")


def attributes_class(values: str) -> Column:
    """Class of an attribute object, from its field values.

    0: flat as it is; 1: flat, but has numbers to round; 2: not a flat object.
    """
    # Text, booleans and integers a double can hold settle it in one pass.
    special = """CASE schema_of_variant(x)
        WHEN 'STRING' THEN false
        WHEN 'BOOLEAN' THEN false
        WHEN 'BIGINT' THEN try_variant_get(x, '$', 'bigint')
            NOT BETWEEN -9007199254740992 AND 9007199254740992
        ELSE true END"""
    # Decimals of up to 15 digits stay what they are.
    exact = r"schema_of_variant(x) RLIKE r'^DECIMAL\(([1-9]|1[0-5]),'"
    return F.expr(
        f"""CASE
        WHEN {values} IS NULL THEN {_NOT_FLAT}
        WHEN NOT exists({values}, x -> {special}) THEN {_FLAT}
        WHEN exists({values}, x -> schema_of_variant(x) RLIKE '^(OBJECT|ARRAY|VOID)')
          THEN {_NOT_FLAT}
        WHEN exists({values}, x -> {special} AND NOT {exact}) THEN {_FLAT_INEXACT}
        ELSE {_FLAT} END"""
    )


def is_flat(attribute_class: Column) -> Column:
    return attribute_class < _NOT_FLAT


def needs_rounding(attribute_class: Column) -> Column:
    return attribute_class == _FLAT_INEXACT


def round_numbers(attributes: str) -> Column:
    """The same flat object with every number as a double holds it.

    Integers are rounded to what a double can hold; an infinite number becomes null.
    """
    rounded = let(
        "d",
        "try_variant_get(x, '$', 'double')",
        """CASE WHEN abs(d) = DOUBLE('Infinity') THEN parse_json('null')
                WHEN abs(d) < 9223372036854775808D AND d = floor(d)
                  THEN CAST(try_cast(d AS BIGINT) AS VARIANT)
                ELSE CAST(d AS VARIANT) END""",
    )
    return F.expr(
        f"""to_variant_object(transform_values(
            try_cast({attributes} AS MAP<STRING, VARIANT>),
            (k, x) -> IF(schema_of_variant(x) RLIKE '{_NUMERIC}', {rounded}, x)))"""
    )


# --- a value as text ----------------------------------------------------------


# 0.DIGITS * 10**POINT, laid out by the size of POINT as script engines do it.
_LAYOUT = """CASE
    WHEN n <= s.point AND s.point <= 21 THEN rpad(s.digits, s.point, '0')
    WHEN s.point > 0 AND s.point <= 21
      THEN concat(left(s.digits, s.point), '.', substr(s.digits, s.point + 1))
    WHEN s.point > -6 AND s.point <= 0 THEN concat('0.', repeat('0', -s.point), s.digits)
    ELSE concat(left(s.digits, 1), IF(n > 1, '.', ''), substr(s.digits, 2),
                IF(s.point < 1, 'e-', 'e+'), abs(s.point - 1)) END"""
# The same two numbers, read off the text of a double such as 123.0 or 1.5E-7.
_DIGITS_AND_POINT = let(
    "m",
    """named_struct(
        'whole', substring_index(substring_index(text, 'E', 1), '.', 1),
        'part', substring_index(substring_index(text, 'E', 1), '.', -1),
        'power', IF(contains(text, 'E'), CAST(substring_index(text, 'E', -1) AS INT), 0))""",
    let(
        "written",
        "ltrim('0', concat(m.whole, m.part))",
        """named_struct(
            'digits', rtrim('0', written),
            'point', length(written) - length(m.part) + m.power)""",
    ),
)


def _number_sql(number: str) -> str:
    size = let(
        "text",
        "CAST(abs(d) AS STRING)",
        let("s", _DIGITS_AND_POINT, let("n", "length(s.digits)", _LAYOUT)),
    )
    return let(
        "d",
        number,
        f"""CASE WHEN d = 0 THEN '0'
            ELSE concat(IF(d < 0, '-', ''),
                        IF(abs(d) = DOUBLE('Infinity'), 'Infinity', {size})) END""",
    )


_SCALAR_TEXT = f"""CASE
    WHEN is_variant_null(x) THEN ''
    WHEN schema_of_variant(x) LIKE 'OBJECT%' THEN '[object Object]'
    WHEN schema_of_variant(x) RLIKE '{_NUMERIC}'
      THEN {_number_sql("try_variant_get(x, '$', 'double')")}
    ELSE try_variant_get(x, '$', 'string') END"""
# Replaces every array by its elements, an empty one by a null, if there is any.
_FLATTEN_ONCE = """IF(exists(xs, x -> schema_of_variant(x) LIKE 'ARRAY%'),
    flatten(transform(xs, x -> CASE
      WHEN schema_of_variant(x) NOT LIKE 'ARRAY%' THEN array(x)
      WHEN size(try_cast(x AS ARRAY<VARIANT>)) = 0 THEN array(parse_json('null'))
      ELSE try_cast(x AS ARRAY<VARIANT>) END)), xs)"""
# How deep brackets are nested, at most as deep as a body may be.
_DEPTH = """least(1000, aggregate(
    split(regexp_replace(to_json(v), r'[^\\[\\]]', ''), ''),
    named_struct('now', 0, 'most', 0),
    (d, c) -> named_struct(
      'now', d.now + CASE c WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END,
      'most', greatest(d.most, d.now + IF(c = '[', 1, 0))),
    d -> d.most))"""


def value_text(value: str) -> Column:
    """Text of a JSON value (not null) in a variant column.

    Array elements are joined by commas at any depth, nulls among them are empty. Every
    pass over the elements opens one level of nesting.
    """
    parts = f"aggregate(sequence(0, {_DEPTH}), array(v), (xs, _) -> {_FLATTEN_ONCE})"
    return F.expr(let("v", value, f"concat_ws(',', transform({parts}, x -> {_SCALAR_TEXT}))"))


# --- the same on the driver, for the value of one filter ----------------------

_NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?(e[+-][0-9]+)?")


def _driver_number_text(number: float) -> str:
    if number == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(number)).normalize().as_tuple()
    text = "".join(map(str, digits))
    point = len(text) + exponent
    if len(text) <= point <= 21:
        body = text.ljust(point, "0")
    elif 0 < point <= 21:
        body = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = f"0.{text.rjust(len(text) - point, '0')}"
    else:
        tail = f".{text[1:]}" if len(text) > 1 else ""
        body = f"{text[0]}{tail}e{point - 1:+d}"
    return ("-" if sign else "") + body


def exact_number(text: str) -> float | None:
    """The finite number whose usual text is exactly ``text``, if there is one."""
    if not _NUMBER.fullmatch(text):
        return None
    number = float(text)
    if math.isinf(number) or _driver_number_text(number) != text:
        return None
    return number


def equals_text(attributes: Column, key: str, text: str) -> Column:
    """True if the value stored under ``key``, read as text, is ``text``.

    The argument decides which kinds of value can match, so nothing is converted to
    text per row: each branch compares one typed value. Its kind is looked at only
    where that value is equal, to tell 3 from "3" and the like.
    """
    name = kind(member(attributes, key))
    matches = (member(attributes, key, "string") == F.lit(text)) & (name == "STRING")
    if text in ("true", "false"):
        wanted = F.lit(text == "true")
        matches |= (member(attributes, key, "boolean") == wanted) & (name == "BOOLEAN")
    number = exact_number(text)
    if number is not None:
        matches |= (member(attributes, key, "double") == F.lit(number)) & is_number(name)
    if text in ("Infinity", "-Infinity"):
        # A number too large for a double is stored as null.
        matches |= F.is_variant_null(member(attributes, key))
    return F.coalesce(matches, F.lit(False))
