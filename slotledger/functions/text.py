"""Tagged assistant text and loosely formed JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotledger import fixed_values as fv

_STRICT = {"allowSingleQuotes": "false"}
_LITERAL = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def strip(text: Column, characters: str = fv.WHITESPACE) -> Column:
    return F.btrim(text, F.lit(characters))


def remove_all(text: Column, patterns: tuple[str, ...]) -> Column:
    """Remove each pattern in turn."""
    return reduce(lambda t, pattern: F.regexp_replace(t, pattern, ""), patterns, text)


def block(text: Column, pattern: str) -> Column:
    """First tagged block without code fences and outer white space; null if there is none."""
    body = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))
    unfenced = F.replace(
        F.replace(strip(body), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")
    )
    return strip(unfenced)


def is_json(text: Column, options: dict[str, str] = _STRICT) -> Column:
    """Whether ``text`` is exactly one JSON value.

    The JSON parser ignores whatever follows the first value, so the text is
    tried both as a list element and as an object member: only a single value
    fits in both places.
    """
    as_element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", options)
    as_member = F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", options
    )
    return as_element.isNotNull() & as_member.isNotNull()


def plain_text(value: Column) -> Column:
    """A JSON value (VARIANT) as text: True, False, None, or its own text."""
    kind = F.schema_of_variant(value)
    text = value.cast("string")
    return (
        F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
    )


#: What follows holds only whole quoted strings.
_OUTSIDE_QUOTES = r"""(?=(?:[^'"]++|'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")*+\z)"""


def scalar_text(value: Column, own: Column) -> Column:
    """``plain_text`` of a variant whose JSON text is ``own``: a number keeps its fraction.

    A whole number is as written; a number with a fraction is written without
    trailing zeros but for one, as long as it needs no exponent.
    """
    number = own.cast("double")
    plain = own.rlike(r"^-?\d+\.\d+$") & (
        (number == 0) | F.abs(number).between(1e-4, 9.999999e15)
    )
    return (
        F.when(own.rlike(r"^-?\d+$") & (own != "-0"), own)
        .when(plain, F.regexp_replace(own, r"(\.\d+?)0+$", "$1"))
        .otherwise(plain_text(value))
    )


def _element_texts(text: Column, options: dict[str, str]) -> Column:
    values = F.from_json(text, "array<variant>", options)
    owns = F.from_json(text, "array<string>", options)

    def element(value: Column, own: Column) -> Column:
        quoted = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))
        return F.when(quoted, own).otherwise(scalar_text(value, own))

    return F.zip_with(values, owns, element)


def string_list(text: Column) -> Column:
    """Items of a bracketed list: JSON, else a quoted literal list, else split at commas.

    Text that is not in brackets has no items.
    """
    bracketed = text.startswith("[") & text.endswith("]")
    literal = F.regexp_replace(text, r",\s*\]\z", "]")
    for word, value in (("None", "null"), ("True", "true"), ("False", "false")):
        literal = F.regexp_replace(literal, rf"\b{word}\b{_OUTSIDE_QUOTES}", value)
    pieces = F.split(strip(text, "[]"), ",")
    cleaned = F.filter(
        F.transform(pieces, lambda p: strip(strip(strip(p), '"'), "'")), lambda p: p != ""
    )
    return (
        F.when(~bracketed, F.array().cast("array<string>"))
        .when(is_json(text), _element_texts(text, _STRICT))
        .when(is_json(literal, _LITERAL), _element_texts(literal, _LITERAL))
        .otherwise(cleaned)
    )


def csv_cell(value: Column) -> Column:
    """One CSV field, quoted only where it must be; empty for null."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(value.rlike('[",\r\n]'), quoted).otherwise(value), F.lit(""))
