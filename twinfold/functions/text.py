"""Unicode-aware text expressions built from JVM functions only."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _decimal_digits() -> tuple[str, str]:
    """Every decimal digit outside ASCII and its ASCII value, found by rule."""
    found = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


_WIDE_DIGITS, _ASCII_DIGITS = _decimal_digits()
MINUS_SIGN = "−"


def ascii_digits(text: Column) -> Column:
    """All decimal digits to ASCII and the minus sign to a hyphen."""
    return F.translate(text, _WIDE_DIGITS + MINUS_SIGN, _ASCII_DIGITS + "-")


def strip_space(text: Column) -> Column:
    """Trim any Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)^\s*\z")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def matches(text: Column, pattern: str) -> Column:
    """All full matches in text order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def occurrences(text: Column, literal: Column) -> Column:
    """How often a literal occurs without overlap."""
    gone = F.replace(text, literal, F.lit(""))
    return F.when(F.length(literal) == 0, F.lit(0)).otherwise(
        ((F.length(text) - F.length(gone)) / F.length(literal)).cast("int")
    )


def sentences(text: Column) -> Column:
    """Non-empty trimmed sentences; a stop followed by space ends one."""
    parts = F.split(text, r"(?U)(?<=[.!?。！？])\s+")
    return F.filter(F.transform(parts, strip_space), lambda s: F.length(s) > 0)


def collapse_space(text: Column) -> Column:
    return strip_space(F.regexp_replace(text, r"(?U)\s+", " "))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _normal_form(form: str):
    @F.pandas_udf(T.StringType())
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return apply


def nfkc(text: Column) -> Column:
    """NFKC; ASCII text keeps its value, though Spark hands every row to the Python helper."""
    return F.when(text.rlike(r"^[\x00-\x7F]*\z"), text).otherwise(_normal_form("NFKC")(text))


def nfc(text: Column) -> Column:
    return F.when(text.rlike(r"^[\x00-\x7F]*\z"), text).otherwise(_normal_form("NFC")(text))
