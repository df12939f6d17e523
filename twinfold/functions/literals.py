"""Literal token patterns and their comparison keys.

The patterns below are fixed values: they decide which spans count as numbers,
units, codes and markers. They use Java syntax with explicit Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinfold.functions import text as tx

# ---- fixed values: numbers -------------------------------------------------
_ND = r"\p{Nd}"
_SEPARATORS = r".,٫٬"
_SIGNS = r"+\-−±"
DECIMAL = (
    rf"(?:(?<![\p{{L}}\p{{N}}.,])[{_SIGNS}])?"
    rf"(?:(?<![\p{{L}}\p{{N}}{_SEPARATORS}])[.٫]{_ND}+|{_ND}+(?:[{_SEPARATORS}]{_ND}+)*)"
)
UNIT_SYMBOLS = r"(?:[μµ]g|[μµ][Ll]|mg|mm|cm|m[Ll]|%)"
SCOPE_UNIT_SYMBOLS = r"(?:mg|mm|cm|m[Ll]|%)"
_SCI_START = rf"(?<![\p{{L}}\p{{N}}_{_SEPARATORS}])[{_SIGNS}]?"
_SCI_BODY = rf"(?:{_ND}+(?:[.٫]{_ND}+)?|[.٫]{_ND}+)[eE][+\-−]?{_ND}+"


def _sci_end(units: str) -> str:
    return rf"(?![{_SEPARATORS}]{_ND})(?:(?![\p{{L}}\p{{N}}_])|(?={units}(?![A-Za-z])))"


# A cheap first-character test keeps the look-behinds off most positions.
_NUMERIC_FIRST = rf"(?=[{_SIGNS}{_SEPARATORS}\p{{Nd}}])"
SCIENTIFIC = _SCI_START + _SCI_BODY + _sci_end(UNIT_SYMBOLS)
SCOPE_SCIENTIFIC = _SCI_START + _SCI_BODY + _sci_end(SCOPE_UNIT_SYMBOLS)
SCIENTIFIC_CANDIDATE = (
    _NUMERIC_FIRST
    + _SCI_START
    + rf"(?:{_ND}+(?:[{_SEPARATORS}]{_ND}+)*|[{_SEPARATORS}]{_ND}+)[eE][+\-−]?{_ND}*"
    + rf"(?:[{_SEPARATORS}]{_ND}+)*(?!{_ND})"
)
NUMBER = rf"{_NUMERIC_FIRST}(?:{SCIENTIFIC}|{DECIMAL})"
SCIENTIFIC = _NUMERIC_FIRST + SCIENTIFIC
SCOPE_SCIENTIFIC = _NUMERIC_FIRST + SCOPE_SCIENTIFIC
_SCI_VALUE = r"^([+\-±]?)(\d+(?:\.\d+)?|\.\d+)[eE]([+\-]?\d+)\z"
EXPONENT_LIMIT = 100

# ---- fixed values: units ---------------------------------------------------
UNIT = rf"(?=[μµmc%])(?<!\p{{L}}){UNIT_SYMBOLS}(?![A-Za-z])"
UNIT_PAIR = (
    rf"(?U){_NUMERIC_FIRST}(?<![\p{{N}}{_SEPARATORS}]){NUMBER}(?:\s*|-(?=[A-Za-zμµ])){UNIT_SYMBOLS}(?![A-Za-z])"
)
SCOPE_UNIT_PAIR = rf"(?U){_NUMERIC_FIRST}(?<![\p{{N}}{_SEPARATORS}]){NUMBER}\s*{SCOPE_UNIT_SYMBOLS}(?![A-Za-z])"

# ---- fixed values: codes ---------------------------------------------------
_CODE_EDGE = r"A-Za-z0-9_\-‐‑"
_CODE_JOIN = (
    r"[_*\p{S}\p{N}\p{Pd}\p{M}]|[\p{L}&&[^가-힣؀-ۿ]]|[\x{10000}-\x{10FFFF}]"
)
IDENTIFIER = (
    rf"(?=[A-Z])(?<![{_CODE_EDGE}])(?<!{_CODE_JOIN}|[./:])"
    r"[A-Z]{2,8}(?:[\-‐‑][A-Z]{1,4})?[\-‐‑]?[0-9]{1,4}[A-Z]{0,3}"
    rf"(?![{_CODE_EDGE}])(?!{_CODE_JOIN}|/)(?![.:][\p{{L}}\p{{N}}])"
)

# ---- fixed values: frequency alias ----------------------------------------
ONCE_DAILY = r"(?iU)(?=o)\bonce\s+daily\b"
KO_ONCE_DAILY = r"(?U)(?=1)(?<!\S)1\s*일\s*1\s*회(?![\p{L}\p{N}_]|[.,٫٬]\p{Nd})"


def scientific_key(token: Column) -> Column:
    """Canonical ``<sign><coefficient>e<power>``; NULL when out of range or malformed.

    ``token`` holds ASCII digits already, see :func:`plain_tokens`.
    """
    plain = F.translate(token, "٫", ".")
    sign = F.regexp_extract(plain, _SCI_VALUE, 1)
    mantissa = F.regexp_extract(plain, _SCI_VALUE, 2)
    exponent = F.regexp_extract(plain, _SCI_VALUE, 3).try_cast("int")
    fraction = F.length(F.regexp_extract(plain, r"\.(\d+)[eE]", 1))
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "")
    trimmed = F.regexp_replace(digits, r"0+\z", "")
    power = exponent - fraction + F.length(digits) - F.length(trimmed)
    body = F.when(F.length(digits) == 0, F.lit("0e0")).otherwise(
        F.concat(trimmed, F.lit("e"), power.cast("string"))
    )
    usable = exponent.isNotNull() & (F.abs(exponent) <= EXPONENT_LIMIT)
    return F.when(usable, F.concat(sign, body))


def _decimal_key(token: Column) -> Column:
    led = F.regexp_replace(token, r"^(?<s>[+\-±]?)[.٫](?=\d)", "${s}0.")
    return F.regexp_replace(led, r"^(?<i>[+\-±]?\d+)[,٫](?<f>\d{1,2})\z", "${i}.${f}")


def number_key(token: Column) -> Column:
    """Comparison key of a number token with ASCII digits; integers skip every rewrite."""
    return (
        F.when(token.rlike(r"^[0-9]+\z"), token)
        .when(token.rlike("[eE]"), F.coalesce(scientific_key(token), _decimal_key(token)))
        .otherwise(_decimal_key(token))
    )


def plain_tokens(tokens: Column) -> Column:
    """Digits of every token to ASCII, in one pass over the list."""
    return F.transform(tokens, tx.ascii_digits)


def unit_key(symbol: Column) -> Column:
    """Micro sign and litre aliases folded to one spelling."""
    folded = F.translate(symbol, "µ", "μ")
    return (
        F.when(folded == "ml", F.lit("mL")).when(folded == "μl", F.lit("μL")).otherwise(folded)
    )


def pair_key(token: Column) -> Column:
    """``<number key> <unit key>`` of an adjacent number and unit (ASCII digits)."""
    number = F.regexp_replace(token, rf"(?U)(?:\s*|-){UNIT_SYMBOLS}\z", "")
    unit = F.regexp_extract(token, rf"({UNIT_SYMBOLS})\z", 1)
    return F.concat(number_key(number), F.lit(" "), unit_key(unit))


def identifier_key(token: Column) -> Column:
    return F.translate(token, "‐‑", "--")


def comparable_draft(source: Column, draft: Column, lang: Column) -> Column:
    """Blank a Korean once-daily spelling when both sides hold it equally often."""
    wanted = tx.count_matches(source, ONCE_DAILY)
    same = (lang == "ko") & (wanted > 0) & (wanted == tx.count_matches(draft, KO_ONCE_DAILY))
    return F.when(same, F.regexp_replace(draft, KO_ONCE_DAILY, " ")).otherwise(draft)
