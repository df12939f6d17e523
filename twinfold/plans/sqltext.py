"""SQL text builders for the comparison queries.

The comparison engine has no look-around in its patterns, so each pattern here
consumes its boundary instead and captures the token. Separators are doubled
first, which leaves a boundary for the next token.
"""

from __future__ import annotations

from twinfold.functions import text as tx

_SEP = ".,٫٬"
_SIGN = r"+\-−±"
_ND = r"\p{Nd}"
_PLAIN = rf"{_ND}+(?:[{_SEP}]{_ND}+)*"
_SCI = rf"(?:{_ND}+(?:[.٫]{_ND}+)?|[.٫]{_ND}+)[eE][+\-−]?{_ND}+"
UNITS = "(?:[μµ]g|[μµ][Ll]|mg|mm|cm|m[Ll]|%)"
_WORD_UNITS = "(?:[μµ]g|[μµ][Ll]|mg|mm|cm|m[Ll])"
_SCI_END = rf"(?:$|[^\p{{L}}\p{{N}}_{_SEP}]|[{_SEP}](?:$|[^\p{{Nd}}])|{UNITS}(?:$|[^A-Za-z]))"
_NUMBER = (
    rf"(?:^|[^\p{{L}}\p{{N}}_{_SEP}])([{_SIGN}]?{_SCI}){_SCI_END}"
    rf"|(?:^|[^\p{{L}}\p{{N}}.,])([{_SIGN}](?:[.٫]{_ND}+|{_PLAIN}))"
    rf"|(?:^|[^\p{{L}}\p{{N}}{_SEP}])([.٫]{_ND}+)|({_PLAIN})"
)
_CANDIDATE = (
    rf"(?:^|[^\p{{L}}\p{{N}}_{_SEP}])([{_SIGN}]?(?:{_PLAIN}|[{_SEP}]{_ND}+)[eE][+\-−]?{_ND}*(?:[{_SEP}]{_ND}+)*)"
)
_PAIR = (
    rf"(?:^|[^\p{{L}}\p{{N}}{_SEP}])([{_SIGN}](?:{_SCI}|{_PLAIN}|[.٫]{_ND}+)(?:\s*|-){UNITS})(?:$|[^A-Za-z])"
    rf"|(?:^|[^\p{{L}}\p{{N}}{_SEP}])([.٫]{_ND}+(?:[eE][+\-−]?{_ND}+)?(?:\s*|-){UNITS})(?:$|[^A-Za-z])"
    rf"|(?:^|[^\p{{N}}{_SEP}])((?:{_SCI}|{_PLAIN})(?:\s*|-){UNITS})(?:$|[^A-Za-z])"
)
_CODE = (
    r"(?:^|[^A-Za-z0-9_\-‐‑*\p{S}\p{N}\p{Pd}\p{M}./:\p{L}]|[가-힣؀-ۿ])"
    r"([A-Z]{2,8}(?:[\-‐‑][A-Z]{1,4})?[\-‐‑]?[0-9]{1,4}[A-Z]{0,3})"
    r"(?:$|[^A-Za-z0-9_\-‐‑*\p{S}\p{N}\p{Pd}\p{M}/.:\p{L}]|[가-힣؀-ۿ]|[.:](?:$|[^\p{L}\p{N}]))"
)


def doubled(text: str) -> str:
    return rf"regexp_replace({text}, '([^\p{{L}}\p{{N}}_.,٫٬+\-−±%])', '\1\1', 'g')"


def _joined(text: str, pattern: str, groups: int) -> str:
    parts = ", ".join(f"regexp_extract_all({text}, '{pattern}', {g})" for g in range(1, groups + 1))
    if groups == 1:
        return parts
    cat = " || ".join(f"coalesce(z[{g}], '')" for g in range(1, groups + 1))
    return f"list_transform(list_zip({parts}), lambda z: {cat})"


def number_tokens(text: str) -> str:
    return _joined(doubled(text), _NUMBER, 4)


def sci_tokens(text: str) -> str:
    return f"list_filter({_joined(doubled(text), _NUMBER, 1)}, lambda t: coalesce(t, '') <> '')"


def sci_candidates(text: str) -> str:
    return _joined(doubled(text), _CANDIDATE, 1)


def pair_tokens(text: str) -> str:
    collapsed = f"list_transform({_joined(doubled(text), _PAIR, 3)}, lambda t: regexp_replace(t, '(\\s)\\s', '\\1', 'g'))"
    return collapsed


def code_tokens(text: str) -> str:
    return _joined(doubled(text), _CODE, 1)


def word_unit_tokens(text: str) -> str:
    return _joined(doubled(text), rf"(?:^|[^\p{{L}}])({_WORD_UNITS})(?:$|[^A-Za-z])", 1)


def percent_count(text: str) -> str:
    """Per cent signs with no letter before and no ASCII letter after."""
    wide = f"replace(regexp_replace({text}, '(\\p{{L}})', '\\1\\1', 'g'), '%', '<%>')"

    def n(pattern: str) -> str:
        return f"len(regexp_extract_all({wide}, '{pattern}'))"

    return f"({n('<%>')} - {n('[' + chr(92) + 'p{L}]<%>')} - {n('<%>[A-Za-z]')} + {n('[' + chr(92) + 'p{L}]<%>[A-Za-z]')})"


def ascii_digits(text: str) -> str:
    return f"translate({text}, '{tx._WIDE_DIGITS}−', '{tx._ASCII_DIGITS}-')"


def sci_key(token: str) -> str:
    """Canonical scientific key; NULL when not scientific."""
    plain = f"translate({ascii_digits(token)}, '٫', '.')"
    shape = r"^([+\-±]?)(\d+(?:\.\d+)?|\.\d+)[eE]([+\-]?\d+)$"
    sign, mant = (f"regexp_extract({plain}, '{shape}', {g})" for g in (1, 2))
    power = f"TRY_CAST(regexp_extract({plain}, '{shape}', 3) AS INTEGER)"
    digits = f"ltrim(replace({mant}, '.', ''), '0')"
    trimmed = f"rtrim({digits}, '0')"
    fraction = f"length(regexp_extract({mant}, '\\.(\\d+)$', 1))"
    moved = f"({power} - {fraction} + length({digits}) - length({trimmed}))"
    return (
        f"CASE WHEN {mant} <> '' AND abs({power}) <= 100 THEN {sign} || CASE WHEN {digits} = '' THEN '0e0' "
        f"ELSE {trimmed} || 'e' || CAST({moved} AS VARCHAR) END END"
    )


def number_key(token: str) -> str:
    plain = ascii_digits(token)
    led = f"regexp_replace({plain}, '^([+\\-±]?)[.٫](\\d)', '\\g<1>0.\\2')".replace("\\g<1>", "\\1")
    short = f"regexp_matches({led}, '^[+\\-±]?\\d+[,٫]\\d{{1,2}}$')"
    plain_key = f"CASE WHEN {short} THEN translate({led}, ',٫', '..') ELSE {led} END"
    return (
        f"CASE WHEN regexp_matches({token}, '^[0-9]+$') THEN {token} "
        f"WHEN regexp_matches({token}, '[eE]') THEN coalesce({sci_key(token)}, {plain_key}) ELSE {plain_key} END"
    )


def unit_key(symbol: str) -> str:
    folded = f"translate({symbol}, 'µ', 'μ')"
    return f"CASE {folded} WHEN 'ml' THEN 'mL' WHEN 'μl' THEN 'μL' ELSE {folded} END"


def pair_key(token: str) -> str:
    number = f"regexp_replace({token}, '(?:\\s*|-){UNITS}$', '')"
    unit = f"regexp_extract({token}, '({UNITS})$', 1)"
    return f"{number_key(number)} || ' ' || {unit_key(unit)}"


def keyed(tokens: str, key) -> str:
    return f"list_transform({tokens}, lambda k: {key('k')})"


def differs(own: str, other: str) -> str:
    return f"(list_sort({own}) IS DISTINCT FROM list_sort({other}))"


def first_excess(raw: str, own: str, other: str) -> str:
    more = (
        f"len(list_filter({own}, lambda a: a = {own}[i])) > len(list_filter({other}, lambda b: b = {own}[i]))"
    )
    return f"{raw}[list_filter(range(1, len({raw}) + 1), lambda i: {more})[1]]"


def words(text: str) -> str:
    """Text in which every non-ASCII letter or mark is an ASCII letter, so that \\b holds."""
    return rf"regexp_replace(regexp_replace({text}, '[^\P{{L}}A-Za-z]', 'z', 'g'), '\p{{M}}', 'z', 'g')"


ONCE_DAILY = r"(?i)\bonce\s+daily\b"


def once_daily_count(text: str) -> str:
    return f"len(regexp_extract_all({words(text)}, '{ONCE_DAILY}'))"


def ko_once_daily_count(text: str) -> str:
    wide = f"regexp_replace({text}, '(\\s)', '\\1\\1', 'g')"
    return f"len(regexp_extract_all({wide}, '(?:^|\\s)1\\s*일\\s*1\\s*회(?:$|[^\\p{{L}}\\p{{N}}_.,])'))"


def numeric_draft(source: str, draft: str, lang: str) -> str:
    return (
        f"CASE WHEN {lang} = 'ko' AND {once_daily_count(source)} > 0 AND {once_daily_count(source)} = {ko_once_daily_count(draft)} "
        f"THEN regexp_replace({draft}, '(^|\\s)1\\s*일\\s*1\\s*회($|[^\\p{{L}}\\p{{N}}_.,])', '\\1 \\2', 'g') ELSE {draft} END"
    )
