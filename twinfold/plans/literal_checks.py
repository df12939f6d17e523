"""Queries of the literal checks over source and draft texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import literals as lit
from twinfold.functions import text as tx
from twinfold.operators.qc import checks, inventory
from twinfold.plans import sqltext as q
from twinfold.plans import tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.relation(spark, folder, "pairs")


_P = f"WITH p AS ({tables.ansi('pairs')}), "
_SIDES = (
    _P
    + f"n AS (SELECT *, {q.numeric_draft('source', 'draft', 'lang')} AS num FROM p), "
    + "s AS (SELECT pair_id, 'source' AS side, source AS t, source AS nt FROM n "
    + "UNION ALL SELECT pair_id, 'draft', draft, num FROM n), "
)


def _counted(tokens: str, key) -> str:
    return (
        f"k AS (SELECT pair_id, side, unnest({tokens}) AS tok FROM s) "
        f"SELECT pair_id, side, {key('tok')} AS key, count(*) AS n FROM k GROUP BY ALL"
    )


@query("number_inventory", _SIDES + _counted(q.number_tokens("nt"), q.number_key))
def number_inventory(spark, folder):
    return inventory.counted_inventory(inventory.prepare(pairs(spark, folder)), "numbers")


@query(
    "scientific_key",
    _SIDES
    + f"k AS (SELECT side, unnest({q.sci_tokens('nt')}) AS tok FROM s) "
    + f"SELECT side, {q.ascii_digits('tok')} AS token, {q.sci_key('tok')} AS key, count(*) AS n FROM k GROUP BY ALL",
)
def scientific_key(spark, folder):
    prepared = inventory.prepare(pairs(spark, folder))
    sides = F.concat(
        F.transform("src_sci_tokens", lambda t: F.struct(F.lit("source").alias("side"), t.alias("token"))),
        F.transform("draft_sci_tokens", lambda t: F.struct(F.lit("draft").alias("side"), t.alias("token"))),
    )
    return (
        prepared.select(F.explode_outer(sides).alias("s"))
        .where("s is not null")
        .select("s.side", "s.token", lit.scientific_key(F.col("s.token")).alias("key"))
        .groupBy("side", "token", "key")
        .agg(F.count("*").alias("n"))
    )


_GATE = (
    _P
    + f"n AS (SELECT *, {q.numeric_draft('source', 'draft', 'lang')} AS num FROM p), "
    + f"""t AS MATERIALIZED (SELECT pair_id, lang, source, draft, {q.number_tokens('source')} AS st, {q.number_tokens('num')} AS dt,
      {q.sci_tokens('source')} AS ss, {q.sci_tokens('num')} AS ds, {q.sci_candidates('source')} AS sc, {q.sci_candidates('num')} AS dc FROM n),
    u AS (SELECT *, {q.keyed('st', q.number_key)} AS sk, {q.keyed('dt', q.number_key)} AS dk,
      list_sort(list_filter(st, lambda x: {q.sci_key('x')} IS NULL)) AS so,
      list_sort({q.keyed(f"list_filter(st, lambda x: {q.sci_key('x')} IS NULL)", q.number_key)}) AS sok,
      list_sort({q.keyed(f"list_filter(dt, lambda x: {q.sci_key('x')} IS NULL)", q.number_key)}) AS dok FROM t),
    g AS MATERIALIZED (SELECT *, len(sc) = len(ss) AND len(dc) = len(ds) AND len(ss) = len(ds)
      AND len(list_filter(sc, lambda x: {q.sci_key('x')} IS NULL)) = 0
      AND len(list_filter(dc, lambda x: {q.sci_key('x')} IS NULL)) = 0
      AND (len(ss) = 0 OR sok IS NOT DISTINCT FROM dok) AS ok FROM u)"""
)


@query("scientific_gate", _GATE + " SELECT pair_id, ok AS supported FROM g")
def scientific_gate(spark, folder):
    return inventory.prepare(pairs(spark, folder)).select("pair_id", F.col("numeric_supported").alias("supported"))


def _state(seen: str, warn: str) -> str:
    return f"CASE WHEN NOT ({seen}) THEN 'not assessed' WHEN {warn} THEN 'warning' ELSE 'checked' END"


_NUM_SEEN = "ok AND (len(st) > 0 OR len(dt) > 0)"
_NUM_WARN = f"(ok AND {q.differs('sk', 'dk')})"


def _one(spark, folder, category: str) -> DataFrame:
    done = checks.evaluate(pairs(spark, folder), [category])
    c = F.col("checks")[0]
    return done.select(
        "pair_id",
        c["state"].alias("state"),
        c["source_span"].alias("source_span"),
        c["draft_span"].alias("draft_span"),
    )


@query(
    "number_check",
    _GATE
    + f" SELECT pair_id, {_state(_NUM_SEEN, _NUM_WARN)} AS state, CAST(NULL AS VARCHAR) AS source_span, "
    + f"CASE WHEN {_NUM_WARN} THEN {q.first_excess('dt', 'dk', 'sk')} END AS draft_span FROM g",
)
def number_check(spark, folder):
    return _one(spark, folder, "number")


@query(
    "once_daily_alias",
    _P
    + f"c AS (SELECT lang, {q.once_daily_count('source')} AS wanted, {q.ko_once_daily_count('draft')} AS found FROM p) "
    + "SELECT lang, count(*) AS pairs, count(*) FILTER (WHERE lang = 'ko' AND wanted > 0 AND wanted = found) AS blanked FROM c GROUP BY lang",
)
def once_daily_alias(spark, folder):
    aliased = lit.comparable_draft(F.col("source"), F.col("draft"), F.col("lang")) != F.col("draft")
    return (
        pairs(spark, folder)
        .groupBy("lang")
        .agg(F.count("*").alias("pairs"), F.count_if(aliased).alias("blanked"))
    )


_UNIT_KEYS = (
    f"list_concat({q.keyed(q.word_unit_tokens('{0}'), q.unit_key)}, list_transform(range({q.percent_count('{0}')}), lambda i: '%'))"
)


def _units(text: str) -> str:
    return _UNIT_KEYS.replace("{0}", text)


@query(
    "unit_inventory",
    _SIDES
    + f"k AS (SELECT pair_id, side, unnest({_units('t')}) AS key FROM s) "
    + "SELECT pair_id, side, key, count(*) AS n FROM k GROUP BY ALL",
)
def unit_inventory(spark, folder):
    return inventory.counted_inventory(inventory.prepare(pairs(spark, folder)), "units")


@query("number_unit_pairs", _SIDES + _counted(q.pair_tokens("t"), q.pair_key))
def number_unit_pairs(spark, folder):
    return inventory.counted_inventory(inventory.prepare(pairs(spark, folder)), "pairs")


_UNITS = (
    _GATE
    + f""", v AS (SELECT *, {q.pair_tokens('source')} AS sp, {q.pair_tokens('draft')} AS dp,
      {_units('source')} AS su, {_units('draft')} AS du FROM g),
    w AS MATERIALIZED (SELECT *, {q.keyed('sp', q.pair_key)} AS spk, {q.keyed('dp', q.pair_key)} AS dpk FROM v)"""
)
_UNIT_SEEN = "lang IN ('ko', 'es') AND ok AND (len(su) > 0 OR len(du) > 0)"
_UNIT_WARN = f"({_UNIT_SEEN} AND ({q.differs('su', 'du')} OR {q.differs('spk', 'dpk')}))"


@query(
    "unit_check",
    _UNITS
    + f" SELECT pair_id, {_state(_UNIT_SEEN, _UNIT_WARN)} AS state, "
    + f"CASE WHEN {_UNIT_WARN} THEN coalesce({q.first_excess('sp', 'spk', 'dpk')}, {q.first_excess('su', 'su', 'du')}) END AS source_span, "
    + f"CASE WHEN {_UNIT_WARN} THEN coalesce({q.first_excess('dp', 'dpk', 'spk')}, {q.first_excess('du', 'du', 'su')}) END AS draft_span FROM w",
)
def unit_check(spark, folder):
    return _one(spark, folder, "unit")


_CODES = _P + f"c AS MATERIALIZED (SELECT *, {q.code_tokens('source')} AS sc, {q.code_tokens('draft')} AS dc FROM p), "
_CODES += (
    "d AS MATERIALIZED (SELECT *, list_transform(sc, lambda x: translate(x, '‐‑', '--')) AS sk, "
    "list_transform(dc, lambda x: translate(x, '‐‑', '--')) AS dk FROM c)"
)


@query(
    "identifier_check",
    _CODES
    + f" SELECT pair_id, {_state('len(sk) + len(dk) > 0', q.differs('sk', 'dk'))} AS state, "
    + f"CASE WHEN {q.differs('sk', 'dk')} THEN {q.first_excess('sc', 'sk', 'dk')} END AS source_span, "
    + f"CASE WHEN {q.differs('sk', 'dk')} THEN {q.first_excess('dc', 'dk', 'sk')} END AS draft_span FROM d",
)
def identifier_check(spark, folder):
    return _one(spark, folder, "identifier")


_DIR = _P + (
    f"d AS (SELECT *, regexp_matches({q.words('source')}, '(?i)\\bproximal\\b') AS px, "
    f"regexp_matches({q.words('source')}, '(?i)\\bdistal\\b') AS ds FROM p), "
    "e AS (SELECT *, lang IN ('ko', 'ar') AND (px OR ds) AS seen, CASE lang "
    "WHEN 'ko' THEN (px AND NOT contains(draft, '근위')) OR (ds AND NOT contains(draft, '원위')) "
    "WHEN 'ar' THEN (px AND NOT contains(draft, 'قريب')) OR (ds AND NOT contains(draft, 'بعيد')) ELSE false END AS lost FROM d)"
)


@query(
    "direction_check",
    _DIR
    + f" SELECT pair_id, {_state('seen', 'lost')} AS state, CAST(NULL AS VARCHAR) AS source_span, CASE WHEN seen AND lost AND lang = 'ko' THEN "
    "CASE WHEN px AND contains(draft, '원위') THEN '원위' WHEN ds AND contains(draft, '근위') THEN '근위' END END AS draft_span FROM e",
)
def direction_check(spark, folder):
    return _one(spark, folder, "direction")


def _hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _marked(text: str) -> str:
    """A source marker that is not one of the excluded idioms."""
    return (
        f"({_hits(text, '(?i)' + chr(92) + 'b(?:not|no)' + chr(92) + 'b')} > "
        f"{_hits(text, '(?i)' + chr(92) + 'b(?:not' + chr(92) + 's+only|no' + chr(92) + 's+(?:more|less)' + chr(92) + 's+than)' + chr(92) + 'b')})"
    )


_HEDGE = (
    r"(?i)\b(?:may|might|could|possibly|possible|definite|suspected|uncertain)\b"
    r"|\bnot\s+(?:all|every|(?:be\s+)?excluded|(?:be\s+)?ruled\s+out)\b|\bno\s+evidence\b"
    r"|\b(?:said|says|reported|reports|stated|states|denied|denies|claimed|claims)\b"
)
_QUOTED = r"[\"“”‘]|(?:^|[^\p{L}])[''’]|[''’](?:$|[^\p{L}])"
_NEG = _P + (
    "c AS (SELECT pair_id, lang, draft, source, "
    rf"list_transform(string_split(regexp_replace(source, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {q.words('x')}) AS sents, "
    rf"string_split(regexp_replace(source, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) AS rawsents FROM p), "
    f"d AS (SELECT *, {_marked(q.words('source'))} AS marked, "
    f"len(list_filter(range(1, len(sents) + 1), lambda i: {_marked('sents[i]')} AND "
    f"(regexp_matches(sents[i], '{_HEDGE}') OR regexp_matches(rawsents[i], '{_QUOTED}')))) > 0 AS held, "
    r"CASE lang WHEN 'ko' THEN regexp_matches(draft, '않|없|아니|아닙|아님|아닌|아닐|(?:^|[^\p{L}])(?:안|못)\s') "
    f"WHEN 'es' THEN {_hits(q.words('draft'), '(?i)' + chr(92) + 'b(?:no|nunca|sin)' + chr(92) + 'b')} > "
    f"{_hits(q.words('draft'), '(?i)' + chr(92) + 'b(?:no' + chr(92) + 's+obstante|sin' + chr(92) + 's+embargo)' + chr(92) + 'b')} "
    r"WHEN 'ar' THEN regexp_matches(regexp_replace(draft, '[\x{064B}-\x{065F}]', '', 'g'), '(?:^|[^\p{L}])(?:و)?(?:لا|ليس|لم|لن)(?:$|[^\p{L}])') "
    "ELSE false END AS visible FROM c), e AS (SELECT *, lang IN ('ko', 'es', 'ar') AND marked AND NOT held AS seen FROM d)"
)


@query(
    "negation_check",
    _NEG
    + f" SELECT pair_id, {_state('seen', 'NOT visible')} AS state, CAST(NULL AS VARCHAR) AS source_span, CAST(NULL AS VARCHAR) AS draft_span FROM e",
)
def negation_check(spark, folder):
    return _one(spark, folder, "negation")


@query("negation_scope_check")
def negation_scope_check(spark, folder):
    return _one(spark, folder, "negation-scope")


_TERM_SEEN = f"lang = 'ko' AND regexp_matches({q.words('source')}, '(?i)\\bfemoral\\s+vein\\b')"


@query(
    "terminology_check",
    _P
    + f"t AS (SELECT *, {_TERM_SEEN} AS seen FROM p) SELECT pair_id, "
    + _state("seen", "NOT regexp_matches(draft, '(?:대퇴|넙다리)\\s*정맥')")
    + " AS state, CAST(NULL AS VARCHAR) AS source_span, CAST(NULL AS VARCHAR) AS draft_span FROM t",
)
def terminology_check(spark, folder):
    return _one(spark, folder, "terminology")


_ROLLED = ("number", "unit", "direction", "negation", "terminology", "identifier", "omission", "other")


def _rollup_sql() -> str:
    parts = [
        f"SELECT pair_id, '{c}' AS category, state FROM ({ORACLE[c + '_check']}) AS c_{c}" for c in _ROLLED[:6]
    ]
    parts += [f"SELECT pair_id, '{c}', 'not assessed' FROM ({tables.ansi('pairs')}) AS n_{c}" for c in _ROLLED[6:]]
    return (
        f"SELECT lang, category, state, count(*) AS pairs FROM ({' UNION ALL '.join(parts)}) AS u "
        f"JOIN (SELECT pair_id, lang FROM ({tables.ansi('pairs')}) AS l) AS k USING (pair_id) GROUP BY ALL"
    )


@query("coverage_rollup", _rollup_sql())
def coverage_rollup(spark, folder):
    return checks.coverage_rollup(checks.evaluate(pairs(spark, folder), list(_ROLLED)))


@query("coverage_rollup_whole")
def coverage_rollup_whole(spark, folder):
    """All nine categories; negation-scope has no comparison SQL."""
    return checks.coverage_rollup(checks.evaluate(pairs(spark, folder), [*_ROLLED, "negation-scope"]))


_MISSING = "list_filter(list_filter(st, lambda x, i: list_position(st, x) = i), lambda x: NOT list_contains(dt, x))"
_KEYS = "list_filter(list_concat(sk, dk), lambda x, i: list_position(list_concat(sk, dk), x) = i)"
_N = "len(list_filter({0}, lambda y: y = k))"
_CHANGED = (
    f"list_filter({_KEYS}, lambda k: {_N.format('sk')} <> {_N.format('dk')})"
)
_LISTED = (
    f"list_transform({_CHANGED}, lambda k: k || ' (source ' || {_N.format('sk')} || ', draft ' || {_N.format('dk')} || ')')"
)


@query(
    "summary_text",
    _GATE
    + f""", cd AS MATERIALIZED (SELECT pair_id, {q.code_tokens('source')} AS scs, {q.code_tokens('draft')} AS dcs FROM p)
    SELECT pair_id, lang, array_to_string(list_filter([
      CASE WHEN len({_MISSING}) > 0 THEN '{checks.SENTENCES["missing"][0]}' || array_to_string({_MISSING}, ', ') || '{checks.SENTENCES["missing"][1]}' END,
      CASE WHEN ok AND {q.differs('sk', 'dk')} THEN '{checks.SENTENCES["changed"][0]}' || array_to_string({_LISTED}, '; ') || '{checks.SENTENCES["changed"][1]}' END,
      CASE WHEN NOT ok THEN '{checks.SENTENCES["powers"]}' END,
      CASE WHEN lang = 'ko' AND regexp_matches({q.words('source')}, '(?i)\\bproximal\\b') AND contains(draft, '원위') AND NOT contains(draft, '근위') THEN '{checks.SENTENCES["direction"]}' END,
      CASE WHEN {_TERM_SEEN} AND NOT regexp_matches(draft, '(?:대퇴|넙다리)\\s*정맥') THEN '{checks.SENTENCES["vein"]}' END,
      CASE WHEN lang IN ('ko', 'ar') AND regexp_matches({q.words('draft')}, '(?i)\\b(?:proximal|distal)\\b') THEN '{checks.SENTENCES["english"]}' END,
      CASE WHEN {q.differs('scs', 'dcs')} THEN '{checks.MESSAGES["identifier"]}' END, '{checks.SENTENCES["end"]}'], lambda x: x IS NOT NULL), ' ') AS summary
    FROM g JOIN cd USING (pair_id)""",
)
def summary_text(spark, folder):
    return checks.summary_text(pairs(spark, folder))
