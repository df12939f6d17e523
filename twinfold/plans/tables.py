"""Input relations derived from the driver tables.

Every relation is one SQL text, valid in Spark and in plain ANSI engines, so a
query and its comparison SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.session import cut_lineage, together

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Size of the parts that derived pages lie in: every step of a page sorts or counts its fragments within the part.
PART_BYTES, PART_LINES = 2_000_000, 20_000
TEXT_TABLES = ("documents", "pages", "conversations")

_SOURCE_TAIL = (
    "' The proximal BRCA1 segment was imaged. The 2.5 mg dose was not recorded. "
    "Give 1.5e-3 mL' || CASE WHEN doc_id % 4 = 1 THEN ' once daily.' ELSE '.' END || CASE WHEN doc_id % 5 = 0 THEN ' The femoral vein was patent.' ELSE '' END"
)


def _choice(change: int, changed: str, plain: str) -> str:
    return f"CASE WHEN CAST(floor(doc_id / 3) AS BIGINT) % 6 = {change} THEN '{changed}' ELSE '{plain}' END"


_NUMBER = _choice(1, "3.5", "2.5")
_UNIT = _choice(2, "mL", "mg")
_CODE = _choice(3, "BRCA2", "BRCA1")
_POWER = "CASE WHEN doc_id % 7 = 3 THEN '0.0015' ELSE '{0}' END"
_DRAFT_TAIL = f"""CASE doc_id % 3
  WHEN 0 THEN ' ' || {_choice(4, "원위", "근위")} || ' ' || {_CODE} || ' 구간을 촬영했습니다. ' || {_NUMBER}
    || ' ' || {_UNIT} || ' 용량은 기록' || {_choice(5, "되었습니다", "되지 않았습니다")} || '. ' || CASE WHEN doc_id % 4 = 1 THEN '1일 1회 ' ELSE '' END
    || {_POWER.format("15e-4")} || ' mL 투여합니다.'
    || CASE WHEN doc_id % 10 = 0 THEN ' 대퇴 정맥은 개존되어 있습니다.' WHEN doc_id % 5 = 0 THEN ' 혈관은 개존되어 있습니다.' ELSE '' END
  WHEN 1 THEN ' El segmento ' || {_CODE} || ' ' || {_choice(4, "distal", "proximal")} || ' fue visualizado. La dosis de '
    || {_NUMBER} || ' ' || {_UNIT} || ' ' || {_choice(5, "fue", "no fue")} || ' registrada. Administrar '
    || {_POWER.format("15e-4")} || ' mL una vez al día.'
  ELSE ' تم تصوير الجزء ' || {_CODE} || ' ' || {_choice(4, "بعيد", "قريب")} || '. ' || {_choice(5, "تم", "لم يتم")}
    || ' تسجيل جرعة ' || {_NUMBER} || ' ' || {_UNIT} || '. أعط ' || {_POWER.format("١٥e-4")} || ' mL مرة يوميا.'
  END"""

PAIRS = f"""SELECT doc_id AS pair_id,
  CASE doc_id % 3 WHEN 0 THEN 'ko' WHEN 1 THEN 'es' ELSE 'ar' END AS lang,
  text || {_SOURCE_TAIL} AS source,
  text || {_DRAFT_TAIL} AS draft
FROM {{documents}}"""

EVAL_CASES = f"""SELECT 'case-' || doc_id AS case_id, lang, source,
  CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'author' END AS author, 'CC0' AS license, doc_id
FROM (SELECT pair_id AS doc_id, lang, source FROM ({PAIRS}) AS p) AS q"""
EVAL_RUNS = f"""SELECT 'run-' || pair_id AS run_id, 'case-' || pair_id AS case_id,
  CASE WHEN pair_id % 23 = 0 THEN 'xx' ELSE lang END AS lang, draft,
  1000 + pair_id % 500 AS latency_ms, 100 + pair_id % 50 AS prompt_tokens,
  CASE WHEN pair_id % 29 = 0 THEN -1 ELSE 40 + pair_id % 20 END AS completion_tokens, pair_id AS doc_id
FROM ({PAIRS}) AS p"""
EVAL_GOLD = """SELECT 'run-' || doc_id AS run_id, 'case-' || doc_id AS case_id,
  CASE (CAST(floor(doc_id / 3) AS BIGINT) % 6) WHEN 1 THEN 'number' WHEN 2 THEN 'unit' WHEN 3 THEN 'other' WHEN 4 THEN 'direction'
    WHEN 5 THEN 'negation' END AS seed_category,
  CASE (CAST(floor(doc_id / 3) AS BIGINT) % 6) WHEN 1 THEN '3.5' WHEN 2 THEN '2.5 mL' WHEN 3 THEN 'BRCA2'
    WHEN 4 THEN CASE doc_id % 3 WHEN 0 THEN '원위' WHEN 1 THEN 'distal' ELSE 'بعيد' END
    WHEN 5 THEN CASE doc_id % 3 WHEN 0 THEN '되었습니다' WHEN 1 THEN 'fue' ELSE 'تم' END END AS seed_span,
  CASE WHEN CAST(floor(doc_id / 3) AS BIGINT) % 6 = 0 THEN 'number,negation' WHEN doc_id % 31 = 0 THEN 'number,style' ELSE 'number' END AS clean
FROM {documents}"""
_RULE_FINDINGS = """SELECT doc_id, 'number' AS category, '3.5' AS draft_span, 'rule' AS provenance FROM {documents} WHERE CAST(floor(doc_id / 3) AS BIGINT) % 6 = 1
  UNION ALL SELECT doc_id, 'unit', '2.5 mL', 'rule' FROM {documents} WHERE CAST(floor(doc_id / 3) AS BIGINT) % 6 = 2
  UNION ALL SELECT doc_id, 'direction', CASE WHEN doc_id % 3 = 0 THEN '원위' END, 'rule' FROM {documents} WHERE CAST(floor(doc_id / 3) AS BIGINT) % 6 = 4
  UNION ALL SELECT doc_id, 'terminology', CAST(NULL AS STRING), 'rule' FROM {documents} WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'number', '99', 'rule' FROM {documents} WHERE doc_id % 9 = 0"""
EVAL_FINDINGS = f"""SELECT 'run-' || doc_id AS run_id, 'baseline' AS arm, category, draft_span, provenance FROM ({_RULE_FINDINGS}) AS a
UNION ALL SELECT 'run-' || doc_id, 'enhanced', category, draft_span, provenance FROM ({_RULE_FINDINGS}) AS b
UNION ALL SELECT 'run-' || doc_id, 'enhanced', 'omission', 'BRCA1', CASE WHEN doc_id % 35 = 0 THEN 'guess' ELSE 'model' END
  FROM {{documents}} WHERE doc_id % 5 = 0
UNION ALL SELECT 'run-' || doc_id, 'enhanced', 'negation', CASE doc_id % 3 WHEN 0 THEN '기록되었습니다' WHEN 1 THEN 'fue registrada' ELSE 'تم' END, 'model'
  FROM {{documents}} WHERE CAST(floor(doc_id / 3) AS BIGINT) % 6 = 5"""
_STATE = """CASE event_type WHEN 'signup' THEN 'reserved' WHEN 'view' THEN 'started' WHEN 'click' THEN 'pending-billing'
  WHEN 'purchase' THEN 'reconciled' ELSE CASE event_id % 3 WHEN 0 THEN 'failed-cost-held' WHEN 1 THEN 'unknown-cost' ELSE 'cancelled' END END"""
_CALL_BASE = f"""SELECT event_id, user_id, ts, 'b' || user_id % 10 AS budget_id,
  CASE WHEN event_id % 101 = 0 THEN 'run-x' ELSE lpad(CAST(event_id - event_id % 2 AS STRING), 32, '0') END AS run_id,
  {_STATE} AS state,
  CASE user_id % 3 WHEN 0 THEN 'settled' WHEN 1 THEN 'reserved-budget-v1' ELSE 'reserved-budget-v2' END AS admission_policy,
  CASE WHEN user_id % 3 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'trial' WHEN 1 THEN 'cash' ELSE 'promo' END ELSE 'operator-budget' END AS bucket,
  CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 1.1 END AS DECIMAL(6,4)) AS tax_multiplier,
  CAST(CASE WHEN user_id % 3 = 0 THEN CAST(value AS DECIMAL(12,2)) * CAST(0.0003 AS DECIMAL(6,4))
    WHEN event_id % 2 = 0 THEN CAST(0.06334656 AS DECIMAL(20,8)) ELSE CAST(0.06968122 AS DECIMAL(20,8)) END AS DECIMAL(20,8)) AS reserved_usd,
  CAST(event_id % 2000 AS INT) AS prompt_tokens, CAST(event_id % 1900 AS INT) AS completion_tokens
FROM {{events}}"""
CALLS = f"""SELECT event_id, user_id, budget_id, run_id, run_id || '-' || event_id % 2 AS call_id, state, admission_policy, bucket,
  tax_multiplier, reserved_usd, prompt_tokens, completion_tokens, 'model-a' AS model,
  CAST(0.06 AS DECIMAL(4,2)) AS input_per_million, CAST(0.24 AS DECIMAL(4,2)) AS output_per_million, 'price-1' AS price_version,
  CASE WHEN event_id % 97 = 0 THEN 'bad evidence' ELSE 'ev-' || event_id END AS billing_evidence,
  CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS STRING) AS day,
  CASE WHEN state IN ('pending-billing', 'reconciled', 'failed-cost-held') AND completion_tokens <= 1800 THEN
    CAST(CAST((CAST(prompt_tokens AS DECIMAL(10,0)) * CAST(0.06 AS DECIMAL(4,2)) + CAST(completion_tokens AS DECIMAL(10,0)) * CAST(0.24 AS DECIMAL(4,2)))
      * CAST(0.000001 AS DECIMAL(8,6)) AS DECIMAL(20,8)) * tax_multiplier AS DECIMAL(24,12)) END AS estimated_cost_usd,
  CASE WHEN state = 'reconciled' THEN CAST(reserved_usd * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(20,8)) END AS billed_cost_usd,
  ts AS reserved_at,
  CASE WHEN state NOT IN ('reserved', 'cancelled') THEN ts + INTERVAL 1 MINUTE END AS started_at,
  CASE WHEN state IN ('pending-billing', 'failed-cost-held', 'reconciled') THEN ts + INTERVAL 2 MINUTE END AS observed_at,
  CASE WHEN state IN ('pending-billing', 'failed-cost-held', 'unknown-cost', 'reconciled') THEN ts + INTERVAL 3 MINUTE END AS finished_at,
  CASE WHEN state IN ('pending-billing', 'reconciled') THEN 'accepted' WHEN state IN ('failed-cost-held', 'unknown-cost') THEN 'failed' END AS outcome,
  CASE WHEN state = 'reconciled' THEN 'rc-' || event_id END AS billing_receipt,
  CASE WHEN state = 'reconciled' THEN ts + INTERVAL 60 MINUTE END AS billing_confirmed_at,
  event_id % 4 <> 0 AS owner_gone,
  admission_policy = 'reserved-budget-v1' AND state IN ('failed-cost-held', 'unknown-cost') AND event_id % 5 = 0 AS loss_accepted
FROM ({_CALL_BASE}) AS base"""
_RECEIPT_COPY = "SELECT 0 AS copy UNION ALL SELECT 1 AS copy"
RECEIPTS = f"""SELECT event_id * 2 + copy AS receipt_id, CASE WHEN event_id % 37 = 0 THEN 'missing' ELSE call_id END AS call_id,
  CASE WHEN event_id % 13 = 0 THEN 'other' ELSE bucket END AS bucket,
  CASE WHEN event_id % 17 = 0 THEN 'model-b' ELSE 'model-a' END AS model,
  CAST(CASE WHEN event_id % 11 = 0 THEN reserved_usd * 2 WHEN event_id % 14 = 0 AND copy = 1 THEN CAST(0 AS DECIMAL(20,8))
    ELSE reserved_usd * CAST(0.5 AS DECIMAL(2,1)) END AS DECIMAL(20,8)) AS billed_cost_usd,
  'rc-' || event_id AS evidence, reserved_at + INTERVAL 60 MINUTE AS confirmed_at
FROM ({CALLS}) AS c CROSS JOIN ({_RECEIPT_COPY}) AS d WHERE copy = 0 OR event_id % 7 = 0"""

def both(spark_lines: str, ansi_lines: str, text: str) -> tuple[str, str]:
    """Spark and ANSI form of a text over a splitting relation."""
    return text.replace("<LINES>", spark_lines), text.replace("<LINES>", ansi_lines)


_LINES_SPARK = "(SELECT doc_id, pos AS line, col AS text FROM (SELECT doc_id, posexplode(split(text, chr(10))) FROM {documents}))"
_LINES_ANSI = (
    "(SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line, unnest(l) AS text "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents}) AS s)"
)
_WORDS_SPARK = f"(SELECT doc_id, line, pos AS w, col AS word FROM (SELECT doc_id, line, posexplode(split(text, ' ')) FROM {_LINES_SPARK}))"
_WORDS_ANSI = (
    "(SELECT doc_id, line, CAST(unnest(range(len(l))) AS INT) AS w, unnest(l) AS word "
    f"FROM (SELECT doc_id, line, string_split(text, ' ') AS l FROM {_LINES_ANSI} AS a) AS s)"
)
LINES = both(_LINES_SPARK, _LINES_ANSI, "SELECT * FROM <LINES> AS l")
FRAGMENTS = both(
    _WORDS_SPARK,
    _WORDS_ANSI,
    """SELECT doc_id AS page_id, line * 100000 + w AS frag_id, word AS text, line,
  CAST(45 * (w % 12) + CASE WHEN doc_id % 2 = 1 AND w % 12 >= 6 THEN 40 ELSE 0 END AS DOUBLE) + (w % 3) * 0.5 AS x,
  CAST(400 * line + 20 * ((w - w % 12) / 12) + w % 4 AS DOUBLE) AS y,
  CAST(6 * length(word) AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height
FROM <LINES> AS f""",
)
REGIONS = both(
    _LINES_SPARK,
    _LINES_ANSI,
    """SELECT doc_id AS page_id, line AS seq, 'p' || doc_id || '-r' || line AS region_id,
  CASE (doc_id + line) % 11 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'caption' WHEN 3 THEN 'footnote'
    WHEN 4 THEN 'equation' ELSE 'paragraph' END AS type,
  CASE (doc_id + 2 * line) % 7 WHEN 0 THEN 'proposed' WHEN 1 THEN 'excluded' ELSE 'verified' END AS status,
  CASE WHEN (doc_id + line) % 2 = 0 THEN 'repeated' ELSE ' ' END AS exclusion_reason, text,
  CAST(50 AS DOUBLE) AS x, CAST(400 * line AS DOUBLE) AS y, CAST(CASE WHEN (doc_id + line) % 29 = 0 THEN 900 ELSE 500 END AS DOUBLE) AS width,
  CAST(380 AS DOUBLE) AS height, CAST(620 AS DOUBLE) AS page_width, CAST(400000 AS DOUBLE) AS page_height
FROM <LINES> AS r""",
)
EDGES = both(
    _LINES_SPARK,
    _LINES_ANSI,
    """SELECT doc_id AS page_id, 'e' || line AS edge_id, 'reading-next' AS type, 'p' || doc_id || '-r' || (line - 1) AS from_id,
  CASE WHEN doc_id % 8 = 1 AND line = 3 THEN 'p' || doc_id || '-r0' ELSE 'p' || doc_id || '-r' || line END AS to_id,
  CASE WHEN (doc_id + line) % 37 = 0 THEN 'proposed' ELSE 'verified' END AS status FROM <LINES> AS a WHERE line >= 1
UNION ALL SELECT doc_id, 'b' || line, 'reading-next', 'p' || doc_id || '-r0', 'p' || doc_id || '-r2', 'verified' FROM <LINES> AS b WHERE doc_id % 8 = 2 AND line = 2
UNION ALL SELECT doc_id, 'c' || line, 'caption-of', 'p' || doc_id || '-r' || line, 'p' || doc_id || '-r' || (line - 1 - doc_id % 2),
  CASE WHEN line % 5 = 0 THEN 'proposed' ELSE 'verified' END FROM <LINES> AS c WHERE (doc_id + line) % 11 = 2 AND line % 7 <> 3
UNION ALL SELECT doc_id, 'n' || line, 'footnote-of', 'p' || doc_id || '-r' || line, 'p' || doc_id || '-r' || (line - 1),
  'verified' FROM <LINES> AS d WHERE (doc_id + line) % 11 = 3""",
)
OWNED = both(
    _WORDS_SPARK,
    _WORDS_ANSI,
    """SELECT doc_id AS page_id, 'p' || doc_id || '-r' || line AS region_id, line * 100000 + w AS frag_id FROM <LINES> AS a WHERE NOT ((doc_id + line) % 19 = 0 AND w = 1)
UNION ALL SELECT doc_id, 'p' || doc_id || '-r' || line, (line - 1) * 100000 FROM <LINES> AS b WHERE (doc_id + line) % 17 = 0 AND w = 0 AND line > 0
UNION ALL SELECT doc_id, 'p' || doc_id || '-r' || line, line * 100000 + 99999 FROM <LINES> AS c WHERE (doc_id + line) % 23 = 0 AND w = 0""",
)
STROKES = both(
    _LINES_SPARK,
    _LINES_ANSI,
    """SELECT doc_id AS page_id, 'p' || doc_id || '-r' || line AS region_id, line * 2 AS stroke_id, 'h' AS axis, CAST(0 AS DOUBLE) AS x,
  CAST(400 * line + CASE WHEN doc_id % 5 = 0 THEN 6 ELSE 390 END AS DOUBLE) AS y, CAST(620 AS DOUBLE) AS width, CAST(0 AS DOUBLE) AS height FROM <LINES> AS a
UNION ALL SELECT doc_id, 'p' || doc_id || '-r' || line, line * 2 + 1, 'v', CAST(302 AS DOUBLE), CAST(400 * line AS DOUBLE), CAST(0 AS DOUBLE),
  CAST(CASE WHEN line % 3 = 0 THEN 400 ELSE 380 END AS DOUBLE) FROM <LINES> AS b WHERE doc_id % 4 = 0""",
)
IMAGES = both(
    _LINES_SPARK,
    _LINES_ANSI,
    """SELECT doc_id AS page_id, CAST(100 AS DOUBLE) AS x, CAST(400 * line + 380 AS DOUBLE) AS y, CAST(200 AS DOUBLE) AS width, CAST(CASE WHEN line % 4 = 2 THEN 20 ELSE 10 END AS DOUBLE) AS height
FROM <LINES> AS i WHERE line % 3 = 1""",
)
DOC_PAGES = "SELECT doc_id AS page_id, doc_id % 3 <> 0 AS visual_inventory_confirmed, CAST(620 AS DOUBLE) AS width, CAST(n_chars * 4 AS DOUBLE) AS height FROM {documents}"


def _cells(edit: bool) -> str:
    """Three cells per line item; the edited copy differs in known ways."""
    row = "l_linenumber - 1"
    value_text = "CAST(CAST(l_quantity AS INT) AS STRING)"
    span = "CASE WHEN l_suppkey % 50 = 0 THEN 2 ELSE 1 END"
    if edit:
        value_text = f"CASE WHEN l_partkey % 9 = 0 THEN {value_text} || '0' ELSE {value_text} END"
        span = "CASE WHEN l_suppkey % 50 = 0 OR l_partkey % 23 = 0 THEN 2 ELSE 1 END"
    role = "CASE WHEN l_partkey % 27 = 0 THEN 'header' ELSE 'value' END" if edit else "'value'"
    drop = "WHERE NOT (l_partkey % 31 = 0)" if edit else ""
    return f"""SELECT l_orderkey AS table_id, 'c' || l_linenumber || '-0' AS cell_id, {row} AS row, 0 AS col, 1 AS row_span, 1 AS col_span,
  'header' AS role, l_returnflag AS text, CAST(NULL AS STRING) AS blank_reason,
  CASE WHEN l_suppkey % 11 = 0 THEN 'c' || l_linenumber || '-0' WHEN l_partkey % 13 = 0 THEN 'c' || (l_linenumber + 1 - 2 * (l_linenumber % 2)) || '-0'
    WHEN l_partkey % 30 = 0 THEN 'c' || l_linenumber || '-2' WHEN l_partkey % 5 = 0 THEN 'c' || (l_linenumber % 7 + 1) || '-0' ELSE '' END AS headers,
  'f' || l_linenumber || '-0' AS frags FROM {{lineitem}}
UNION ALL SELECT l_orderkey, 'c' || l_linenumber || '-1', {row}, 1, {span}, 1, {role}, {value_text}, NULL, 'c' || l_linenumber || '-0', 'f' || l_linenumber || '-1'
FROM {{lineitem}} {drop}
UNION ALL SELECT l_orderkey, 'c' || l_linenumber || '-2', {row}, 2, 1, CASE WHEN l_partkey % 17 = 0 THEN 2 ELSE 1 END,
  CASE WHEN l_partkey % 10 = 0 THEN 'blank' WHEN l_partkey % 41 = 0 THEN 'label' ELSE 'value' END,
  CASE WHEN l_partkey % 10 = 0 AND l_suppkey % 3 <> 0 THEN '' WHEN l_partkey % 43 = 0 THEN ' ' ELSE CAST(l_partkey AS STRING) END,
  CASE WHEN l_partkey % 20 = 0 THEN 'inherited' END, 'c' || l_linenumber || '-0', 'f' || l_linenumber || '-2' FROM {{lineitem}}"""


CELLS, CELLS_EDITED = _cells(False), _cells(True)
GRIDS = "SELECT l_orderkey AS table_id, CAST(max(l_linenumber) AS INT) AS row_count, 3 AS column_count FROM {lineitem} GROUP BY l_orderkey"

_ORDER_LINES = """SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
  l_partkey AS p, l_suppkey AS s, CAST(floor(l_quantity) AS INT) AS q, CAST(floor(l_extendedprice) AS INT) AS e, CAST(floor(l_discount * 100) AS INT) AS d, l_returnflag AS r FROM {lineitem}"""
_SIDES = "SELECT 0 AS t UNION ALL SELECT 1 AS t"
_COLUMNS = "SELECT 0 AS c UNION ALL SELECT 1 AS c UNION ALL SELECT 2 AS c UNION ALL SELECT 3 AS c UNION ALL SELECT 4 AS c"
_CELL_X = "CAST(CASE WHEN page_id % 4 = 3 THEN 40 + 120 * c ELSE 30 + 140 * c END AS DOUBLE)"
#: Pages of 640 by line items: a title on some, prose in two columns, one or two captioned tables of several kinds.
PAGE_TABLES = f"""SELECT page_id, n * 100 + t * 10 + c AS frag_id,
  CASE WHEN s % 9 = 0 THEN 'n.a.' WHEN c = 0 THEN CAST(q AS STRING) WHEN c = 1 THEN CAST(e AS STRING) WHEN c = 2 THEN CAST(d AS STRING) || '%'
    WHEN c = 3 THEN CAST(q AS STRING) || ' (' || CAST(d AS STRING) || '%)' ELSE '-' || CAST(d AS STRING) || '.5' END AS text,
  {_CELL_X} + (p % 3) * 2 AS x, CAST(440 + 2000 * t + 20 * n + CASE WHEN s % 17 = 0 AND n > 3 THEN 6 ELSE 0 END + c % 2 AS DOUBLE) AS y,
  CAST(50 AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height
FROM ({_ORDER_LINES}) AS a CROSS JOIN ({_SIDES}) AS b CROSS JOIN ({_COLUMNS}) AS k
WHERE (t = 0 OR page_id % 3 = 0) AND (c < 4 OR page_id % 4 = 3) AND NOT (p % 6 = 0 AND c IN (1, 2))
UNION ALL SELECT page_id, n * 100 + t * 10 + 5, 'wrapped', CAST(32 AS DOUBLE), CAST(450 + 2000 * t + 20 * n AS DOUBLE), CAST(60 AS DOUBLE), CAST(10 AS DOUBLE)
FROM ({_ORDER_LINES}) AS a CROSS JOIN ({_SIDES}) AS b WHERE (t = 0 OR page_id % 3 = 0) AND p % 7 = 0
UNION ALL SELECT page_id, n * 100 + t * 10 + 6, 'packed on day ' || CAST(q AS STRING) || ' with flag ' || r || ' for part', CAST(30 + 290 * t AS DOUBLE), CAST(30 + 14 * n + 3 * t AS DOUBLE),
  CAST(CASE WHEN p % 11 = 0 AND t = 0 THEN 300 ELSE 260 END AS DOUBLE), CAST(10 AS DOUBLE) FROM ({_ORDER_LINES}) AS a CROSS JOIN ({_SIDES}) AS b
UNION ALL SELECT page_id, n * 100 + t * 10 + 7, 'sent from store ' || CAST(s AS STRING) || ' by way of sea', CAST(30 + 300 * t AS DOUBLE), CAST(1400 + 14 * n AS DOUBLE), CAST(250 AS DOUBLE), CAST(10 AS DOUBLE)
FROM ({_ORDER_LINES}) AS a CROSS JOIN ({_SIDES}) AS b WHERE page_id % 6 < 4
UNION ALL SELECT page_id, 10000000 + t * 10 + c, 'Column ' || substring('abcde', c + 1, 1), {_CELL_X}, CAST(425 + 2000 * t AS DOUBLE), CAST(60 AS DOUBLE), CAST(10 AS DOUBLE)
FROM ({_ORDER_LINES}) AS a CROSS JOIN ({_SIDES}) AS b CROSS JOIN ({_COLUMNS}) AS k WHERE n = 1 AND (t = 0 OR page_id % 3 = 0) AND (c < 4 OR page_id % 4 = 3)
UNION ALL SELECT page_id, 10000000 + t * 10 + 5, CASE WHEN page_id % 5 = 0 THEN 'TABLE 3 shows the lines' ELSE 'TABLE ' || CAST(t + 1 AS STRING) || '. Lines' END,
  CAST(CASE WHEN page_id % 4 = 3 THEN 150 ELSE 30 END AS DOUBLE), CAST(405 + 2000 * t AS DOUBLE), CAST(100 AS DOUBLE), CAST(10 AS DOUBLE)
FROM ({_ORDER_LINES}) AS a CROSS JOIN ({_SIDES}) AS b WHERE n = 1 AND (t = 0 OR page_id % 3 = 0)
UNION ALL SELECT page_id, 10000008 + t, CASE t WHEN 0 THEN 'see' ELSE 'A title across both columns' END, CAST(CASE t WHEN 0 THEN 10 ELSE 100 END AS DOUBLE), CAST(CASE t WHEN 0 THEN 406 ELSE 10 END AS DOUBLE),
  CAST(CASE t WHEN 0 THEN 15 ELSE 400 END AS DOUBLE), CAST(10 AS DOUBLE) FROM ({_ORDER_LINES}) AS a CROSS JOIN ({_SIDES}) AS b WHERE n = 1 AND ((t = 0 AND page_id % 7 = 0) OR (t = 1 AND page_id % 2 = 0))"""

_RULE_LINES = f"""SELECT *, count(*) OVER (PARTITION BY page_id) AS m FROM ({_ORDER_LINES}) AS o"""
_ROW_AND_HEAD = "SELECT 0 AS k UNION ALL SELECT 1 AS k"
_THREE = "SELECT 0 AS c UNION ALL SELECT 1 AS c UNION ALL SELECT 2 AS c"
_FOUR = f"{_THREE} UNION ALL SELECT 3 AS c"
_SECOND = "(t = 0 OR page_id % 3 = 0)"
_TOP = "(100 + 3000 * t)"
_RULED_FROM = f"({_RULE_LINES}) AS a CROSS JOIN ({_SIDES}) AS b"
_STROKE_ENDS = "CAST({w} AS DOUBLE) AS width, CAST({h} AS DOUBLE) AS height, {op} AS operator_index, '{colour}' AS colour"


def _stroke(number: str, axis: str, x: str, y: str, w: str, h: str, source: str, where: str, op: str = "100 + n", colour: str = "#000000") -> str:
    return (
        f"SELECT page_id, {number} AS stroke_id, '{axis}' AS axis, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, "
        f"{_STROKE_ENDS.format(w=w, h=h, op=op, colour=colour)} FROM {source} WHERE {_SECOND} AND {where}"
    )


#: Ruled tables by line items: three columns, one row each and a header; sides are missing, broken or open on some pages.
RULES = " UNION ALL ".join(
    [
        _stroke("n * 1000 + t * 100 + c", "h", "49.5 + 150 * c", f"{_TOP} + 20 * (n + 1) - 0.5", "151", "1", f"{_RULED_FROM} CROSS JOIN ({_THREE}) AS k",
                "NOT (n < m AND p % 6 = 0 AND page_id % 8 <> 3 AND c = CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END)"),
        _stroke("n * 1000 + t * 100 + 10 + k", "h", "49.5", f"{_TOP} + 20 * k - 0.5", "451", "1", f"{_RULED_FROM} CROSS JOIN ({_ROW_AND_HEAD}) AS k", "n = 1"),
        _stroke("n * 1000 + t * 100 + 20 + c", "v", "49.5 + 150 * c", f"{_TOP} + 20 * n - CASE WHEN page_id % 16 = 3 THEN 0 ELSE 0.5 END", "1", "CASE WHEN page_id % 5 = 1 AND n = 2 AND c = 1 THEN 8 ELSE 21 END", f"{_RULED_FROM} CROSS JOIN ({_FOUR}) AS k",
                "NOT (c = 2 AND s % 10 = 0 AND page_id % 8 <> 3)"),
        _stroke("n * 1000 + t * 100 + 30 + c", "v", "49.5 + 150 * c", f"{_TOP} + CASE WHEN page_id % 8 = 3 THEN 6 ELSE -0.5 END", "1", "CASE WHEN page_id % 8 = 3 THEN 14 ELSE 21 END", f"{_RULED_FROM} CROSS JOIN ({_THREE}) AS k", "n = 1 AND c > 0"),
        _stroke("n * 1000 + t * 100 + 40 + k", "v", "49.5 + 450 * k", _TOP, "1", "20 * (m + 1)", f"{_RULED_FROM} CROSS JOIN ({_ROW_AND_HEAD}) AS k", "n = 1"),
        _stroke("n * 1000 + t * 100 + 50", "h", "50", _TOP, "450", "20", _RULED_FROM, "n = 1 AND page_id % 8 = 3 AND page_id % 11 <> 5", "1", "#dddddd"),
    ]
)
_HEAD_Y = f"{_TOP} + 8"
RULED_TEXTS = f"""SELECT page_id, n * 1000 + t * 100 + c AS frag_id, CASE c WHEN 0 THEN r WHEN 1 THEN CAST(q AS STRING) ELSE CAST(e AS STRING) END AS text,
  CAST(60 + 150 * c AS DOUBLE) AS x, CAST({_TOP} + 20 * n + 5 AS DOUBLE) AS y, CAST(CASE WHEN p % 45 = 0 AND c = 0 THEN 150 ELSE 40 END AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height
FROM {_RULED_FROM} CROSS JOIN ({_THREE}) AS k WHERE {_SECOND}
UNION ALL SELECT page_id, t * 100 + c, 'Head ' || substring('abc', c + 1, 1), CAST(60 + 150 * c AS DOUBLE), CAST({_HEAD_Y} - CASE WHEN page_id % 9 = 1 AND c = 2 THEN 1 ELSE 0 END AS DOUBLE), CAST(40 AS DOUBLE), CAST(10 AS DOUBLE)
FROM {_RULED_FROM} CROSS JOIN ({_THREE}) AS k WHERE {_SECOND} AND n = 1
UNION ALL SELECT page_id, t * 100 + 10, CASE WHEN page_id % 13 = 0 THEN 'TABLE 1 shows' ELSE 'TABLE ' || CAST(t + 1 AS STRING) END, CAST(60 AS DOUBLE), CAST({_TOP} - 25 AS DOUBLE), CAST(80 AS DOUBLE), CAST(10 AS DOUBLE)
FROM {_RULED_FROM} WHERE {_SECOND} AND n = 1
UNION ALL SELECT page_id, t * 100 + 11, 'beside', CAST(520 AS DOUBLE), CAST({_TOP} + 300 * (page_id % 2) AS DOUBLE), CAST(60 AS DOUBLE), CAST(10 AS DOUBLE)
FROM {_RULED_FROM} WHERE t = 0 AND n = 1 AND page_id % 4 = 1"""
RULED_PAGES = "SELECT l_orderkey AS page_id, CAST(640 AS DOUBLE) AS width, CAST(9000 AS DOUBLE) AS height, l_orderkey % 17 <> 0 AS complete FROM {lineitem} GROUP BY l_orderkey"
RULED_IMAGES = f"""SELECT page_id, CAST(400 AS DOUBLE) AS x, CAST(60 + 60 * (n % 4) AS DOUBLE) AS y, CAST(50 AS DOUBLE) AS width, CAST(20 AS DOUBLE) AS height FROM ({_ORDER_LINES}) AS a WHERE p % 61 = 0"""

_SPACED = "CASE WHEN page_id % 8 = 1 THEN 40 ELSE 20 END"
_TWO_OR_THREE = "(c < 2 OR page_id % 4 <> 1)"
_BAND_AT = f"{_TOP} + CASE k WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE CASE WHEN page_id % 16 = 1 THEN 61 ELSE 42 END + {_SPACED} * (m - 1) END"
_BANDS = "SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k"
#: Tables between three level rules cut into two or three parts, one row a line item; rules are missing, moved or one too many on some pages.
SCAFFOLD_RULES = " UNION ALL ".join(
    [
        _stroke("t * 100 + k * 10 + c", "h", "50 + 150 * c + CASE WHEN page_id % 11 = 4 AND k = 2 AND c = 1 THEN 2 ELSE 0 END", f"{_BAND_AT} - 0.5 + CASE WHEN page_id % 9 = 2 AND c = 1 THEN 0.25 ELSE 0 END",
                "150", "1", f"{_RULED_FROM} CROSS JOIN ({_THREE}) AS j CROSS JOIN ({_BANDS}) AS b3", f"n = 1 AND {_TWO_OR_THREE} AND NOT (page_id % 7 = 3 AND k = 1 AND c = 1)", "100 + k * 10 + c"),
        _stroke("t * 100 + 50", "h", "50", f"{_TOP} - 8.5", "450", "1", _RULED_FROM, "n = 1 AND page_id % 23 = 0", "90"),
    ]
)
#: Their texts: ``part`` 0 caption, 1 body, 2 text of no line.
SCAFFOLD_TEXTS = f"""SELECT page_id, t AS region_id, n * 1000 + t * 100 + c AS frag_id, 1 AS part,
  CASE c WHEN 0 THEN CASE WHEN p % 37 = 0 THEN '12' ELSE r END WHEN 1 THEN CASE WHEN p % 29 = 0 THEN 'n/a' ELSE CAST(q AS STRING) END ELSE CAST(e AS STRING) END AS text,
  CAST(50 + 150 * c + CASE WHEN s % 19 = 0 THEN 20 ELSE 0 END AS DOUBLE) AS x, CAST({_TOP} + 26 + {_SPACED} * (n - 1) + CASE WHEN s % 8 = 0 AND c = 1 THEN 0.25 ELSE 0 END AS DOUBLE) AS y,
  CAST(CASE WHEN p % 43 = 0 THEN 140 ELSE 40 END AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height
FROM {_RULED_FROM} CROSS JOIN ({_THREE}) AS j WHERE {_SECOND} AND {_TWO_OR_THREE} AND NOT (c = 0 AND p % 5 = 0 AND page_id % 4 <> 1)
UNION ALL SELECT page_id, t, n * 1000 + t * 100 + 10, 1, 'lot', CAST(100 AS DOUBLE), CAST({_TOP} + 26 + {_SPACED} * (n - 1) AS DOUBLE), CAST(30 AS DOUBLE), CAST(10 AS DOUBLE)
FROM {_RULED_FROM} WHERE {_SECOND} AND s % 6 = 0 AND p % 43 <> 0 AND s % 19 <> 0
UNION ALL SELECT page_id, t, t * 100 + c, 1, CASE WHEN page_id % 13 = 5 AND c = 1 THEN '2020' ELSE 'Head ' || substring('abc', c + 1, 1) END, CAST(50 + 150 * c AS DOUBLE), CAST({_TOP} + 6 AS DOUBLE), CAST(40 AS DOUBLE), CAST(10 AS DOUBLE)
FROM {_RULED_FROM} CROSS JOIN ({_THREE}) AS j WHERE {_SECOND} AND {_TWO_OR_THREE} AND n = 1
UNION ALL SELECT page_id, t, t * 100 + 20, 0, CASE WHEN page_id % 17 = 1 THEN 'TABLE 1 shows' ELSE 'TABLE ' || CAST(t + 1 AS STRING) END, CAST(CASE WHEN page_id % 19 = 1 THEN 40 ELSE 60 END AS DOUBLE), CAST({_TOP} - 25 AS DOUBLE), CAST(80 AS DOUBLE), CAST(10 AS DOUBLE)
FROM {_RULED_FROM} WHERE {_SECOND} AND n = 1
UNION ALL SELECT page_id, t, 30, 2, 'beside', CAST(CASE WHEN page_id % 10 = 3 THEN 520 ELSE 240 END AS DOUBLE), CAST({_TOP} + 22 AS DOUBLE), CAST(60 AS DOUBLE), CAST(3 AS DOUBLE)
FROM {_RULED_FROM} WHERE t = 0 AND n = 1 AND page_id % 10 IN (3, 7)"""

RELATIONS: dict[str, str | tuple[str, str]] = {
    "lines": LINES,
    "fragments": FRAGMENTS,
    "page_tables": PAGE_TABLES,
    "rules": RULES,
    "ruled_texts": RULED_TEXTS,
    "ruled_pages": RULED_PAGES,
    "ruled_images": RULED_IMAGES,
    "scaffold_rules": SCAFFOLD_RULES,
    "scaffold_texts": SCAFFOLD_TEXTS,
    "regions": REGIONS,
    "edges": EDGES,
    "owned": OWNED,
    "doc_pages": DOC_PAGES,
    "strokes": STROKES,
    "images": IMAGES,
    "cells": CELLS,
    "cells_edited": CELLS_EDITED,
    "grids": GRIDS,
    "pairs": PAIRS,
    "eval_cases": EVAL_CASES,
    "eval_runs": EVAL_RUNS,
    "eval_gold": EVAL_GOLD,
    "eval_findings": EVAL_FINDINGS,
    "calls": CALLS,
    "receipts": RECEIPTS,
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a small text input one partition per core.

    Texts are costly to scan. A large input already has more partitions than
    cores and is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, size: Column, most: int) -> DataFrame:
    """Rows dealt by a key into parts of about ``most`` of summed ``size``: what is derived from them stays together in a part."""
    spark = df.sparkSession
    total = int(df.agg(F.sum(size)).first()[0] or 0)
    return df.repartition(max(-(-total // most), int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def derive(spark: SparkSession, folder: str, sql: str, by: str | None = None, **more: DataFrame) -> DataFrame:
    """Run a derivation; only the driver tables it names are opened, and ``more`` tables as given; texts are dealt ``by`` a key."""
    used = {name: read(spark, folder, name) for name in TABLES if "{" + name + "}" in sql}
    used = {name: (dealt(df, by, F.octet_length("text"), PART_BYTES) if by else spread(df)) if name in TEXT_TABLES else df for name, df in used.items()}
    return spark.sql(sql, **used, **more)


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their place in the order, written once: the parts of derived pages would each sort all line items.

    They lie together by order, and so does all that is derived from them.
    """
    with together(spark):
        lines = dealt(read(spark, folder, "lineitem"), "l_orderkey", F.lit(1), PART_LINES)
        return cut_lineage(spark.sql(_RULE_LINES, lineitem=lines).withColumnRenamed("page_id", "_page"))


#: A cross join with a list of numbers; as a generator it leaves rows together, which a union over cross joins does not know.
_LISTED = re.compile(r"CROSS JOIN \(((?:(?: UNION ALL )?SELECT [0-9] AS (\w+))+)\) AS (\w+)")


def relation(spark: SparkSession, folder: str, name: str, numbered: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """The rows of a relation; one made of numbered line items may take them from ``numbered_lines``, texts may be dealt ``by`` a key."""
    sql = RELATIONS[name]
    sql = sql if isinstance(sql, str) else sql[0]
    if numbered is None:
        return derive(spark, folder, sql, by)
    for source in (_RULE_LINES, _ORDER_LINES):
        sql = sql.replace(source, "SELECT * FROM {numbered}")
    sql = _LISTED.sub(lambda m: f"LATERAL VIEW explode(array({', '.join(re.findall('[0-9]+', m[1]))})) {m[3]} AS {m[2]}", sql)
    # each part of a union names its page anew, or the union does not see that the parts lie alike
    sql = re.sub(r"\bpage_id\b", "_page", sql).replace("SELECT _page,", "SELECT _page AS page_id,")
    return derive(spark, folder, sql, numbered=numbered)


def ansi(name: str) -> str:
    """The same derivation over plain table names, for comparison SQL."""
    sql = RELATIONS[name]
    sql = sql if isinstance(sql, str) else sql[1]
    for table in TABLES:
        sql = sql.replace("{" + table + "}", table)
    return sql
