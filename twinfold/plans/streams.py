"""Queries of the keyed state machines over finished event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinfold.operators.qc import checks
from twinfold.plans import literal_checks
from twinfold.plans.tables import read, relation
from twinfold.streaming import stateful as st

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def requests(spark, folder):
    e = read(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("client_id"),
        F.concat(F.lit("b"), (F.col("user_id") % 10).cast("string")).alias("budget_id"),
        F.expr(
            "datediff(cast(ts as date), date'1970-01-01') * 86400000000L + (hour(ts) * 3600L + minute(ts) * 60L) * 1000000L"
            " + cast(extract(second from ts) * 1000000 as bigint)"
        ).alias("at_us"),
        "event_type",
        "value",
    )


_R = "WITH RECURSIVE r AS (SELECT event_id AS request_id, user_id AS client_id, 'b' || user_id % 10 AS budget_id, epoch_us(ts) AS at_us, event_type FROM events)"


def _chain(key: str, limit: int) -> str:
    """Windows of a key by following each start to the first request an hour later."""
    return (
        _R
        + f""", w(k, start) AS (SELECT {key}, min(at_us) FROM r GROUP BY 1 UNION ALL SELECT w.k, (SELECT min(r.at_us) FROM r WHERE r.{key} = w.k AND r.at_us >= w.start + 3600000000) FROM w
      WHERE EXISTS (SELECT 1 FROM r WHERE r.{key} = w.k AND r.at_us >= w.start + 3600000000)),
    a AS (SELECT r.*, w.start, row_number() OVER (PARTITION BY w.k, w.start ORDER BY at_us, request_id) AS n FROM r ASOF JOIN w ON r.{key} = w.k AND r.at_us >= w.start)
    SELECT request_id, n <= {limit} AS allowed FROM a"""
    )


@query("hourly_rate_limit", _chain("client_id", st.PER_CLIENT))
def hourly_rate_limit(spark, folder):
    return st.hourly_rate_limit(requests(spark, folder), "client_id", st.PER_CLIENT, ["request_id"])


@query("global_rate_limit", _chain("budget_id", st.GLOBAL_PER_HOUR))
def global_rate_limit(spark, folder):
    return st.hourly_rate_limit(requests(spark, folder), "budget_id", st.GLOBAL_PER_HOUR, ["request_id"])


@query(
    "hourly_clients",
    _R
    + " SELECT budget_id, CAST(floor(at_us / 3600000000.0) AS BIGINT) AS hour, count(DISTINCT client_id) AS clients, count(DISTINCT client_id) > 4 AS refuses_new FROM r GROUP BY ALL",
)
def hourly_clients(spark, folder):
    return st.hourly_clients(requests(spark, folder), 4)


CLIENT_CAP = 3


@query(
    "bounded_clients",
    _R
    + f""", o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY budget_id ORDER BY at_us, request_id) AS n FROM r),
    w(budget_id, n, request_id, m, allowed, refused_full) AS (
      SELECT DISTINCT budget_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS STRUCT(c BIGINT, s BIGINT, k INTEGER)[]), false, false FROM o
      UNION ALL SELECT budget_id, n, request_id, CASE WHEN NOT refuses AND cnt < {st.PER_CLIENT} THEN list_filter(base, lambda x: x.c <> client_id) || [{{'c': client_id, 's': CASE WHEN cnt = 0 THEN at_us ELSE mine.s END, 'k': cnt + 1}}] ELSE base END,
        NOT refuses AND cnt < {st.PER_CLIENT}, refuses
      FROM (SELECT *, NOT known AND len(base) >= {CLIENT_CAP} AS refuses, CASE WHEN mine IS NULL OR at_us - mine.s >= 3600000000 THEN 0 ELSE mine.k END AS cnt
        FROM (SELECT *, list_filter(base, lambda x: x.c = client_id)[1] AS mine
          FROM (SELECT o.budget_id, o.n, o.request_id, o.client_id, o.at_us, len(list_filter(w.m, lambda x: x.c = o.client_id)) > 0 AS known,
              CASE WHEN len(list_filter(w.m, lambda x: x.c = o.client_id)) = 0 AND len(w.m) >= {CLIENT_CAP} THEN list_filter(w.m, lambda x: o.at_us - x.s < 3600000000) ELSE w.m END AS base
            FROM w JOIN o ON o.budget_id = w.budget_id AND o.n = w.n + 1))))
    SELECT request_id, allowed, refused_full, CAST(len(m) AS INTEGER) AS tracked FROM w WHERE n > 0""",
)
def bounded_clients(spark, folder):
    return st.bounded_clients(requests(spark, folder), ["request_id"], CLIENT_CAP)


_KIND = {"signup": "reserve", "view": "start", "click": "observe", "purchase": "accept", "error": "fail"}


def lifecycle_events(spark, folder):
    r = requests(spark, folder)
    kind = F.create_map(*[F.lit(v) for kv in _KIND.items() for v in kv])[F.col("event_type")]
    swap = F.when((F.col("request_id") % 9 == 0) & (kind == "fail"), "receipt").otherwise(kind)
    return r.select(
        F.col("request_id").alias("event_id"),
        F.col("client_id").alias("call_id"),
        "at_us",
        swap.alias("event"),
        (F.col("request_id") % 3 != 0).alias("valid"),
    )


_LIFE = (
    _R
    + """, e AS (SELECT request_id AS event_id, client_id AS call_id, at_us, request_id % 3 <> 0 AS valid, CASE event_type WHEN 'signup' THEN 'reserve' WHEN 'view' THEN 'start' WHEN 'click' THEN 'observe'
      WHEN 'purchase' THEN 'accept' ELSE CASE WHEN request_id % 9 = 0 THEN 'receipt' ELSE 'fail' END END AS ev FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY at_us, event_id) AS rn FROM e),
    w(call_id, rn, event_id, state, obs, legal) AS (SELECT DISTINCT call_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', false, true FROM n
      UNION ALL SELECT n.call_id, n.rn, n.event_id,
        CASE WHEN w.state = '' AND ev = 'reserve' THEN 'reserved' WHEN w.state = 'reserved' AND ev = 'start' THEN 'started' WHEN w.state = 'started' AND ev = 'accept' THEN CASE WHEN w.obs THEN 'pending-billing' ELSE 'unknown-cost' END
          WHEN w.state = 'started' AND ev = 'fail' THEN CASE WHEN w.obs THEN 'failed-cost-held' ELSE 'unknown-cost' END
          WHEN ev = 'receipt' AND w.state IN ('pending-billing', 'failed-cost-held', 'unknown-cost') THEN 'reconciled' ELSE w.state END,
        CASE WHEN w.state = 'started' AND ev = 'observe' THEN n.valid ELSE w.obs END,
        (w.state = '' AND ev = 'reserve') OR (w.state = 'reserved' AND ev = 'start') OR (w.state = 'started' AND ev IN ('observe', 'accept', 'fail')) OR (ev = 'receipt' AND w.state IN ('pending-billing', 'failed-cost-held', 'unknown-cost'))
      FROM w JOIN n ON n.call_id = w.call_id AND n.rn = w.rn + 1)
    SELECT call_id, event_id, state, legal FROM w WHERE rn > 0"""
)


@query("call_lifecycle", _LIFE)
def call_lifecycle(spark, folder):
    return st.call_lifecycle(lifecycle_events(spark, folder), ["call_id", "event_id"])


_ROLL = (
    _R
    + """, s AS (SELECT *, at_us AS reserved_us, at_us + request_id % 5 * 3600000000 AS started_us FROM r),
    e AS (SELECT request_id, budget_id, false AS starts, reserved_us AS t, floor((reserved_us + 32400000000) / 86400000000.0) AS day, floor((started_us + 32400000000) / 86400000000.0) <> day AS moved FROM s
      UNION ALL SELECT request_id, budget_id, true, started_us, floor((started_us + 32400000000) / 86400000000.0) AS day, floor((reserved_us + 32400000000) / 86400000000.0) <> day FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY budget_id, day ORDER BY t, starts, request_id) AS rn FROM e),
    w(budget_id, day, rn, request_id, starts, moved, held, fits) AS (SELECT DISTINCT budget_id, day, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false, false, CAST(0 AS BIGINT), true FROM n
      UNION ALL SELECT budget_id, day, rn, request_id, starts, moved, CASE WHEN NOT starts OR (moved AND ok) THEN held + 6334656 ELSE held END, ok
      FROM (SELECT n.*, w.held, NOT n.starts OR NOT n.moved OR w.held + 6334656 <= 50000000 AS ok FROM w JOIN n ON n.budget_id = w.budget_id AND n.day = w.day AND n.rn = w.rn + 1) AS q)
    SELECT request_id, moved, fits FROM w WHERE rn > 0 AND starts"""
)


@query("midnight_rollover", _ROLL)
def midnight_rollover(spark, folder):
    r = requests(spark, folder)
    starts = r.select(
        "request_id",
        "budget_id",
        F.col("at_us").alias("reserved_us"),
        (F.col("at_us") + (F.col("request_id") % 5) * st.HOUR_US).alias("started_us"),
        F.lit(6_334_656).alias("cost"),
    )
    return st.midnight_rollover(starts, st.UNIT // 2, ["request_id"])


_ADMIT = (
    _R
    + """, n AS (SELECT *, (1 + request_id % 3) * 6334656 AS ask, request_id % 17 = 0 AS blocked, CAST(floor((at_us + 32400000000) / 86400000000.0) AS BIGINT) AS day, row_number() OVER (PARTITION BY budget_id ORDER BY at_us, request_id) AS rn FROM r),
    w(budget_id, rn, request_id, day, dh, h, ok) AS (SELECT DISTINCT budget_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(1500000 AS BIGINT), false FROM n
      UNION ALL SELECT budget_id, rn, request_id, day, CASE WHEN ok THEN base + ask ELSE base END, CASE WHEN ok THEN h + ask ELSE h END, ok
      FROM (SELECT n.budget_id, n.rn, n.request_id, n.day, n.ask, w.h, CASE WHEN n.day = w.day THEN w.dh ELSE 0 END AS base,
          NOT n.blocked AND n.ask <= 15000000 AND CASE WHEN n.day = w.day THEN w.dh ELSE 0 END + n.ask <= 500000000 AND w.h + n.ask <= 10000000000 AS ok
        FROM w JOIN n ON n.budget_id = w.budget_id AND n.rn = w.rn + 1) AS s)
    SELECT request_id, ok AS admitted FROM w WHERE rn > 0"""
)


@query("admission_stream", _ADMIT)
def admission_stream(spark, folder):
    """Prices and ceilings of the ledger; every seventeenth request meets an open blocking call."""
    r = requests(spark, folder).withColumns(
        {"calls": (1 + F.col("request_id") % 3).cast("int"), "blocked": F.col("request_id") % 17 == 0}
    )
    step = st.admission_step(6_334_656, 15_000_000, 5 * st.UNIT, 100 * st.UNIT, 1_500_000)
    return st.admission(r, step, ["request_id"])


_TTL = (
    _R
    + """, k AS (SELECT *, client_id % 50 AS case_id, event_type <> 'error' AS ok FROM r),
    w(k, start) AS (SELECT case_id, min(at_us) FILTER (WHERE ok) FROM k GROUP BY 1 UNION ALL SELECT w.k, (SELECT min(k.at_us) FROM k WHERE k.case_id = w.k AND k.ok AND k.at_us >= w.start + 900000000) FROM w
      WHERE EXISTS (SELECT 1 FROM k WHERE k.case_id = w.k AND k.ok AND k.at_us >= w.start + 900000000)),
    a AS (SELECT k.request_id, k.at_us, w.start FROM k ASOF LEFT JOIN w ON k.case_id = w.k AND k.at_us > w.start)
    SELECT request_id, coalesce(at_us - start < 900000000, false) AS cached FROM a"""
)


@query("ttl_dedup", _TTL)
def ttl_dedup(spark, folder):
    r = requests(spark, folder).withColumns(
        {"case_id": F.col("client_id") % 50, "success": F.col("event_type") != "error"}
    )
    return st.ttl_dedup(r, "case_id", ["request_id"])


@query(
    "journal",
    _R
    + """, e AS (SELECT request_id, client_id, CASE WHEN request_id % 11 = 0 THEN at_us - 86400000000 ELSE at_us END AS at_us, request_id % 13 <> 0 AS valid FROM r),
    p AS (SELECT *, max(CASE WHEN valid THEN at_us END) OVER q AS hi, first_value(at_us) OVER (PARTITION BY client_id ORDER BY request_id) AS st FROM e WINDOW q AS (PARTITION BY client_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, valid AND at_us >= greatest(coalesce(hi, st), st) AS ok FROM p),
    s AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY client_id ORDER BY request_id ROWS UNBOUNDED PRECEDING) AS n FROM f)
    SELECT request_id, CASE WHEN ok THEN CAST(n AS INT) END AS sequence, CASE WHEN ok THEN (at_us - st) / 1000.0 END AS offset_ms FROM s""",
)
def journal(spark, folder):
    r = requests(spark, folder)
    late = F.col("request_id") % 11 == 0
    events = r.select(
        "request_id",
        F.col("client_id").alias("session_id"),
        F.col("request_id").alias("arrival"),
        F.lit(1).alias("generation"),
        F.when(late, F.col("at_us") - st.DAY_US).otherwise(F.col("at_us")).alias("at_us"),
        (F.col("request_id") % 13 != 0).alias("valid"),
    )
    return st.journal(events, ["request_id"]).drop("dropped")


@query(
    "qc_findings",
    f"SELECT lang, category, 'review' AS severity, pairs AS findings FROM ({literal_checks.ORACLE['coverage_rollup']}) AS c WHERE state = 'warning'",
)
def qc_findings(spark, folder):
    """The stateless plan of the check stream, on a table."""
    done = checks.findings(checks.evaluate(relation(spark, folder, "pairs"), list(literal_checks._ROLLED)))
    return done.groupBy("lang", "category", "severity").agg(F.count("*").alias("findings"))
