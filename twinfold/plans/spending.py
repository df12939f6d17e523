"""Queries of the cost ledger."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from twinfold.operators import ledger as lg
from twinfold.plans.tables import ansi, relation
from twinfold.streaming import stateful

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LIMITS = lg.Limits(
    promo_remaining=Decimal("25"), trial_remaining=Decimal("1"), cash_remaining=Decimal("25")
)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def calls(spark, folder):
    return relation(spark, folder, "calls")


_HELD = (
    "CASE WHEN state = 'cancelled' THEN 0 WHEN admission_policy = 'reserved-budget-v2' THEN reserved_usd "
    "WHEN state = 'reconciled' THEN billed_cost_usd ELSE reserved_usd END"
)
_C = f"WITH c AS (SELECT *, CAST({_HELD} AS DECIMAL(24,10)) AS held FROM ({ansi('calls')}) AS x)"
_BLOCK = """(state IN ('reserved', 'started', 'pending-billing', 'unknown-cost', 'failed-cost-held')
  AND NOT (admission_policy <> 'settled' AND bucket = 'operator-budget' AND (state = 'pending-billing' OR loss_accepted))
  AND NOT (admission_policy = 'reserved-budget-v2' AND coalesce(outcome, '') = 'failed' AND started_at IS NOT NULL AND finished_at >= started_at
    AND ((state = 'unknown-cost' AND observed_at IS NULL) OR (state = 'failed-cost-held' AND estimated_cost_usd IS NOT NULL)) AND owner_gone))"""


@query(
    "committed",
    _C + " SELECT budget_id, state, count(*) AS calls, CAST(sum(held) AS DOUBLE) AS held FROM c GROUP BY ALL",
)
def committed(spark, folder):
    return calls(spark, folder).groupBy("budget_id", "state").agg(
        F.count("*").alias("calls"), F.sum(lg.committed()).cast("double").alias("held")
    )


@query(
    "accounting_day",
    "SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS events FROM events GROUP BY ALL",
)
def accounting_day(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.groupBy(lg.accounting_day(F.col("ts")).alias("day")).agg(F.count("*").alias("events"))


@query(
    "budget_check",
    _C
    + """, w AS (SELECT *, coalesce(sum(held) OVER (PARTITION BY budget_id, day ORDER BY reserved_at, call_id, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dayb,
    coalesce(sum(held) OVER (PARTITION BY budget_id ORDER BY reserved_at, call_id, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS allb FROM c)
    SELECT event_id, CAST(dayb AS DOUBLE) AS day_before, CAST(allb AS DOUBLE) AS held_before, dayb + reserved_usd <= 5 AS within_day,
    allb + reserved_usd + 0.015 <= 100 AS within_budget FROM w""",
)
def budget_check(spark, folder):
    return lg.budget_check(calls(spark, folder), LIMITS).select(
        "event_id",
        F.col("day_before").cast("double").alias("day_before"),
        F.col("held_before").cast("double").alias("held_before"),
        "within_day",
        "within_budget",
    )


@query(
    "bucket_report",
    _C
    + """, b AS (SELECT budget_id, coalesce(sum(held) FILTER (WHERE bucket = 'promo'), 0) AS p, coalesce(sum(held) FILTER (WHERE bucket = 'trial'), 0) AS t,
    coalesce(sum(held) FILTER (WHERE bucket = 'cash'), 0) AS k FROM c GROUP BY 1)
    SELECT budget_id, CAST(p AS DOUBLE) AS promo, CAST(t AS DOUBLE) AS trial, CAST(k AS DOUBLE) AS cash, p <= 5 AS promo_ok, t <= 1 AS trial_ok, k + 0.015 <= 5 AS cash_ok FROM b""",
)
def bucket_report(spark, folder):
    r = lg.bucket_report(calls(spark, folder), LIMITS)
    sums = [F.col(c).cast("double").alias(c) for c in ("promo", "trial", "cash")]
    return r.select("budget_id", *sums, "promo_ok", "trial_ok", "cash_ok")


@query("blocking_calls", _C + f" SELECT event_id, state, admission_policy FROM c WHERE {_BLOCK}")
def blocking_calls(spark, folder):
    return calls(spark, folder).where(lg.blocking(LIMITS)).select("event_id", "state", "admission_policy")


@query(
    "estimate_cost",
    "SELECT event_id, CASE WHEN event_id % 1900 <= 1800 THEN CAST(((event_id % 2000) * CAST(0.06 AS DECIMAL(4,2)) + (event_id % 1900) * CAST(0.24 AS DECIMAL(4,2))) "
    "* CASE WHEN event_id % 2 = 0 THEN CAST(1 AS DECIMAL(6,4)) ELSE CAST(1.1 AS DECIMAL(6,4)) END AS DOUBLE) / 1000000 END AS estimate FROM events",
)
def estimate_cost(spark, folder):
    return calls(spark, folder).select(
        "event_id", F.round(lg.estimate_cost("model-a").cast("double"), 12).alias("estimate")
    )


@query(
    "max_call_cost",
    _C
    + " SELECT event_id, CAST(ceil((1048576 * 0.06 + 1800 * 0.24) / 1000000 * CAST(tax_multiplier AS DOUBLE) * 100000000 - 0.000001) / 100000000 AS DOUBLE) AS bound FROM c",
)
def max_call_cost(spark, folder):
    return calls(spark, folder).select(
        "event_id", lg.max_call_cost(F.col("tax_multiplier")).cast("double").alias("bound")
    )


@query(
    "run_estimate",
    _C
    + """ SELECT run_id, CASE WHEN count(*) FILTER (WHERE state <> 'cancelled') > 0 AND count(*) FILTER (WHERE state <> 'cancelled')
    = count(estimated_cost_usd) FILTER (WHERE state <> 'cancelled') THEN CAST(sum(estimated_cost_usd) FILTER (WHERE state <> 'cancelled') AS DOUBLE) END AS estimate FROM c GROUP BY run_id""",
)
def run_estimate(spark, folder):
    r = lg.run_estimate(calls(spark, folder))
    return r.select("run_id", F.col("estimate").cast("double").alias("estimate"))


@query(
    "lifetime_attempts",
    "WITH RECURSIVE r AS (SELECT 'b' || user_id % 10 AS budget_id, event_id AS request_id, ts, 1 + event_id % 2 AS attempts FROM events), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY budget_id ORDER BY ts, request_id) AS rn FROM r), "
    "w(budget_id, rn, request_id, b, used, fits) AS (SELECT DISTINCT budget_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), true FROM n "
    "UNION ALL SELECT n.budget_id, n.rn, n.request_id, w.used, CASE WHEN w.used + attempts <= 999 THEN w.used + attempts ELSE w.used END, w.used + attempts <= 999 "
    "FROM w JOIN n ON n.budget_id = w.budget_id AND n.rn = w.rn + 1) "
    "SELECT request_id, b AS before, fits FROM w WHERE rn > 0",
)
def lifetime_attempts(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    requests = e.select(
        F.concat(F.lit("b"), (F.col("user_id") % 10).cast("string")).alias("budget_id"),
        F.col("event_id").alias("request_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        (1 + F.col("event_id") % 2).alias("attempts"),
    )
    return stateful.lifetime_attempts(requests, 999, ["request_id"])


@query(
    "availability",
    _C
    + f""" SELECT budget_id, count(*) FILTER (WHERE {_BLOCK}) AS blockers, CAST(coalesce(sum(held) FILTER (WHERE day = '2024-01-15'), 0) AS DOUBLE) AS day_held,
    CAST(sum(held) AS DOUBLE) AS held, count(*) FILTER (WHERE {_BLOCK}) = 0 AND coalesce(sum(held) FILTER (WHERE day = '2024-01-15'), 0) + 0.12669312 <= 5
    AND sum(held) + 0.12669312 + 0.015 <= 100 AS available FROM c GROUP BY budget_id""",
)
def availability(spark, folder):
    a = lg.availability(calls(spark, folder), LIMITS, F.lit("2024-01-15"), 2, F.lit(Decimal(1)))
    return a.select(
        "budget_id",
        "blockers",
        F.col("day_held").cast("double").alias("day_held"),
        F.col("held").cast("double").alias("held"),
        "available",
    )


_NOW = "TIMESTAMP '2024-01-28 00:00:00'"


@query(
    "reconcile",
    f"""WITH c AS (SELECT * FROM ({ansi('calls')}) AS x WHERE run_id <> 'run-x'), r AS ({ansi('receipts')}), j AS (SELECT r.receipt_id, r.call_id, r.billed_cost_usd AS rb, r.evidence AS re, r.confirmed_at AS rc, c.state,
    c.billed_cost_usd AS cb, c.billing_receipt AS ce, c.billing_confirmed_at AS cc,
    coalesce(r.model = 'model-a' AND r.confirmed_at <= {_NOW} AND NOT c.loss_accepted AND r.bucket = c.bucket AND r.billed_cost_usd BETWEEN 0 AND c.reserved_usd
      AND r.confirmed_at >= coalesce(c.finished_at, c.started_at, c.reserved_at)
      AND (c.state IN ('pending-billing', 'failed-cost-held', 'unknown-cost', 'reconciled') OR (c.state IN ('reserved', 'started') AND c.owner_gone)), false) AS ok
    FROM r LEFT JOIN c USING (call_id)),
    k AS (SELECT *, min(CASE WHEN ok AND state <> 'reconciled' THEN receipt_id END) OVER (PARTITION BY call_id) AS fid FROM j),
    l AS (SELECT k.*, f.rb AS fb, f.re AS fe, f.rc AS fc FROM k LEFT JOIN j f ON f.receipt_id = k.fid AND f.call_id = k.call_id)
    SELECT receipt_id, call_id, CASE WHEN state IS NULL THEN 'unmatched' WHEN NOT ok THEN 'rejected' WHEN state = 'reconciled' AND rb = cb AND re = ce AND rc = cc THEN 'replay'
      WHEN state = 'reconciled' THEN 'rejected' WHEN receipt_id = fid THEN 'applied' WHEN rb = fb AND re = fe AND rc = fc THEN 'replay' ELSE 'rejected' END AS outcome FROM l""",
)
def reconcile(spark, folder):
    now = F.to_timestamp_ntz(F.lit("2024-01-28 00:00:00"))
    well_formed = calls(spark, folder).where("run_id <> 'run-x'")
    return lg.reconcile(well_formed, relation(spark, folder, "receipts"), "model-a", now)


_VALID_EV = "regexp_matches({0}, '^[A-Za-z0-9._:-]{{1,160}}$')"


@query(
    "ledger_rules",
    f"""WITH c AS ({ansi('calls')}), b AS (SELECT event_id, unnest([
      CASE WHEN NOT regexp_matches(run_id, '^[0-9A-Fa-f]{{32}}$') THEN 'run-id' END,
      CASE WHEN NOT {_VALID_EV.format('billing_evidence')} THEN 'evidence' END,
      CASE WHEN reserved_usd <= 0 OR reserved_usd > 0.15 THEN 'reserved' END,
      CASE WHEN state = 'pending-billing' AND estimated_cost_usd IS NULL THEN 'pending-estimate' END,
      CASE WHEN estimated_cost_usd > reserved_usd THEN 'estimate' END]) AS rule FROM c)
    SELECT event_id, rule FROM b WHERE rule IS NOT NULL""",
)
def ledger_rules(spark, folder):
    checked = lg.ledger_rules(calls(spark, folder), "model-a", "price-1")
    return (
        checked.select("event_id", F.explode_outer("broken").alias("rule")).where("rule is not null")
    )


@query(
    "read_ledger",
    f"""WITH c AS ({ansi('calls')}), v AS (SELECT budget_id, call_id, count(*) AS n, max(CASE WHEN NOT regexp_matches(run_id, '^[0-9A-Fa-f]{{32}}$')
      OR NOT {_VALID_EV.format('billing_evidence')} OR reserved_usd <= 0 OR reserved_usd > 0.15 OR (state = 'pending-billing' AND estimated_cost_usd IS NULL)
      OR coalesce(estimated_cost_usd > reserved_usd, false) THEN 1 ELSE 0 END) AS bad FROM c GROUP BY ALL)
    SELECT budget_id, CAST(sum(n) AS BIGINT) AS calls, count(*) FILTER (WHERE bad = 1) AS invalid_calls, count(*) FILTER (WHERE n > 1) AS repeated_ids,
      max(bad) = 0 AND max(n) = 1 AS accepted FROM v GROUP BY budget_id""",
)
def read_ledger(spark, folder):
    return lg.ledger_gate(lg.ledger_rules(calls(spark, folder), "model-a", "price-1"))
