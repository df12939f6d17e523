"""Cost-ledger analytics over call rows. Money stays DECIMAL until a report casts it."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators.wide_window import running_before

# ---- fixed values ----------------------------------------------------------
STATES = (
    "reserved", "started", "pending-billing", "unknown-cost", "failed-cost-held", "cancelled", "reconciled",
)
UNRESOLVED = ("reserved", "started", "pending-billing", "unknown-cost", "failed-cost-held")
SETTLED, RESERVATION, PERMANENT = "settled", "reserved-budget-v1", "reserved-budget-v2"
SETTLED_BUCKETS, OPERATOR_BUCKET = ("trial", "cash", "promo"), "operator-budget"
INPUT_BOUND, OUTPUT_BOUND = 1_048_576, 1_800
INPUT_PER_MILLION, OUTPUT_PER_MILLION = Decimal("0.06"), Decimal("0.24")
PRIOR_CASH_HOLD = Decimal("0.015")
CALL_CEILING = Decimal("0.15")
PROMO_EXPOSURE, PROMO_PROTECTED = Decimal("5"), Decimal("20")
DAY_OFFSET_HOURS = 9
MONEY = "decimal(24,10)"


@dataclass(frozen=True)
class Limits:
    """Spend ceilings of one policy."""

    policy: str = PERMANENT
    daily: Decimal = Decimal("5")
    budget: Decimal = Decimal("100")
    per_run: Decimal = CALL_CEILING
    promo_remaining: Decimal | None = None
    trial_remaining: Decimal | None = None
    cash_remaining: Decimal | None = None
    extra: dict = field(default_factory=dict)


def money(value: Column | Decimal) -> Column:
    return (F.lit(value) if isinstance(value, Decimal) else value).cast(MONEY)


def committed(state="state", policy="admission_policy", reserved="reserved_usd", billed="billed_cost_usd") -> Column:
    """What a call holds against its budget."""
    return (
        F.when(F.col(state) == "cancelled", money(Decimal(0)))
        .when(F.col(policy) == PERMANENT, money(F.col(reserved)))
        .when(F.col(state) == "reconciled", money(F.col(billed)))
        .otherwise(money(F.col(reserved)))
    )


def accounting_day(ts: Column) -> Column:
    """Calendar day at UTC+9 of a UTC wall-clock timestamp, as text."""
    return (ts + F.expr(f"INTERVAL {DAY_OFFSET_HOURS} HOURS")).cast("date").cast("string")


def hour_tile(ts: Column) -> Column:
    """Hour of a timestamp as text; grows with time in any session zone."""
    return F.concat(ts.cast("date").cast("string"), F.format_string(" %02d", F.hour(ts)))


def max_call_cost(tax: Column) -> Column:
    """Upper bound of one call, rounded up at eight decimals."""
    bound = (INPUT_BOUND * INPUT_PER_MILLION + OUTPUT_BOUND * OUTPUT_PER_MILLION) / Decimal(1_000_000)
    scaled = F.lit(bound * Decimal(100_000_000)).cast("decimal(20,2)") * tax.cast("decimal(6,4)")
    return (F.ceil(scaled).cast("decimal(20,0)") / F.lit(Decimal(100_000_000))).cast("decimal(20,8)")


def estimate_cost(model: str) -> Column:
    """Usage estimate; NULL unless the model is the priced one and counts are in bounds."""
    p, c = F.col("prompt_tokens"), F.col("completion_tokens")
    valid = (
        (F.col("model") == model) & p.between(0, INPUT_BOUND) & c.between(0, OUTPUT_BOUND)
    )
    raw = p.cast("decimal(10,0)") * F.lit(INPUT_PER_MILLION) + c.cast("decimal(10,0)") * F.lit(OUTPUT_PER_MILLION)
    per_call = (raw * F.lit(Decimal("0.000001"))).cast("decimal(20,8)")
    return F.when(valid, (per_call * F.col("tax_multiplier").cast("decimal(6,4)")).cast("decimal(24,12)"))


def blocking(limits: Limits, owner_gone: str = "owner_gone", loss_accepted: str = "loss_accepted") -> Column:
    """Whether an unresolved call stops new admissions under the policy."""
    operator = (
        F.col("admission_policy").isin(RESERVATION, PERMANENT)
        & (F.col("bucket") == OPERATOR_BUCKET)
        & ((F.col("state") == "pending-billing") | F.col(loss_accepted))
        & F.lit(limits.policy in (RESERVATION, PERMANENT))
    )
    finished = (
        F.lit(limits.policy == PERMANENT)
        & (F.col("admission_policy") == PERMANENT)
        & (F.col("outcome") == "failed")
        & F.col("started_at").isNotNull()
        & (F.col("finished_at") >= F.col("started_at"))
        & (
            ((F.col("state") == "unknown-cost") & F.col("observed_at").isNull())
            | ((F.col("state") == "failed-cost-held") & F.col("estimated_cost_usd").isNotNull())
        )
        & F.col(owner_gone)
    )
    return F.col("state").isin(*UNRESOLVED) & ~F.coalesce(operator, F.lit(False)) & ~F.coalesce(finished, F.lit(False))


def budget_check(calls: DataFrame, limits: Limits) -> DataFrame:
    """Per call: what was held before it that day and in total, and whether it fits.

    Running sums go through hourly tiles, so one very busy budget is spread over
    many tasks.
    """
    held = calls.withColumn("held", committed())
    tile = hour_tile(F.col("reserved_at"))
    # call ids can repeat, so an event id settles ties where there is one
    order = [F.col(c) for c in ("reserved_at", "call_id", "event_id") if c in calls.columns]
    total = running_before(held, ["budget_id"], tile, order, {"held_before": F.col("held")})
    daily = running_before(total, ["budget_id", "day"], tile, order, {"day_before": F.col("held")})
    request = money(F.col("reserved_usd"))
    return daily.withColumns(
        {
            "within_day": F.col("day_before") + request <= money(limits.daily),
            "within_budget": F.col("held_before") + request + money(PRIOR_CASH_HOLD) <= money(limits.budget),
        }
    )


def bucket_report(calls: DataFrame, limits: Limits) -> DataFrame:
    """Held amounts per budget and bucket against the bucket caps."""
    held = calls.groupBy("budget_id").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("bucket") == b, committed())), money(Decimal(0))).alias(b.split("-")[0])
            for b in (*SETTLED_BUCKETS, OPERATOR_BUCKET)
        ]
    )

    def cap(remaining: Decimal | None, most: Decimal, protected: Decimal) -> Column:
        return money(min(most, (remaining or Decimal(0)) - protected))

    return held.withColumns(
        {
            "promo_ok": F.col("promo") <= cap(limits.promo_remaining, PROMO_EXPOSURE, PROMO_PROTECTED),
            "trial_ok": F.col("trial") <= cap(limits.trial_remaining, Decimal(1), Decimal(0)),
            "cash_ok": F.col("cash") + money(PRIOR_CASH_HOLD)
            <= cap(limits.cash_remaining, Decimal(5), Decimal(20)),
        }
    )


def run_estimate(calls: DataFrame) -> DataFrame:
    """Estimate per run, only when every call that was not cancelled has one."""
    live = F.col("state") != "cancelled"
    n = F.count_if(live)
    known = F.count_if(live & F.col("estimated_cost_usd").isNotNull())
    return calls.groupBy("run_id").agg(
        F.when((n > 0) & (n == known), F.sum(F.when(live, F.col("estimated_cost_usd")))).alias("estimate")
    )


def availability(calls: DataFrame, limits: Limits, today: Column, wanted: int, tax: Column) -> DataFrame:
    """One row per budget: whether ``wanted`` more calls could start on ``today``."""
    ask = money(max_call_cost(tax) * wanted)
    totals = calls.groupBy("budget_id").agg(
        F.count_if(blocking(limits)).alias("blockers"),
        F.coalesce(F.sum(F.when(F.col("day") == today, committed())), money(Decimal(0))).alias("day_held"),
        F.coalesce(F.sum(committed()), money(Decimal(0))).alias("held"),
    )
    fits = (
        (F.col("blockers") == 0)
        & (ask <= money(limits.per_run))
        & (F.col("day_held") + ask <= money(limits.daily))
        & (F.col("held") + ask + money(PRIOR_CASH_HOLD) <= money(limits.budget))
    )
    return totals.withColumn("available", fits)


def reconcile(calls: DataFrame, receipts: DataFrame, model: str, now: Column) -> DataFrame:
    """Every receipt with its outcome: applied, replay, rejected or unmatched.

    Receipts arrive in ``receipt_id`` order: the first valid one settles the
    call, an identical later one is a replay, others conflict.
    """
    r = receipts.select(
        F.col("call_id"),
        F.col("bucket").alias("r_bucket"),
        F.col("model").alias("r_model"),
        F.col("billed_cost_usd").alias("r_billed"),
        F.col("evidence").alias("r_evidence"),
        F.col("confirmed_at").alias("r_confirmed"),
        F.col("receipt_id"),
    )
    joined = r.join(calls, "call_id", "left")
    since = F.coalesce("finished_at", "started_at", "reserved_at")
    valid = (
        evidence_id(F.col("r_evidence"))
        & (F.col("r_model") == model)
        & (F.col("r_confirmed") <= now)
        & ~F.col("loss_accepted")
        & (F.col("r_bucket") == F.col("bucket"))
        & (F.col("r_billed") >= 0)
        & (F.col("r_billed") <= F.col("reserved_usd"))
        & (F.col("r_confirmed") >= since)
        & (
            F.col("state").isin("pending-billing", "failed-cost-held", "unknown-cost", "reconciled")
            | (F.col("state").isin("reserved", "started") & F.col("owner_gone"))
        )
    )
    marked = joined.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    first = (
        marked.where("_valid and state <> 'reconciled'")
        .groupBy("call_id")
        .agg(
            F.min_by(
                F.struct("r_billed", "r_evidence", "r_confirmed", "receipt_id"),
                "receipt_id",
            ).alias("_first")
        )
    )
    settled = marked.join(first, "call_id", "left")
    already = F.col("state") == "reconciled"
    same_saved = (
        (F.col("r_billed") == F.col("billed_cost_usd"))
        & (F.col("r_evidence") == F.col("billing_receipt"))
        & (F.col("r_confirmed") == F.col("billing_confirmed_at"))
    )
    same_first = (
        (F.col("r_billed") == F.col("_first.r_billed"))
        & (F.col("r_evidence") == F.col("_first.r_evidence"))
        & (F.col("r_confirmed") == F.col("_first.r_confirmed"))
    )
    outcome = (
        F.when(F.col("state").isNull(), "unmatched")
        .when(~F.col("_valid"), "rejected")
        .when(already & same_saved, "replay")
        .when(already, "rejected")
        .when(F.col("receipt_id") == F.col("_first.receipt_id"), "applied")
        .when(same_first, "replay")
        .otherwise("rejected")
    )
    return settled.select("receipt_id", "call_id", outcome.alias("outcome"))


def evidence_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9\-_.:]{1,160}\z"), F.lit(False))


def ledger_rules(calls: DataFrame, model: str, price_version: str) -> DataFrame:
    """Names of the rules each call breaks; an empty list means a valid entry."""
    reservation = F.col("admission_policy").isin(RESERVATION, PERMANENT)
    since = F.coalesce("finished_at", "started_at", "reserved_at")
    reconciled = F.col("state") == "reconciled"
    estimated = F.col("estimated_cost_usd").isNotNull()
    rules = {
        "run-id": F.col("run_id").rlike(r"^[0-9A-Fa-f]{32}\z"),
        "call-id": F.col("call_id").isin(F.concat("run_id", F.lit("-0")), F.concat("run_id", F.lit("-1"))),
        "day": F.try_to_timestamp(F.col("day"), F.lit("yyyy-MM-dd")).isNotNull() & F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}\z"),
        "bucket": F.when(F.col("admission_policy") == SETTLED, F.col("bucket").isin(*SETTLED_BUCKETS)).otherwise(
            reservation & (F.col("bucket") == OPERATOR_BUCKET)
        ),
        "evidence": evidence_id(F.col("billing_evidence")),
        "reserved-at": F.col("reserved_at").isNotNull(),
        "price": (F.col("input_per_million") == F.lit(INPUT_PER_MILLION))
        & (F.col("output_per_million") == F.lit(OUTPUT_PER_MILLION))
        & (F.col("price_version") == price_version),
        "tax": F.col("tax_multiplier").between(1, 2),
        "reserved": (F.col("reserved_usd") > 0) & (F.col("reserved_usd") <= F.lit(CALL_CEILING)),
        "reserved-bound": ~reservation | (F.col("reserved_usd") == max_call_cost(F.col("tax_multiplier"))),
        "state": F.col("state").isin(*STATES),
        "receipt": F.when(
            reconciled,
            (F.col("billed_cost_usd") >= 0)
            & (F.col("billed_cost_usd") <= F.col("reserved_usd"))
            & evidence_id(F.col("billing_receipt"))
            & (F.col("billing_confirmed_at") >= since),
        ).otherwise(
            F.col("billed_cost_usd").isNull()
            & F.col("billing_receipt").isNull()
            & F.col("billing_confirmed_at").isNull()
        ),
        "pending-estimate": (F.col("state") != "pending-billing") | estimated,
        "pending-timeline": ~reservation
        | (F.col("state") != "pending-billing")
        | (
            (F.col("outcome") == "accepted")
            & F.col("started_at").isNotNull()
            & F.col("observed_at").isNotNull()
            & F.col("finished_at").isNotNull()
        ),
        "estimate": ~estimated
        | (
            (F.col("estimated_cost_usd") == estimate_cost(model))
            & (F.col("estimated_cost_usd") <= F.col("reserved_usd"))
        ),
    }
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return calls.withColumn("broken", broken)


def ledger_gate(checked: DataFrame) -> DataFrame:
    """One verdict per ledger: every entry valid and every call id once."""
    ids = checked.groupBy("budget_id", "call_id").agg(
        F.count("*").alias("n"), F.max(F.size("broken")).alias("worst")
    )
    return ids.groupBy("budget_id").agg(
        F.sum("n").alias("calls"),
        F.count_if(F.col("worst") > 0).alias("invalid_calls"),
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
        (F.bool_and(F.col("worst") == 0) & F.bool_and(F.col("n") == 1)).alias("accepted"),
    )
