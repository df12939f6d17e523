"""Literal checks and receipt matching on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.qc import checks


def qc_stream(pairs: DataFrame) -> DataFrame:
    """Findings of a stream of pairs; the same narrow plan as on a table, no state."""
    return checks.findings(checks.evaluate(pairs))


def reconcile_stream(calls: DataFrame, receipts: DataFrame, delay: str = "2 days") -> DataFrame:
    """Calls with their receipts, as an outer stream-stream join.

    The watermark is our choice: a receipt later than ``delay`` after its call
    finished comes out unmatched and goes through the batch reconciliation.
    """
    c = calls.withWatermark("finished_at", delay).alias("c")
    r = receipts.withWatermark("confirmed_at", delay).alias("r")
    on = (
        (F.col("c.call_id") == F.col("r.r_call_id"))
        & (F.col("r.confirmed_at") >= F.col("c.finished_at"))
        & (F.col("r.confirmed_at") <= F.col("c.finished_at") + F.expr(f"INTERVAL {delay}"))
    )
    joined = c.join(r, on, "left_outer")
    valid = (F.col("r_bucket") == F.col("bucket")) & F.col("r_billed").between(0, F.col("reserved_usd"))
    outcome = F.when(F.col("r_call_id").isNull(), "unmatched").when(valid, "applied").otherwise("rejected")
    return joined.select("call_id", "r_call_id", outcome.alias("outcome"))
