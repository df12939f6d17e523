"""Sinks that never replace evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write once; fails when anything is already there."""
    df.write.mode("errorifexists").format(fmt).save(path)
