"""Inline run markers, run redistribution and run status: per-row expressions."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions import text as tx

MARKER_LIMIT, BOUNDARY_REACH = 48, 12
DEFAULT_TAG = "DOC"


def marker_pattern(tag: str = DEFAULT_TAG) -> str:
    return rf"⟦{tag}_\d{{4}}⟧"


def markers(text: Column, tag: str = DEFAULT_TAG) -> Column:
    return tx.matches(text, marker_pattern(tag))


def strip_markers(text: Column, tag: str = DEFAULT_TAG) -> Column:
    return F.regexp_replace(text, marker_pattern(tag), "")


def marker_spans(text: Column, tag: str = DEFAULT_TAG) -> Column:
    """Texts between markers, one per marker."""
    return F.filter(F.split(text, marker_pattern(tag)), lambda _, i: i > 0)


def _malformed(text: Column, tag: str) -> Column:
    found = markers(text, tag)
    n = F.size(found)
    expected = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit(f"⟦{tag}_"), F.format_string("%04d", i), F.lit("⟧")),
    )
    bare = strip_markers(text, tag)
    return (
        ~n.between(1, MARKER_LIMIT)
        | tx.is_blank(bare)
        | ~text.rlike("^" + marker_pattern(tag))
        | (found != expected)
        | F.contains(bare, F.lit(f"⟦{tag}"))
    )


def inline_contract(units: DataFrame, tag: str = DEFAULT_TAG) -> DataFrame:
    """Whether a target keeps the markers of its source, with stripped texts."""
    src, dst = F.col("source"), F.col("target")
    marked = lambda t: F.contains(t, F.lit(f"⟦{tag}"))
    same = markers(src, tag) == markers(dst, tag)
    valid = F.when(~marked(src), ~marked(dst)).otherwise(~_malformed(src, tag) & ~_malformed(dst, tag) & same)
    return units.withColumns(
        {
            "valid": F.coalesce(valid, F.lit(False)),
            "source_text": strip_markers(src, tag),
            "target_text": strip_markers(dst, tag),
            "target_spans": marker_spans(dst, tag),
        }
    )


_CUT_AT = regex.compile(r"[\s\p{P}\p{S}]")


def _cut(text: str, lengths: list[int]) -> list[str]:
    """Pieces of one text for runs of the given lengths."""
    total, cursor, parts = sum(lengths), 0, []
    for weight in lengths[:-1]:
        end = wanted = min(cursor + round(len(text) * weight / total), len(text))
        if cursor < wanted < len(text):
            for d in range(BOUNDARY_REACH + 1):
                if wanted + d < len(text) and _CUT_AT.match(text[wanted + d]):
                    end = wanted + d + 1
                    break
                if wanted - d > cursor and _CUT_AT.match(text[wanted - d - 1]):
                    end = wanted - d
                    break
        parts.append(text[cursor:end])
        cursor = end
    return [*parts, text[cursor:]] if lengths else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut_all(texts: pd.Series, lengths: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or n is None else _cut(t, list(n)) for t, n in zip(texts, lengths)])


def distribute_text(units: DataFrame) -> DataFrame:
    """Cut ``translated`` over the original ``runs`` in proportion to their lengths.

    A cut moves to the nearest space, punctuation or symbol within reach. The cut
    depends on the one before it, so the walk is an Arrow-batched helper. A null text or null runs give null.
    """
    lengths = F.transform(F.filter("runs", lambda r: F.length(r) > 0), F.length)
    return units.withColumn("parts", _cut_all("translated", lengths))


def run_status(runs: DataFrame) -> DataFrame:
    """``ok`` or ``partial`` from the stage states, with the completed time."""
    rules, critique = F.col("rules_state"), F.col("critique_state")
    done = (rules == "completed") & critique.isin("completed", "skipped")
    status = (
        F.when(F.col("translation_state") == "failed", "provider-error").when(done, "ok").otherwise("partial")
    )
    elapsed = sum(
        (F.when(F.col(f"{s}_state") == "completed", F.col(f"{s}_ms")).otherwise(0) for s in ("translation", "critique", "rules")),
        F.lit(0),
    )
    return runs.withColumns({"status": status, "elapsed_ms": elapsed})


def truncate_list(df: DataFrame, column: str, most: int) -> DataFrame:
    """First ``most`` entries and an explicit overflow flag."""
    return df.withColumns(
        {f"{column}_overflow": F.size(column) > most, column: F.slice(column, 1, most)}
    )
