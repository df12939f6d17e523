"""Per-row literal inventories used by every check.

Everything here is a narrow projection: one scan, no shuffle, usable on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions import literals as lit
from twinfold.functions import multiset as ms
from twinfold.functions import text as tx


def prepare(pairs: DataFrame) -> DataFrame:
    """Add the inventories of both sides to ``pairs(source, draft, lang)``."""
    src, dft = F.col("source"), F.col("draft")
    base = pairs.withColumn("numeric_draft", lit.comparable_draft(src, dft, F.col("lang")))
    num = F.col("numeric_draft")
    tokens = base.withColumns(
        {
            "src_number_tokens": tx.matches(src, lit.NUMBER),
            "draft_number_tokens": tx.matches(num, lit.NUMBER),
            "src_pair_tokens": tx.matches(src, lit.UNIT_PAIR),
            "draft_pair_tokens": tx.matches(dft, lit.UNIT_PAIR),
            "src_sci_tokens": lit.plain_tokens(tx.matches(src, lit.SCIENTIFIC)),
            "draft_sci_tokens": lit.plain_tokens(tx.matches(num, lit.SCIENTIFIC)),
            "src_sci_candidates": lit.plain_tokens(tx.matches(src, lit.SCIENTIFIC_CANDIDATE)),
            "draft_sci_candidates": lit.plain_tokens(tx.matches(num, lit.SCIENTIFIC_CANDIDATE)),
        }
    )

    def folded(tokens: str, key) -> Column:
        return ms.keyed(F.col(tokens), key, lit.plain_tokens(F.col(tokens)))

    return tokens.withColumns(
        {
            "src_numbers": folded("src_number_tokens", lit.number_key),
            "draft_numbers": folded("draft_number_tokens", lit.number_key),
            "src_units": ms.keyed(tx.matches(src, lit.UNIT), lit.unit_key),
            "draft_units": ms.keyed(tx.matches(dft, lit.UNIT), lit.unit_key),
            "src_pairs": folded("src_pair_tokens", lit.pair_key),
            "draft_pairs": folded("draft_pair_tokens", lit.pair_key),
            "src_codes": ms.keyed(tx.matches(src, lit.IDENTIFIER), lit.identifier_key),
            "draft_codes": ms.keyed(tx.matches(dft, lit.IDENTIFIER), lit.identifier_key),
        }
    ).withColumn("numeric_supported", numeric_gate("src", "draft"))


def _ordinary(numbers: Column) -> Column:
    """Keys of the plain numbers; a scientific key always holds an ``e``."""
    return F.array_sort(F.filter(ms.keys(numbers), lambda k: ~k.contains("e")))


def numeric_gate(src: str, dft: str) -> Column:
    """Whether scientific notation on both sides can be compared at all."""
    s_cand, d_cand = F.col(f"{src}_sci_candidates"), F.col(f"{dft}_sci_candidates")
    s_sci, d_sci = F.col(f"{src}_sci_tokens"), F.col(f"{dft}_sci_tokens")
    unusable = lambda token: lit.scientific_key(token).isNull()
    shape = (
        (F.size(s_cand) == F.size(s_sci))
        & (F.size(d_cand) == F.size(d_sci))
        & (F.size(s_sci) == F.size(d_sci))
        & ~F.exists(s_cand, unusable)
        & ~F.exists(d_cand, unusable)
    )
    ordinary_same = _ordinary(F.col(f"{src}_numbers")) == _ordinary(F.col(f"{dft}_numbers"))
    return shape & ((F.size(s_sci) == 0) | ordinary_same)


def counted_inventory(prepared: DataFrame, kind: str) -> DataFrame:
    """Long form ``(pair_id, side, key, n)`` of one inventory kind.

    ``kind`` is ``numbers``, ``units``, ``pairs`` or ``codes``. The exploded
    tokens are counted map-side before the shuffle. The outer form of explode
    keeps Spark from pushing a size filter that would extract everything twice.
    """
    sides = F.array(
        F.struct(F.lit("source").alias("side"), F.col(f"src_{kind}").alias("items")),
        F.struct(F.lit("draft").alias("side"), F.col(f"draft_{kind}").alias("items")),
    )
    return (
        prepared.select("pair_id", F.explode_outer(sides).alias("s"))
        .select("pair_id", F.col("s.side").alias("side"), F.explode_outer("s.items").alias("item"))
        .where(F.col("item").isNotNull())
        .groupBy("pair_id", "side", F.col("item.key").alias("key"))
        .agg(F.count("*").alias("n"))
    )
