"""Translatable units of markup, plain text and positioned page items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions import text as tx

# ---- fixed values ----------------------------------------------------------
BLOCK_TAGS = "p|h[1-6]|li|td|th|figcaption|title|text"
_DROPPED = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
_OPEN, _CLOSE = "\u0001", "\u0002"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def html_blocks(html: Column) -> Column:
    """Texts of the block elements of a page, in order.

    A block ends at its own end tag or at the next block start, so unclosed
    blocks are read like closed ones.
    """
    bare = F.regexp_replace(html, _DROPPED, "")
    opened = F.regexp_replace(bare, rf"(?i)<(?:{BLOCK_TAGS})(?:\s[^>]*)?>", _OPEN)
    marked = F.regexp_replace(opened, rf"(?i)</(?:{BLOCK_TAGS})\s*>", _CLOSE)
    pieces = F.filter(F.split(marked, _OPEN), lambda _, i: i > 0)

    def clean(piece: Column) -> Column:
        inside = F.substring_index(piece, _CLOSE, 1)
        return tx.strip_space(unescape(F.regexp_replace(inside, "<[^>]*>", "")))

    return F.filter(F.transform(pieces, clean), tx.has_letter)


def read_units_html(pages: DataFrame) -> DataFrame:
    """``(page_id, unit_id, ord, text)`` of ``pages(page_id, html)``; no shuffle."""
    rows = pages.select("page_id", F.posexplode(html_blocks(F.col("html"))).alias("ord", "text"))
    return rows.select("page_id", F.format_string("pkg_%08d", F.col("ord")).alias("unit_id"), "ord", "text")


def split_lines(docs: DataFrame) -> DataFrame:
    """One row per line of ``docs(doc_id, text)``; ``unit_id`` is NULL without a letter."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("ord", "text"))
    unit = F.when(tx.has_letter(F.col("text")), F.format_string("line_%08d", F.col("ord")))
    return rows.select("doc_id", unit.alias("unit_id"), "ord", "text")


def translate_apply(units: DataFrame, translations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Target text per unit; a missing or blank translation keeps the source."""
    target = translations.select(key, "unit_id", F.col("text").alias("_target"))
    joined = units.join(target, [key, "unit_id"], "left")
    usable = F.col("_target").isNotNull() & ~tx.is_blank(F.col("_target"))
    return joined.withColumns(
        {"target": F.when(usable, F.col("_target")).otherwise(F.col("text")), "translated": usable}
    ).drop("_target")


def join_lines(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Whole texts again. A text came from one row, so its lines fit in one row."""
    applied = translate_apply(units, translations)
    lines = F.array_sort(F.collect_list(F.struct("ord", "target")))
    return applied.groupBy("doc_id").agg(
        F.array_join(F.transform(lines, lambda x: x["target"]), "\n").alias("text"),
        F.count_if("translated").alias("translated"),
    )


def read_fragments(items: DataFrame, scale: float = 1.0) -> DataFrame:
    """Positioned fragments from items with a six-number transform ``t0..t5``."""
    height = F.hypot("t2", "t3")
    return items.where(~tx.is_blank(F.col("text"))).select(
        "page_id",
        "frag_id",
        "text",
        F.col("t4").alias("x"),
        (F.col("t5") - height).alias("y"),
        (F.col("item_width") * F.lit(scale)).alias("width"),
        height.alias("height"),
    )


def structure_signature(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """Hash of the markup with all text blanked: equal hash, equal topology."""
    bare = F.regexp_replace(markup, r">[^<]*<", "><")
    return docs.select(key, tx.sha256_hex(bare).alias("signature"))
