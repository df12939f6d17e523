"""Multiset comparison inside one row: no shuffle and linear memory.

Inventories are arrays of ``struct<key string, pos int, raw string>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed(tokens: Column, key, plain: Column | None = None) -> Column:
    """Attach a comparison key and the text position to every token.

    ``plain`` optionally holds a rewritten form of each token for the key.
    """
    if plain is None:
        return F.transform(
            tokens,
            lambda raw, i: F.struct(key(raw).alias("key"), i.alias("pos"), raw.alias("raw")),
        )
    numbered = F.zip_with(tokens, plain, lambda raw, p: F.struct(raw.alias("raw"), p.alias("plain")))
    return F.transform(
        numbered,
        lambda t, i: F.struct(key(t["plain"]).alias("key"), i.alias("pos"), t["raw"].alias("raw")),
    )


def keys(inventory: Column) -> Column:
    return F.transform(inventory, lambda item: item["key"])


def differs(own: Column, other: Column) -> Column:
    """True when the two key multisets are unequal."""
    return F.array_sort(keys(own)) != F.array_sort(keys(other))


def _signed(inventory: Column, delta: int) -> Column:
    return F.transform(
        inventory,
        lambda item: F.struct(
            item["key"].alias("key"),
            F.lit(delta).alias("delta"),
            item["pos"].alias("pos"),
            item["raw"].alias("raw"),
        ),
    )


def first_excess(own: Column, other: Column, longest: int | None = None) -> Column:
    """First own token whose key occurs more often than on the other side.

    Both sides are sorted by key and folded once with constant state, so a text
    with very many tokens stays at n log n.
    """
    ordered = F.array_sort(F.concat(_signed(own, 1), _signed(other, -1)))
    start = F.struct(
        F.lit(None).cast("string").alias("key"),
        F.lit(0).alias("balance"),
        F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("string").alias("raw"),
        F.lit(None).cast("int").alias("best_pos"),
        F.lit(None).cast("string").alias("best_raw"),
    )

    def wins(state: Column) -> Column:
        better = state["best_pos"].isNull() | (state["pos"] < state["best_pos"])
        return (state["balance"] > 0) & state["pos"].isNotNull() & better

    def step(state: Column, item: Column) -> Column:
        same = state["key"].eqNullSafe(item["key"])
        usable = item["delta"] > 0
        if longest is not None:
            usable = usable & (F.length(item["raw"]) <= longest)
        take = usable & (~same | state["pos"].isNull())
        keep_best = same | ~wins(state)
        return F.struct(
            item["key"].alias("key"),
            (F.when(same, state["balance"]).otherwise(F.lit(0)) + item["delta"]).alias("balance"),
            F.when(take, item["pos"]).when(same, state["pos"]).alias("pos"),
            F.when(take, item["raw"]).when(same, state["raw"]).alias("raw"),
            F.when(keep_best, state["best_pos"]).otherwise(state["pos"]).alias("best_pos"),
            F.when(keep_best, state["best_raw"]).otherwise(state["raw"]).alias("best_raw"),
        )

    return F.aggregate(
        ordered,
        start,
        step,
        lambda state: F.when(wins(state), state["raw"]).otherwise(state["best_raw"]),
    )
