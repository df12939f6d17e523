"""Repeated windows of a corpus from sampled anchors, by refinement of buckets.

In every window of ``width`` units (bytes or words) the gram with the least hash is the window's anchor, the first on a
tie. It depends on the window's content only, so equal windows have equal anchors at equal places and a window can only
repeat if its anchor does. About two grams in ``width - gram`` are anchors; only they are shuffled.

Windows that share an anchor are handled as a block of shifts. A block has a core, which every window in it holds, and
a union, all that they hold together. Blocks are bucketed by both: a union that occurs twice makes every window of the
block a repeat at once; a core that occurs once rules all of them out; what is left is cut into smaller blocks, down to
single windows. Of each repeated union one occurrence stands for all when smaller blocks are compared, so a passage
that a third of all documents hold is one row. Buckets are counted map-side; no bucket is ever gathered in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import Rolling, mix64, ragged
from twinfold.session import cut_lineage

_PLACE = np.uint64(0xFFFFFFFF)
#: ``spot`` holds an anchor's place and the least and most shift of its windows: place * 2**24 + low * 2**12 + high.
BLOCK_SCHEMA = "doc long, spot long, core long, union long, stands boolean"
_KINDS = {"doc": pa.int64(), "spot": pa.int64(), "core": pa.int64(), "union": pa.int64(), "stands": pa.bool_()}
WIDEST = 1 << 12
SALTS = 4


def find_anchors(rolling: Rolling, sums: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of joined sequences, given their prefix sums and offsets.

    Returns arrays: ``row`` (sequence), ``core`` (hash of the gram), ``union`` (hash of all that windows with this
    anchor can hold), ``at`` (from the sequence's start), ``low`` and ``high`` (the least and most units that windows
    of this anchor begin before it).
    """
    span = width - gram + 1
    n = len(sums) - width
    room = np.diff(offsets) - width + 1
    fit = room > 0
    if n <= 0 or not fit.any():
        none = np.zeros(0, np.int64)
        return {k: none for k in ("row", "core", "union", "at", "low", "high")}
    grams = rolling.raw_windows(sums, gram)
    blocks = np.full(-(-len(grams) // span) * span, np.iinfo(np.uint64).max)
    np.bitwise_or(grams & ~_PLACE, np.arange(len(grams), dtype=np.uint64), out=blocks[: len(grams)])
    blocks = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]).astype(np.uint32)
    step = np.zeros(n + 1, np.int8)
    step[offsets[:-1][fit]] += 1
    np.add.at(step, (offsets[:-1] + room)[fit], -1)
    valid = np.cumsum(step[:n], dtype=np.int8).view(bool)
    change = np.ones(n + 1, bool)
    change[1:n] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(valid & change[:n])
    last = np.flatnonzero(valid & change[1:])
    place = chosen[first].astype(np.int64)
    row = np.searchsorted(offsets, first, side="right") - 1
    low, high = offsets[row], offsets[row + 1]
    left = np.maximum(low, place - span + 1)
    right = np.minimum(high, place + width)
    return {
        "row": row,
        "core": mix64(grams[place]).view(np.int64),
        "union": mix64(rolling.spans(sums, left, right) + (place - left).astype(np.uint64)).view(np.int64),
        "at": place - low,
        "low": place - last,
        "high": place - first,
    }


def cut_blocks(
    rolling: Rolling, sums: np.ndarray, begin: int, length: int, need: dict[str, np.ndarray], width: int, size: int
) -> dict[str, np.ndarray]:
    """Blocks of ``size`` shifts of one sequence's anchors (``at``, ``core``, ``low``, ``high``, ``stands``).

    An anchor that stands for others is cut over all its valid shifts, another one over its own windows. Single
    windows keep the core they come from.
    """
    at, low, high = need["at"], need["low"], need["high"]
    low = np.maximum(low, np.maximum(0, at + width - length))
    high = np.minimum(high, at)
    first, number = low // size, np.maximum(high // size - low // size + 1, 0) * (high >= low)
    block, own = ragged(first, number)
    at, low, high = at[own], np.maximum(low[own], block * size), np.minimum(high[own], block * size + size - 1)
    if size == 1:
        start = begin + at - block
        core = need["core"][own].view(np.uint64)
        union = mix64(rolling.spans(sums, start, start + width) + block.astype(np.uint64))
    else:
        far, near = at - block * size - size + 1, at - block * size
        core = rolling.spans(sums, begin + near, begin + far + width)
        inside = (far >= 0) & (near + width <= length)
        whole = rolling.spans(sums, begin + np.maximum(far, 0), begin + np.minimum(near + width, length))
        core = mix64(core + block.astype(np.uint64))
        alone = mix64(mix64(need["doc"][own].view(np.uint64)) + (at * 2 + 1).astype(np.uint64) + core)
        union = np.where(inside, mix64(whole + block.astype(np.uint64)), alone)
    return {"own": own, "at": at, "core": core.view(np.int64), "union": union.view(np.int64), "low": low, "high": high}


def at_of(spot: Column) -> Column:
    return F.shiftright(spot, 24)


def low_of(spot: Column) -> Column:
    return F.shiftright(spot, 12).bitwiseAND(WIDEST - 1)


def high_of(spot: Column) -> Column:
    return spot.bitwiseAND(WIDEST - 1)


def in_company(blocks: DataFrame) -> DataFrame:
    """The blocks whose core occurs more than once.

    The cores are written first: a join of two plain shuffles is one that Spark can split where a core is frequent.
    """
    many = blocks.groupBy("core").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("core").alias("_core"))
    return blocks.join(cut_lineage(many), F.col("core") == F.col("_core")).drop("_core")


def _salted(keys: DataFrame) -> DataFrame:
    return keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def buckets(blocks: DataFrame) -> DataFrame:
    """``(core, union, n, doc, spot)``: occurrences of each pair of buckets, and one of them."""
    return blocks.groupBy("core", "union").agg(
        F.sum(F.when(F.col("stands"), 2).otherwise(1)).alias("n"), F.min("doc").alias("doc"), F.min_by("spot", "doc").alias("spot")
    )


def judged(held: DataFrame) -> DataFrame:
    """The buckets that matter, with ``open`` where their core occurs in several unions, one of them single."""
    several = (
        held.groupBy("core")
        .agg(F.count("*").alias("_unions"), F.min("n").alias("_least"))
        .where("_unions > 1 and _least = 1")
        .select(F.col("core").alias("_core"))
    )
    salt = F.pmod(F.col("union"), F.lit(SALTS)) == F.col("_salt")  # a core may have any number of unions
    marked = held.join(_salted(several), (F.col("core") == F.col("_core")) & salt, "left").withColumn("open", F.col("_core").isNotNull())
    return marked.where("open or n > 1").drop("_core", "_salt")


def open_blocks(judged_: DataFrame, size: int) -> DataFrame:
    """Blocks of open buckets, to be cut further.

    A union that occurs once is cut over its own windows, a repeated one stands for its occurrences.
    """
    repeated, spot = F.col("n") > 1, F.col("spot")
    block = (low_of(spot) / size).cast("int") * size
    return judged_.where("open").select(
        "doc",
        at_of(spot).alias("at"),
        "core",
        F.when(repeated, block).otherwise(low_of(spot)).cast("int").alias("low"),
        F.when(repeated, block + size - 1).otherwise(high_of(spot)).cast("int").alias("high"),
        repeated.alias("stands"),
    )


def repeats(blocks: DataFrame, held: DataFrame) -> DataFrame:
    """``(doc, spot)`` of every block whose union occurs more than once."""
    twice = held.where("n > 1").select(F.col("core").alias("_core"), F.col("union").alias("_union"))
    same = (F.col("core") == F.col("_core")) & (F.col("union") == F.col("_union"))
    salt = F.pmod(F.col("doc"), F.lit(SALTS)) == F.col("_salt")  # a union may have any number of occurrences
    return blocks.where(~F.col("stands")).join(_salted(twice), same & salt).select("doc", "spot")


def gathered_ranges(spots: DataFrame, width: int) -> DataFrame:
    """``(doc, ranges)``: begin and end of the windows of each block."""
    spot = F.col("spot")
    ends = F.struct((at_of(spot) - high_of(spot)).alias("begin"), (at_of(spot) - low_of(spot) + width).alias("end"))
    return spots.groupBy("doc").agg(F.collect_list(ends).alias("ranges"))


def block_batch(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    """Blocks of several sequences as one batch of BLOCK_SCHEMA."""
    parts = [p | {"spot": p["at"] << 24 | p["low"] << 12 | p["high"]} for p in parts]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64)).cast(kind)
            for name, kind in _KINDS.items()
        ],
        names=list(_KINDS),
    )


def anchor_batches(sequences, width: int, gram: int):
    """Batches of the coarsest blocks; ``sequences`` yields (prefix sums, offsets, keys of the sequences)."""
    for rolling, sums, offsets, keys in sequences:
        found = find_anchors(rolling, sums, offsets, width, gram)
        yield block_batch([found | {"doc": keys[found["row"]], "stands": np.zeros(len(found["at"]), bool)}])


def block_batches(sequences, needs: pa.ListArray, width: int, size: int):
    """Batches of blocks of ``size`` shifts, for the needs of the sequences in the same order."""
    bounds = needs.offsets.to_numpy()
    flat_needs = {k: needs.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "core", "low", "high", "stands")}
    done = 0
    for rolling, sums, offsets, keys in sequences:
        parts = []
        for i in range(len(offsets) - 1):
            own = {k: v[bounds[done + i] : bounds[done + i + 1]] for k, v in flat_needs.items()}
            own = {k: v if k == "stands" else v.astype(np.int64) for k, v in own.items()}
            own["doc"] = np.full(len(own["at"]), keys[i])
            cut = cut_blocks(rolling, sums, int(offsets[i]), int(offsets[i + 1] - offsets[i]), own, width, size)
            parts.append(cut | {"doc": own["doc"][cut["own"]], "stands": own["stands"][cut["own"]]})
        done += len(offsets) - 1
        yield block_batch(parts)


def gathered_needs(need: DataFrame) -> DataFrame:
    return need.groupBy("doc").agg(F.collect_list(F.struct("at", "core", "low", "high", "stands")).alias("need"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as separate ascending ranges; touching ones become one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return begin[starts], reach[np.append(starts[1:], len(begin)) - 1] if len(begin) else reach
