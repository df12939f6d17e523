"""Exact byte-level substring removal by refinement of suffix buckets.

Suffixes are put into buckets by a gram at their start, and a bucket is refined by the buckets of later offsets: the
suffix's bucket for twice the length is that of (its bucket, the bucket at the offset beyond it). Here a bucket's
identifier is a hash of the bytes it stands for, so refined identifiers are made from prefix sums where the text is,
and only their counts travel. Each level is one shuffle on bucket identifiers; suffixes alone in their bucket leave,
and what a level has settled is not looked at again by the next, finer one (see ``anchors``). The first
level needs no shuffle of the texts; all later ones are one plan, so that the texts are shuffled once for them and for
the result. The first level holds
only sampled suffixes, chosen so that no repeated 400-byte string can be missed.

A byte goes if a 400-byte string that covers it starts anywhere else, in the same text or another one. Identifiers of
the last level have 128 bits. Null text counts as empty; repeated rows are texts of their own and so remove each other
from 400 bytes on; shorter texts stay whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.anchors import (
    BLOCK_SCHEMA,
    WIDEST,
    anchor_batches,
    block_batches,
    buckets,
    gathered_needs,
    gathered_ranges,
    in_company,
    judged,
    merged,
    open_blocks,
    repeats,
)
from twinfold.llm.common import Rolling, clean_text, flat, pieces
from twinfold.session import cut_lineage

WIDTH = 400
GRAM = 160
SIZES = (16, 1)
CHUNK = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc, doc_id, text)``: rows alike in id and text share the key ``doc``."""
    return docs.select("doc_id", clean_text().alias("text")).select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")


def _sequences(batch: pa.RecordBatch, rolling: Rolling):
    data, offsets = flat(batch.column("text"))
    keys = batch.column("doc").to_numpy()
    for start, stop in pieces(offsets, CHUNK):
        part = data[offsets[start] : offsets[stop]]
        yield rolling, rolling.prefix(rolling.bytes[part]), offsets[start : stop + 1] - offsets[start], keys[start:stop]


def first_level(texts: DataFrame, width: int, gram: int, sequences=_sequences) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            yield from anchor_batches(sequences(batch, rolling), width, gram)

    return texts.select("doc", "text").mapInArrow(run, BLOCK_SCHEMA)


def next_level(texts: DataFrame, need: DataFrame, width: int, size: int, sequences=_sequences) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            if batch.num_rows:
                yield from block_batches(sequences(batch, rolling), batch.column("need"), width, size)

    return texts.join(gathered_needs(need).hint("shuffle_hash"), "doc").mapInArrow(run, BLOCK_SCHEMA)


def repeated_ranges(texts: DataFrame, dealt: DataFrame, width: int = WIDTH, gram: int = GRAM, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``(doc, ranges)``: ranges (begin, end) of the windows that occur elsewhere too.

    ``dealt`` are the same texts, shuffled by ``doc``.
    """
    if not gram <= width < WIDEST:
        raise ValueError(f"a window has from {gram} to {WIDEST - 1} units")
    blocks, size = first_level(texts, width, gram), width - gram + 1
    blocks = cut_lineage(in_company(blocks))
    held = cut_lineage(judged(buckets(blocks)))
    found = repeats(blocks, held)
    for finer, last in zip(sizes, (*[False] * (len(sizes) - 1), True), strict=True):
        blocks, size = next_level(dealt, open_blocks(held, size), width, finer), finer
        held = buckets(blocks) if last else judged(buckets(blocks))
        found = found.unionByName(repeats(blocks, held))
    return gathered_ranges(found, width)


def range_arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Merged begins and ends per row, None for a row without any."""
    bounds = column.offsets.to_numpy()
    begin, end = (column.values.field(k).to_numpy(zero_copy_only=False) for k in ("begin", "end"))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        yield merged(begin[low:high], end[low:high]) if high > low else None


def with_ranges(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return texts.join(ranges.hint("shuffle_hash"), "doc", "left").withColumn("ranges", F.coalesce("ranges", empty))


def remove_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, hash of what is left."""
    texts = keyed(docs)
    dealt = texts.repartition("doc")
    schema = T.StructType(
        [docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column("text"))
            view, out = memoryview(np.ascontiguousarray(data)), []
            for row, ranges in enumerate(range_arrays(batch.column("ranges"))):
                at, stop = int(offsets[row]), int(offsets[row + 1])
                first, removed, spans = at, 0, 0
                digest = hashlib.sha256()
                if ranges is not None:
                    spans, removed = len(ranges[0]), int((ranges[1] - ranges[0]).sum())
                    for begin, end in zip(*ranges, strict=True):
                        digest.update(view[first : at + begin])
                        first = at + end
                digest.update(view[first:stop])
                out.append((stop - at, removed, spans, digest.hexdigest()))
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[f.name for f in schema])

    return with_ranges(dealt, repeated_ranges(texts, dealt, width, gram, sizes)).select("doc_id", "text", "ranges").mapInArrow(run, schema)
