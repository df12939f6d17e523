"""Vector best-fit packing of tokenised documents into sequences.

A document is its token ids and one end id. Longer ones are cut into pieces of the full width, of which only the first
may be shorter. A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces go by falling length to the open sequence that fits them under every capacity and leaves the least
weighted residual norm (``rule="norm"``), or whose residual has the largest weighted dot product with the piece
(``rule="dot"``). The query's capacities are 1024 tokens, 1024 documents and 1024**2, so tokens decide.

Pieces of one length are alike, so the plan is made on the histogram of lengths: at most ``width`` counts, whatever the
corpus. It says how many sequences get which lengths at which offsets. A piece finds its place by its rank among the
pieces of its length: its rank within its task, known when it was cut, and the count of earlier tasks. So no group of
equal lengths is ever gathered, and packing is over all pieces, not per partition.

Tokens come from one vocabulary file, given as ranks to ``tiktoken``; the ids are those of ``tokenizers`` on the JSON
form of the same vocabulary (tested), at a quarter of its CPU time. Null text counts as empty: one piece with the end
id. Ids, null or repeated, are carried along; every row is packed. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.common import clean_text, held
from twinfold.session import cut_lineage

WIDTH = 1024
END_ID = 2
WEIGHTS = (1.0, 0.05, 0.05)
#: The added token of the default vocabulary, taken as one token where a text holds its literal.
ADDED = {"<|endoftext|>": 50256}


def ranks_path() -> tuple[str, str]:
    """Vocabulary file and split pattern of the default tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def load_encoder(path: str, pattern: str):
    """The encoder of a rank file; kept for the life of the worker process."""

    def build():
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)

    return held(("ranks", path, pattern), build)


def cut_pieces(docs: DataFrame, width: int = WIDTH, end_id: int = END_ID, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, _task, _rank)``; ``_rank`` counts equal lengths within a task."""
    path, pattern = tokenizer or ranks_path()
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
        + [T.StructField("_task", T.IntegerType()), T.StructField("_rank", T.LongType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        task = TaskContext.get().partitionId()
        seen = np.zeros(width + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            source, piece, start, length, crc, rank = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.concatenate([encoder.encode_to_numpy(text, allowed_special="all").astype("<u4"), end])
                stop = len(ids) % width or width
                at = number = 0
                while at < len(ids):
                    n = stop - at
                    source.append(row)
                    piece.append(number)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at:stop].tobytes()))
                    rank.append(seen[n])
                    seen[n] += 1
                    at, stop, number = stop, stop + width, number + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(source, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(source), task, np.int32)),
                    pa.array(rank, pa.int64()),
                ],
                names=[f.name for f in schema],
            )

    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(cut, schema)


def plan_sequences(
    counts: dict[int, int],
    width: int = WIDTH,
    max_docs: int | None = None,
    max_cost: int | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
) -> tuple[np.ndarray, int]:
    """Best-fit over a histogram: rows (length, first rank, first sequence, offset), and the number of sequences.

    The pieces of a length with ranks from a row's first rank up to the next row's go to sequences counted from the
    row's first sequence, at its offset. Sequences that look alike are handled together.
    """
    caps = np.array([width, max_docs or width, max_cost or width * width], np.float64)
    weight = np.array(weights)
    kinds: dict[tuple, list[list]] = {}  # residual vector -> [number of sequences, lengths inside]

    def add(residual: tuple, number: int, inside: tuple) -> None:
        kinds.setdefault(residual, []).append([number, inside])

    for size in sorted((n for n in counts if counts[n]), reverse=True):
        left = counts[size]
        demand = np.array([size, 1, size * size], np.float64)
        most = int(min(caps // demand))
        if most < 1:
            raise ValueError(f"a piece of {size} tokens exceeds a capacity")
        while left:
            open_ = np.array(list(kinds), np.float64).reshape(-1, 3)
            fits = np.flatnonzero((open_ >= demand).all(axis=1))
            if not len(fits):
                full, rest = divmod(left, most)
                for number, n in ((full, most), (1 if rest else 0, rest)):
                    if number:
                        add(tuple(int(x) for x in caps - n * demand), number, (size,) * n)
                break
            if rule == "norm":
                score = (weight * ((open_[fits] - demand) / caps) ** 2).sum(axis=1)
            else:
                score = -(weight * (open_[fits] / caps) * (demand / caps)).sum(axis=1)
            key = tuple(int(x) for x in open_[fits[np.argmin(score)]])
            groups = kinds[key]
            number, inside = groups.pop()
            used = min(left, number)
            if used < number:
                groups.append([number - used, inside])
            if not groups:
                del kinds[key]
            add(tuple(int(x) for x in np.array(key) - demand), used, (*inside, size))
            left -= used
    ranks = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for groups in kinds.values():
        for number, inside in groups:
            offset = 0
            for size in inside:
                rows.append((size, ranks[size], sequence, offset))
                ranks[size] += number
                offset += size
            sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 4), sequence


def place(pieces: DataFrame, plan: np.ndarray) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with their ``_rank`` among all pieces of their length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType(
        [pieces.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
    )
    keys = plan[:, 0] << 48 | plan[:, 1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            row = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(plan[row, 2] + rank - plan[row, 1]), pa.array(plan[row, 3])],
                names=[f.name for f in schema],
            )

    return pieces.select(*names, "_rank").mapInArrow(put, schema)


def pack_documents(docs: DataFrame, width: int = WIDTH, end_id: int = END_ID, tokenizer: tuple[str, str] | None = None, **capacities) -> DataFrame:
    """One row per piece: its document, place in it, ids' checksum, sequence and offset there."""
    pieces = cut_lineage(cut_pieces(docs, width, end_id, tokenizer))
    per_task = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    # at most ``width`` rows
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan, _ = plan_sequences(counts, width, **capacities)
    ranked = pieces.join(shifts, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    return place(ranked, plan)
