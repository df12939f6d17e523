"""Ranked lexical search by presence masks.

Every item is a query against all documents. A document's score for an item sums, over the item's terms, a weight that
falls with the number of documents that hold the term times a share that grows with the term's occurrences and falls with
the document's length. All but the logarithm of the weight is integer arithmetic.

**Postings.** One pass over the texts counts the terms of each document; only the items' own are kept, as a list of term
numbers and occurrences beside the document's length. The table is written to the shared folder, since the weights need
the totals over all documents before any score can be told.

**Masks.** A task takes its documents in blocks. For an item, the presence of its terms in the block is a bitmap per term;
the bits of a document are its mask, and equal masks form a group. All documents of a group score at most what its terms
give at the block's highest occurrences and the least length. Groups are evaluated by falling bound, until the best
``k`` scores found so far, by this task and in any earlier block, all exceed the next bound: then no other document can
enter, ties included. Each task gives its best ``k`` for an item, and these are ranked in two steps, by salt and whole.

Items are dealt in blocks of at most ``ITEM_TERMS`` terms (one item at least), each with its own pass; a task holds the
dictionary of one block and never the whole set of items.

Rows: null text has no terms. Documents without any term count in no total and get no rank. Each row of items is a query of
its own, also where ids repeat; an item without terms, or whose terms no document holds, has no rows. Repeated documents
are ranked each, null ids after all others of their score. Empty tables give an empty result. Only the id and text columns
are read, so others cannot clash. Texts are in memory one at a time, besides their Arrow batch.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from twinfold.llm.common import clean_text
from twinfold.session import ensure_checkpoint_dir

K = 10
ITEM_TERMS = 1_000_000
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 4_000_000
CELLS = 8_000_000
SLICE = 4_000_000
SALTS = 64
TASKS = 1 << 40

#: Bytes that are no part of a term become blanks, capitals become small letters.
FOLD = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def count_terms(data: bytes) -> Counter:
    """Occurrences of every term of a text in UTF-8, slice by slice."""
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and FOLD[data[end]] != 0x20:
            end += 1
        found.update(data[at:end].translate(FOLD).split())
        at = end
    return found


def item_blocks(items: DataFrame, limit: int = ITEM_TERMS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item id, distinct terms) in blocks of at most ``limit`` terms; one block at a time is on the driver."""
    block, size = [], 0
    for row in items.select("item_id", clean_text().alias("text")).toLocalIterator():
        terms = sorted(count_terms(row["text"].encode()))
        if block and size + len(terms) > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``(doc_id, n, term, tf)``: length in terms, and occurrences of those of the given terms that the text holds."""
    number = {t: i for i, t in enumerate(terms)}
    lists = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("term", lists), T.StructField("tf", lists)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, term, tf = [], [0], [], []
            for text in batch.column("text"):
                counts = count_terms(text.as_py().encode())
                sizes.append(sum(counts.values()))
                here = number.keys() & counts.keys()
                term += map(number.__getitem__, here)
                tf += map(counts.__getitem__, here)
                ends.append(len(term))
            ends = pa.array(ends, pa.int32())
            columns = [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(run, schema)


class Block:
    """Postings of some documents, by term."""

    def __init__(self, batches: list[pa.RecordBatch], factor: tuple[int, int], first: int) -> None:
        docs = pa.Table.from_batches(batches).combine_chunks()
        documents, terms = factor
        term = docs.column("term").combine_chunks()
        counts = np.diff(term.offsets.to_numpy())
        values = term.flatten().to_numpy()
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(counts)), counts)[order]
        self.tf = docs.column("tf").combine_chunks().flatten().to_numpy()[order].astype(np.int64)
        self.values, at = np.unique(values[order], return_index=True)
        self.at = np.append(at, len(values))
        #: 100 - 90 + 90 * n / average length; Python's integers, since the product may pass 64 bits
        self.m = np.array([10 + 90 * n * documents // terms for n in docs.column("n").to_pylist()], np.int64)
        self.ids = docs.column("doc_id")
        self.first = first

    def find(self, term: int) -> slice:
        at = np.searchsorted(self.values, term)
        known = at < len(self.values) and self.values[at] == term
        return slice(self.at[at], self.at[at + 1]) if known else slice(0, 0)


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def masks_of(presence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a bitmap of terms by documents: the first column of each group, and each column's group."""
    packed = np.packbits(presence, axis=0)
    packed = np.concatenate([packed, np.zeros((-len(packed) % 8, packed.shape[1]), np.uint8)])
    words = np.ascontiguousarray(packed.T).view(np.uint64)
    first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)[1:]
    for i in range(1, words.shape[1]):
        codes = np.unique(words[:, i], return_inverse=True)[1]
        first, group = np.unique(group * (codes.max() + 1) + codes, return_index=True, return_inverse=True)[1:]
    return first, group


def search_block(block: Block, terms: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> None:
    """Put the block's documents that belong there into ``best``, a heap of (score, known id, falling id, falling row, id)."""
    spans = [block.find(t) for t in terms]
    use = [i for i, s in enumerate(spans) if s.start < s.stop and weights[i] > 0]
    if not use:
        return
    weight = weights[use]
    owners, occurrences = [block.owner[spans[i]] for i in use], [block.tf[spans[i]] for i in use]
    docs = np.unique(np.concatenate(owners))
    width = max(1, CELLS // len(use))
    for part in range(0, len(docs), width):
        here = docs[part : part + width]
        tf = np.zeros((len(use), len(here)), np.int64)
        for row, (owner, count) in enumerate(zip(owners, occurrences, strict=True)):
            low, high = np.searchsorted(owner, (here[0], here[-1] + 1))
            tf[row, np.searchsorted(here, owner[low:high])] = count[low:high]
        _search_groups(block, here, tf, weight, best, k)


def _search_groups(block: Block, docs: np.ndarray, tf: np.ndarray, weight: np.ndarray, best: list[tuple], k: int) -> None:
    m = block.m[docs]
    most = weight * share(tf.max(axis=1), m.min())
    if len(best) == k and most.sum() < best[0][0]:
        return
    first, group = masks_of(tf > 0)
    bound = most @ (tf[:, first] > 0)
    falling = np.argsort(-bound, kind="stable")
    place = np.empty(len(falling), np.int64)
    place[falling] = np.arange(len(falling))
    order = np.argsort(place[group], kind="stable")  # documents by their group's bound
    ends = np.cumsum(np.bincount(place[group]))
    done = 0
    at = 0
    while at < len(falling) and not (len(best) == k and best[0][0] > bound[falling[at]]):
        at = min(int(np.searchsorted(ends, done + 4 * k)) + 1, len(ends))  # with groups that hold some documents more
        here = order[done : ends[at - 1]]
        done = int(ends[at - 1])
        scores = (weight[:, None] * share(tf[:, here], m[here])).sum(axis=0)
        for column in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)).tolist():
            row = int(docs[here[column]])
            identity = block.ids[row].as_py()
            entry = (int(scores[column]), identity is not None, -(identity or 0), -(block.first + row), identity)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry[:4] > best[0][:4]:
                heapq.heapreplace(best, entry)


def _search(table: DataFrame, block: list[tuple[object, list[bytes]]], numbers: list[np.ndarray], weights: np.ndarray, factor: tuple[int, int], k: int, item_type: T.DataType) -> DataFrame:
    schema = T.StructType(
        [T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType())]
        + [T.StructField(n, T.LongType()) for n in ("score", "place")]
    )
    ids = [x for x, _ in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in ids]
        task = TaskContext.get().partitionId()
        waiting, docs, held, first = [], 0, 0, 0

        def take() -> None:
            here = Block(waiting, factor, first)
            for item, terms in enumerate(numbers):
                search_block(here, terms, weights[terms], best[item], k)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS // 4):
                part = batch.slice(at, BLOCK_DOCS // 4)
                waiting.append(part)
                docs += part.num_rows
                held += len(part.column("term").flatten())
                if docs >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    take()
                    waiting, first, docs, held = [], first + docs, 0, 0
        if docs:
            take()
        rows = [(item, ids[item], entry[4], entry[0], task * TASKS - entry[3]) for item, found in enumerate(best) for entry in found]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.names
        )

    return table.mapInArrow(run, schema)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = K, limit: int = ITEM_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    out = None
    for block in item_blocks(items, limit):
        terms = sorted({t for _, own in block for t in own})
        number = {t: i for i, t in enumerate(terms)}
        path = f"{spark.sparkContext.getCheckpointDir()}/postings-{uuid.uuid4()}"
        postings(docs, terms).where("n > 0").write.parquet(path)
        table = spark.read.parquet(path)
        documents, length = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for term, count in table.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            df[term] = count  # one number for each term of the block
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        numbers = [np.array([number[t] for t in own if df[number[t]]], np.int64) for _, own in block]
        found = _search(table.where(F.size("term") > 0), block, numbers, weights, (documents, length), k, items.schema["item_id"].dataType)
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place"))
        salted = Window.partitionBy("item", F.pmod(F.xxhash64("place"), F.lit(SALTS))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        found = found.select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is not None:
        return out
    schema = T.StructType([items.schema["item_id"], *(T.StructField(n, t) for n, t in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())))])
    return spark.createDataFrame([], schema)
