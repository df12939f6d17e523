"""Benchmark decontamination by rare n-gram seeds and local alignment.

Every four-word gram of a test item is a seed, and no seed is dropped, neither for being frequent nor for having a rarer
neighbour: any four words in a row that survive editing find their item. One pass over all documents finds the seeds in
each document and aligns the item with the words around them (Smith-Waterman: 1 for a match, -0.5 for a mismatch or a
gap). The score over the item's length is 1 for a verbatim copy and falls with every edit; from the threshold on,
document and item are reported with the place. Words around a seed that share fewer of the item's words than the
threshold asks for cannot reach it and are not aligned. A copy without four surviving words in a row is not found.

Words are lower case in ASCII and split at white space and ASCII punctuation. Test items are taken in blocks of
bounded size and each block passes over all documents; nothing of the documents is shuffled, and what a task holds
depends on the item block and one Arrow batch.

Rows: null or empty texts, and items of fewer than four words, match nothing. Items with equal words are reported each;
repeated documents are reported each. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinfold.llm.common import Rolling, clean_text, flat, letters_only, lower_ascii, pieces, word_bounds

SEED = 4
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
PENALTY = 0.5


def plain_words(rolling: Rolling, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, word offsets) of pieces of the array."""
    data, offsets = flat(texts)
    for start, stop in pieces(offsets, 1_000_000):
        part = lower_ascii(data[offsets[start] : offsets[stop]])
        begin, end, at = word_bounds(part, offsets[start : stop + 1] - offsets[start], letters_only())
        yield start, rolling.spans(rolling.prefix(rolling.bytes[part]), begin, end), at


def grams(rolling: Rolling, words: np.ndarray, offsets: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of joined texts by their first word, and which of them lie within one text."""
    hashes = rolling.windows(rolling.prefix(words), size)
    inside = np.ones(len(hashes), bool)
    for k in range(1, size):
        edge = offsets[1:-1] - k
        inside[edge[(edge >= 0) & (edge < len(hashes))]] = False
    return hashes, inside


class Seeds:
    """A set of gram hashes with a quick first look; ``find`` gives positions and their numbers in the sorted set."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.sort(hashes)
        self.shift = np.uint64(64 - 22)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.sorted >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.seen[(hashes >> self.shift).astype(np.int64)] & inside)
        number = np.minimum(np.searchsorted(self.sorted, hashes[at]), max(len(self.sorted) - 1, 0))
        hit = self.sorted[number] == hashes[at] if len(self.sorted) else np.zeros(0, bool)
        return at[hit], number[hit]


def align(item: np.ndarray, words: np.ndarray, penalty: float = PENALTY) -> tuple[float, int]:
    """Best local alignment score, and the end of it in ``words``."""
    slope = penalty * np.arange(len(words) + 1)
    above, best, end = np.zeros(len(words) + 1), 0.0, 0
    for word in item:
        row = np.maximum(above - penalty, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(words == word, 1.0, -penalty))
        above = np.maximum.accumulate(row + slope) - slope
        at = int(above.argmax())
        if above[at] > best:
            best, end = float(above[at]), at
    return best, end


def item_blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``limit`` words at most (one item at least); one block at a time is on the driver."""
    block, held = [], 0
    for row in items.select("item_id", clean_text().alias("text")).toLocalIterator():
        n = len(row["text"]) // 2 + 1
        if block and held + n > limit:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += n
    if block:
        yield block


def _item_words(block: list[tuple[int, str]]) -> tuple[Rolling, np.ndarray, np.ndarray]:
    rolling = Rolling()
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, own, at in plain_words(rolling, pa.array([t for _, t in block], pa.large_string())):
        words.append(own)
        counts.append(np.diff(at))
    return rolling, np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def item_seeds(words: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, item number and place in the item of every seed, ordered by hash."""
    hashes, inside = grams(rolling, words, offsets)
    at = np.flatnonzero(inside)
    item = np.searchsorted(offsets, at, side="right") - 1
    order = np.argsort(hashes[at], kind="stable")
    return hashes[at][order], item[order], (at - offsets[item])[order]


class Aligner:
    """Finds the items of a block in texts."""

    def __init__(self, block: list[tuple[int, str]], threshold: float) -> None:
        self.rolling, words, offsets = _item_words(block)
        self.items = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.sizes = np.diff(offsets)
        self.hashes, self.item, self.place = item_seeds(words, offsets, self.rolling)
        self.seeds = Seeds(np.unique(self.hashes))
        self.first = np.searchsorted(self.hashes, self.seeds.sorted)
        self.many = np.diff(np.append(self.first, len(self.hashes)))
        self.threshold = threshold

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item number, score, begin word, end word)."""
        for start, words, offsets in plain_words(self.rolling, texts):
            at, number = self.seeds.find(*grams(self.rolling, words, offsets))
            if not len(at):
                continue
            many = self.many[number]
            seed = np.repeat(self.first[number] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = np.repeat(at, many)
            owner, item = np.searchsorted(offsets, at, side="right") - 1, self.item[seed]
            begin = at - self.place[seed]
            order = np.lexsort((begin, item, owner))
            owner, item, begin = owner[order], item[order], begin[order]
            # alignments of one item that could overlap are one region
            new = np.ones(len(order) + 1, bool)
            new[1:-1] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (np.diff(begin) > 2 * self.sizes[item[1:]])
            bounds = np.flatnonzero(new)
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                size = len(self.items[item[low]])
                lower = max(int(begin[low]) - size, int(offsets[owner[low]]))
                upper = min(int(begin[high - 1]) + 2 * size, int(offsets[owner[low] + 1]))
                found = self.judge(int(item[low]), words[lower:upper])
                if found:
                    shift = lower - int(offsets[owner[low]])
                    yield start + int(owner[low]), int(item[low]), found[0], found[1] + shift, found[2] + shift

    def judge(self, item: int, words: np.ndarray) -> tuple[float, int, int] | None:
        own = self.items[item]
        if np.isin(own, words).sum() / len(own) < self.threshold:  # a score is at most the item's words that are there
            return None
        best, end = align(own, words)
        if best / len(own) < self.threshold:
            return None
        return best / len(own), end - align(own[::-1], words[:end][::-1])[1], end


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, limit: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, score, begin_word, end_word)`` of each place where a document holds an item."""
    schema = T.StructType(
        [docs.schema["doc_id"], items.schema["item_id"], T.StructField("score", T.DoubleType())]
        + [T.StructField(n, T.LongType()) for n in ("begin_word", "end_word")]
    )
    ids = pa.int64() if isinstance(items.schema["item_id"].dataType, T.LongType) else None
    out = None
    for block in item_blocks(items, limit):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            aligner = Aligner(block, threshold)
            for batch in batches:
                rows = list(aligner.scan(batch.column("text")))
                text, item, score, begin, end = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(text, pa.int64())),
                        pa.array([block[i][0] for i in item], ids),
                        pa.array(score, pa.float64()),
                        pa.array(begin, pa.int64()),
                        pa.array(end, pa.int64()),
                    ],
                    names=[f.name for f in schema],
                )

        found = docs.select("doc_id", clean_text().alias("text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, limit: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no item, with all their columns; each block of items passes over what is left."""
    out = docs
    for block in item_blocks(items, limit):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            aligner = Aligner(block, threshold)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row[0] for row in aligner.scan(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
