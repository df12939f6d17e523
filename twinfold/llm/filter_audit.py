"""Audit of the interaction of text filters with decision diagrams.

Five conditions fail a document: A few words, B few distinct words, C many capitals, D markup characters, E a text that a
document of smaller id holds too. Which of them fail is a mask of five bits. For every part of the corpus the masks and
their counts become a decision diagram: one level for each filter, a low edge for passing it and a high edge for failing
it, equal subgraphs shared, and at the ends the count vectors (documents, good ones, toxic ones). Every node knows the
sum of what lies below it.

With the levels in the order in which filters are applied, the path of low edges from the root is the run of the filters:
at step i the high edge of its node leads to what the step removes and the low edge to what it keeps. The 120 orders are
visited by adjacent level swaps (plain changes), each of which rebuilds two levels only. What fails the step's filter but
went earlier is the filter's total less what it removes; what fails no other filter is at the end of the path of low edges
but one. A filter's Shapley sum is what it removes, over all orders.

Spark's part: each text is read once and becomes a mask and a hash of 256 bits. Rows alike in hash, part and id are
counted, then the least id of each hash decides E, so a text that a third of all rows hold meets as partial counts only.
What is left is at most 32 counts a part. Nothing is broadcast.

Rows: null text is empty and null part is the empty string. A null id is never smaller than another and has none smaller,
so E passes. Repeated rows count each; rows of one id do not fail E by one another. Labels are looked up by id (repeated
labels: any that says 1; null or other values: not), documents without one are neither good nor toxic. An empty table
gives no rows. Only ``doc_id``, ``text``, the part column and the label columns are read, so others cannot clash. Texts
are in memory one at a time, besides their Arrow batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.common import clean_text

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
MARKS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
LATER_BYTES = bytes(range(0x80, 0xC0))
SPREAD = 1024
NONE = (0, 0, 0)


def failures(data: bytes) -> int:
    """Bits 0 to 3 for the conditions A to D of a text in UTF-8."""
    words = data.split()  # at the bytes 20 and 09 to 0D
    points = len(data.translate(None, LATER_BYTES))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MAX_CAPITAL_PERCENT * points) << 2
        | (len(data.translate(None, MARKS)) < len(data)) << 3
    )


def judged(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, text_hash)`` of every row, E left open."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("text_hash", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, hashes = [], []
            for text in batch.column("text"):
                data = text.as_py().encode()
                masks.append(failures(data))
                hashes.append(hashlib.sha256(data).digest())
            columns = [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), clean_text().alias("text")).mapInArrow(run, schema)


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and failure mask."""
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = judged(docs, part).groupBy("text_hash", "part", "doc_id").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    # null ids meet no label; their rows are spread by their text
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text_hash"), F.lit(SPREAD))).otherwise(0)
    rows = rows.withColumn("salt", spread).join(flags.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    rows = rows.select(
        "text_hash", "part", "mask", "doc_id", "n", *((F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic"))
    )
    counts = ("n", "good", "toxic")
    null_id = F.col("doc_id").isNull()
    # by text and part: all counts, those of null ids, and the least id with its counts
    texts = rows.groupBy("text_hash", "part").agg(
        F.first("mask").alias("mask"),
        *(F.sum(c).alias(c) for c in counts),
        *(F.sum(F.when(null_id, F.col(c)).otherwise(0)).alias(f"null_{c}") for c in counts),
        F.min(F.when(~null_id, F.struct("doc_id", *counts))).alias("least"),
    )
    everywhere = F.min("least.doc_id").over(Window.partitionBy("text_hash"))  # one row for each part that holds the text
    texts = texts.withColumn("first_here", F.col("least.doc_id") == everywhere)
    for c in counts:
        alone = F.when(F.col("first_here"), F.col(f"least.{c}")).otherwise(0)
        texts = texts.withColumn(f"pass_{c}", F.col(f"null_{c}") + F.coalesce(alone, F.lit(0)))
    sides = F.array(
        F.struct("mask", *(F.col(f"pass_{c}").alias(c) for c in counts)),
        F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - F.col(f"pass_{c}")).alias(c) for c in counts)),
    )
    return texts.select("part", F.inline(sides)).where("n > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in counts))


class Diagram:
    """Decision diagram of masks with count vectors at its ends; ``order`` names the filter of each level."""

    def __init__(self, filters: str, counts: dict[int, tuple[int, ...]]) -> None:
        self.order = list(filters)
        self.unique: dict[tuple, tuple] = {}
        self.root = self._built(0, 0, {m: tuple(c) for m, c in counts.items()})

    def _built(self, level: int, mask: int, counts: dict[int, tuple[int, ...]]) -> tuple:
        if level == len(self.order):
            return self._end(counts.get(mask, NONE))
        return self._node(level, self._built(level + 1, mask, counts), self._built(level + 1, mask | 1 << level, counts))

    def _end(self, sums: tuple[int, ...]) -> tuple:
        return self.unique.setdefault(("end", sums), (sums, None, None))

    def _node(self, level: int, low: tuple, high: tuple) -> tuple:
        """A node is (sums below, low, high); equal ones are one object."""
        key = (level, id(low), id(high))
        if key not in self.unique:
            self.unique[key] = (tuple(a + b for a, b in zip(low[0], high[0])), low, high)
        return self.unique[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next; the levels below stay as they are."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        below = {k: v for k, v in self.unique.items() if k[0] == "end" or k[0] > level + 1}
        old_root, self.unique = self.root, below
        done: dict[int, tuple] = {}

        def moved(node: tuple, at: int) -> tuple:
            if id(node) not in done:
                _, low, high = node
                if at < level:
                    done[id(node)] = self._node(at, moved(low, at + 1), moved(high, at + 1))
                else:
                    done[id(node)] = self._node(
                        level, self._node(level + 1, low[1], high[1]), self._node(level + 1, low[2], high[2])
                    )
            return done[id(node)]

        self.root = moved(old_root, 0)

    def steps(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
        """Along the path of low edges: the filter, sums kept, sums removed, documents that fail nothing else."""
        node = self.root
        for letter in self.order:
            _, low, high = node
            alone = high
            while alone[1] is not None:
                alone = alone[1]
            yield letter, low[0], high[0], alone[0][0]
            node = low


def plain_changes(n: int) -> Iterator[int]:
    """The lower place of each adjacent swap that leads through all orders of n things."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    for turn in range(math.factorial(n - 1)):
        down = turn % 2 == 0  # the last thing walks down, then up
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is not None:
            yield at + 1 if down else at


def audit(counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders and steps."""
    fails = {x: sum(c[0] for m, c in counts.items() if m >> i & 1) for i, x in enumerate(filters)}
    diagram = Diagram(filters, counts)
    rows, shapley = [], dict.fromkeys(filters, 0)
    changes = plain_changes(len(filters))
    while True:
        name = "".join(diagram.order)
        for step, (letter, kept, gone, alone) in enumerate(diagram.steps(), 1):
            shapley[letter] += gone[0]
            rows.append((name, step, kept[0], gone[0], fails[letter] - gone[0], alone, gone[1], gone[2], letter))
        at = next(changes, None)
        if at is None:
            return [(*row[:-1], shapley[row[-1]]) for row in rows]
        diagram.swap(at)


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Every order and step of the five filters, by part."""

    def report(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"])}
        out = pd.DataFrame(audit(counts), columns=["filter_order", "step", *COLUMNS])
        out.insert(0, "part", key[0])
        return out

    return mask_counts(docs, labels, part).groupBy("part").applyInPandas(report, REPORT)
