"""Exact word-level substring removal with suffix automata of reference shards.

The reference holds every word sequence of the threshold's length that starts twice in the corpus, once each: its
windows are found by the bucket counts of ``anchors``, one occurrence of each is its owner, and the owners' windows,
joined where they overlap, are the reference passages. Passages are dealt into shards by their owner and the range of
positions they lie in, so a long owner's passages spread over shards.
A shard's suffix automaton is built in every task that needs it, and the parts of documents that hold anchors of the
shard are streamed through it for matching statistics. Maximal spans at or above the threshold are removed. A window is
never judged on what is left of the text.

A shard that many documents meet is copied to as many tasks as the words of their parts ask for, counted over all
blocks that meet the shard, so a passage that a third of all documents hold is no hot task. A block of windows goes to the shard of the owner of the same windows, so
each window of a document travels to one shard, however many shards there are. Hashes find candidates; the automaton
compares the words themselves.

Rows: null text counts as empty; repeated rows are texts of their own and so remove each other from 35 words on; shorter
texts stay whole. Words are split at ``[\\x20\\x09-\\x0D]`` and kept unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.anchors import SALTS, at_of, buckets, high_of, in_company, judged, low_of, merged, open_blocks
from twinfold.llm.common import Rolling, Scratch, batch_words, flat, pieces, word_bounds
from twinfold.llm.suffix_buckets import first_level, keyed, next_level, range_arrays, with_ranges

WIDTH = 35
GRAM = 10
SHARD_WORDS = 100_000
TASK_WORDS = 1_000_000


class SuffixAutomaton:
    """Online suffix automaton of words; passages never join."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0
        self._break = -1

    def extend(self, word) -> None:
        nxt, link, length = self.next, self.link, self.length
        new, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
        self.last = new

    def add(self, passage: list) -> None:
        for word in passage:
            self.extend(word)
        self.extend(self._break)  # a word that no text has
        self._break -= 1

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans covered by matches of at least ``least`` words."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out: list[list[int]] = []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                size += 1
            if size >= least:
                begin = i + 1 - size
                if out and begin <= out[-1][1]:
                    out[-1][1] = i + 1
                    out[-1][0] = min(out[-1][0], begin)
                else:
                    out.append([begin, i + 1])
        return [(a, b) for a, b in out]


def _sequences(batch: pa.RecordBatch, rolling: Rolling):
    step, keys = 500, batch.column("doc").to_numpy()
    for start in range(0, batch.num_rows, step):
        words, offsets = batch_words(rolling, batch.column("text").slice(start, step))
        yield rolling, rolling.prefix(words), offsets, keys[start : start + step]


def parts_of(dealt: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(doc, shard, begin, words)``: the words, as bytes, of each document's merged ranges per shard.

    ``ranges`` is (doc, shard, begin, end) in words.
    """
    gathered = ranges.groupBy("doc").agg(F.collect_list(F.struct("shard", "begin", "end")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            keys, bounds = batch.column("doc").to_numpy(), batch.column("parts").offsets.to_numpy()
            shard, begin, end = (batch.column("parts").values.field(k).to_numpy(zero_copy_only=False) for k in ("shard", "begin", "end"))
            for start, stop in pieces(offsets, 2_000_000):
                piece = data[offsets[start] : offsets[stop]]
                first, last, at = word_bounds(piece, offsets[start : stop + 1] - offsets[start])
                raw, rows = piece.tobytes(), []
                for i in range(start, stop):
                    own, word = slice(bounds[i], bounds[i + 1]), at[i - start]
                    for s in np.unique(shard[own]):
                        here = shard[own] == s
                        for a, b in zip(*merged(begin[own][here], end[own][here]), strict=True):
                            rows.append((keys[i], s, a, raw[first[word + a] : last[word + b - 1]]))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                        names=["doc", "shard", "begin", "words"],
                    )

    return dealt.join(gathered.hint("shuffle_hash"), "doc").mapInArrow(run, "doc long, shard long, begin long, words binary")


def match_shards(reference: DataFrame, parts: DataFrame, copies: DataFrame, width: int) -> DataFrame:
    """``(doc, begin, end)`` of matches; ``copies`` is (shard, n): the tasks that share a shard's documents."""
    dealt_to = F.coalesce("n", F.lit(1))
    passages = reference.join(copies, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), dealt_to - 1)))
    streams = parts.join(copies, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("doc", "begin"), dealt_to).cast("int"))

    def stream(known: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        for passage in known["words"]:
            automaton.add(passage.split())
        seen: dict[bytes, list[tuple[int, int]]] = {}
        doc, begin, end = [], [], []
        for key, first, words in zip(texts["doc"], texts["begin"], texts["words"], strict=True):
            if words not in seen:
                seen[words] = automaton.spans(words.split(), width)
            for a, b in seen[words]:
                doc.append(key)
                begin.append(first + a)
                end.append(first + b)
        return pd.DataFrame({"doc": np.array(doc, np.int64), "begin": np.array(begin, np.int64), "end": np.array(end, np.int64)})

    return (
        passages.select("shard", "copy", "words").groupBy("shard", "copy")
        .cogroup(streams.select("shard", "copy", "doc", "begin", "words").groupBy("shard", "copy"))
        .applyInPandas(stream, "doc long, begin long, end long")
    )


def _ranges(rows: DataFrame, width: int) -> DataFrame:
    spot = F.col("spot")
    return rows.select("doc", "shard", (at_of(spot) - high_of(spot)).alias("begin"), (at_of(spot) - low_of(spot) + width).alias("end"))


def shard_of(shards: int) -> Column:
    """Shard of an owner's windows: by its document and the range of ``SHARD_WORDS`` words they lie in."""
    return F.pmod(F.xxhash64("doc", F.floor(at_of(F.col("spot")) / SHARD_WORDS)), F.lit(shards))


def task_counts(asked: DataFrame, width: int) -> DataFrame:
    """``(shard, n)``: the tasks that the words of all blocks that meet a shard ask for; ``asked`` is (spot, shard)."""
    words = high_of(F.col("spot")) - low_of(F.col("spot")) + width
    return asked.groupBy("shard").agg((1 + F.floor(F.sum(words) / TASK_WORDS)).cast("int").alias("n"))


def routed(blocks: DataFrame, owners: DataFrame) -> DataFrame:
    """``(doc, spot, shard)`` of every block whose union has an owner: the owner's shard, so one only.

    A core can have owners in every shard; a union has one, however many shards there are.
    """
    own = owners.select(F.col("core").alias("_core"), F.col("union").alias("_union"), "shard")
    salted = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a union may have any number of occurrences
    same = (F.col("core") == F.col("_core")) & (F.col("union") == F.col("_union"))
    salt = F.pmod(F.col("doc"), F.lit(SALTS)) == F.col("_salt")
    return blocks.where(~F.col("stands")).join(salted, same & salt).select("doc", "spot", "shard")


def repeated_spans(texts: DataFrame, dealt: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``(doc, ranges)`` of the words to remove; ``dealt`` are the same texts, shuffled by ``doc``."""
    scratch = Scratch(texts.sparkSession)
    blocks = scratch.keep("blocks", in_company(first_level(texts, width, gram, _sequences)))
    held = scratch.keep("held", judged(buckets(blocks)))
    fine = scratch.keep("fine", next_level(dealt, open_blocks(held, width - gram + 1), width, 1, _sequences))
    sizes = held.agg(F.sum(high_of(F.col("spot")) - low_of(F.col("spot")) + 1)).first()[0] or 0
    shards = 1 + int(sizes) // SHARD_WORDS
    coarse, single = (
        scratch.keep(name, b.where("n > 1").select("doc", "spot", "core", "union").withColumn("shard", shard_of(shards)))
        for name, b in (("coarse", held), ("single", buckets(fine)))
    )
    scratch.drop("held")
    asked = scratch.keep("asked", routed(blocks, coarse).unionByName(routed(fine, single)))
    scratch.drop("blocks", "fine")
    copies = scratch.keep("copies", task_counts(asked, width))
    reference = parts_of(dealt, _ranges(coarse.unionByName(single), width))
    spans = match_shards(reference, parts_of(dealt, _ranges(asked, width)), copies, width)
    return spans.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))


def remove_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: words, words removed, hash of the words that stay, joined by single spaces."""
    texts = keyed(docs)
    dealt = texts.repartition("doc")
    schema = T.StructType(
        [docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")] + [T.StructField("kept_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text"), range_arrays(batch.column("ranges")), strict=True):
                words = text.as_buffer().to_pybytes().split()  # bytes split at the six white-space characters
                kept, at = [], 0
                for begin, end in zip(*ranges, strict=True) if ranges is not None else ():
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in zip(*out, strict=True)]], names=[f.name for f in schema])

    return with_ranges(dealt, repeated_spans(texts, dealt, width, gram)).select("doc_id", "text", "ranges").mapInArrow(run, schema)
