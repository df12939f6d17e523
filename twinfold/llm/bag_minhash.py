"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A text is the multiset of its five-word shingles. Every shingle owns a Poisson process of points in weight and time,
made from its hash: the weight axis is cut into octaves [0, 1), [1, 2), [2, 4), ..., each a process of its own, and a
point is thinned by its place inside its octave. A shingle of count c shows the points below weight c, so equal parts
of two weights show equal points and the least time per register collides with probability equal to the weighted
Jaccard similarity. Points come in order of time and a shingle is left as soon as it is later than the latest register,
so most shingles cost one point.

Equal multisets are one class before banding. In every band bucket the member of least hash is compared with all
others, so similar buckets choose the same one; links found so give components. What may still link is narrowed by the
triangle inequality (``bucket_links``): of a group only members that lie about as far from the chosen one as a member
of another component are compared throughout, in blocks of bounded size that emit their links alone. So no bucket emits all its pairs, and no link that banding can find is lost between components. Similarity is
verified on the texts' whole multisets.

With 24 bands of 4 registers a pair at similarity 0.8 is missed with probability 3e-6.

Rows: a text of one to four words is one shingle; a text without words (null, empty, blank) is compared with nothing.
Rows alike in id and text are one document. Null ids come last when the least id of a group is chosen. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.common import Rolling, Scratch, batch_words, clean_text, flat, mix64, pieces, ragged
from twinfold.operators.graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
BLOCK_ROWS = 512
BLOCK_BYTES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OCTAVE = np.uint64(0xA0761D6478BD642F)


def shingles(rolling: Rolling, texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of every distinct shingle, ordered by text and hash."""
    words, offsets = batch_words(rolling, texts)
    length = np.diff(offsets)
    number = np.where(length >= size, length - size + 1, np.minimum(length, 1))
    begin, owner = ragged(offsets[:-1], number)
    hashes = rolling.spans(rolling.prefix(words), begin, np.minimum(begin + size, offsets[owner + 1]))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """BagMinHash registers (least times) of every text; infinite for a text without shingles."""
    octaves = 1 + np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
    octave, own = ragged(np.zeros(len(counts), np.int64), octaves)
    text, weight = owner[own], counts[own].astype(np.float64)
    low = np.where(octave == 0, 0.0, 2.0 ** (octave - 1))
    width = np.where(octave == 0, 1.0, low)
    seed = mix64(hashes[own] + octave.astype(np.uint64) * _OCTAVE)
    times = np.full((n_texts, registers), np.inf)
    cells = times.ravel()
    clock = np.zeros(len(own))
    turn = 0
    while len(clock):
        turn += 1
        draw = mix64(seed + np.uint64(turn * int(_STEP) % 2**64))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * width)
        draw = mix64(draw ^ _OCTAVE)
        register = ((draw >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        level = low + width * ((draw & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        seen = level < weight
        np.minimum.at(cells, text[seen] * registers + register[seen], clock[seen])
        alive = clock < times.max(axis=1)[text]
        seed, clock, text, weight, low, width = (x[alive] for x in (seed, clock, text, weight, low, width))
    return times


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = times.view(np.uint64).reshape(len(times), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, values.shape[:2]).copy()
    for i in range(rows):
        keys = mix64(keys + values[:, :, i])
    return keys.view(np.int64)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, key, n_shingles, print1, print2, bands)``: prints tell multisets apart in 128 bits."""
    schema = T.StructType(
        [docs.schema["doc_id"]]
        + [T.StructField(n, T.LongType()) for n in ("key", "n_shingles", "print1", "print2")]
        + [T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for start, stop in pieces(offsets, 4_000_000):
                part = batch.slice(start, stop - start)
                n = stop - start
                owner, hashes, counts = shingles(rolling, part.column("text"), size)
                keys = band_keys(signatures(owner, hashes, counts, n, bands * rows), bands, rows)
                prints = []
                for salt in (np.uint64(1), _OCTAVE):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, owner, mix64(hashes ^ salt) * counts.astype(np.uint64))
                    prints.append(pa.array(total.view(np.int64)))
                number = np.bincount(owner, weights=counts, minlength=n).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(number), *prints, lists], names=[f.name for f in schema]
                )

    return keyed(docs).mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", clean_text().alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def similarity(rolling: Rolling, left: pa.Array, right: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    sides = [shingles(rolling, x, size) for x in (left, right)]
    owner, hashes, counts = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((hashes, owner))
    owner, hashes, counts = owner[order], hashes[order], counts[order]
    both = np.flatnonzero((owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1]))
    shared = np.bincount(owner[both], weights=np.minimum(counts[both], counts[both + 1]), minlength=n)
    total = np.bincount(owner, weights=counts, minlength=n)
    return shared / np.maximum(total - shared, 1)


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(a, b, similarity)`` of pairs of keys; ``texts`` is (key, text), one row per key."""
    held = (
        pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("right")), "b")
        .join(texts.select(F.col("key").alias("a"), F.col("text").alias("left")), "a")
        .select("a", "b", "left", "right")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            offsets = flat(batch.column("left"))[1] + flat(batch.column("right"))[1]
            for start, stop in pieces(offsets, 4_000_000):
                part = batch.slice(start, stop - start)
                found = similarity(rolling, part.column("left"), part.column("right"), size)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(found)], names=["a", "b", "similarity"])

    return held.mapInArrow(run, "a long, b long, similarity double")


def compared(scratch: Scratch, groups: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """``(a, b)``: all links between members of different components of a group; ``groups`` is (grp, cid, component,
    n_bytes).

    A group is dealt into blocks of bounded rows and bytes, and each pair of blocks is one small task that multiplies
    the members' shingle sets; groups of one block share tasks, as many as their bytes ask for. Rows are dealt by key and
    meet their texts last. Only links are emitted.
    """
    weight = groups.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("n_bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    blocks = scratch.keep("blocks", weight.select("grp", blocks.alias("_blocks"), "n_bytes"))
    alone = blocks.where("_blocks = 1").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shared = 2 * (alone // BLOCK_BYTES + 1)
    dealt = groups.join(blocks.select("grp", "_blocks"), "grp").withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int"))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns(
        {"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}
    )
    task = F.when(F.col("_blocks") > 1, F.xxhash64("grp", "_i", "_j")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(shared)))
    paired = paired.select("grp", "cid", "component", "_own", "_i", "_j", task.alias("_task")).join(texts.select(F.col("key").alias("cid"), "text"), "cid")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rolling, out = Rolling(), [np.zeros((0, 2), np.int64)]
        for _, one in rows.groupby(["grp", "_i", "_j"], sort=False):
            if one["component"].nunique() > 1:
                out.append(links_within(rolling, one, threshold, size))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return distinct_pairs(paired.groupBy("_task").applyInPandas(run, "a long, b long"))


def links_within(rolling: Rolling, rows: pd.DataFrame, threshold: float, size: int) -> np.ndarray:
    """Pairs of rows at or above the threshold, of different components and, given two blocks, of different blocks.

    The counts of a shingle are spread into unit elements, so that shared elements are a product of 0/1 matrices.
    """
    n = len(rows)
    owner, hashes, counts = shingles(rolling, pa.array(rows["text"], pa.large_string()), size)
    level, own = ragged(np.zeros(len(counts), np.int64), counts)
    owner, elements = owner[own], mix64(hashes[own] + level.astype(np.uint64) * _OCTAVE)
    _, element, times = np.unique(elements, return_inverse=True, return_counts=True)
    total = np.bincount(owner, minlength=n)
    common = times[element] > 1
    owner, element = owner[common], element[common]
    place = np.cumsum(times > 1) - 1
    element = place[element]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    shared = np.zeros((n, n), np.float32)
    for first in range(0, int(element[-1]) + 1 if len(element) else 0, 4096):
        low, high = np.searchsorted(element, (first, first + 4096))
        part = np.zeros((n, 4096), np.float32)
        part[owner[low:high], element[low:high] - first] = 1
        shared += part @ part.T
    component, block, cid = rows["component"].to_numpy(), rows["_own"].to_numpy(), rows["cid"].to_numpy()
    similar = shared >= threshold * np.maximum(total[:, None] + total[None, :] - shared, 1) - 1e-9
    similar &= component[:, None] != component[None, :]
    if rows["_i"].iloc[0] != rows["_j"].iloc[0]:
        similar &= block[:, None] != block[None, :]
    left, right = np.nonzero(np.triu(similar, 1))
    return np.column_stack([np.minimum(cid[left], cid[right]), np.maximum(cid[left], cid[right])])


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, text, n_bytes)`` of the given keys, one row each."""
    wanted = keyed(docs).select("key", "text").join(keys.distinct().hint("shuffle_hash"), "key", "left_semi")
    return wanted.groupBy("key").agg(F.max("text").alias("text")).withColumn("n_bytes", F.octet_length("text"))


def within_reach(placed: DataFrame, near: float) -> DataFrame:
    """The rows of (grp, component, distance, ..) that may lie within ``near`` of a row of another component.

    Rows whose distances to the group's chosen member differ by more than ``near`` are further apart than that. Distances
    are told in steps of a quarter of ``near``, one step more than needed on either side.
    """
    step = placed.withColumn("_step", F.floor(F.col("distance") * 4 / near).cast("int"))
    held = step.groupBy("grp", "_step").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    spread = held.select("grp", F.explode(F.sequence(F.col("_step") - 5, F.col("_step") + 5)).alias("_step"), "lo", "hi")
    mixed = spread.groupBy("grp", "_step").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    return step.join(mixed.select("grp", "_step"), ["grp", "_step"], "left_semi").drop("_step", "distance")


def bucket_links(scratch: Scratch, docs: DataFrame, members: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Nodes and links that join all members (bucket, cid) whose texts are similar and share a bucket.

    Every bucket's chosen member is compared with the others, and links give components. Distances obey the triangle
    inequality: with 1 - threshold = t, a linked pair is either within 2t and 3t of the chosen member, or both are
    beyond 2t. So what is left to compare is, in groups of several components, all within 3t of a chosen member, and
    each bucket's members beyond 2t; and of these only members about as far from the chosen one (``within_reach``).
    """
    near = 1 - threshold
    chosen = (
        members.groupBy("bucket")
        .agg(F.min(F.struct(F.xxhash64("cid").alias("o"), "cid")).alias("one"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("bucket", F.col("one.cid").alias("a"))
    )
    starred = scratch.keep("starred", members.join(chosen, "bucket").select("bucket", "a", F.col("cid").alias("b")))
    texts = scratch.keep("texts", texts_of(docs, starred.select(F.col("b").alias("key"))))
    tested = scratch.keep("tested", verified(distinct_pairs(starred.where("a <> b")), texts, size))
    links = tested.where(F.col("similarity") >= threshold).select("a", "b")
    nodes = scratch.keep("nodes", texts.select(F.lit(0).alias("g"), F.col("key").alias("cid"), "n_bytes"))
    joined = scratch.keep("joined", _components(nodes, links).join(nodes.drop("g"), "cid"))
    distance = 1 - F.col("similarity")
    near_by = tested.where(distance <= 3 * near + 1e-9)
    kin = near_by.select(F.col("a").alias("grp"), F.col("b").alias("cid"), distance.alias("distance")).unionByName(
        near_by.select(F.col("a").alias("grp"), F.col("a").alias("cid"), F.lit(0.0).alias("distance")).distinct()
    )
    far = starred.join(tested.where(distance > 2 * near - 1e-9).select("a", "b", distance.alias("distance")), ["a", "b"])
    far = far.select(F.col("bucket").alias("grp"), F.col("b").alias("cid"), "distance")
    placed = scratch.keep("placed", kin.unionByName(far).join(joined, "cid"))
    scratch.drop("starred", "joined")
    more = compared(scratch, within_reach(placed, near), texts, threshold, size)
    links = scratch.keep("links", links.unionByName(more))
    scratch.drop("texts", "tested", "placed", "blocks")
    return nodes, links


def near_documents(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """One row per document: ``key``, ``group_id`` (the least id of its group) and whether it is the one that stays."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep("signed", sign(docs, bands, rows, size).withColumn("uid", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "uid")
    classes = scratch.keep(
        "classes",
        signed.where("n_shingles > 0")
        .groupBy("print1", "print2")
        .agg(F.min(order).alias("least"), F.first("bands").alias("bands"))
        .withColumn("cid", F.col("least.key")),
    )
    nodes, links = bucket_links(scratch, docs, classes.select("cid", F.explode("bands").alias("bucket")), threshold, size)
    member = classes.select("print1", "print2", "least", "cid").join(_components(nodes, links), "cid", "left")
    member = member.withColumn("component", F.coalesce("component", "cid"))
    best = member.groupBy("component").agg(F.min("least").alias("best"))
    told = member.join(best, "component").select("print1", "print2", "best")
    rest = signed.select("doc_id", "key", "uid", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(p)).alias(p) for p in ("print1", "print2")])
    return rest.join(told, ["print1", "print2"], "left").select(
        "doc_id",
        "key",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("group_id"),
        F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        "n_shingles",
    )


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    edges = links.select(F.lit(0).alias("g"), F.col("a").alias("src"), F.col("b").alias("dst"))
    return components(nodes, edges, "g", "cid").drop("g")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns; rows alike in id and text are one document."""
    stays = near_documents(docs, **options).where("kept").select(F.col("key").alias("_key")).distinct()
    # the row travels as one struct, so its column names cannot clash with the key's
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("doc_id", clean_text()).alias("_key"))
    return marked.join(stays.hint("shuffle_hash"), "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
