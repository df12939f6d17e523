"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the centred, PCA-projected vectors is learned on a bounded sample so that the signs of the rotated
vectors are balanced codes. Codes are cut into equal parts of at most 16 bits, ``tables`` at least; a vector is stored under each of its parts and
looked up under every part within ``radius`` bits of its own. Pairs that meet in any table are ranked again by the
cosine of the original vectors in double precision, and only those at or above the threshold are links.

Equal vectors of one label form a class before anything is paired, so copies never multiply: a class carries its size.
Links and components are over classes; ``n_links`` adds the sizes. Large buckets are split by the skew join.

With the defaults (64 bits, four tables, radius one) a pair at cosine 0.98 is missed with probability below 1 %, and
pairs above it less often; longer vectors get more tables. At a billion vectors use wider parts: fewer tables and a larger radius.

Rows: a vector that is null, zero, or holds null or non-finite numbers, and a row without a label, links with nothing
and is its own component. Vectors are compared only with those of equal length; a length that the sample lacks gets a
fixed rotation. Repeated rows are vectors of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.graph import components
from twinfold.session import cut_lineage

SAMPLE = 20_000
THRESHOLD = 0.98
TABLES = 4
PART_BITS = 16
RADIUS = 1
ROUNDS = 50


def learn_rotation(sample: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (PCA times rotation) of unit vectors."""
    dim = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) >= 2 * dim else np.zeros(dim)
    start = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0]
    if len(sample) < 2 * dim:
        return mean, start
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    flat = centred @ axes
    turn = start
    for _ in range(rounds):
        code = np.where(flat @ turn >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(code.T @ flat)
        turn = (u @ vt).T
    return mean, axes @ turn


def fit(classes: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """One model per vector length, from the ``sample`` rows that come first by the hash of their content."""
    rows = classes.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toPandas()["embedding"]
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(len(row), []).append(np.asarray(row, np.float64))
    unit = {n: np.array(x) / np.linalg.norm(x, axis=1, keepdims=True) for n, x in by_length.items()}
    return {n: learn_rotation(x) for n, x in unit.items()}


def encode(classes: DataFrame, models: dict, tables: int = TABLES) -> DataFrame:
    """``(cid, label, n_dims, codes)``: one integer per table, all of the code's bits together; ``tables`` is the least number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict(models)
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column("embedding").to_pylist()]
            lengths = np.array([len(v) for v in vectors], np.int32)
            codes: list[np.ndarray] = [np.zeros(0, np.int64)] * len(vectors)
            for n in np.unique(lengths):
                mean, turn = held.setdefault(n, learn_rotation(np.zeros((0, n))))
                rows = np.flatnonzero(lengths == n)
                x = np.array([vectors[i] for i in rows])
                bits = ((x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ turn) >= 0
                parts = np.array_split(bits, max(tables, -(-int(n) // PART_BITS)), axis=1)
                own = np.stack([part @ (np.int64(1) << np.arange(part.shape[1], dtype=np.int64)) for part in parts], axis=1)
                for i, code in zip(rows, own, strict=True):
                    codes[i] = code
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("label"), pa.array(lengths), pa.array(codes, pa.list_(pa.int64()))],
                names=["cid", "label", "n_dims", "codes"],
            )

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("cid", "label", "embedding").mapInArrow(run, f"cid bigint, label {kind}, n_dims int, codes array<bigint>")


def candidates(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, whose codes are within ``radius`` bits in at least one table.

    Looking up is one-sided: flipping bits of one code finds every code within the radius.
    """
    stored = codes.select("cid", "label", "n_dims", F.size("codes").alias("tables"), F.posexplode("codes").alias("t", "code"))
    bits = "transform(sequence(0, cast(n_dims / tables as int)), i -> shiftleft(1L, i))"
    level = masks = "array(0L)"
    for _ in range(radius):
        level = f"flatten(transform({level}, m -> transform({bits}, o -> m ^ o)))"
        masks = f"array_distinct(concat({masks}, {level}))"
    probes = stored.withColumn("code", F.explode(F.expr(f"transform({masks}, m -> code ^ m)"))).drop("tables")
    left = probes.withColumnRenamed("cid", "a")
    right = stored.withColumnRenamed("cid", "b")
    met = left.join(right, ["label", "n_dims", "t", "code"]).where("a < b")
    return met.groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_")


def linked(pairs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs whose original vectors have at least the cosine."""
    own = classes.select("cid", "embedding")
    both = pairs.join(own.toDF("a", "va"), "a").join(own.toDF("b", "vb"), "b").select("a", "b", "va", "vb")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = batch.column("va"), batch.column("vb")
            if not len(va):
                continue
            sizes = np.diff(va.offsets.to_numpy())
            x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for v in (va, vb))
            at = np.cumsum(sizes) - sizes
            dot, nx, ny = (np.add.reduceat(p, at) for p in (x * y, x * x, y * y))
            cosine = dot / (np.sqrt(nx) * np.sqrt(ny))
            keep = cosine >= threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(cosine[keep])],
                names=["a", "b", "cosine"],
            )

    return both.mapInArrow(rank, "a bigint, b bigint, cosine double")


def vector_classes(rows: DataFrame) -> DataFrame:
    """``(cid, label, embedding, first_id, n)``: the distinct comparable vectors of each label."""
    value = "embedding"
    sound = F.col("label").isNotNull() & (F.size(value) > 0) & ~F.exists(
        value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ) & F.exists(value, lambda x: x != 0)
    grouped = rows.where(sound).groupBy("label", value).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    return cut_lineage(grouped.withColumn("cid", F.monotonically_increasing_id()))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, radius: int = RADIUS, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: direct links, the least id reachable by links, and whether it is that one."""
    rows = rows.select("vec_id", "label", "embedding")
    classes = vector_classes(rows)
    codes = encode(classes, fit(classes, sample), tables)
    links = cut_lineage(linked(candidates(codes, radius), classes, threshold))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("cid").alias("b"), F.col("n").alias("_n"))
    degree = both.join(size, "b").groupBy(F.col("a").alias("cid")).agg(F.sum("_n").alias("_others"))
    nodes = classes.select(F.lit(0).alias("g"), "cid")
    edges = links.select(F.lit(0).alias("g"), F.col("a").alias("src"), F.col("b").alias("dst"))
    member = components(nodes, edges, "g", "cid").drop("g")
    named = classes.join(member, "cid")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = (
        named.join(least, "component")
        .join(degree, "cid", "left")
        .select("label", "embedding", (F.col("n") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"), "component_id")
    )
    return rows.join(told, ["label", "embedding"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n_links").isNull(), True).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
