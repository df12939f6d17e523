"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted in order; each model sees the text's features and the probabilities of the categories before
it. While training, those are out-of-fold predictions, so that a later model learns how far to trust an earlier one on
texts it has not seen. The decision threshold comes from out-of-fold predictions too.

Features are presence of hashed words and of word beginnings of four to six bytes, lower case in ASCII and split at
ASCII punctuation, and a few rates of the whole text. The models are logistic with an L1 penalty, so a long text does
not gather noise from rare words.

The chain is fitted on at most ``SAMPLE`` labelled documents, those that come first by the hash of their id. Everything
else is one pass over all documents without a shuffle. The default chain is low_quality, toxic, from ``labels``.

Rows: a null or empty text has no features and gets the probabilities of the intercepts. Labels with a null id or value
are left out, an id labelled twice counts as its largest value, an id of several documents as the largest text. Where
no label or only one class of a category is there, its probability is the class's own rate and nothing is rejected.
An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.common import Rolling, clean_text, flat, letters_only, lower_ascii, pieces, word_bounds

SAMPLE = 10_000
BUCKETS = 1 << 18
SCREENED = 4096
FOLDS = 3
PENALTY = 3e-4  # at 8000 rows; it grows with fewer
RIDGE = 3e-3
STEPS = 150
STARTS = (4, 5, 6)
RATES = 5


def features(rolling: Rolling, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text number, bucket, rates) of pieces of the array; buckets may repeat within a text."""
    data, offsets = flat(texts)
    breaks = letters_only()
    for start, stop in pieces(offsets, 1_000_000):
        part = data[offsets[start] : offsets[stop]]
        own = offsets[start : stop + 1] - offsets[start]
        begin, end, at = word_bounds(part, own, breaks)
        sums = rolling.prefix(rolling.bytes[lower_ascii(part)])
        words = rolling.spans(sums, begin, end)
        owner = np.repeat(np.arange(stop - start), np.diff(at))
        owners, hashes = [owner], [words]
        for k in STARTS:
            longer = end - begin > k
            owners.append(owner[longer])
            hashes.append(rolling.spans(sums, begin[longer], begin[longer] + k) * np.uint64(2 * k + 1))
        buckets = (np.concatenate(hashes) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)
        n, size = stop - start, np.maximum(np.diff(own), 1)
        repeated = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        rate = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[own]) / size
        count = np.bincount(owner, minlength=n)
        rates = np.column_stack([
            np.log1p(count),
            np.bincount(owner[1:][repeated], minlength=n) / np.maximum(count, 1),
            rate((part >= 65) & (part <= 90)),
            rate((part >= 48) & (part <= 57)),
            rate((part > 32) & (part < 48)),
        ])
        yield start, np.concatenate(owners), buckets, rates


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scaled(dense: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised rates, held within two deviations; zero for a text without words."""
    return np.clip((dense - mean) / scale, -2, 2) * (dense[:, :1] > 0)


def fit_linear(row: np.ndarray, bucket: np.ndarray, dense: np.ndarray, label: np.ndarray) -> dict:
    """L1 logistic regression by accelerated proximal steps on the buckets that differ most between the classes."""
    n, rate = len(label), label.mean() if len(label) else 0.0
    mean, scale = dense.mean(axis=0) if n else np.zeros(dense.shape[1]), dense.std(axis=0) + 1e-9 if n else np.ones(dense.shape[1])
    if not 0 < rate < 1:
        value = 30.0 if rate == 1 else -30.0
        return {"bias": value, "bucket": np.zeros(0, np.int64), "weight": np.zeros(0), "dense": np.zeros(dense.shape[1]), "mean": mean, "scale": scale}
    of = [np.bincount(bucket[label[row] == y], minlength=BUCKETS) for y in (0, 1)]
    total, expected = of[0] + of[1], (of[0] + of[1]) * rate
    score = np.where(total >= 3, (of[1] - expected) ** 2 / np.maximum(expected * (1 - rate), 1e-9), 0)
    chosen = np.sort(np.argpartition(-score, SCREENED)[:SCREENED])
    chosen = chosen[score[chosen] > 0]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    col = place[bucket]
    keep = col >= 0
    row, col = row[keep], col[keep]
    x = _scaled(dense, mean, scale)
    weight, slope, bias = np.zeros(len(chosen)), np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    # step from the largest eigenvalue of the features' second moments, by power iteration
    v = np.ones(len(chosen)) if len(chosen) else np.zeros(0)
    size = 1.0
    for _ in range(12):
        if not len(v):
            break
        u = np.bincount(col, weights=np.bincount(row, weights=v[col], minlength=n)[row], minlength=len(chosen)) / n
        size = float(np.linalg.norm(u)) or 1.0
        v = u / size
    penalty = PENALTY * (8000 / n) ** 0.7
    step = 4 / (size * 1.05 + x.shape[1] + 1)
    ahead, momentum = (weight, slope, bias), 1.0
    for _ in range(STEPS):
        w, s, b = ahead
        error = _sigmoid(np.bincount(row, weights=w[col], minlength=n) + x @ s + b) - label
        new_w = w - step * np.bincount(col, weights=error[row], minlength=len(chosen)) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new = (new_w, s - step * (x.T @ error / n + RIDGE * s), b - step * error.mean())
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = tuple(a + (momentum - 1) / later * (a - o) for a, o in zip(new, (weight, slope, bias), strict=True))
        (weight, slope, bias), momentum = new, later
    used = weight != 0
    return {"bias": float(bias), "bucket": chosen[used], "weight": weight[used], "dense": slope, "mean": mean, "scale": scale}


def apply_linear(model: dict, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Probabilities; a bucket counts once per text, and only those with a weight are looked at."""
    place = np.full(BUCKETS, -1, np.int32)
    place[model["bucket"]] = np.arange(len(model["bucket"]))
    col = place[bucket]
    keep = col >= 0
    width = max(len(model["bucket"]), 1)
    cells = np.unique(row[keep] * width + col[keep])
    weights = model["weight"][cells % width] if len(cells) else np.zeros(0)
    sums = np.bincount(cells // width, weights=weights, minlength=len(dense))
    return _sigmoid(sums + _scaled(dense, model["mean"], model["scale"]) @ model["dense"] + model["bias"])


def fit_chain(row: np.ndarray, bucket: np.ndarray, rates: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> dict:
    """Models of the categories in order and the threshold of the last, from out-of-fold probabilities."""
    dense, models, out = rates, [], np.zeros(len(labels))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        out = np.zeros(len(y))
        for f in range(FOLDS):
            inside = fold != f
            place = np.cumsum(inside) - 1
            seen = inside[row]
            model = fit_linear(place[row[seen]], bucket[seen], dense[inside], y[inside])
            held = ~seen
            out[~inside] = apply_linear(model, np.cumsum(~inside)[row[held]] - 1, bucket[held], dense[~inside])
        models.append(fit_linear(row, bucket, dense, y))
        dense = np.column_stack([dense, out])
    return {"models": models, "threshold": best_threshold(out, labels[:, -1] if len(labels) else out)}


def best_threshold(probability: np.ndarray, label: np.ndarray) -> float:
    """The middle of the gap whose decisions have the best F1; above 1 where a class is missing."""
    if not len(label) or not 0 < label.mean() < 1:
        return 2.0
    order = np.argsort(-probability, kind="stable")
    p, y = probability[order], label[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    best = int(np.argmax(f1))
    return float((p[best] + p[best + 1]) / 2) if best + 1 < len(p) else float(p[best] / 2)


def category_labels(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """Ids with 0/1 categories in chain order, from ``labels``."""
    sound = labels.where("doc_id is not null and quality is not null and toxic is not null")
    held = sound.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return held.select("doc_id", (1 - F.col("q")).alias("low_quality"), F.col("t").alias("toxic")), ["low_quality", "toxic"]


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> dict:
    """The fitted chain. ``labels`` has one row per id and 0/1 categories; at most ``sample`` are used."""
    chosen = labels.select(F.col("doc_id").alias("_id"), F.array(*[F.col(c).cast("double") for c in categories]).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = (
        docs.select("doc_id", clean_text().alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most ``sample`` rows
        .groupBy("doc_id")
        .agg(F.max("text").alias("text"), F.first("y").alias("y"))
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for start, owner, bucket, rates in features(rolling, batch.column("text")):
                n = len(rates)
                cells = np.unique(owner * BUCKETS + bucket)
                at = np.searchsorted(cells // BUCKETS, np.arange(n + 1))
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.string()),
                        part.column("y"),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((cells % BUCKETS).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * RATES, pa.int32()), pa.array(rates.ravel())),
                    ],
                    names=["id", "y", "buckets", "rates"],
                )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        import pickle
        import zlib

        rows = rows.sort_values("id").reset_index(drop=True)
        row = np.repeat(np.arange(len(rows)), rows["buckets"].map(len))
        bucket = np.concatenate([np.asarray(b, np.int64) for b in rows["buckets"]])
        fold = np.array([zlib.crc32(i.encode()) % FOLDS for i in rows["id"]])
        chain = fit_chain(row, bucket, np.array(rows["rates"].tolist()), np.array(rows["y"].tolist()), fold)
        return pd.DataFrame({"chain": [pickle.dumps(chain)]})

    import pickle

    found = (
        texts.mapInArrow(extract, "id string, y array<double>, buckets array<int>, rates array<double>")
        .groupBy(F.lit(0).alias("all"))  # at most ``sample`` rows
        .applyInPandas(fit, "chain binary")
        .collect()
    )
    if found:
        return pickle.loads(found[0]["chain"])
    none = np.zeros(0, np.int64)
    rates = lambda k: np.zeros((0, RATES + k))
    return {"models": [fit_linear(none, none, rates(k), np.zeros(0)) for k in range(len(categories))], "threshold": 2.0}


def _probabilities(chain: dict, rolling: Rolling, texts: pa.Array) -> np.ndarray:
    out = [np.zeros((0, len(chain["models"])))]
    for _, owner, bucket, rates in features(rolling, texts):
        dense = rates
        for model in chain["models"]:
            dense = np.column_stack([dense, apply_linear(model, owner, bucket, dense)])
        out.append(dense[:, RATES:])
    return np.concatenate(out)


def score(docs: DataFrame, chain: dict, categories: list[str]) -> DataFrame:
    """``doc_id``, a probability per category, and the decision on the last one, for every document."""
    names = [f"p_{c}" for c in categories]
    schema = T.StructType(
        [docs.schema["doc_id"]] + [T.StructField(n, T.DoubleType()) for n in names] + [T.StructField(categories[-1], T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            p = _probabilities(chain, rolling, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c) for c in p.T], pa.array(p[:, -1] > chain["threshold"])],
                names=[f.name for f in schema],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def reject(docs: DataFrame, chain: dict) -> DataFrame:
    """The documents that the chain does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            p = _probabilities(chain, rolling, batch.column("text"))
            yield batch.filter(pa.array(p[:, -1] <= chain["threshold"]))

    return docs.mapInArrow(run, docs.schema)
