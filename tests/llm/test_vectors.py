import math
import random

import numpy as np

from twinfold.llm import vectors
from twinfold.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, a int, codes string"


def brute(rows):
    good = [(i, np.asarray(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {}
    for n, (i, v, lab) in enumerate(good):
        for m, (j, w, lab2) in enumerate(good):
            if n != m and lab == lab2 and len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.98:
                near.setdefault(n, set()).add(m)
    links = {i: 0 for i, _, _ in rows} | {good[n][0]: len(x) for n, x in near.items()}
    least = {}
    for n in range(len(good)):
        seen, todo = {n}, [n]
        while todo:
            for m in near.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least[good[n][0]] = min(good[m][0] for m in seen)
    return {i: (links[i], least.get(i, i), least.get(i, i) == i) for i, _, _ in rows}


def test_small(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [rng.gauss(0, 1) for _ in range(16)]
        for c in range(5):
            rows.append((len(rows), [x + rng.gauss(0, 0.12) * c for x in base], g % 3))
        rows += [(len(rows), base, g % 3), (len(rows) + 1, [2 * x for x in base], 7)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, rows[0][1], None), (905, [], 2), (906, [1.0, 2.0, 3.0], 2), (907, [1.0, 2.0, 3.0], 2), (908, [float("inf"), 1.0], 2)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame([(*r, "c", 1, "d") for r in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got == brute(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_recall_of_longer_vectors(spark):
    rng = np.random.default_rng(5)
    for dim in (128, 256):
        rows = []
        for g in range(200):
            x, y = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
            rows += [(len(rows), x.tolist(), 1), (len(rows) + 1, (0.981 * x + math.sqrt(1 - 0.981**2) * y).tolist(), 1)]
        rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
        want = brute(rows)
        got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame([(*r, "c", 1, "d") for r in rows], SCHEMA)).collect()}
        assert sum(x[0] for x in want.values()) == 400
        assert sum(r.n_links for r in got.values()) >= 0.97 * 400, dim
        assert all(got[i].n_links <= want[i][0] for i in want)


def test_recall_on_a_table(spark, folder):
    df = table(spark, folder, "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    want = brute(rows)
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert set(got) == set(want)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(x[0] for x in want.values())
    assert all(got[i].n_links <= want[i][0] for i in want)
