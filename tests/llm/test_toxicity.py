import random

import numpy as np

from twinfold.llm import toxicity
from twinfold.llm.common import table


def test_held_out_accuracy(spark, make):
    rng = random.Random(2)
    plain = [f"p{i}" for i in range(300)]
    bad = ["vilest", "horridity", "grossness"]
    docs, labels = [], []
    for i in range(900):
        toxic, poor = i % 5 == 0, i % 4 == 1
        words = [rng.choice(plain) for _ in range(rng.randint(3, 400))]
        if poor:
            words = [w for w in words[:50] for _ in range(12)]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "ä", "xx", "q"]) + rng.choice([",", "", "."]))
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if poor else 1, int(toxic)))
    docs += [(9000, None), (None, ""), (9001, "Vilest. thing"), (3, "doubled id")]
    known = spark.createDataFrame([r for r in labels if r[0] < 600] + [(None, 1, 1), (5, None, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    frame = make(docs)
    held, names = toxicity.category_labels(known)
    chain = toxicity.train(frame, held, names)
    rows = {r.doc_id: r for r in toxicity.score(frame, chain, names).collect() if r.p_toxic is not None}
    assert np.mean([rows[i].toxic == bool(t) for i, _, t in labels if i >= 600]) >= 0.98
    assert np.mean([(rows[i].p_low_quality > 0.5) == (q == 0) for i, q, _ in labels if i >= 600]) >= 0.97
    assert rows[9001].toxic and not rows[9000].toxic
    kept = toxicity.reject(frame, chain)
    assert kept.columns == frame.columns and kept.count() == sum(not r.toxic for r in toxicity.score(frame, chain, names).collect())


def test_without_labels_nothing_is_rejected(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    frame = make([(1, "a"), (2, None)])
    for labels in (none, one):
        held, names = toxicity.category_labels(labels)
        chain = toxicity.train(frame, held, names)
        assert [r.toxic for r in toxicity.score(frame, chain, names).collect()] == [False, False]
        assert toxicity.score(make([]), chain, names).count() == 0


def test_table(spark):
    folder = "/root/testdata/sf0.1"
    docs = table(spark, folder, "documents")
    held, names = toxicity.category_labels(table(spark, folder, "labels"))
    train = held.where("doc_id % 2 = 0")
    rows = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.train(docs, train, names), names).collect()}
    rest = held.where("doc_id % 2 = 1").collect()
    assert np.mean([rows[r.doc_id] == bool(r.toxic) for r in rest]) >= 0.97
