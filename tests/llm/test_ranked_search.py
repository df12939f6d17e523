import math
import random
import re
from collections import Counter

import pytest

from twinfold.llm import ranked_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item, text in items:
        found = []
        for (i, c), size in zip(counts, sizes):
            score = 0
            for term in set(terms(text)):
                df = sum(term in other for _, other in counts)
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                    score += weight * (1_000_000_000 * c[term] // (1000 * c[term] + 8 * (10 + 90 * size * n // length)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS term", "2 AS tf", "3 AS score", "4 AS place")
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS rank")
    rows = search.ranked_documents(frame.repartition(3), queries, **more).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(20 * n)] + ["Été", "ÉTÉ", "x-y", "A_b", "7"] * n
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 90])))) for j in range(12)]
    return docs, items


EDGES = [(901, None), (902, ""), (903, "--- !"), (None, "w1 w2"), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2"), (904, "w3 " * 30_000), (905, "w4,W4;w4 w4")]


@pytest.mark.parametrize("small", [False, True])
def test_ranks_equal_the_plain_version(spark, monkeypatch, small):
    docs, items = corpus(4, 150)
    docs += EDGES + docs[:20]  # repeated rows tie
    items += [(3, "w1 w2"), (50, None), (51, "absent words"), (52, "x" * 50_000), (None, "w5")]
    items = [x for n, x in enumerate(items) if x[0] not in [y[0] for y in items[:n]]]
    if small:  # slices of texts, and blocks of items
        monkeypatch.setattr(search, "SLICE", 7)
        assert search.count_terms(b"Ab cd-ab " * 9) == Counter({b"ab": 18, b"cd": 9})
    assert run(spark, docs, items, **({"limit": 20} if small else {})) == plain(docs, items)


def test_fewer_and_repeated_items(spark):
    docs = [(i, "same words here") for i in range(40)] + [(99, "other")]
    assert [r[2] for r in sorted(run(spark, docs, [(1, "same HERE")]), key=lambda r: r[1])] == list(range(10))
    assert run(spark, docs, [(1, "other"), (1, "other")]) == run(spark, docs, [(1, "other")]) * 2
    assert run(spark, docs, [(1, "same")], k=3) == plain(docs, [(1, "same")], 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []


def test_groups_of_long_masks_are_whole():
    import numpy as np

    rng = np.random.default_rng(5)
    presence = rng.random((200, 300)) < 0.02
    presence[:, 100:] = presence[:, rng.integers(0, 100, 200)]
    first, group = search.masks_of(presence)
    assert (presence[:, first[group]] == presence).all() and len(first) == len({c.tobytes() for c in presence.T})
