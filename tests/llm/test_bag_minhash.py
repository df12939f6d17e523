import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.brute import WORD
from twinfold.llm import bag_minhash
from twinfold.llm.common import Rolling, table


def bag(text, size=5):
    words = WORD.findall(text or "")
    if 0 < len(words) < size:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def brute_groups(texts, threshold=0.8):
    bags = [(k, bag(t)) for k, t in texts]
    near = {k: {k} for k, _ in bags}
    for i, (k, a) in enumerate(bags):
        for m, b in bags[:i]:
            if a and b and jaccard(a, b) >= threshold:
                near[k].add(m)
                near[m].add(k)
    least = {}
    for k, _ in bags:
        seen, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        least[k] = min(seen)
    return least


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=5):
    rng = random.Random(seed)
    draw = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    texts = []
    for g in range(8):
        base = draw(rng.choice((30, 80, 200)))
        texts += [base, base.replace(" ", "\n  ")] + [edited(rng, base, k) for k in (1, 1, 2, 3, 4, 6)]
    chain = draw(60)
    for _ in range(12):
        texts.append(chain)
        chain = edited(rng, chain, 1)
    line = draw(9)
    texts += [" ".join([line] * n) for n in (1, 2, 40, 41, 50, 200)]
    texts += ["", None, " \n", "a b", "a b", "a  b", "a b c d", "x"] + [draw(50) for _ in range(10)]
    return list(enumerate(texts))


def test_groups_equal_the_plain_version(make):
    texts = corpus()
    rows = bag_minhash.near_documents(make(texts)).collect()
    assert {r.doc_id: r.group_id for r in rows} == brute_groups(texts)
    assert all(r.kept == (r.doc_id == r.group_id) for r in rows) and len(rows) == len(texts)
    kept = bag_minhash.deduplicate(make(texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_groups(texts).values()))
    assert bag_minhash.near_documents(make([])).count() == 0


def test_repeated_rows_and_null_ids(make):
    text = "one two three four five six"
    rows = bag_minhash.near_documents(make([(3, text), (3, text), (None, text), (None, None), (5, None)])).collect()
    assert sorted((str(r.doc_id), str(r.group_id)) for r in rows) == [("3", "3"), ("3", "3"), ("5", "5"), ("None", "3"), ("None", "None")]
    assert sum(r.kept for r in rows) == 3
    kept = bag_minhash.deduplicate(make([(3, text), (3, text), (None, text), (None, None), (5, None)]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "None"]


def test_registers_collide_as_often_as_weights_overlap():
    a = " ".join(["p q r s t"] * 30 + [f"a{i}" for i in range(60)])
    b = " ".join(["p q r s t"] * 45 + [f"a{i}" for i in range(40)])
    rolling = Rolling()
    owner, hashes, counts = bag_minhash.shingles(rolling, pa.array([a, b]))
    times = bag_minhash.signatures(owner, hashes, counts, 2, 20_000)
    want = jaccard(bag(a), bag(b))
    assert abs(np.mean(times[0] == times[1]) - want) < 0.02
    assert abs(bag_minhash.similarity(rolling, pa.array([a]), pa.array([b]))[0] - want) < 1e-12
    assert abs(times.mean() * sum(bag(a).values()) - 1) < 0.3


def test_documents_of_a_table(spark, folder):
    docs = table(spark, folder, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.group_id for r in bag_minhash.near_documents(docs).collect()} == brute_groups(texts)


def test_deduplicating_keeps_columns_named_as_inner_ones(make, words):
    inner = ["_key", "_row", "kept", "uid", "print1", "band"]
    text = " ".join(words(30))
    docs = make([(4, text), (2, text), (7, "another text of some words"), (None, None)])
    docs = docs.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, 9)) AS {c}" for c in inner])
    left = bag_minhash.deduplicate(docs)
    assert left.columns == docs.columns
    rows = {r.doc_id: r for r in left.collect()}
    assert set(rows) == {2, 7, None}
    assert all(rows[k][c] == f"{c}{9 if k is None else k}" for k in rows for c in inner)


def test_near_copies_of_one_text_meet_few_times(make, monkeypatch):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    texts = list(enumerate([edited(rng, base, 2) for _ in range(60)] + [edited(rng, base, 20) for _ in range(3)]))
    compared, rows = bag_minhash.compared, []

    def counted(scratch, groups, *rest):
        rows.append(groups.count())
        return compared(scratch, groups, *rest)

    monkeypatch.setattr(bag_minhash, "compared", counted)
    found = {r.doc_id: r.group_id for r in bag_minhash.near_documents(make(texts)).collect()}
    assert found == brute_groups(texts)
    assert rows[0] <= 4 * len(texts)  # of 24 bands with 63 members each
