import random

from tests.llm import brute
from twinfold.llm import suffix_buckets
from twinfold.llm.common import table


def corpus(seed, alphabet, joiner, unit, n_docs=60):
    """Texts with copies, edited copies, shared passages near the window's width, and repeats inside a text."""
    rng = random.Random(seed)
    draw = lambda n: joiner.join(rng.choice(alphabet) for _ in range(n))
    shared = [draw(n) for n in (unit - 1, unit, unit + 1, 2 * unit, 3 * unit)]
    texts = []
    for i in range(n_docs):
        parts = [draw(rng.randint(0, 2 * unit))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), draw(rng.randint(0, unit // 2))]
        texts.append(joiner.join(p for p in parts if p))
        if i % 7 == 3:
            texts.append(rng.choice(texts))
        if i % 6 == 2:
            t = rng.choice(texts)
            k = rng.randint(0, len(t))
            texts.append(t[:k] + rng.choice(alphabet) + t[k + 1 :])
    texts += ["", None, alphabet[0] * 3, joiner.join([alphabet[0]] * 4 * unit), joiner.join(alphabet[:3] * 2 * unit)]
    return list(enumerate(texts))


def same(rows, want):
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_bytes_equal_the_plain_version(make):
    texts = corpus(1, "abcdé ", "", 60)
    for gram, sizes in ((40, (8, 1)), (10, (1,)), (60, (1,))):
        rows = suffix_buckets.remove_substrings(make(texts), width=60, gram=gram, sizes=sizes).collect()
        same(rows, brute.repeated_bytes(dict(texts), 60))


def test_bytes_of_a_table(spark, folder):
    docs = table(spark, folder, "documents").limit(120)
    texts = {r.doc_id: r.text for r in docs.collect()}
    docs = docs.where(docs.doc_id.isin(list(texts)))
    same(suffix_buckets.remove_substrings(docs).collect(), brute.repeated_bytes(texts))


def test_repeated_rows_and_null_ids(make):
    text = "the quick brown fox " * 3 + "x" * 40
    rows = suffix_buckets.remove_substrings(make([(1, text), (1, text), (None, text), (None, None), (2, "short")]), width=30, gram=20).collect()
    assert sorted(r.n_bytes - r.n_removed for r in rows) == [0, 0, 0, 0, 5]
    assert suffix_buckets.remove_substrings(make([])).count() == 0
