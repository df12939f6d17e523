import random
import re

from twinfold.llm import decontaminate
from twinfold.llm.common import table


def plain(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def smith_waterman(item, words):
    best, above = 0.0, [0.0] * (len(words) + 1)
    for a in item:
        row = [0.0]
        for j, b in enumerate(words):
            row.append(max(0.0, above[j] + (1 if a == b else -0.5), above[j + 1] - 0.5, row[j] - 0.5))
        above = row
        best = max(best, *row)
    return best


def brute(texts, items, threshold=0.5, run=4):
    """Score of each document and item that share ``run`` words in a row."""
    out = {}
    for d, t in texts:
        words = plain(t)
        for i, x in items:
            own = plain(x)
            grams = {tuple(own[k : k + run]) for k in range(len(own) - run + 1)}
            if any(tuple(words[k : k + run]) in grams for k in range(len(words) - run + 1)):
                score = smith_waterman(own, words) / len(own)
                if score >= threshold:
                    out[d, i] = score
    return out


def test_equal_the_plain_version(spark, make):
    rng = random.Random(11)
    draw = lambda n: [f"w{rng.randrange(150)}" for _ in range(n)]
    items = [(i, " ".join(draw(rng.randint(8, 40)))) for i in range(20)] + [(50, "too short"), (51, None), (52, "")]
    texts = []
    for i in range(120):
        words = draw(rng.randint(0, 120))
        if i % 2:
            own = items[rng.randrange(20)][1].split()
            for _ in range(rng.randint(0, len(own) // 3)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice(([], ["edited"], [own[k], "more"], [own[k].upper() + ","]))
            at = rng.randint(0, len(words))
            words[at:at] = own
        texts.append((i, rng.choice((" ", "\n", ", ")).join(words)))
    texts += [(900, None), (901, ""), (None, items[0][1]), (903, items[1][1] + " " + " ".join(draw(200)) + " " + items[1][1])]
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id int")
    rows = decontaminate.find_leaks(make(texts), bench).collect()
    want = brute(texts, items)
    best = {}
    for r in rows:
        best[r.doc_id, r.item_id] = max(best.get((r.doc_id, r.item_id), 0), r.score)
        assert 0 <= r.begin_word < r.end_word <= len(plain(dict(texts)[r.doc_id]))
    assert brute(texts, items, run=5).keys() <= best.keys() <= want.keys()
    assert all(abs(best[k] - want[k]) < 1e-9 for k in best) and len(best) >= 0.95 * len(want)
    assert sum(r.doc_id == 903 and r.item_id == 1 for r in rows) == 2
    kept = decontaminate.without_leaks(make(texts), bench).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in texts} - {d for d, _ in best}
    small = decontaminate.find_leaks(make(texts), bench, limit=300).collect()
    assert sorted(map(str, small)) == sorted(map(str, rows))


def test_one_word_in_five_replaced(spark, make):
    items = [(i, " ".join(f"v{i}x{k}" for k in range(30))) for i in range(6)]
    edited = lambda t: " ".join("new" if k % 5 == 4 else w for k, w in enumerate(t.split()))
    texts = [(i, f"some words before {edited(t)} and after") for i, t in items]
    texts += [(10 * i + k, t) for i, t in items[3:] for k in range(3)]  # verbatim copies of half of the items
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make(texts), bench).collect()}
    assert found == {(i, i) for i in range(6)} | {(10 * i + k, i) for i in range(3, 6) for k in range(3)}
    assert decontaminate.without_leaks(make(texts), bench).count() == 0
    assert found == brute(texts, items).keys()


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(make([(1, "a b c d e")]), none).count() == 0
    assert decontaminate.without_leaks(make([(1, "a b c d e")]), none).count() == 1
    some = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontaminate.find_leaks(make([]), some).count() == 0


def test_table(spark, folder):
    docs, bench = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if r.text in t}
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert whole <= found and len(found) <= len(whole) + 5
