import random
from itertools import permutations

from tests.llm.brute import WORD
from twinfold.llm import filter_audit as audit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(docs, labels):
    """{(part, order, step): columns} of (doc_id, text, lang) rows, applying the filters one after another."""
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    rows = []
    for k, t, lang in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": k is not None and least[t] < k,
        }
        good, toxic = (any(i == k and k is not None and x[j] == 1 for i, *x in labels) for j in (0, 1))
        rows.append((lang or "", {x for x, f in fails.items() if f}, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                removed[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS part", "2 AS mask", "3 AS salt", "4 AS good")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS salt", "2 AS n")
    rows = audit.filter_audit(frame, marks).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_every_order_and_step_equals_the_plain_version(spark):
    rng = random.Random(3)
    texts = []
    for i in range(60):
        n = rng.choice([0, 1, 90, 99, 100, 101, 180])
        words = [rng.choice(["Ab", f"w{rng.randrange(60)}", f"v{j}", "été", "CAPS"]) for j in range(n)]
        texts.append(rng.choice([" ", "\t\n", "\x0b", "  "]).join(words) + rng.choice(["", "", " $5", "|", "  "]))
    texts += [None, "", "x" * 300_000, "w " * 50_000, "a\x85b " * 100, "É" * 10 + "E"]
    docs = [(rng.choice([i, i, i % 7, None]), t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts + texts[:30] + texts[50:])]
    docs += docs[:10]
    labels = [(rng.randrange(60), rng.choice([0, 1, None]), rng.choice([0, 1, None, 2])) for _ in range(70)] + [(None, 1, 1)]
    assert run(spark, docs, labels) == plain(docs, labels)


def test_one_text_of_all_rows(spark):
    docs = [(i, "same", "en" if i % 3 else "fr") for i in range(500)]
    found = run(spark, docs, [])
    assert found == plain(docs, [])
    assert found["en", "EABCD", 1][:4] == (0, 333, 0, 0) and found["fr", "EABCD", 1][:2] == (1, 166)


def test_empty_tables(spark):
    assert run(spark, [], []) == {} and run(spark, [], [(1, 1, 1)]) == {}


def test_swaps_pass_all_orders_and_share_nodes():
    order, seen = list("ABCDE"), {"ABCDE"}
    for at in audit.plain_changes(5):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add("".join(order))
    assert len(seen) == 120
    diagram = audit.Diagram("ABCDE", {m: (1, 0, 0) for m in range(32)})  # one node a level when all ends are alike
    assert len(diagram.unique) == 6 and diagram.root[0] == (32, 0, 0)
    for at in (0, 3, 1, 2):
        diagram.swap(at)
    assert len(diagram.unique) == 6 and diagram.root[0] == (32, 0, 0)
