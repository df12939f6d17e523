import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from twinfold.llm import packing
from twinfold.llm.common import table

JSON = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(texts, width):
    out = []
    for k, t in texts:
        ids = np.array(JSON.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % width or width
        cuts = [0, *range(first, len(ids) + 1, width)]
        out += [(k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


def check(rows, texts, width):
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(expected(texts, width), key=key)
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for inside in at.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= width
    return len(at)


def test_documents_of_a_table(spark, folder):
    docs = table(spark, folder, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.pack_documents(docs).collect()
    used = check(rows, texts, 1024)
    least = -(-sum(r.length for r in rows) // 1024)
    assert used <= least * 1.02 + 1


def test_odd_rows(make):
    texts = [(0, None), (None, ""), (2, "a"), (2, "a"), (3, "<|endoftext|> é𝄞   x\r\n\t" * 9), (4, "word " * 5000), (5, "x" * 31), (6, "'s'S 12 ٣ 漢字 " * 20)]
    assert check(packing.pack_documents(make(texts), width=32).collect(), texts, 32)
    assert packing.pack_documents(make([])).count() == 0


def test_plan_holds_every_capacity_and_is_near_the_bound():
    rng = random.Random(4)
    for rule in ("norm", "dot"):
        counts = defaultdict(int)
        for _ in range(3000):
            counts[rng.randint(1, 77)] += rng.randint(1, 9)
        plan, used = packing.plan_sequences(counts, 100, max_docs=6, max_cost=6000, rule=rule)
        inside = defaultdict(list)
        per = {n: sorted(r for r in plan.tolist() if r[0] == n) for n in counts}
        for n, rows in per.items():
            for row, nxt in zip(rows, [*rows[1:], (n, counts[n])], strict=True):
                for k in range(nxt[1] - row[1]):
                    inside[row[2] + k].append((row[3], n))
        assert sum(map(len, inside.values())) == sum(counts.values()) and len(inside) == used
        for x in inside.values():
            assert len(x) <= 6 and sum(n for _, n in x) <= 100 and sum(n * n for _, n in x) <= 6000
    counts = {n: 50 for n in range(1, 101)}
    assert packing.plan_sequences(counts, 100)[1] <= sum(n * c for n, c in counts.items()) / 100 * 1.01 + 1
