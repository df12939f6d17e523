from tests.llm import brute
from tests.llm.test_substrings import corpus, same
from twinfold.llm import suffix_automata
from twinfold.llm.common import table


def test_words_equal_the_plain_version(make):
    texts = corpus(7, ["aa", "b", "é", "Dd", "e f"], " ", 12) + [(900, "x\x1cy\t\x0bz \x0c\r\n" * 9), (901, "x\x1cy z " * 9)]
    for gram in (4, 12):
        rows = suffix_automata.remove_passages(make(texts), width=12, gram=gram).collect()
        same(rows, brute.repeated_words(dict(texts), 12))


def test_shards_and_copies(make, monkeypatch):
    monkeypatch.setattr(suffix_automata, "SHARD_WORDS", 40)
    monkeypatch.setattr(suffix_automata, "TASK_WORDS", 100)
    texts = corpus(8, ["aa", "b", "c", "Dd"], " ", 12)
    same(suffix_automata.remove_passages(make(texts), width=12, gram=4).collect(), brute.repeated_words(dict(texts), 12))


def test_tasks_and_shards_are_bounded(make, monkeypatch):
    seen, match = [], suffix_automata.match_shards

    def watched(reference, parts, copies, width):
        sent = {}
        for r in parts.collect():
            sent[r.shard] = sent.get(r.shard, 0) + len(r.words.split())
        held = {}
        for r in reference.collect():
            held[r.shard] = held.get(r.shard, 0) + len(r.words.split())
        seen.append((sent, held, {r.shard: r.n for r in copies.collect()}))
        return match(reference, parts, copies, width)

    monkeypatch.setattr(suffix_automata, "match_shards", watched)
    monkeypatch.setattr(suffix_automata, "TASK_WORDS", 500)
    # a passage of one window in different surroundings: all its coarse unions occur once
    line = " ".join(f"licence{k}" for k in range(35))
    texts = [(i, " ".join([*(f"a{i}x{k}" for k in range(40)), line, *(f"b{i}x{k}" for k in range(40))])) for i in range(60)]
    same(suffix_automata.remove_passages(make(texts)).collect(), brute.repeated_words(dict(texts)))
    (sent, _, copies), *_ = seen
    assert sum(sent.values()) >= 60 * 35 and all(copies.get(s, 1) >= w / 500 for s, w in sent.items())
    # one long owner
    monkeypatch.setattr(suffix_automata, "SHARD_WORDS", 200)
    texts = [(i, " ".join(f"w{k}" for k in range(3000))) for i in range(2)]
    same(suffix_automata.remove_passages(make(texts)).collect(), brute.repeated_words(dict(texts)))
    assert len(seen[-1][1]) > 3 and max(seen[-1][1].values()) < 1500


def test_table(spark, folder):
    docs = table(spark, folder, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    same(suffix_automata.remove_passages(docs).collect(), brute.repeated_words(texts))


def test_repeated_rows_and_null_ids(make):
    text = " ".join(f"w{i}" for i in range(40))
    rows = suffix_automata.remove_passages(make([(1, text), (1, text), (None, text), (None, None), (2, "short text")])).collect()
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(0, 0), (2, 0), (40, 40), (40, 40), (40, 40)]
    assert suffix_automata.remove_passages(make([])).count() == 0


def test_automaton():
    a = suffix_automata.SuffixAutomaton()
    a.add([1, 2, 3, 4, 5])
    a.add([3, 4, 6])
    assert a.spans([9, 2, 3, 4, 6, 3, 9, 3, 4, 6], 3) == [(1, 5), (7, 10)]
    assert a.spans([5, 3], 2) == [] and a.spans([1, 2, 3, 4, 5, 3, 4], 5) == [(0, 5)]


def test_each_part_meets_one_shard_however_many_there_are(make, monkeypatch):
    sent, match = [], suffix_automata.match_shards

    def watched(reference, parts, copies, width):
        sent.append(parts.count())
        return match(reference, parts, copies, width)

    monkeypatch.setattr(suffix_automata, "match_shards", watched)
    # one gram that all texts hold, in repeats that few share: its owners lie in many shards
    line = " ".join(f"licence{k}" for k in range(12))
    rows = [(i, " ".join([*(f"a{i // 3}x{k}" for k in range(30)), line, *(f"b{i // 3}x{k}" for k in range(30))])) for i in range(60)]
    wanted = brute.repeated_words(dict(rows))
    for limit in (1_000_000, 20):
        monkeypatch.setattr(suffix_automata, "SHARD_WORDS", limit)
        same(suffix_automata.remove_passages(make(rows)).collect(), wanted)
    assert sent[1] <= 4 * sent[0], sent
