import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer, decoders

from twinfold.llm import bpe
from twinfold.llm.common import table

LIBRARY = Tokenizer.from_file(bpe.default_path())
VOCABULARY = bpe.Vocabulary(bpe.default_path())


def ids_of(text, encoder=None):
    return np.frombuffer(b"".join((encoder or bpe.Encoder(VOCABULARY)).encode(text)), "<u4").tolist()


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def digests(ids):
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


TEXTS = [
    None,
    "",
    " \t\r\n　",
    "it's WE'LL 'S ''re x'd 12½ ² Ⅷ",
    "x<|endoftext|>y <|startoftext|><|endoftext|> <|endoftext|",
    "é 각 ̀ Σς ΣΑΣ İI ǅ ﬁ Ᲊ ՘ \U0001f600‍\U0001f680 \x00\x1c\x85",
    "A" * 70_000 + "!" * 3000,
    "漢字かな" * 5000,
    "aaaa bbbb " * 20_000,
]


def test_round_trips_equal_the_library(spark, make, folder):
    rows = bpe.round_trips(make(list(enumerate(TEXTS)) + [(1, "twice"), (1, "twice"), (None, "no id")])).collect()
    wanted = [(i, *digests(expected(t))) for i, t in enumerate(TEXTS)] + [(1, *digests(expected("twice")))] * 2 + [(None, *digests(expected("no id")))]
    assert sorted(map(tuple, rows), key=str) == sorted(wanted, key=str)
    docs = table(spark, folder, "documents")
    wanted = [(r.doc_id, *digests(expected(r.text))) for r in docs.collect()]
    assert sorted(map(tuple, bpe.round_trips(docs).collect()), key=str) == sorted(wanted, key=str)
    assert bpe.round_trips(make([])).count() == 0


def test_encode_and_decode_tables(make):
    coded = bpe.encode_documents(make(list(enumerate(TEXTS[:6]))))
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: expected(t) for i, t in enumerate(TEXTS[:6])}
    texts = {r.doc_id: r.text for r in bpe.decode_documents(coded).collect()}
    assert texts == {i: LIBRARY.decode(expected(t), skip_special_tokens=False) for i, t in enumerate(TEXTS[:6])}


@pytest.mark.parametrize("alphabet", ["ab", "thein", "aab", "lol!", "абв", "한국어", "aeinrst'"])
def test_streaming_equals_the_whole(monkeypatch, alphabet):
    monkeypatch.setattr(bpe, "BLOCK", 64)
    rng = random.Random(alphabet)
    for size in (1, 2, 50, 3000, 6000):
        text = "".join(rng.choices(alphabet, k=size))
        assert ids_of(text) == expected(text)


def test_prefix_tokens_beyond_the_lookahead_are_final():
    rng = random.Random(6)
    names = [w.removesuffix("</w>") for w in LIBRARY.get_vocab() if w.removesuffix("</w>").isascii() and w.removesuffix("</w>").isalpha()]
    for _ in range(20):
        word = "".join(rng.choices(names, k=400)).encode()[:1500]
        whole = VOCABULARY.merged([VOCABULARY.inner[b] for b in word])
        ends = np.cumsum([VOCABULARY.sizes[t] for t in whole])
        cut = rng.randrange(VOCABULARY.lookahead, len(word))
        part = VOCABULARY.merged([VOCABULARY.inner[b] for b in word[:cut]])
        final = int((ends <= cut - VOCABULARY.lookahead).sum())
        assert part[:final] == whole[:final]


def test_lookahead_of_small_merge_lists():
    # symbols 0 1 2; 0+1 -> 3, then 0+3 -> 4: a last 1 reaches back over two 0s
    assert bpe.sufficient_lookahead([(0, 1, 3), (0, 3, 4)], {0: 1, 1: 1, 2: 1, 3: 2}) == 2
    assert bpe.sufficient_lookahead([(0, 1, 3), (2, 1, 4)], {0: 1, 1: 1, 2: 1, 3: 2}) == 1


def test_memory_of_a_long_word_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 256)
    machine, out = bpe.Transducer(VOCABULARY), []
    for _ in range(200):
        out += [x for part in machine.feed(b"therein" * 20) for x in part]
        assert len(machine.waiting) <= VOCABULARY.lookahead + 3 * 256
    assert out + machine.finish() == expected("therein" * 4000)


def test_byte_level_decoder_and_malformed_bytes(tmp_path):
    with open(bpe.default_path(), encoding="utf-8") as lines:
        data = json.load(lines)
    data["decoder"] = json.loads(Tokenizer.from_file(bpe.default_path()).to_str())["decoder"] or {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    path = tmp_path / "bytes.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    other, vocabulary, rng = Tokenizer.from_file(str(path)), bpe.Vocabulary(str(path)), random.Random(7)
    assert isinstance(other.decoder, decoders.ByteLevel)
    for _ in range(300):
        ids = rng.choices(range(256), k=rng.randrange(9)) + rng.choices([49406, 500, 320, 60_000], k=2)
        machine = bpe.Decoder(vocabulary)
        text = "".join(machine.feed([x]) for x in ids) + machine.finish()
        assert text == other.decode(ids, skip_special_tokens=False)


def test_every_known_character_is_classed_as_in_the_library():
    encoder = bpe.Encoder(VOCABULARY)
    rng = random.Random(8)
    points = [*range(0x2000), *rng.sample([p for p in range(0x2000, 0x110000) if not 0xD800 <= p <= 0xDFFF], 15_000)]
    for p in points:
        text = f"a{chr(p)}1{chr(p)}!{chr(p)} b"
        got = LIBRARY.normalizer.normalize_str(text)
        assert encoder.words(text) == [got[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(got)], hex(p)
