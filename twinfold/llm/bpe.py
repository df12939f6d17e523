"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

**Lookahead.** Merges run by falling priority. Take a word and a prefix of it. Their tokens agree up to the prefix's end
before any merge; a merge (u, v) moves that place left only when u ends there and v begins there in one of the two, and
then by the length of u. For a later merge (u', v') to move it again, v' must begin with that very u: u lies on the chain
of left parts that v' was made from. So the place moves at most by the heaviest chain of merges of rising rank, each
linked to the next in this way, where a merge weighs the length of its u. ``sufficient_lookahead`` finds it from the merge
list in one pass. Tokens that end so many symbols before the last symbol read are final, whatever follows, and the rest
can be encoded without them. This needs every merge to come after those that make its parts, which is checked.

**Encoding.** Text is cut at blanks and added tokens, normalised (NFC, lower case), split into words
and fed to the transducer in blocks. It holds the lookahead and one block, however long the word is. Stretches and words
seen before come from two tables of at most ``CACHE`` short entries. Texts of over ``CHUNK`` characters are taken piece by
piece. Characters that this Python's Unicode version does not know are left to the tokenizer's own normaliser
and splitter, since versions class them differently.

**Decoding.** Ids come in blocks and become bytes, and a UTF-8 state machine turns bytes into text, holding back at most an
unfinished character. Malformed bytes become U+FFFD. The file says whether tokens are joined by blanks (no decoder) or
spell bytes (byte-level decoder). Ids that the vocabulary does not hold are skipped.

Rows: null text counts as empty and has no tokens; ids, null or repeated, are carried along; every row gives one row. An
empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns cannot clash. Texts are in
memory one at a time, besides their Arrow batch.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinfold.llm.common import clean_text, held

CHUNK = 1_000_000
CACHE = 300_000
BLOCK = 4096
CACHED_LENGTH = 64
# The word pattern of the tokenizer file, applied to normalised text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = regex.compile(r"\s+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], sizes: dict[int, int]) -> int:
    """Symbols after which what lies before is final; ``merges`` are (left, right, made) by falling priority."""
    left = {made: u for u, _, made in merges}
    weight: dict[int, int] = {}
    most = 0
    for u, v, _ in merges:
        before, part = 0, v
        while part is not None:
            before = max(before, weight.get(part, 0))
            part = left.get(part)
        here = sizes[u] + before
        weight[u] = max(weight.get(u, 0), here)
        most = max(most, here)
    return most


class Vocabulary:
    """Merges, symbols and decoder of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as lines:
            data = json.load(lines)
        model = data["model"]
        self.path = path
        ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [ids[x] for x in letters]
        self.final = [ids[x + self.suffix] for x in letters]
        self.sizes = dict.fromkeys([*self.inner, *self.final], 1)
        self.rank: dict[tuple[int, int], int] = {}
        merges = []
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            u, v, made = ids[a], ids[b], ids[a + b]
            if u not in self.sizes or v not in self.sizes or made in self.sizes:
                raise ValueError(f"merge {n} does not follow the merges of its parts, or repeats one")
            self.sizes[made] = self.sizes[u] + self.sizes[v]
            self.rank[u, v] = n
            merges.append((u, v, made))
        self.made = [made for *_, made in merges]
        self.lookahead = sufficient_lookahead(merges, self.sizes)
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        for x in data["added_tokens"]:
            if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or SPACES.search(x["content"]):
                raise ValueError("added tokens are taken as they stand only, and hold no white space")
        names = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        kind = (data["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {kind}")
        self.separator = b" " if kind is None else b""
        byte_of = {x: b for b, x in enumerate(letters)}
        self.spelling: dict[int, bytes] = {}
        for text, n in [*ids.items(), *self.added.items()]:
            known = kind is not None and all(x in byte_of for x in text)
            self.spelling[n] = bytes(byte_of[x] for x in text) if known else text.encode()

    def merged(self, symbols: list[int]) -> list[int]:
        """Tokens of a run of symbols, all merges applied."""
        return self._merged_short(symbols) if len(symbols) < 48 else self._merged_long(symbols)

    def _merged_short(self, out: list[int]) -> list[int]:
        rank, made = self.rank, self.made
        none = len(made)
        ranks = [rank.get(pair, none) for pair in zip(out, out[1:])]
        while ranks and (n := min(ranks)) < none:
            i = ranks.index(n)
            token = out[i] = made[n]
            del out[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((out[i - 1], token), none)
            if i < len(ranks):
                ranks[i] = rank.get((token, out[i + 1]), none)
        return out

    def _merged_long(self, token: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        rank, made = self.rank, self.made
        after = list(range(1, len(token))) + [-1]
        before = list(range(-1, len(token) - 1))
        heap = [(n, i) for i, pair in enumerate(zip(token, token[1:])) if (n := rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            n, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j < 0 or rank.get((token[i], token[j])) != n:
                continue  # one of the two has been merged since
            token[i], token[j] = made[n], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (found := rank.get((token[a], token[b]))) is not None:
                    heapq.heappush(heap, (found, a))
        return [x for x in token if x >= 0]

    def word(self, data: bytes) -> list[int]:
        """Tokens of a whole word."""
        symbols = [self.inner[b] for b in data]
        symbols[-1:] = [self.final[b] for b in data[-1:]]
        return self.merged(symbols)


class Transducer:
    """Encodes one word that comes in blocks of bytes; holds the lookahead and one block."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.waiting = bytearray()

    def feed(self, data: bytes) -> Iterator[list[int]]:
        """Tokens that have become final."""
        for at in range(0, len(data), BLOCK):
            self.waiting += data[at : at + BLOCK]
            stable = len(self.waiting) - 1 - self.vocabulary.lookahead
            if stable >= BLOCK:
                yield self._drain(stable)

    def _drain(self, stable: int) -> list[int]:
        inner, sizes = self.vocabulary.inner, self.vocabulary.sizes
        out, end = [], 0
        for token in self.vocabulary.merged([inner[b] for b in self.waiting[:-1]]):  # the last may end the word
            if end + sizes[token] > stable:
                break
            end += sizes[token]
            out.append(token)
        del self.waiting[:end]
        return out

    def finish(self) -> list[int]:
        data = bytes(self.waiting)
        self.waiting.clear()
        return self.vocabulary.word(data)


class Encoder(dict):
    """Little-endian ids of stretches of text without blanks, by stretch; fills itself through the transducer."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.by_word: dict[str, bytes] = {}
        self.known: set[str] = set(map(chr, range(128)))
        self._library = None

    def __missing__(self, stretch: str) -> bytes:
        added = self.vocabulary.added
        if not any(x in stretch for x in added):
            return self._keep(self, stretch, b"".join(map(self.word, self.words(stretch))))
        parts = []
        for piece in self.vocabulary.added_pattern.split(stretch):
            parts += [np.array([added[piece]], "<u4").tobytes()] if piece in added else map(self.word, self.words(piece))
        return b"".join(parts)

    def word(self, word: str) -> bytes:
        packed = self.by_word.get(word)
        if packed is None:
            data = word.encode()
            if len(data) <= BLOCK:  # no block would become final before the end
                ids = self.vocabulary.word(data)
            else:
                machine = Transducer(self.vocabulary)
                ids = [x for part in machine.feed(data) for x in part] + machine.finish()
            packed = self._keep(self.by_word, word, struct.pack(f"<{len(ids)}I", *ids))
        return packed

    def _keep(self, store: dict[str, bytes], key: str, packed: bytes) -> bytes:
        if len(key) <= CACHED_LENGTH:
            if len(store) >= CACHE:
                store.clear()
            store[key] = packed
        return packed

    def _strange(self, text: str) -> bool:
        new = set(text) - self.known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return True
        self.known |= new
        return False

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without added tokens."""
        if text.isascii() or not self._strange(text):  # white space is in no word, so it stays as it is
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return [text] if text.isalpha() else WORDS.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.vocabulary.path)
        text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids, piece after piece of the text."""
        for piece in pieces_of(text):
            yield b"".join(map(self.__getitem__, piece.replace("\n", " ").split(" ")))


def pieces_of(text: str, limit: int = CHUNK) -> Iterator[str]:
    """The text cut before blanks, where no word, added token or composed character goes across."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Decoder:
    """Turns ids that come in blocks into text; holds at most an unfinished character."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.spelling, self.separator = vocabulary.spelling, vocabulary.separator
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        found = [x for x in map(self.spelling.get, ids) if x is not None]
        if not found:
            return ""
        data = self.separator.join(found)
        data, self.begun = (self.separator + data if self.begun else data), True
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def vocabulary_of(path: str) -> Vocabulary:
    return held(("vocabulary", path), lambda: Vocabulary(path))


def encoder_of(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(vocabulary_of(path)))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every text."""
    path = path or default_path()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            packed = [np.frombuffer(b"".join(encoder.encode(t)), "<u4").astype(np.int64) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, packed)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *packed])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids count as none."""
    path = path or default_path()
    schema = T.StructType([coded.schema["doc_id"], T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                machine = Decoder(vocabulary)
                texts.append(machine.feed(ids or ()) + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every text, encoded and decoded as a stream."""
    path = path or default_path()
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType(), False)]
        + [T.StructField(n, T.StringType(), False) for n in ("ids_sha256", "decoded_sha256")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column("text"):  # one text at a time, not a list of them all
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
                machine = Decoder(encoder.vocabulary)
                for packed in encoder.encode(text.as_py()):
                    ids.update(packed)
                    n += len(packed) // 4
                    back.update(machine.feed(np.frombuffer(packed, "<u4").tolist()).encode())
                back.update(machine.finish().encode())
                counts.append(n)
                coded.append(ids.hexdigest())
                decoded.append(back.hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(run, schema)
