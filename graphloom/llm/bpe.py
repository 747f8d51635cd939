"""Byte-level BPE encoding over a trie of distinct words, and decoding.

The greedy merge order makes every prefix of a word end in one definite token.
The last token of a prefix is the one suffix token t such that t may follow the
last token of the prefix before it, where "may follow" means that BPE, run on the
bytes of both, gives just these two.  The distinct words of a batch are put
into a trie and walked depth first, in preorder, which for bytes is sorted order;
the states on the path from the root are kept on a stack, so a prefix that many
words share is encoded once.  A word's tokens are read backwards from its end.

Defined cases: null text counts as empty and gives no tokens; strings of special
tokens in a text become their ids, as the tokenizers library does; rows with a
null doc_id keep it; repeated rows are encoded alike; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import bounded_batches

#: How the vocabulary's file splits text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: Words, and pairs of tokens, that a task keeps at once.
KEPT_WORDS, KEPT_PAIRS = 150_000, 500_000
#: Vocabularies that a worker keeps between tasks.
KEPT_ENCODERS = 2


def _printed_bytes() -> dict[str, int]:
    """The vocabulary file's character for each byte: printable Latin-1 stands for itself, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairEncoder:
    """Encodes words by the states of their prefixes."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        printed = _printed_bytes()
        raw = lambda s: bytes(printed[c] for c in s)
        vocabulary = {raw(s): i for s, i in data["model"]["vocab"].items() if all(c in printed for c in s)}
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in vocabulary.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank, self.parts = {}, {}
        for n, merge in enumerate(data["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            left, right = raw(left), raw(right)
            pair = (vocabulary[left], vocabulary[right])
            whole = vocabulary[left + right]
            self.rank.setdefault(pair, n)
            self.parts.setdefault(whole, (*pair, n))
        self.longest = max(map(len, vocabulary))
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.usable = {b: i for b, i in vocabulary.items() if self.stands(i)}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.cache: dict[str, bytes] = {}

    def stands(self, token: int) -> bool:
        """Whether BPE on a token's own bytes gives this token."""
        known = self.whole.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = self.whole[token] = parts is None or (self.stands(parts[0]) and self.stands(parts[1]) and self._apart(parts[0], parts[1], parts[2]))
        return known

    def _apart(self, left: int, right: int, until: float) -> bool:
        """Whether no merge of rank below ``until`` crosses the border of two tokens.

        Both are taken apart, the later merge first; at each moment the pieces at the border
        must not merge before one of them is merged further.
        """
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < until:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # of equal ranks the left one's merge comes first, so the right piece is younger
            if b is None or (a is not None and a[2] > b[2]):
                # the border pair stands before left's merge: pairs of an equal rank to the left go first
                until, left = a[2], a[1]
            else:
                # pairs of right's own rank at the border are further left, so they'd go first
                until, right = b[2] + 1, b[0]

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.follows.get(key)
        if known is None:
            known = self.follows[key] = self._apart(left, right, float("inf"))
        return known

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Encodings (unsigned 32-bit, little-endian) of distinct words given in sorted order."""
        usable, follows, may_follow, longest = self.usable, self.follows, self.may_follow, self.longest
        out, lasts, starts, before = [], [], [], b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del lasts[shared:], starts[shared:]
            for end in range(shared + 1, len(word) + 1):
                # only one start can be right: the last token grown by a byte, then a byte alone, are the likeliest
                start = starts[-1] if starts else 0
                token = usable.get(word[start:end])
                if token is None or start and not (follows.get(lasts[start - 1] << 32 | token) or may_follow(lasts[start - 1], token)):
                    start = end - 1
                    token = usable[word[start:end]]
                    if not (follows.get(lasts[start - 1] << 32 | token) or may_follow(lasts[start - 1], token)):
                        for start in range(max(0, end - longest), end - 1):
                            token = usable.get(word[start:end])
                            if token is not None and (not start or follows.get(lasts[start - 1] << 32 | token) or may_follow(lasts[start - 1], token)):
                                break
                lasts.append(token)
                starts.append(start)
            end, tokens = len(word), []
            while end:
                tokens.append(lasts[end - 1])
                end = starts[end - 1]
            tokens.reverse()
            out.append(pack(f"<{len(tokens)}I", *tokens))
            before = word
        return out

    def split(self, text: str) -> list[str]:
        return (ASCII_WORDS if text.isascii() else self.words).findall(text)

    def forget(self) -> None:
        """Drop what is kept between batches."""
        self.cache, self.follows = {}, {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            pieces = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
            split.append(self.split(text) if len(pieces) == 1 else [w for p in pieces for w in ([p] if p in self.special else self.split(p))])
        if len(self.cache) > KEPT_WORDS:
            self.cache = {}
        if len(self.follows) > KEPT_PAIRS:
            self.follows = {}
        cache = self.cache
        cache.update((s, np.array([i], dtype="<u4").tobytes()) for s, i in self.special.items())
        fresh = {w for words in split for w in words}.difference(cache)
        by_bytes = sorted((w.encode("utf-8", "surrogatepass"), w) for w in fresh)
        cache.update(zip((w for _, w in by_bytes), self.encode_words([b for b, _ in by_bytes]), strict=True))
        return [b"".join(map(cache.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[bytes, BytePairEncoder] = {}


def encoder(content: bytes) -> BytePairEncoder:
    """The encoder of a vocabulary file's content; a worker keeps it between tasks."""
    key = hashlib.blake2b(content).digest()
    if key not in _encoders:
        if len(_encoders) >= KEPT_ENCODERS:
            _encoders.clear()
        _encoders[key] = BytePairEncoder(content)
        gc.freeze()
    return _encoders[key]


def vocabulary_of(df: DataFrame, path: str):
    """The vocabulary file, which the driver reads, as a broadcast: executors needn't have it."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


#: Characters of text that a task encodes at once, if one text isn't longer.
BATCH_CHARS = 4_000_000


def _batches(column: pa.Array) -> Iterator[list[str]]:
    batch, size = [], 0
    for text in column:
        text = text.as_py() or ""
        if batch and size + len(text) > BATCH_CHARS:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of whole texts."""
    bounded_batches(docs)
    given = vocabulary_of(docs, path)

    def run(batches):
        coder = encoder(given.value)
        for batch in batches:
            blobs = [ids for texts in _batches(batch.column(1)) for ids in coder.encode_batch(texts)]
            flat = np.frombuffer(b"".join(blobs), dtype="<u4").astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n_tokens", "ids"])
        coder.forget()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of doc_id, ids."""
    bounded_batches(encoded)
    given = vocabulary_of(encoded, path)

    def run(batches):
        coder = encoder(given.value)
        for batch in batches:
            texts = [None if ids is None else coder.decode(np.array(ids, dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: whole texts encoded, and decoded from the ids, in one pass."""
    bounded_batches(docs)
    given = vocabulary_of(docs, path)

    def run(batches):
        coder = encoder(given.value)
        for batch in batches:
            blobs = [ids for texts in _batches(batch.column(1)) for ids in coder.encode_batch(texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(b) // 4 for b in blobs], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in blobs], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(b).encode()).hexdigest() for b in blobs], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        coder.forget()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
