"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree are the ranks of its adjacent pairs, so the root is the lowest rank and the way
down that prefers left children leads to the leftmost pair with it. A merge changes three leaves, each a
logarithmic update. The trees of many words lie in one array and advance together.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

NONE = np.int32(1 << 30)
#: Distinct words whose ids a worker remembers, and words whose trees are built together.
CACHE, TOGETHER = 350_000, 1 << 15
#: Texts of more characters are cut into words step by step.
LONG = 1 << 22


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file of the tokenizers library (byte-level BPE, no normaliser), read once a process."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.pieces: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: int(t["id"]) for t in spec.get("added_tokens", ())}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(pattern)
        self.first = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        _, at = np.unique(keys, return_index=True)
        self.keys, self.ranks = keys[at], at.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.cache: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def trees(self, words: list[bytes], n: int) -> list[bytes]:
        """Ids (little-endian uint32) of words of 2 to ``n`` bytes, ``n`` a power of two."""
        lens = np.array([len(w) for w in words])
        inside = np.arange(n) < lens[:, None]
        sym = np.full((len(words), n), -1, np.int32)
        sym[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.tile(np.arange(1, n + 1), (len(words), 1))
        prv = nxt - 2
        tree = np.full((len(words), 2 * n), NONE, np.int32)
        pair = inside[:, 1:]
        tree[:, n : 2 * n - 1][pair] = self.rank(sym[:, :-1][pair], sym[:, 1:][pair])
        for at in range(n // 2, 0, -1) if n <= 2 else ():
            tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])
        width = n
        while n > 2 and width > 1:
            level = tree[:, width : 2 * width]
            width //= 2
            tree[:, width : 2 * width] = np.minimum(level[:, 0::2], level[:, 1::2])
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best, at = tree[row, 1], np.ones(len(row), np.int64)
            while at[0] < n:
                at = 2 * at + (tree[row, 2 * at] != best)
            i = at - n
            j = nxt[row, i]
            k = nxt[row, j]
            sym[row, i], sym[row, j] = self.made[best], -1
            nxt[row, i] = k
            inner, some = k < lens[row], prv[row, i] >= 0
            prv[row[inner], k[inner]] = i[inner]
            leaf = np.full(len(row), NONE, np.int32)
            leaf[inner] = self.rank(sym[row[inner], i[inner]], sym[row[inner], k[inner]])
            self._put(tree, row, at, leaf)
            self._put(tree, row, j + n, np.full(len(row), NONE, np.int32))
            p, r = prv[row, i][some], row[some]
            self._put(tree, r, p + n, self.rank(sym[r, p], sym[r, i[some]]))
            row = row[tree[row, 1] < NONE]
        alive = sym >= 0
        ids, ends = sym[alive].astype("<u4").tobytes(), 4 * np.cumsum(alive.sum(1))
        return [ids[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]

    @staticmethod
    def _put(tree: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        if not len(row):
            return
        tree[row, at] = value
        while at[0] > 1:
            at = at >> 1
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not remembered yet."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        by_size: dict[int, list[str]] = {}
        for w in set(words).difference(self.cache):
            by_size.setdefault(1 << max(1, (len(w.encode()) - 1).bit_length()), []).append(w)
        for n, group in by_size.items():
            step = max(1, TOGETHER * 8 // n)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                raw = [w.encode() for w in part]
                if n == 2:
                    for w, b in zip(part, raw):
                        if len(b) == 1:
                            self.cache[w] = self.first[b[0]].astype("<u4").tobytes()
                    part, raw = [w for w, b in zip(part, raw) if len(b) > 1], [b for b in raw if len(b) > 1]
                self.cache.update(zip(part, self.trees(raw, n)))

    def _chunks(self, text: str) -> Iterator[list[str] | int]:
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                yield self.special[part]
            elif len(part) <= LONG:
                yield self.words.findall(part)
            else:
                found = (m[0] for m in self.words.finditer(part))
                while step := list(itertools.islice(found, 1 << 16)):
                    yield step

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        out, held, size = [], [], 0

        def flush() -> None:
            nonlocal size
            self.learn(itertools.chain.from_iterable(c for chunks in held for c in chunks if not isinstance(c, (int, bytes))))
            get = self.cache.__getitem__
            out.extend(b"".join(c if isinstance(c, bytes) else c.to_bytes(4, "little") if isinstance(c, int) else b"".join(map(get, c)) for c in chunks) for chunks in held)
            held.clear()
            size = 0

        for text in texts:
            if len(text) > LONG:
                flush()
                parts = []
                for c in self._chunks(text):
                    if isinstance(c, list):
                        self.learn(c)
                        c = b"".join(map(self.cache.__getitem__, c))
                    parts.append(c)
                held.append(parts)
                continue
            held.append(list(self._chunks(text)))
            size += len(text)
            if size > LONG:
                flush()
        flush()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        get = self.pieces.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def model(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    """Path and word pattern of the public byte-level vocabulary that the machine offers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, decoded`` for every row, without a shuffle. A null text counts as empty.

    Special tokens in a text are ids of their own, as the tokenizers library does by default. Repeated rows are encoded as rows, an empty
    table gives none, and a very long text is one row's work, word by word.
    """
    own = default_vocabulary()
    where = path or own[0], pattern or own[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(*where)
        for b in batches:
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])
            del ids
            give_back()

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of its encoding and of what that decodes to."""
    own = default_vocabulary()
    where = path or own[0], pattern or own[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(*where)
        for b in batches:
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(bpe.decode(x).encode()) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
