"""Removal of repeated word passages by suffix trees over groups of suffixes with a common prefix.

A part's suffixes are split by their first word, groups that are too large by the next one, and so on, so that
prefixes of different lengths give groups that fit in memory. Each group's suffix tree is built from its
sorted leaves; the tree's internal nodes at depth ``GRAM`` and beyond are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import WINDOW, Repeats, covered_windows, shared_prefix
from .runs import RUN_BYTES, pack_ints, split_blobs, join_blobs, unpack_ints

GRAM = 8
#: Suffixes whose tree is built at once; larger groups are split by one more word.
GROUP = 20_000
#: Bytes of a word's number in a part.
UNIT = 4


def groups(keys: list[bytes], members: list[int], depth: int = 1) -> Iterator[list[int]]:
    """Members by prefixes as long as they have to be for ``GROUP`` members, of ``GRAM`` words at most."""
    by: dict[bytes, list[int]] = {}
    for m in members:
        by.setdefault(keys[m][(depth - 1) * UNIT : depth * UNIT], []).append(m)
    for own in by.values():
        if len(own) > GROUP and depth < GRAM:
            yield from groups(keys, own, depth + 1)
        elif len(own) > 1:
            yield own


class WordRepeats(Repeats):
    gram = GRAM

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        words = [t.split() for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)
        seen: dict[bytes, int] = {}
        put, hashed = seen.setdefault, xxhash.xxh64_intdigest
        flat = np.fromiter((put(w, len(seen)) for own in words for w in own), np.int64, int(starts[-1]))
        table = np.fromiter(map(hashed, seen), np.uint64, len(seen))
        return table[flat] if len(seen) else np.zeros(0, np.uint64), starts, words

    def contexts(self, aux: list[list[bytes]], at: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, list[tuple[int, bytes]], int]:
        starts = np.concatenate([[0], np.cumsum([len(w) for w in aux], dtype=np.int64)])
        doc = np.searchsorted(starts, at, "right") - 1
        local = at - starts[doc]
        seen: dict[tuple[int, bytes], int] = {}
        which = np.zeros(len(at), np.int64)
        for i, (d, a, left, right) in enumerate(zip(doc.tolist(), local.tolist(), before.tolist(), after.tolist())):
            which[i] = seen.setdefault((left, b" ".join(aux[d][a - left : a + right])), len(seen))
        return which, list(seen), len(seen)

    def encode(self, store: list[tuple[int, bytes]], chosen: np.ndarray) -> bytes:
        own = [store[i] for i in chosen.tolist()]
        return join_blobs(pack_ints(np.array([left for left, _ in own], np.uint64)), b"\n".join(text for _, text in own))

    def resolve(self, payloads: list[bytes], docs: list[np.ndarray]) -> list[np.ndarray]:
        numbers: dict[bytes, int] = {}
        after, before = [], []
        for p in payloads:
            lefts, texts = split_blobs(p)
            for left, text in zip(unpack_ints(lefts).tolist(), texts.split(b"\n")):
                words = np.array([numbers.setdefault(w, len(numbers)) for w in text.split(b" ")], ">u4")
                after.append(words[left:].tobytes())
                before.append(words[:left][::-1].tobytes())
        of = np.concatenate(docs).tolist() if docs else []
        masks = np.zeros(len(of), np.uint64)
        for own in groups(after, list(range(len(of)))):
            own.sort(key=after.__getitem__)
            lcp = [0] + [shared_prefix(after[a], after[b], UNIT) for a, b in zip(own, own[1:])]
            masks[own] = covered_windows(lcp, [of[i] for i in own], [before[i] for i in own], GRAM, UNIT)
        return np.split(masks, np.cumsum([len(d) for d in docs])[:-1]) if docs else []

    def kept(self, aux: list[list[bytes]], starts: np.ndarray, covered: np.ndarray) -> list[bytes]:
        out = []
        for words, a, b in zip(aux, starts[:-1], starts[1:]):
            gone = covered[a:b]
            out.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words))
        return out


def remove_repeats(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``doc_id, n_symbols, kept, starts, ends`` over the words of ``docs(doc_id, text)``; see ``Repeats.remove``."""
    return WordRepeats().remove(docs, run_bytes)


def summary(found: DataFrame) -> DataFrame:
    """The contract's columns: ``doc_id, n_words, n_removed, kept_sha256``."""
    gone = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    return found.select("doc_id", F.col("n_symbols").alias("n_words"), gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
