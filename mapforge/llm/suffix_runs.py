"""Removal of repeated byte passages by a distributed merge sort of suffixes that knows common prefixes.

Each run sorts its suffixes and sends them front-coded: how many bytes a suffix shares with the one before, and
the rest. A part combines all runs' sequences with a loser tree in which every contestant carries what it
shares with the last winner. Contestants that share different amounts are decided without looking at a byte, and
those that share the same are compared behind it; what the winners share falls out of the merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import WINDOW, Repeats, covered_windows, mix, shared_prefix

GRAM = 16
LEFT = WINDOW - GRAM
#: Bytes from the anchor on, bytes before it (nearest first), and how many there are of both.
WIDTH = WINDOW + LEFT + 2
#: Bytes have several suffixes where words have one, so runs are smaller.
RUN_BYTES = 2 << 20
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted distinct rows of bytes: what each shares with the row before, and the rest of each."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        shared[1:] = (rows[1:] != rows[:-1]).argmax(1)
    return shared, rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes()


def front_decode(shared: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, last, at = [], b"", 0
    for h in shared.tolist():
        n = width - h
        last = last[:h] + rest[at : at + n]
        at += n
        out.append(last)
    return out


def merge(sequences: list[list[bytes]], shared: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """Sorted sequences of strings in one order: sequence, place in it, and what it shares with the one before.

    ``shared`` has the front codes. Strings are of equal length.
    """
    n = len(sequences)
    size = 1 << max(0, n - 1).bit_length()
    place = [0] * size
    now = [s[0] if s else b"" for s in sequences] + [b""] * (size - n)
    #: What a contestant shares with the last winner that it met; -1: its sequence has ended.
    known = [0 if s else -1 for s in sequences] + [-1] * (size - n)
    loser = [0] * size

    def meet(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's ``known`` is then what it shares with the winner."""
        ha, hb = known[a], known[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha < 0:
            return a, b
        x, y = now[a][ha:], now[b][ha:]
        if y < x:
            a, b = b, a
        known[b] = ha + shared_prefix(x, y)
        return a, b

    winner = list(range(size))
    level = size
    while level > 1:
        level //= 2
        ahead = []
        for i in range(level):
            won, lost = meet(winner[2 * i], winner[2 * i + 1])
            loser[level + i] = lost
            ahead.append(won)
        winner = ahead
    top = winner[0]
    while known[top] >= 0:
        yield top, place[top], known[top]
        place[top] = at = place[top] + 1
        if at < len(sequences[top]):
            now[top], known[top] = sequences[top][at], shared[top][at]
        else:
            known[top] = -1
        node = (size + top) >> 1
        while node:
            other = loser[node]
            ha, hb = known[top], known[other]
            if ha < hb:
                loser[node], top = top, other
            elif ha == hb and ha >= 0:
                won, lost = meet(top, other)
                loser[node], top = lost, won
            node >>= 1


class ByteRepeats(Repeats):
    gram = GRAM
    spread = 4

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        return _Lazy(data), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64), data

    def contexts(self, aux: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        rows = np.zeros((len(at), WIDTH), np.uint8)
        for j in range(WINDOW):
            on = after > j
            rows[on, j] = aux[at[on] + j]
        for j in range(LEFT):
            on = before > j
            rows[on, WINDOW + j] = aux[at[on] - 1 - j]
        rows[:, -2], rows[:, -1] = after, before + 1
        distinct, which = np.unique(rows.view(f"S{WIDTH}").reshape(-1), return_inverse=True)
        return which, np.frombuffer(distinct.tobytes(), np.uint8).reshape(-1, WIDTH), len(distinct)

    def encode(self, store: np.ndarray, chosen: np.ndarray) -> bytes:
        shared, rest = front_code(store[chosen])
        return len(shared).to_bytes(8, "little") + shared.tobytes() + rest

    def resolve(self, payloads: list[bytes], docs: list[np.ndarray]) -> list[np.ndarray]:
        sequences, shared = [], []
        for p in payloads:
            n = int.from_bytes(p[:8], "little")
            codes = np.frombuffer(p, np.uint8, n, 8)
            sequences.append(front_decode(codes, p[8 + n :], WIDTH))
            shared.append(codes.tolist())
        of = [d.tolist() for d in docs]
        masks = [np.zeros(len(d), np.uint64) for d in docs]
        group: list[tuple[int, int]] = []
        lcp: list[int] = []

        def close() -> None:
            if len(group) > 1:
                texts = [sequences[s][i] for s, i in group]
                before = [t[WINDOW : WINDOW + t[-1] - 1] for t in texts]
                found = covered_windows(lcp, [of[s][i] for s, i in group], before, GRAM)
                for (s, i), m in zip(group, found):
                    masks[s][i] = m
            group.clear()
            lcp.clear()

        room = 0
        for s, i, h in merge(sequences, shared):
            length = sequences[s][i][-2]
            h = min(h, room, length)
            if h < GRAM:
                close()
                h = 0
            group.append((s, i))
            lcp.append(h)
            room = length
        close()
        return masks

    def kept(self, aux: np.ndarray, starts: np.ndarray, covered: np.ndarray) -> list[bytes]:
        left = aux[~covered].tobytes()
        ends = np.concatenate([[0], np.cumsum(~covered, dtype=np.int32)])[starts]
        return [left[a:b] for a, b in zip(ends[:-1], ends[1:])]


class _Lazy:
    """Bytes whose symbols' hashes are looked up by slice."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data

    def __getitem__(self, at: slice) -> np.ndarray:
        return _BYTES[self.data[at]]


def remove_repeats(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``doc_id, n_symbols, kept, starts, ends`` over the UTF-8 bytes of ``docs(doc_id, text)``; see ``Repeats.remove``."""
    return ByteRepeats().remove(docs, run_bytes)


def summary(found: DataFrame) -> DataFrame:
    """The contract's columns: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return found.select(
        "doc_id",
        F.col("n_symbols").alias("n_bytes"),
        (F.col("n_symbols") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
