"""Passages that begin in a document with a smaller id as well: what both repeat removers share.

A window is ``WINDOW`` consecutive symbols (bytes or words) of one document. In every window the smallest
hash among its grams of ``gram`` symbols marks an anchor, so equal windows have an anchor at equal places.
Suffixes are taken at anchors alone, about one in ``WINDOW - gram`` symbols over two, together with what stands
before them; two suffixes that share ``r`` symbols, and ``s`` symbols before them, share every window that
begins ``l`` symbols before the anchor for ``WINDOW - r <= l <= s``. A first exchange of hashes tells which
anchors' grams occur in two documents at all, and only those suffixes travel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runs as R

WINDOW = 50
#: Bits of a gram's hash that the first exchange compares; a chance agreement only sends a suffix in vain.
HASH_BITS = 40
#: Symbols whose hashes are computed at once.
STEP = 1 << 19
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams; ``gram`` is a power of two."""
    h, width, level = symbols, 1, 0
    while width < gram:
        h = h[:-width] * _MULTIPLIERS[level] + h[width:]
        width, level = 2 * width, level + 1
    return mix(h) | np.uint64(1)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        x, have = pick(x[:-have], x[have:]), 2 * have
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _anchors(symbols: np.ndarray, starts: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    span = WINDOW - gram + 1
    if len(symbols) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(symbols, gram)
    least = _sliding(h, span, np.minimum)
    for end in starts[1:-1]:  # windows that would cross into the next document
        least[max(0, end - WINDOW + 1) : end] = 0
    padded = np.zeros(len(least) + 2 * span - 2, np.uint64)
    padded[span - 1 : span - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, span, np.maximum) == h)
    return at, h[at]


def anchors(symbols: np.ndarray, starts: np.ndarray, gram: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of documents that begin at ``starts`` (the end is the last).

    Windows never cross documents. Long documents are cut into steps that overlap by what a window and its
    neighbours reach, so the temporary arrays stay small whatever the length.
    """
    out_at, out_h = [], []
    first, n = 0, len(starts) - 1
    while first < n:
        last = first + 1
        while last < n and starts[last + 1] - starts[first] <= step:
            last += 1
        lo, hi = int(starts[first]), int(starts[last])
        if hi - lo <= step or last > first + 1:
            at, h = _anchors(symbols[lo:hi], starts[first : last + 1] - lo, gram)
            out_at.append(at + lo)
            out_h.append(h)
        else:
            for a in range(lo, hi, step):
                b = min(hi, a + step + 2 * WINDOW)
                at, h = _anchors(symbols[max(lo, a - 2 * WINDOW) : b], np.array([0, b - max(lo, a - 2 * WINDOW)]), gram)
                at = at + max(lo, a - 2 * WINDOW)
                inside = (at >= a) & (at < min(hi, a + step))
                out_at.append(at[inside])
                out_h.append(h[inside])
        first = last
    if not out_at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_at), np.concatenate(out_h)


def internal_nodes(lcp: Sequence[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """The nodes of a suffix tree at depth ``least`` or more: first leaf, end of leaves, depth, parent's depth.

    ``lcp[i]`` is what sorted leaves ``i - 1`` and ``i`` share. Parents above ``least`` count as ``least - 1``.
    """
    stack: list[tuple[int, int]] = []
    n = len(lcp)
    for i in range(1, n + 1):
        h = lcp[i] if i < n else 0
        first = i - 1
        while stack and stack[-1][1] > h:
            first, depth = stack.pop()
            if depth >= least:
                yield first, i, depth, max(h, stack[-1][1] if stack else 0, least - 1)
        if h and (not stack or stack[-1][1] < h):
            stack.append((first, h))


def shared_prefix(a: bytes, b: bytes, unit: int = 1) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n // unit
    different = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return (n - (different.bit_length() + 7) // 8) // unit


def _longest_from_smaller(docs: list[int], before: list[bytes], unit: int) -> list[int]:
    """For each leaf, the most symbols before it that it shares with a leaf of a smaller document; -1: none is smaller.

    With leaves sorted by what stands before them, the nearest leaf of a smaller document on either side shares most.
    """
    n = len(docs)
    order = sorted(range(n), key=before.__getitem__)
    near = [0] + [shared_prefix(before[order[i - 1]], before[order[i]], unit) for i in range(1, n)]
    best = [-1] * n
    for step in (1, -1):
        stack: list[tuple[int, int]] = []
        for at in range(n) if step == 1 else range(n - 1, -1, -1):
            leaf = order[at]
            run = near[at] if step == 1 else near[at + 1] if at + 1 < n else 0
            while stack and stack[-1][0] >= docs[leaf]:
                run = min(run, stack.pop()[1])
            if stack:
                best[leaf] = max(best[leaf], run)
            stack.append((docs[leaf], run))
    return best


def covered_windows(lcp: Sequence[int], docs: list[int], before: list[bytes], gram: int, unit: int = 1) -> list[int]:
    """For sorted leaves, bit ``l`` tells that the window from ``l`` symbols before it is in a smaller document.

    ``before`` holds the symbols before a leaf, nearest first, ``unit`` bytes each.
    """
    masks = [0] * len(docs)
    for first, end, depth, above in internal_nodes(lcp, gram):
        low, high = WINDOW - min(depth, WINDOW), WINDOW - above - 1
        if end - first == 2:
            a, b = docs[first], docs[first + 1]
            if a == b:
                continue
            best = [-1, -1]
            best[b > a] = shared_prefix(before[first], before[first + 1], unit)
        else:
            best = _longest_from_smaller(docs[first:end], before[first:end], unit)
        for i, most in enumerate(best, first):
            most = min(most, high)
            if most >= low:
                masks[i] |= (1 << (most + 1)) - (1 << low)
    return masks


class Repeats:
    """Removal of repeated windows; ``gram`` and the methods that raise tell bytes from words."""

    gram: int
    spread = 2

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, object]:
        """Hashes of all symbols, where documents begin (and the end), and what ``contexts`` and ``kept`` need."""
        raise NotImplementedError

    def contexts(self, aux: object, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, object, int]:
        """Which distinct context each anchor has, and a store of the distinct ones in a fixed order, and their number."""
        raise NotImplementedError

    def encode(self, store: object, chosen: np.ndarray) -> bytes:
        raise NotImplementedError

    def resolve(self, payloads: list[bytes], docs: list[np.ndarray]) -> list[np.ndarray]:
        """Of each run's contexts the windows that are in a smaller document; ``docs``: the contexts' least documents."""
        raise NotImplementedError

    def kept(self, aux: object, starts: np.ndarray, covered: np.ndarray) -> list[bytes]:
        raise NotImplementedError

    # The steps of a run

    def _grams(self, blob: list[bytes]) -> dict:
        ids, raw_ids, texts = R.documents(blob)
        symbols, starts, aux = self.symbols(texts)
        at, h = anchors(symbols, starts, self.gram)
        h = mix(h) >> np.uint64(64 - HASH_BITS)  # anchors have small hashes: parts, which are ranges, would be uneven
        doc = np.searchsorted(starts, at, "right") - 1
        keys, which = np.unique(h, return_inverse=True)
        return {"ids": ids, "raw_ids": raw_ids, "starts": starts, "aux": aux, "at": at, "doc": doc, "keys": keys, "which": which}

    def _hashes(self, blob: list[bytes], parts: int) -> Iterator[tuple[int, bytes]]:
        g = self._grams(blob)
        ids = g["ids"][g["doc"]]
        low, high = _extremes(g["which"], ids, len(g["keys"]))
        edges = R.cuts(g["keys"], HASH_BITS, parts)
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if b > a:
                yield p, R.join_blobs(R.pack_sorted(g["keys"][a:b]), np.packbits(low[a:b] != high[a:b]).tobytes())

    @staticmethod
    def _shared(_: int, of: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        keys, several = [], []
        for p in payloads:
            k, bits = R.split_blobs(p)
            keys.append(R.unpack_sorted(k))
            several.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(keys[-1])))
        found, which, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[which[np.concatenate(several) > 0]] = True
        at = 0
        for run, k in zip(of, keys):
            yield run, R.join_blobs(np.packbits(shared[which[at : at + len(k)]]).tobytes())
            at += len(k)

    def _suffixes(self, blob: list[bytes], shared: dict[int, bytes], parts: int) -> dict:
        """The run's anchors whose grams are shared, and their distinct contexts, by part."""
        g = self._grams(blob)
        edges = R.cuts(g["keys"], HASH_BITS, parts)
        keep = np.zeros(len(g["keys"]), bool)
        for p, bits in shared.items():
            a, b = edges[p], edges[p + 1]
            keep[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        part_of = np.zeros(len(g["keys"]), np.int64)
        for p in range(parts):
            part_of[edges[p] : edges[p + 1]] = p
        chosen = keep[g["which"]]
        at, doc = g["at"][chosen], g["doc"][chosen]
        before = np.minimum(at - g["starts"][doc], WINDOW - self.gram)
        after = np.minimum(g["starts"][doc + 1] - at, WINDOW)
        which, store, n = self.contexts(g["aux"], at, before, after)
        ids = g["ids"][doc]
        least, _ = _extremes(which, ids, n)
        part = np.zeros(n, np.int64)
        part[which] = part_of[g["which"][chosen]]
        return g | {"at": at, "of": ids, "before": before, "after": after, "context": which, "store": store, "least": least, "part": part}

    def _send(self, blob: list[bytes], answers: dict[int, bytes], parts: int) -> Iterator[tuple[int, bytes]]:
        shared = {p: R.split_blobs(x)[0] for p, x in answers.items()}
        s = self._suffixes(blob, shared, parts)
        order = np.argsort(s["part"], kind="stable")
        edges = np.searchsorted(s["part"][order], np.arange(parts + 1))
        for p in range(parts):
            if edges[p + 1] > edges[p]:
                own = order[edges[p] : edges[p + 1]]
                yield p, R.join_blobs(shared[p], R.pack_ints(_unsigned(s["least"][own])), self.encode(s["store"], own))

    def _resolve(self, _: int, of: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        split = [R.split_blobs(p) for p in payloads]
        masks = self.resolve([x[2] for x in split], [_signed(R.unpack_ints(x[1])) for x in split])
        for run, x, m in zip(of, split, masks):
            yield run, R.join_blobs(x[0], R.pack_ints(m))

    def _finish(self, blob: list[bytes], answers: dict[int, bytes], parts: int) -> pa.Table:
        split = {p: R.split_blobs(x) for p, x in answers.items()}
        s = self._suffixes(blob, {p: x[0] for p, x in split.items()}, parts)
        masks = np.zeros(len(s["least"]), np.uint64)
        order = np.argsort(s["part"], kind="stable")
        edges = np.searchsorted(s["part"][order], np.arange(parts + 1))
        for p, x in split.items():
            masks[order[edges[p] : edges[p + 1]]] = R.unpack_ints(x[1])
        mask, low = masks[s["context"]], WINDOW - s["after"]
        whole = np.where(s["before"] >= low, (np.uint64(1) << (s["before"] + 1).astype(np.uint64)) - (np.uint64(1) << np.maximum(low, 0).astype(np.uint64)), np.uint64(0))
        mask = np.where(s["of"] > s["least"][s["context"]], whole, mask)
        starts = s["starts"]
        begins = np.zeros(int(starts[-1]) + 1, np.int8)
        for back in range(WINDOW - self.gram + 1):
            hit = (mask >> np.uint64(back)) & np.uint64(1) > 0
            begins[s["at"][hit] - back] = 1
        total = np.cumsum(begins[:-1], dtype=np.int32)
        covered = total > 0
        covered[WINDOW:] = total[WINDOW:] > total[:-WINDOW]
        steps = np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8))
        kept = self.kept(s["aux"], starts, covered)
        out: dict[str, list] = {"doc_id": s["raw_ids"], "n_symbols": np.diff(starts).tolist(), "kept": kept, "starts": [], "ends": []}
        on, off = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        for a, b in zip(starts[:-1], starts[1:]):  # a run of removed symbols may go on in the next document
            i, j = np.searchsorted(off, a, "right"), np.searchsorted(on, b, "left")
            out["starts"].append(np.maximum(on[i:j], a) - a)
            out["ends"].append(np.minimum(off[i:j], b) - a)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    def remove(self, docs: DataFrame, run_bytes: int = R.RUN_BYTES) -> DataFrame:
        """``doc_id, n_symbols, kept binary, starts, ends``: what is left, and the removed spans in symbols.

        A symbol goes if a window over it begins in a document with a smaller id as well; windows are judged on
        the input. Null texts are empty, a null id is larger than any other, and rows of the same id do not
        remove from each other. An empty table gives no rows.
        """
        packed = R.Runs(docs, run_bytes, self.spread)
        parts = packed.parts
        shared = R.gather(packed.scatter(lambda blob: self._hashes(blob, parts)), self._shared)
        answers = R.gather(packed.scatter_with(shared, lambda blob, got: self._send(blob, got, parts)), self._resolve)
        return packed.finish(answers, lambda blob, got: self._finish(blob, got, parts), "doc_id long, n_symbols long, kept binary, starts array<long>, ends array<long>")


def _extremes(which: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of each of ``n`` groups, none of them empty."""
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((values, which))
    ends = np.searchsorted(which[order], np.arange(n + 1))
    return values[order][ends[:-1]], values[order][ends[1:] - 1]


def _unsigned(ids: np.ndarray) -> np.ndarray:
    """Signed ids in an order-preserving form whose small values are small."""
    return (ids.astype(np.uint64) << np.uint64(1)) ^ (ids >> 63).astype(np.uint64)


def _signed(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)
