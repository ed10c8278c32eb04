import hashlib
import random

import numpy as np
import pytest

from mapforge.llm import repeats, runs, subtrees, suffix_runs

from .cases import frame, messy, texts


def plain(rows, split):
    """Per row: removed flags by brute force."""
    seqs = [split((t or "").encode()) for _, t in rows]
    order = [runs.NULL_ID if i is None else i for i, _ in rows]
    first = {}
    for i, s in zip(order, seqs):
        for a in range(len(s) - 49):
            w = tuple(s[a : a + 50])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, s in zip(order, seqs):
        gone = [False] * len(s)
        for a in range(len(s) - 49):
            if first[tuple(s[a : a + 50])] < i:
                gone[a : a + 50] = [True] * 50
        out.append((s, gone))
    return out


def key(r):
    return repr(tuple(r))


def check_bytes(spark, rows, run_bytes):
    got = sorted(map(key, suffix_runs.summary(suffix_runs.remove_repeats(frame(spark, rows), run_bytes)).collect()))
    want = []
    for (i, _), (s, gone) in zip(rows, plain(rows, list)):
        kept = bytes(b for b, g in zip(s, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        want.append(key((i, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    assert got == sorted(want)
    return sum(sum(g) for _, g in plain(rows, list))


def check_words(spark, rows, run_bytes):
    got = sorted(map(key, subtrees.summary(subtrees.remove_repeats(frame(spark, rows), run_bytes)).collect()))
    want = []
    for (i, _), (s, gone) in zip(rows, plain(rows, bytes.split)):
        kept = b" ".join(b for b, g in zip(s, gone) if not g)
        want.append(key((i, len(s), sum(gone), hashlib.sha256(kept).hexdigest())))
    assert got == sorted(want)
    return sum(sum(g) for _, g in plain(rows, bytes.split))


@pytest.mark.parametrize("run_bytes", [1000, 1 << 20])
def test_against_plain(spark, run_bytes):
    rows = texts()
    random.Random(1).shuffle(rows)
    assert check_bytes(spark, rows, run_bytes) > 1000
    assert check_words(spark, rows, run_bytes) > 300


def test_messy_tables(spark):
    rows = messy(texts(seed=11))
    assert check_bytes(spark, rows, 3000)
    assert check_words(spark, rows, 3000)
    for module in (suffix_runs, subtrees):
        assert module.summary(module.remove_repeats(frame(spark, []))).count() == 0


def test_passages_that_differ_in_places(spark):
    """Windows that begin and end around small changes, on either side of an anchor."""
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") for _ in range(400)]
    rows = []
    for i in range(40):
        own = list(base[rng.randrange(60) : 400 - rng.randrange(60)])
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = rng.choice("abcdefgh")
        rows.append((rng.randrange(10_000), "".join(own)))
    check_bytes(spark, rows, 2000)
    check_words(spark, [(i, " ".join(t)) for i, t in rows], 2000)


def test_long_documents_are_cut_without_loss():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 4, 30_000).astype(np.uint8)
    symbols = suffix_runs._BYTES[data]
    starts = np.array([0, 10, 9_000, 29_900, 30_000])
    a, h = repeats.anchors(symbols, starts, 16)
    b, g = repeats.anchors(symbols, starts, 16, step=500)
    assert (a == b).all() and (h == g).all()
    for s, e in zip(starts[:-1], starts[1:]):
        for w in range(s, e - 49):
            assert ((a >= w) & (a <= w + 34)).any()


def test_merge_is_sorted_and_knows_prefixes():
    rng = random.Random(6)
    sequences = [sorted({bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(40))}) for _ in range(13)]
    codes = [suffix_runs.front_code(np.array([list(x) for x in s], np.uint8).reshape(-1, 12)) for s in sequences]
    assert [suffix_runs.front_decode(c, rest, 12) for c, rest in codes] == sequences
    out = list(suffix_runs.merge(sequences, [c.tolist() for c, _ in codes]))
    words = [sequences[s][i] for s, i, _ in out]
    assert words == sorted(w for s in sequences for w in s)
    for (_, _, h), a, b in zip(out[1:], words, words[1:]):
        assert h == repeats.shared_prefix(a, b)


def test_groups_split_by_longer_prefixes(monkeypatch):
    monkeypatch.setattr(subtrees, "GROUP", 3)
    rng = random.Random(8)
    keys = [bytes(rng.choice((0, 1)) if j % 4 == 3 else 0 for j in range(48)) for _ in range(300)]
    found = list(subtrees.groups(keys, list(range(300))))
    held = {m: n for n, own in enumerate(found) for m in own}
    assert len(held) == sum(map(len, found))
    for i in range(300):
        for j in range(i):
            if keys[i][:32] == keys[j][:32]:
                assert held[i] == held[j]


def test_integers_survive_packing():
    for v in ([], [0], [1, 255], [1, 256, 70_000], [2**63, 5]):
        assert runs.unpack_ints(runs.pack_ints(np.array(v, np.uint64))).tolist() == v
    ids = np.array([0, -1, 5, -(2**63), 2**63 - 1])
    assert (repeats._signed(repeats._unsigned(ids)) == ids).all()


def test_parts_are_even():
    """Anchors are where hashes are least, and still no part gets much more of them than another."""
    rng = random.Random(9)
    blob = [runs.pack_documents(list(range(20)), [bytes(rng.choices(b"abcdefghijkl ", k=20_000)) for _ in range(20)])]
    for op in (suffix_runs.ByteRepeats(), subtrees.WordRepeats()):
        sizes = np.diff(runs.cuts(op._grams(blob)["keys"], repeats.HASH_BITS, 50))
        assert sizes.sum() > 500 and sizes.max() < 3 * sizes.mean()
