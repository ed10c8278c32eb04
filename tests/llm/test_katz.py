import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mapforge.llm import katz

from .cases import frame, messy, texts


def plain(rows):
    """The model by dictionaries; a list of (row, score) and the distributions."""
    K = katz.KATZ_K
    tokens = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            uni.update(w)
            bi.update(zip([None, *w], w))
    N, V = sum(uni.values()), len(uni)
    times = lambda c: [sum(v == r for v in c.values()) for r in range(K + 2)]
    d1, d2 = katz.Discounts.fit(times(uni)), katz.Discounts.fit(times(bi))
    disc = lambda d, c: d.of[c] if c <= K else 1.0
    p1 = {w: disc(d1, c) * c / N for w, c in uni.items()}
    if sum(p1.values()) > 1 - 1e-12:
        p1 = {w: p * N / (N + 1) for w, p in p1.items()}
    unknown = 1 - sum(p1.values())
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c

    def p2(h, w):
        low = p1.get(w, unknown)
        if h not in after:
            return low
        n = sum(after[h].values())
        p = {x: disc(d2, c) * c / n for x, c in after[h].items()}
        if sum(p.values()) > 1 - 1e-9 / n:
            p = {x: v * n / (n + 1) for x, v in p.items()}
        if w in p:
            return p[w]
        return (1 - sum(p.values())) / (1 - sum(p1[x] for x in p)) * low

    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((uni[x] + 1) / (N + V + 1)) for x in w)
        out.append((i, held(i), len(w), sum(x in uni for x in w), N, base, sum(math.log10(p2(h, x)) for h, x in zip([None, *w], w))))
    return out, uni, p2


@pytest.mark.parametrize("run_bytes,hot", [(2000, 3), (1 << 20, 1000)])
def test_against_plain(spark, monkeypatch, run_bytes, hot):
    rows = texts(n=120)
    want, uni, p2 = plain(rows)
    for h in [None, *list(uni)[:20]]:
        assert abs(sum(p2(h, w) for w in uni) + p2(h, b"never seen") - 1) < 1e-9
    got = {r.doc_id: r for r in katz.fit_and_score(frame(spark, rows), run_bytes).collect()}
    assert len(got) == len(rows)
    for w in want:
        r = got[w[0]]
        assert tuple(r)[:5] == w[:5]
        assert abs(r.base_score - w[5]) < 1e-8 * max(1, abs(w[5]))
        assert abs(r.score - w[6]) < 1e-8 * max(1, abs(w[6])), w[0]


def test_hot_histories_are_dealt_by_follower(monkeypatch):
    """With a threshold that makes many histories hot, a run asks several parts, and the sums still agree."""
    from mapforge.llm import runs as R

    monkeypatch.setattr(katz, "HOT_LEAST", 2)
    rows = [(i, t or "") for i, t in texts(n=60)]
    blob = [R.pack_documents([i for i, _ in rows], [t.encode() for _, t in rows])]
    parts = 7
    run = katz._Run(blob)
    answers, tables = {}, {}
    for p, x in run.words(parts):
        (_, tables[p]), (_, answers[p]) = katz._words_part(p, [0], [x])
    run.know(answers, parts)
    run.pairs(parts, 10)
    assert len(run.asked) > len(set(run.asked.tolist()))
    assert sum(len(w) for _, _, w in run.by_part(parts)) == len(run.pair_history)
    total = defaultdict(int)
    for p, h, w in run.by_part(parts):
        assert set(run.pair_history[w].tolist()) <= set(run.asked[h].tolist())
        for x in run.pair_counts[w]:
            total["n"] += int(x)
    assert total["n"] == int((run.training & run.both).sum())


def test_edges(spark):
    assert katz.fit_and_score(frame(spark, [])).count() == 0
    rows = messy(texts())
    want = sorted((repr(w[:5]), round(w[6], 6)) for w in plain(rows)[0])
    got = sorted((repr(tuple(r)[:5]), round(r.score, 6)) for r in katz.fit_and_score(frame(spark, rows), 3000).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])
    only = next(i for i in range(100) if katz.held_out(i))
    alone = katz.fit_and_score(frame(spark, [(only, "a b")])).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.score, alone.base_score) == (3, 0, 0, 0.0, 0.0)


def test_better_than_the_base_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = katz.fit_and_score(df).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert a > b


def test_discounts():
    d = katz.Discounts.fit([0, 1000, 400, 200, 120, 80, 55])
    assert all(0 < x < 1 for x in d.of[1:])
    for odd in ([0] * 7, [0, 0, 5, 0, 0, 0, 0], [0, 1, 50, 1, 1, 1, 1]):
        assert all(0 < x <= 1 for x in katz.Discounts.fit(odd).of)


def test_too_many_words():
    katz.check_numbers(np.array([0, (1 << 31) - 1]))
    with pytest.raises(OverflowError):
        katz.check_numbers(np.array([1 << 31]))
