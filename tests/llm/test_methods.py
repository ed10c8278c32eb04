"""What the methods ask for beyond the contracts' columns."""

import random
from collections import Counter
from itertools import combinations

from mapforge.llm import fingerprint, rules

from .cases import frame, messy, texts


def plain_digest(text):
    """The digest from every triplet of every window, in plain Python."""
    n = [0] * fingerprint.BUCKETS
    for at in range(len(text)):
        for salt, (i, j) in enumerate(combinations(range(1, fingerprint.WINDOW), 2)):
            if at + j < len(text):
                key = (text[at] | text[at + i] << 8 | text[at + j] << 16) + (salt << 24)
                key ^= key >> 15
                key = key * 0x2C1B3C6D % (1 << 32)
                key ^= key >> 12
                key = key * 0x297A2D39 % (1 << 32)
                n[key >> (33 - fingerprint.BUCKETS.bit_length())] += 1
    q = [sorted(n)[fingerprint.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    code = [sum(c > x for x in q) for c in n]
    body = [code[i] | code[i + 1] << 2 | code[i + 2] << 4 | code[i + 3] << 6 for i in range(0, len(code), 4)]
    return body, q


def test_digest_against_plain():
    rng = random.Random(2)
    for size in (0, 1, 2, 3, 4, 5, 50, 700):
        text = bytes(rng.choice(b"abc de") for _ in range(size))
        body, (q1, q2, q3) = plain_digest(text)
        got = bytes.fromhex(fingerprint.digest(text))
        assert list(got[2:]) == body
        assert got[1] == (q1 * 15 // max(q3, 1)) << 4 | q2 * 15 // max(q3, 1)


def test_policies_and_ablation_of_the_stored_ledger(spark):
    df = frame(spark, messy(texts(n=80)))
    rows = rules.judged(df).collect()
    assert len(rows) == df.count()
    sole = Counter(r.failed_bits for r in rows if r.failed_bits.bit_count() == 1)
    by_bit = {1 << r.bit: r.name for r in rules.RULES}
    for r in rows:
        assert r.kept_v1 == (r.failed_bits & rules.POLICIES["v1"] == 0)
        alone = r.failed_bits & rules.POLICIES["v2"]
        assert (r.sole_rule, r.n_sole) == ((by_bit[alone], sole[alone]) if alone.bit_count() == 1 else (None, None))
    assert sum(sole.values()) > 3
    assert rules.judged(frame(spark, [])).count() == 0
