import random
from pathlib import Path

import corpus_pipeline
from mapforge.llm import shingles, simhash

from .cases import frame, messy, texts

TOP = 1 << 63


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([b" ".join(w)] if w else [])


def kept_ids(rows):
    """Least ids of the groups that brute force links."""
    sets = sorted({plain_set(t) for _, t in rows}, key=sorted)
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        r = find(plain_set(t))
        least[r] = min(least.get(r, TOP), TOP if i is None else i)
    return sorted(least.values())


def changed_copies(seed, n_words, share, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for k in range(copies):
        w = [word() for _ in range(n_words)]
        other = [word() if rng.random() < share else x for x in w]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    return rows


def stage(spark, rows):
    run = dict(corpus_pipeline.STAGES)["near-dedup by shingles"]
    return sorted(TOP if r.doc_id is None else r.doc_id for r in run(spark, frame(spark, rows), "").collect())


def test_stage_against_plain(spark):
    rows = messy(texts(n=120)) + [(5000 + i, t) for i, t in changed_copies(4, 300, 0.02, 60)] + [(7000 + i, t) for i, t in changed_copies(5, 30, 0.02, 30)]
    want = kept_ids(rows)
    assert len([i for i in want if 5000 <= i < 7000]) < 100 < len(want) < len(rows)
    assert stage(spark, rows) == want


def test_edges(spark):
    assert stage(spark, []) == []
    assert stage(spark, [(3, None), (1, " \n"), (2, "a"), (4, "A"), (5, "a b c d e f g h"), (6, "a b c d e f g"), (7, "a b c d e f g h i")]) == [1, 2, 5, 6]
    step, shingles.STEP = shingles.STEP, 7
    try:
        parts = shingles.shingles(b"a b c d e f g h i j k l m n o p q r s t")
    finally:
        shingles.STEP = step
    assert list(parts) == list(shingles.shingles(b"a b c d e f g h i j k l m n o p q r s t"))


def test_stored_tables_stay_below_the_texts(spark, monkeypatch):
    """Sets are about as large as the texts; what is stored beside the documents that stay are prefixes and links."""
    stored = {}

    def seen(df, name):
        out = materialise(df, name)
        path = Path(out.stored_at.removeprefix("file://"))
        stored[path] = sum(f.stat().st_size for f in path.glob("*.parquet"))
        return out

    materialise = shingles.materialise
    monkeypatch.setattr(shingles, "materialise", seen)
    rng = random.Random(8)
    rows = [(i, " ".join(str(rng.randrange(10**5)) for _ in range(800))) for i in range(300)]
    assert stage(spark, rows) == [i for i, _ in rows]
    assert 0 < max(stored.values()) < sum(len(t) for _, t in rows) / 2


def test_near_copies_are_found_by_pigeonring(spark, monkeypatch):
    """Sets that SimHash and the pigeonring join link are compared, and of prefixes only what these leave."""
    found = []
    links = shingles.simhash.links
    monkeypatch.setattr(shingles.simhash, "links", lambda fps, *a: found.append(sorted(map(tuple, links(fps, *a).collect()))) or links(fps, *a))
    base = changed_copies(6, 6000, 0, 1)[0][1].split()
    rows = [(i, " ".join([*base[: 6000 - i], *(f"w{i}" for _ in range(i))])) for i in range(3)]
    assert stage(spark, rows) == kept_ids(rows) == [0]
    fps = sorted({shingles._fingerprint(shingles.shingles(t.encode())) for _, t in rows})
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert near and found == [near]


def test_sets_that_only_share_a_passage_are_not_compared(spark, monkeypatch):
    """Pairs that share common shingles grow faster than the documents; bitmaps settle them, and sets are built for the rest."""
    compared = []
    sets = shingles.shingle_sets
    monkeypatch.setattr(shingles, "shingle_sets", lambda texts, width: compared.extend(r.doc_id for r in texts.select("doc_id").collect()) or sets(texts, width))
    rng = random.Random(9)
    passage = [str(rng.randrange(10**6)) for _ in range(60)]
    rows = [(i, " ".join([*(str(rng.randrange(10**6)) for _ in range(200)), *passage])) for i in range(40)]
    rows += [(100 + i, f"{rows[i][1]} x") for i in range(3)]
    assert stage(spark, rows) == kept_ids(rows) == list(range(40))
    assert set(compared) == {0, 1, 2, 100, 101, 102}


def test_bitmaps_differ_no_more_than_sets(spark):
    rng = random.Random(10)
    some = lambda n: shingles.np.array([rng.randrange(-(2**62), 2**62) for _ in range(n)], shingles.np.int64)
    rows = []
    for n in (1, 63, 85, 86, 170, 171, 682, 683, 700):
        a = some(n)
        for cut, new in ((0, 0), (n // 9, n // 9), (n // 5, 0), (0, n // 4), (n // 2, n // 2)):
            b = shingles.np.concatenate([a[cut:], some(new)])
            rows.append((shingles._bitmap(a).tolist(), shingles._bitmap(b).tolist(), cut + new))
    found = spark.createDataFrame(rows, "x array<long>, y array<long>, most int").select(shingles._bits_apart(shingles.F.col("x"), shingles.F.col("y")).alias("n"), "most").collect()
    assert all(r.n <= r.most for r in found) and sum(r.n > r.most / 3 for r in found if r.most > 20) > 5


def test_texts_that_stay_are_not_shuffled(spark):
    rows = [(i, f"text {i}") for i in range(20)]
    docs = frame(spark, rows)
    first = docs.where("doc_id % 2 = 0").selectExpr("cast(doc_id as long) as doc_id", "xxhash64(text) as th")
    out = simhash.keep_first(docs, first)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 20, 2))
    again = simhash.keep_first(docs.union(docs), first)
    assert sorted(r.doc_id for r in again.collect()) == list(range(0, 20, 2))
