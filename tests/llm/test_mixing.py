import math
import random

import numpy as np
from pyspark.sql import functions as F

from mapforge.llm import mixing

from .cases import frame, messy, texts

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=1):
    """Documents whose words tell their domain."""
    rng = random.Random(seed)
    own = {"clean": ["calm", "river", "stone"], "low": ["a#b", "###", "x|y"], "toxic": ["awful", "vile", "nasty"]}
    rows, labels = [], []
    for i in range(n):
        d = rng.choices(list(own), [6, 3, 1])[0]
        rows.append((i, " ".join(rng.choice(own[d] + ["the", "of", "and"] * 2) for _ in range(rng.randint(20, 90)))))
        if i % 2:
            labels.append((i, int(d != "low"), int(d == "toxic")))
    return rows, labels


def test_posteriors_and_rates(spark):
    rows, labels = corpus()
    got = mixing.summary(frame(spark, rows), spark.createDataFrame(labels, LABELS)).toPandas()
    assert len(got) == len(rows)
    truth = {"low": lambda t: "#" in t or "|" in t, "toxic": lambda t: any(w in t for w in ("awful", "vile", "nasty"))}
    right = 0
    for r in got.itertuples():
        text = rows[r.doc_id][1]
        want = "low" if truth["low"](text) else "toxic" if truth["toxic"](text) else "clean"
        assert abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 and r.rate >= 0
        assert r.n_tokens == len(text.split())
        right += max(("clean", "low", "toxic"), key=lambda d: getattr(r, f"p_{d}")) == want
    assert right / len(rows) > 0.95
    mass = {d: float((got.rate * got.n_tokens * got[f"p_{d}"]).sum()) for d in mixing.TARGETS}
    for d, share in mixing.TARGETS.items():
        assert abs(mass[d] / got.n_tokens.sum() - share) < 1e-4


def plain_rates(t, p, want, start, top, rounds=20_000):
    """The same problem by plain projected gradient in one process."""
    gram = np.linalg.inv((p * t[:, None]).T @ p)
    r = np.full(len(t), start)
    for _ in range(rounds):
        off = (r * t) @ p - want
        r = np.clip(r - p @ (gram @ off), 0, top)
    return (r * t) @ p


def test_rates_with_a_bound_against_plain(spark):
    rng = np.random.default_rng(0)
    n = 300
    p = rng.dirichlet([0.4, 0.3, 1.0], n)
    t = rng.integers(1, 500, n)
    cols = list(mixing.DOMAINS)
    data = [(i, i, 1, int(t[i]), *map(float, p[i])) for i in range(n)]
    members = spark.createDataFrame(data, "doc_id long, th long, rows long, n_tokens long, " + ", ".join(f"p_{d} double" for d in cols))
    for targets, top, base in (({"clean": 0.9, "low": 0.05, "toxic": 0.05}, 1.0, "clean"), ({"clean": 0.2, "low": 0.1, "toxic": 0.7}, None, None), ({"clean": 1.0}, 1.0, None)):
        out = mixing.fit_rates(members, targets, max_rate=top, base=base).orderBy("doc_id").toPandas()
        r = out.rate.to_numpy()
        assert (r >= 0).all() and (top is None or (r <= top).all())
        share = np.array([targets.get(d, 0.0) for d in cols])
        share = share / share.sum()
        budget = (t @ p)[cols.index(base)] / share[cols.index(base)] if base else t.sum()
        want = share * budget
        start = budget / t.sum() if top is None else min(top, budget / t.sum())
        plain = plain_rates(t.astype(float), p, want, start, top or np.inf)
        safe = np.linalg.inv((p * t[:, None]).T @ p)
        loss = lambda x: float((x - want) @ safe @ (x - want)) / budget
        assert loss((r * t) @ p) <= loss(plain) + 1e-4


def test_draw_follows_rates(spark):
    docs = frame(spark, [(i, f"t{i % 7}") for i in range(4000)] + [(None, None)])
    rates = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), (F.coalesce(F.col("doc_id"), F.lit(3)) % 4 / 2.0).alias("rate"))
    got = dict(mixing.draw(docs, rates).where("doc_id is not null").groupBy((F.col("doc_id") % 4).alias("k")).count().collect())
    assert 0 not in got and got[2] == 1000
    assert abs(got[1] - 500) < 90 and abs(got[3] - 1500) < 90
    assert mixing.draw(docs, rates).columns == docs.columns


def test_edges(spark):
    labels = spark.createDataFrame([], LABELS)
    rows = messy(texts())
    out = mixing.summary(frame(spark, rows), labels).collect()
    assert len(out) == len(rows)
    assert all(abs(r.p_clean - 1 / 3) < 1e-9 for r in out)
    assert mixing.summary(frame(spark, []), labels).count() == 0
    odd = spark.createDataFrame([(0, None, 1), (None, 1, 1), (3, 1, None), (6, 1, 0), (6, 0, 0)], LABELS)
    assert mixing.summary(frame(spark, rows), odd).count() == len(rows)
    assert not any(math.isnan(r.rate) for r in mixing.summary(frame(spark, [(1, ""), (2, None)]), odd).collect())


def test_no_python_on_the_executors(spark):
    rows, labels = corpus(60)
    plan = mixing.summary(frame(spark, rows), spark.createDataFrame(labels, LABELS))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "ArrowEval", "MapInArrow"))
