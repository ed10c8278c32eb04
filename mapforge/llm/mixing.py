"""Mixing documents to target weights of domains they belong to softly, in DataFrame operations alone.

A classifier learned from a labelled table gives each document a posterior over domains. Nonnegative rates are
then fitted to documents such that the expected tokens of every domain, rate times tokens times posterior
summed over documents, meet a target. The fit is a projected-gradient least squares: each step needs one sum
over documents for each domain, and a document's rate follows from its posterior and the few numbers of the
steps so far, so nothing but these sums ever leaves the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, materialise, quoted, scratch

#: Domains, each with what its labels say; the first that holds counts.
DOMAINS = {"toxic": "toxic = 1", "low": "quality = 0", "clean": "quality = 1"}
#: Labelled documents that the classifier learns from, as expected of a selection by hash: the bound of its sample.
SAMPLE = 20_000
#: In how many labelled documents a word (or other mark) occurs that the classifier is to know; fewer tell too little of it.
LEAST_DOCS = 8
#: A mark speaks for or against a domain where its number there is so many standard deviations from what chance makes likely; its share is then
#: drawn towards the domain's by so many documents' worth. Without this the noise of hundreds of common words outweighs what a text says.
SIGNIFICANT, PSEUDO = 5.0, 10.0
#: Marks that are sent to all executors at most; more are joined by key.
BROADCAST_MARKS = 200_000
#: Steps at most; how near all domains must come to their targets, as a share of the budget; and what a step must gain for another
#: to be taken, as a share of the loss or in all (the loss is about the square of how far the domains' shares are off).
STEPS, CLOSE, GAIN, FLOOR = 100, 1e-6, 1e-4, 1e-8
#: A domain with less than this share of the tokens takes no part in the fit: no rates can reach it.
TRACE = 1e-9
TARGETS = {"clean": 0.85, "low": 0.10, "toxic": 0.05}


@dataclass(frozen=True)
class Classifier:
    """``weights(mark, w_<domain>...)`` as a stored table, and log priors."""

    weights: DataFrame
    priors: dict[str, float]


def _marked(texts: DataFrame) -> DataFrame:
    """``mark`` for each distinct lower-case word of a text, and for its shape: symbols, capitals and repetition.

    ``n_tokens`` is the number of words. Texts are split once, in a projection of its own, as a generator's
    input would be computed anew for each use. The first mark of shape occurs once in every row.
    """
    keep = [c for c in texts.columns if c != "text"]
    once = lambda x: F.explode(F.array(x))
    split = texts.select(*keep, "text", once(F.split(F.lower(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))), WORD_SPLIT)).alias("w"))
    sized = split.select(*keep, "text", F.size("w").alias("n"), once(F.array_distinct("w")).alias("d"))
    share = lambda name, x: F.concat(F.lit(f" {name} "), F.least(F.lit(9), F.floor(20 * x / F.col("n"))).cast("string"))
    bare = F.col("text")
    for c in "#*$%&|<>":
        bare = F.replace(bare, F.lit(c))
    symbols = F.octet_length("text") - F.octet_length(bare)
    loud = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("!")))
    capitals = F.when(F.upper("text") == F.col("text"), F.lit(" capitals")).otherwise(F.lit(" mixed"))
    shape = F.array(share("symbols", symbols), share("loud", loud), share("again", F.col("n") - F.size("d")), capitals)
    n_tokens = F.when(F.get("d", 0) == "", 0).otherwise(F.col("n")).cast("long").alias("n_tokens")
    whole = sized.select(*keep, n_tokens, F.concat("d", shape).alias("marks"))
    return whole.select(*keep, "n_tokens", F.explode("marks").alias("mark"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learn from ``labels(doc_id, quality, toxic)`` how marks speak for domains.

    Labels with a null are left out; of several for a document the worst holds. Without labels all documents
    get the same posterior.
    """
    worst = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.coalesce(*(F.when(F.expr(rule), F.lit(d)) for d, rule in DOMAINS.items()))
    known = materialise(worst.select("doc_id", domain.alias("domain")).where("domain is not null"), "labelled")
    total = known.count()
    share = min(1.0, sample / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    seen = _marked(_texts(docs).join(F.broadcast(chosen), "doc_id").select("domain", "text")).where("mark <> ''")
    of = {r.domain: r.n for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row a domain
    n = {d: of.get(d, 0) for d in DOMAINS}
    whole = sum(n.values())
    counts = seen.groupBy("mark").agg(F.count("*").alias("df"), *(F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in DOMAINS)).where(F.col("df") >= LEAST_DOCS)
    share_of = {d: (n[d] + 1) / (whole + len(DOMAINS)) for d in DOMAINS}

    def weight(d: str) -> Column:
        own, df, q = F.col(f"n_{d}"), F.col("df"), share_of[d]
        tells = F.abs(own - df * q) > 1 + SIGNIFICANT * F.sqrt(df * q * (1 - q))
        return F.when(tells, F.log((own + PSEUDO * q) / (df + PSEUDO)) - float(np.log(q))).otherwise(0.0).alias(f"w_{d}")

    known_marks = counts.select("mark", *map(weight, DOMAINS)).where(" or ".join(f"w_{d} <> 0" for d in DOMAINS))
    return Classifier(materialise(known_marks, "marks"), {d: float(np.log((n[d] + 1) / (whole + len(n)))) for d in DOMAINS})


def posteriors(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, th, n_tokens, p_<domain>...`` for each distinct (doc_id, text), with how many ``rows`` it has.

    Words that the classifier does not know say nothing. A text's words are counted next to where they are
    read, so that the shuffle carries one row a document.
    """
    weights = classifier.weights
    if weights.count() <= BROADCAST_MARKS:
        weights = F.broadcast(weights)
    found = _marked(_texts(docs)).join(weights, "mark", "left").groupBy("doc_id", "th").agg(
        F.count_if(F.col("mark").startswith(" symbols ")).alias("rows"), F.first("n_tokens").alias("n_tokens"), *(F.sum(f"w_{d}").alias(f"s_{d}") for d in DOMAINS)
    )
    # equal rows repeat their marks, which does not change what they say
    logit = {d: F.lit(classifier.priors[d]) + F.coalesce(F.col(f"s_{d}") / F.col("rows"), F.lit(0.0)) for d in DOMAINS}
    top = F.greatest(*logit.values())
    total = sum((F.exp(x - top) for x in logit.values()), F.lit(0.0))
    return found.select("doc_id", "th", "rows", "n_tokens", *((F.exp(x - top) / total).alias(f"p_{d}") for d, x in logit.items()))


def _moved(rate: Column, step: np.ndarray, max_rate: float | None) -> Column:
    """A document's rate after one more step, a number for every domain, within its bounds."""
    down = sum((F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, step)), F.lit(0.0))
    r = F.greatest(F.lit(0.0), rate - down)
    return F.least(F.lit(float(max_rate)), r) if max_rate is not None else r


def _rate(start: Column, steps: list[np.ndarray], max_rate: float | None) -> Column:
    """A document's rate after all ``steps``."""
    if not steps:
        return start
    flat = ",".join(repr(float(x)) for s in steps for x in s)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    k = len(p)
    values = F.split(F.lit(flat), ",").cast("array<double>")

    def go(r: Column, at: Column) -> Column:
        down = sum((p[j] * F.get(values, (at * k + j).cast("int")) for j in range(k)), F.lit(0.0))
        r = F.greatest(F.lit(0.0), r - down)
        return F.least(F.lit(float(max_rate)), r) if max_rate is not None else r

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), start, go)


def fit_rates(members: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None, max_rate: float | None = None, base: str | None = None, reachable: bool = False) -> DataFrame:
    """``members`` with ``rate``: expected tokens of domain d come as near as they can to ``targets[d]`` of the budget.

    Targets are scaled to add up to 1. The budget is given, or what makes domain ``base`` meet its target as it is,
    or all tokens. With ``reachable`` a domain's target is lowered to what ``max_rate`` lets it have, so that one that hardly occurs does not
    draw the others; ``balance`` tells by how much. Residuals are measured in the metric of the domains' inverse Gram matrix, in which the same
    step suits small and large domains, or in that of the documents whose rates are not at a bound; each pass tries both in several lengths
    and takes the best. The fit ends at the tolerances ``CLOSE``, ``GAIN`` or ``FLOOR``; if none is met in ``STEPS`` steps it raises.
    A document without tokens gets the start's rate, moved like any other's. An empty table stays empty.
    """
    names, own = list(DOMAINS), f"rate_{uuid.uuid4().hex}"
    weight = F.col("rows") * F.col("n_tokens")
    pair = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = members.agg(F.sum(weight).alias("t"), *(F.sum(weight * F.col(f"p_{d}")) for d in names), *(F.sum(weight * F.col(f"p_{names[i]}") * F.col(f"p_{names[j]}")) for i, j in pair)).first()
    tokens = float(sums[0] or 0)
    if not tokens:
        return members.withColumn("rate", F.lit(1.0))
    have = np.array([float(x) for x in sums[1 : 1 + len(names)]])
    gram = np.zeros((len(names), len(names)))
    for (i, j), x in zip(pair, sums[1 + len(names) :]):
        gram[i, j] = gram[j, i] = float(x)
    share = np.array([max(0.0, float(targets.get(d, 0.0))) for d in names])
    share = share / share.sum()
    if budget is None:
        budget = tokens if base is None or not share[names.index(base)] else have[names.index(base)] / share[names.index(base)]
    want = share * budget
    if reachable and max_rate is not None:
        want = np.minimum(want, max_rate * have)
    live = have > TRACE * tokens
    want = np.where(live, want, 0.0)

    def inverse(g: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(g), np.ix_(live, live)
        out[at] = np.linalg.inv(g[at] + TRACE * tokens * np.eye(int(live.sum())))
        return out

    safe = metric = inverse(gram)
    start = F.lit(budget / tokens if max_rate is None else min(max_rate, budget / tokens))
    steps: list[np.ndarray] = []
    got, small = have * (budget / tokens if max_rate is None else min(max_rate, budget / tokens)), 1.0
    loss = float((got - want) @ safe @ (got - want)) / budget
    for _ in range(STEPS):
        off = got - want
        if np.abs(off).max() <= CLOSE * budget:
            break
        tried = [small * s * (m @ off) for m, s in ((metric, 1), (metric, 0.5), (safe, 1), (safe, 4), (safe, 16))]
        moved = members.withColumn(own, _rate(start, steps, max_rate))
        after = [_moved(F.col(own), c, max_rate) for c in tried]
        sums = moved.agg(*(F.sum(weight * r * F.col(f"p_{d}")) for r in after for d in names)).first()
        reached = [np.array([float(x) for x in sums[i * len(names) : (i + 1) * len(names)]]) for i in range(len(tried))]
        losses = [float((x - want) @ safe @ (x - want)) / budget for x in reached]
        best = int(np.argmin(losses))
        if losses[best] >= loss:  # all went too far
            small /= 8
            if small < 1e-4:
                break
            continue
        gained, small = loss - losses[best], 1.0
        steps.append(tried[best])
        got, loss = reached[best], losses[best]
        if gained <= max(GAIN * loss, FLOOR):
            break
        inside = F.when((after[best] > 0) & (after[best] < float(max_rate or 1e300)), weight).otherwise(0.0)
        free = np.zeros_like(gram)
        for (i, j), x in zip(pair, moved.agg(*(F.sum(inside * F.col(f"p_{names[i]}") * F.col(f"p_{names[j]}")) for i, j in pair)).first()):
            free[i, j] = free[j, i] = float(x)
        metric = inverse(free)
    else:
        raise RuntimeError(f"rates did not settle in {STEPS} steps")
    return members.withColumn("rate", _rate(start, steps, max_rate))


def balance(rated: DataFrame, targets: Mapping[str, float] = TARGETS, max_rate: float | None = None, base: str | None = None) -> DataFrame:
    """A row per domain: ``domain``, expected tokens ``available`` at rate 1, ``asked`` by the targets, ``reachable`` under ``max_rate``, and ``reached``."""
    tokens = F.col("rows") * F.col("n_tokens")
    sums = rated.agg(F.sum(tokens).alias("whole"), *(F.sum(tokens * F.col(f"p_{d}")).alias(f"have_{d}") for d in DOMAINS), *(F.sum(tokens * F.col("rate") * F.col(f"p_{d}")).alias(f"got_{d}") for d in DOMAINS))
    total = sum(max(0.0, float(targets.get(d, 0.0))) for d in DOMAINS)
    share = {d: max(0.0, float(targets.get(d, 0.0))) / total for d in DOMAINS}
    budget = F.col(f"have_{base}") / share[base] if base and share[base] else F.col("whole").cast("double")
    rows = []
    for d in DOMAINS:
        asked = budget * share[d]
        most = F.least(asked, max_rate * F.col(f"have_{d}")) if max_rate is not None else asked
        rows.append(F.struct(F.lit(d).alias("domain"), F.col(f"have_{d}").alias("available"), asked.alias("asked"), most.alias("reachable"), F.col(f"got_{d}").alias("reached")))
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, max_rate: float | None = None, base: str | None = None, reachable: bool = False) -> DataFrame:
    """``doc_id, th, rows, n_tokens, p_<domain>..., rate`` for each distinct (doc_id, text).

    Repeated rows are one with their number; equal texts of different ids get equal rates. A very long text is one row's work, split once.

    A null text is empty and gets the prior; a null id is kept; an empty table gives no rows.
    """
    with scratch() as keep:
        members = keep(materialise(posteriors(docs, train(docs, labels)), "members"))
    return fit_rates(members, targets, max_rate=max_rate, base=base, reachable=reachable)


def draw(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as its rate says: the whole part, and once more by a hash of id and text."""
    tag = uuid.uuid4().hex
    own_th, key, th, n, copy = (f"{c}_{tag}" for c in ("own", "key", "th", "n", "copy"))
    own = docs.withColumn(own_th, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    chance = F.pmod(F.xxhash64("doc_id", "th", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    times = rates.select(F.col("doc_id").alias(key), F.col("th").alias(th), F.floor(F.col("rate") + chance).cast("int").alias(n)).where(F.col(n) > 0)
    out = own.join(times, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own_th) == F.col(th)))
    columns = [F.col(quoted(c)) for c in docs.columns]
    return out.select(*columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy)).select(*columns)


def summary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, p_<domain>..., rate``."""
    out = mix(docs, labels)
    return out.select("doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy")).drop("copy")
