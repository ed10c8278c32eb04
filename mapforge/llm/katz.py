"""Katz backoff scoring with Good-Turing discounts, from n-gram tables partitioned by hash.

``fit`` writes two tables to the shared folder. The unigram table has every word's count, dealt by the word's hash;
a word's place in it is its number from then on. The bigram table is dealt by the history and has every
follower's count and, for each history, the sums that fix its backoff weight: how many followers have
each small count, what the larger counts add up to, and the unigram probability of all seen followers. With the
discounts, which come from the counts of all counts, these give the weight at which a history's
probabilities add up to exactly one. Along with the tables each run of documents is answered about its own n-grams, so
that ``score`` evaluates every token where its text is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs as R
from .common import materialise

#: Counts up to this are discounted.
KATZ_K = 5
#: A history that makes up more than a part's share of all tokens, and at least this many, is dealt by follower as well.
HOT_LEAST = 1000
#: Not a word, so it can stand for the end of a text.
END = b""
_TABLE = -1


def held_out(doc_id: int | None) -> bool:
    """By the id's decimal digits; a null id is never held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


@dataclass(frozen=True)
class Discounts:
    """What is left of a count: ``of[c]`` for ``c`` up to ``KATZ_K``, all of it beyond."""

    of: tuple[float, ...]

    @classmethod
    def fit(cls, times: list[int]) -> Discounts:
        """Good-Turing from ``times[r]``, how many n-grams have count ``r`` (up to ``KATZ_K + 1``).

        The largest ``k`` whose discounts all lie within (0, 1) is used; where none does, which takes tiny or odd
        corpora, one absolute discount is.
        """
        for k in range(KATZ_K, 0, -1):
            if not all(times[1 : k + 2]):
                continue
            common = (k + 1) * times[k + 1] / times[1]
            if common >= 1:
                continue
            d = [((r + 1) * times[r + 1] / (r * times[r]) - common) / (1 - common) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return cls((1.0, *d, *[1.0] * (KATZ_K - k)))
        part = times[1] / (times[1] + 2 * times[2]) if times[1] else 0.5
        part = min(part, 0.9)
        return cls((1.0, *(1 - part / r for r in range(1, KATZ_K + 1))))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.append(np.array(self.of), 1.0)[np.minimum(counts, KATZ_K + 1)]


@dataclass(frozen=True)
class Unigrams:
    """What all counts of words add up to."""

    tokens: int
    words: int
    discounts: Discounts
    unknown: float
    scale: float

    @classmethod
    def fit(cls, tokens: int, words: int, times: list[int]) -> Unigrams:
        d = Discounts.fit(times)
        if not tokens:
            return cls(0, 0, d, 1.0, 1.0)
        small = sum(r * times[r] for r in range(1, KATZ_K + 1))
        mass = (sum(d.of[r] * r * times[r] for r in range(1, KATZ_K + 1)) + tokens - small) / tokens
        scale = 1.0 if mass < 1 else tokens / (tokens + 1)
        return cls(tokens, words, d, 1 - mass * scale, scale)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words by count; of all unknown words together for count 0."""
        return np.where(counts > 0, self.scale * self.discounts(counts) * counts / max(1, self.tokens), self.unknown)


def check_numbers(numbers: np.ndarray) -> None:
    """A pair of numbers is packed in 64 bits; a vocabulary that outgrows its half fails rather than mixing words up."""
    if len(numbers) and numbers.max() >= 1 << 31:
        raise OverflowError("more than 2^31 numbers of words")


class _Run:
    """A run's tokens: numbers of its distinct words, histories, and what belongs to which document."""

    def __init__(self, blob: list[bytes]) -> None:
        _, self.raw_ids, texts = R.documents(blob)
        seen: dict[bytes, int] = {END: 0}
        put = seen.setdefault
        docs = [t.lower().split() for t in texts]
        self.sizes = np.array([len(w) + 1 for w in docs], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        total = int(self.sizes.sum())
        self.token = np.zeros(total, np.int64)
        inner = np.ones(total, bool)
        inner[self.ends - 1] = False
        self.token[inner] = np.fromiter((put(w, len(seen)) for own in docs for w in own), np.int64, total - len(docs))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, self.token = hashes[order], rank[self.token]
        self.held = np.array([held_out(i) for i in self.raw_ids], bool)
        self.training = np.repeat(~self.held, self.sizes)

    def words(self, parts: int) -> Iterator[tuple[int, bytes]]:
        counts = np.bincount(self.token[self.training], minlength=len(self.hashes)).astype(np.uint64)
        edges = R.cuts(self.hashes, 64, parts)
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if b > a:
                yield p, R.join_blobs(R.pack_sorted(self.hashes[a:b]), R.pack_ints(counts[a:b]))

    def know(self, answers: dict[int, bytes], parts: int) -> None:
        """Counts and numbers of the run's words; number 0 is an unknown word as a follower and the start as a history."""
        edges = R.cuts(self.hashes, 64, parts)
        self.counts, self.number = np.zeros(len(self.hashes), np.int64), np.zeros(len(self.hashes), np.int64)
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if b > a:
                counts, place = (R.unpack_ints(x).astype(np.int64) for x in R.split_blobs(answers[p]))
                if len(counts) != b - a:
                    raise RuntimeError("a run changed between two passes: read the documents from a table")
                self.counts[a:b] = counts
                self.number[a:b] = np.where(place > 0, (place - 1) * parts + p + 1, 0)
        check_numbers(self.number)

    def pairs(self, parts: int, tokens: int) -> None:
        """Distinct (history, follower) of known words, dealt to parts, with training counts."""
        follower = self.number[self.token]
        history = np.zeros(len(follower), np.int64)
        history[1:] = follower[:-1]
        known = history > 0
        history[self.starts], known[self.starts] = 0, True
        of_history = np.zeros(len(follower), np.int64)
        of_history[1:] = self.counts[self.token[:-1]]
        starts = ~self.held
        hot = max(HOT_LEAST, tokens // parts)
        spread = np.minimum(parts, of_history // hot + 1)
        spread[self.starts] = parts
        self.known, self.history = known, history
        # a history is asked of all parts that it is dealt to, followers or not
        asked, first = np.unique(history[known], return_index=True)
        width = spread[known][first]
        place = np.repeat(asked, width), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        self.asked, self.asked_part = place[0], (place[0] + place[1]) % parts
        both = known & (follower > 0)
        key = history[both] << 32 | follower[both]
        keys, self.pair = np.unique(key, return_inverse=True)
        self.both = both
        self.pair_history, self.pair_follower = keys >> 32, keys & 0xFFFFFFFF
        self.pair_counts = np.bincount(self.pair[self.training[both]], minlength=len(keys))
        by = np.searchsorted(asked, self.pair_history)
        self.pair_part = (self.pair_history + self.pair_follower % width[by]) % parts
        of_word = np.zeros(int(self.number.max()) + 1 if len(self.number) else 1, np.int64)
        of_word[self.number] = self.counts
        self.pair_unigram = of_word[self.pair_follower]
        self.n_starts = int(starts.sum())

    def by_part(self, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Positions among the asked histories and among the pairs, for each part that is asked."""
        a = np.argsort(self.asked_part, kind="stable")
        b = np.argsort(self.pair_part, kind="stable")
        ea, eb = (np.searchsorted(x, np.arange(parts + 1)) for x in (self.asked_part[a], self.pair_part[b]))
        for p in range(parts):
            if ea[p + 1] > ea[p]:
                yield p, a[ea[p] : ea[p + 1]], b[eb[p] : eb[p + 1]]

    def ask(self, parts: int) -> Iterator[tuple[int, bytes]]:
        for p, h, w in self.by_part(parts):
            asked = self.asked[h]
            n = np.diff(np.searchsorted(self.pair_history[w], np.append(asked, 1 << 62)))
            yield p, R.join_blobs(*map(R.pack_ints, (np.diff(asked, prepend=0), n, self.pair_follower[w], self.pair_counts[w], self.pair_unigram[w])))


def _words_part(part: int, of: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    split = [R.split_blobs(p) for p in payloads]
    keys = [R.unpack_sorted(k) for k, _ in split]
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.zeros(len(found), np.uint64)
    at = 0
    for k, (_, c) in zip(keys, split):
        counts[which[at : at + len(k)]] += R.unpack_ints(c)
        at += len(k)
    place = np.where(counts > 0, np.cumsum(counts > 0), 0)
    yield _TABLE, R.join_blobs(R.pack_sorted(found[counts > 0]), R.pack_ints(counts[counts > 0]))
    at = 0
    for run, k in zip(of, keys):
        own = which[at : at + len(k)]
        yield run, R.join_blobs(R.pack_ints(counts[own]), R.pack_ints(place[own]))
        at += len(k)


def _pairs_part(payloads: list[bytes], of: list[int], unigrams: Unigrams) -> Iterator[tuple[int, bytes]]:
    split = [[R.unpack_ints(x).astype(np.int64) for x in R.split_blobs(p)] for p in payloads]
    asked = [np.cumsum(x[0]) for x in split]
    histories, which = np.unique(np.concatenate(asked), return_inverse=True)
    own_history, at = [], 0
    for a, x in zip(asked, split):
        own_history.append(np.repeat(which[at : at + len(a)], x[1]))
        at += len(a)
    keys = np.concatenate(own_history) << 32 | np.concatenate([x[2] for x in split])
    found, first, pair = np.unique(keys, return_index=True, return_inverse=True)
    counts = np.bincount(pair, np.concatenate([x[3] for x in split]), len(found)).astype(np.int64)
    word = np.concatenate([x[4] for x in split])[first]
    n, history = len(histories), found >> 32
    small = [np.bincount(history[counts == r], minlength=n) for r in range(1, KATZ_K + 1)]
    large = np.bincount(history, np.where(counts > KATZ_K, counts, 0), n).astype(np.int64)
    lower = np.bincount(history, np.where(counts > 0, unigrams.probability(word), 0.0), n)
    seen = counts > 0
    sums = lambda h: (*(R.pack_ints(s[h]) for s in small), R.pack_ints(large[h]), lower[h].tobytes())
    yield _TABLE, R.join_blobs(R.pack_sorted(histories.astype(np.uint64)), R.pack_ints(np.bincount(history[seen], minlength=n)), R.pack_ints(found[seen] & 0xFFFFFFFF), R.pack_ints(counts[seen]), *sums(np.arange(n)))
    at_h = at_p = 0
    for run, a, x in zip(of, asked, split):
        h, p = which[at_h : at_h + len(a)], pair[at_p : at_p + len(x[2])]
        yield run, R.join_blobs(R.pack_ints(counts[p]), *sums(h))
        at_h, at_p = at_h + len(a), at_p + len(x[2])


def _times(table: DataFrame, at: int) -> tuple[int, int, list[int]]:
    """Sum of counts, their number, and how many there are of each small count, in all parts of a stored table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0):
                c = R.unpack_ints(R.split_blobs(p.as_py())[at]).astype(np.int64)
                row = [int(c.sum()), len(c), *np.bincount(np.minimum(c, KATZ_K + 2), minlength=KATZ_K + 3)[: KATZ_K + 2].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names)

    names = ["total", "n", *(f"n{r}" for r in range(KATZ_K + 2))]
    rows = table.where(F.col("run") == _TABLE).select("payload").mapInArrow(count, ", ".join(f"{c} long" for c in names))
    total, n, *times = (int(v or 0) for v in rows.agg(*(F.sum(c).alias(c) for c in names)).first())
    return total, n, times


@dataclass
class Model:
    """The stored tables (rows with run -1), with the answers that the fitted documents' runs were given."""

    words: DataFrame
    pairs: DataFrame
    unigrams: Unigrams
    discounts: Discounts
    parts: int


def fit(docs: DataFrame, run_bytes: int = R.RUN_BYTES) -> Model:
    """Count the words and bigrams of all documents that are not held out; texts end with a token of their own."""
    packed = R.Runs(docs, run_bytes)
    parts = packed.parts
    words = materialise(R.gather(packed.scatter_in_place(lambda blob: _Run(blob).words(parts)), _words_part), "unigrams")
    unigrams = Unigrams.fit(*_times(words, 1))

    def ask(blob: list[bytes], answers: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        run = _Run(blob)
        run.know(answers, parts)
        run.pairs(parts, unigrams.tokens)
        return run.ask(parts)

    sent = packed.scatter_with(words.where(F.col("run") != _TABLE), ask)
    pairs = materialise(R.gather(sent, lambda _, of, payloads: _pairs_part(payloads, of, unigrams)), "bigrams")
    return Model(words, pairs, unigrams, Discounts.fit(_times(pairs, 3)[2]), parts)


def backoff(small: list[np.ndarray], large: np.ndarray, lower: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per history: its count, the factor on its followers' probabilities, and the weight of the unigrams.

    A history whose followers all have large counts leaves nothing to discount; it gives up one count.
    """
    count = sum((r * s for r, s in enumerate(small, 1)), large)
    kept = sum((r * discounts.of[r] * s for r, s in enumerate(small, 1)), large.astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.where(count - kept > 1e-9, 1.0, count / (count + 1.0))
        left = np.where(count > 0, 1 - factor * kept / count, 1.0)
    return count, factor, left / np.maximum(1 - lower, 1e-300)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(model: Model, docs: DataFrame, run_bytes: int = R.RUN_BYTES) -> DataFrame:
    """Log10 probabilities of the documents that the model was fitted with, held out or not.

    ``base_score`` is the add-one unigram score. A token is evaluated recursively: by its bigram if that
    was seen, else by the history's weight times its unigram, else by the mass of unknown words. A null text is
    the end alone; repeated rows are scored as rows; without any training token all scores are 0.
    """
    parts, unigrams, discounts = model.parts, model.unigrams, model.discounts

    def finish(blob: list[bytes], answers: dict[int, bytes]) -> pa.Table:
        run = _Run(blob)
        run.know({p: x for p, x in answers.items() if p < parts}, parts)
        run.pairs(parts, unigrams.tokens)
        n = len(run.asked)
        small, large, lower = [np.zeros(n, np.int64) for _ in range(KATZ_K)], np.zeros(n, np.int64), np.zeros(n)
        counts = np.zeros(len(run.pair_history), np.int64)
        for p, h, w in run.by_part(parts):
            x = R.split_blobs(answers[parts + p])
            counts[w] = R.unpack_ints(x[0]).astype(np.int64)
            for s, data in zip(small, x[1:]):
                s[h] = R.unpack_ints(data).astype(np.int64)
            large[h], lower[h] = R.unpack_ints(x[1 + KATZ_K]).astype(np.int64), np.frombuffer(x[2 + KATZ_K])
        asked, which = np.unique(run.asked, return_inverse=True)
        m = len(asked)
        whole = lambda v: np.bincount(which, v, m)
        count, factor, weight = backoff([whole(s) for s in small], whole(large), whole(lower), discounts)
        c_word = run.counts[run.token]
        p = unigrams.probability(c_word)
        at = np.searchsorted(asked, run.history[run.known])
        p[run.known] *= weight[at]
        c_pair = np.zeros(len(run.token), np.int64)
        c_pair[run.both] = counts[run.pair]
        seen = c_pair > 0
        at = np.searchsorted(asked, run.history[seen])
        p[seen] = factor[at] * discounts(c_pair[seen]) * c_pair[seen] / count[at]
        base = np.log10((c_word + 1) / (unigrams.tokens + unigrams.words + 1))
        add = lambda v: np.add.reduceat(v, run.starts) if len(run.starts) else v[:0]
        cols = [run.raw_ids, run.held, run.sizes, add((c_word > 0).astype(np.int64)), np.full(len(run.sizes), unigrams.tokens), add(base), add(np.log10(p))]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({name.split()[0]: pa.array(c, k) for name, c, k in zip(_SCORES.split(", "), cols, kinds)})

    own = lambda t: t.where(F.col("run") != _TABLE)
    answers = own(model.words).union(own(model.pairs).select("run", (F.col("part") + parts).alias("part"), "payload"))
    return R.Runs(docs, run_bytes).finish(answers, finish, _SCORES)


def fit_and_score(docs: DataFrame, run_bytes: int = R.RUN_BYTES) -> DataFrame:
    return score(fit(docs, run_bytes), docs, run_bytes)
