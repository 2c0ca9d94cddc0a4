"""How characteristic a term is of a record.

Each term's occurrence counts are modelled as a mixture of two Poisson distributions over all N records: in "elite"
records, which are about the term, it occurs with a higher rate than in the others. The mixture is fitted by
expectation-maximisation, to its end, on the term's frequency histogram (count -> number of records, absent ones included), and the
posterior probability of the elite component scores each count. On the same histogram, ``weight`` = tf * ln(N / df).

Everything is a function of (term, tf), so it is computed once for each pair on the histogram and joined back to the
occurrences. Terms in more than ``frequent`` of all records would be hot keys of that join; their scores are broadcast, up to
``told`` rows, the most frequent first. Whatever the input, a key that is left to the shuffle then has no more than
occurrences / ``told`` rows.

Defined results: null texts count as empty; records without terms get no row, but count in N; ids that are null get no
row, but count in N and in the histograms; repeated ids are summed as separate rows of the same record's terms would be,
so ids should be unique; an empty table gives no rows. Texts are used whole.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.text import small_batches, tokens, utf8
from folioscan.storage import materialize

#: The fit: plain rounds before accelerated ones; accelerated rounds before Newton steps join; estimated change that is left at the end; change that is none; difference of
#: log rates that are one; accelerated rounds after which it is an error that terms are still changing.
PLAIN, EXTRAPOLATED, TOLERANCE, STILL, ALIKE, MOST = 50, 50, 1e-6, 1e-13, 1e-8, 100_000
TINY = 1e-12
LOGIT_LEAST, LOGIT_MOST = math.log(TINY), math.log(1e9)
FLUSH = 300_000
FREQUENT_ROWS = 500_000


def _counted(columns: list[list[bytes | None]]):
    for texts in zip(*columns):
        c: Counter = Counter()
        for t in texts:
            if t:
                c.update(tokens(t))
        yield c


def occurrences(docs: DataFrame, doc_id: str, fields: list[str]) -> DataFrame:
    """(doc_id, term, tf) over all fields of a record together."""

    def emit(batches):
        for b in small_batches(batches, 1, 1 << 20):
            ids, terms, tfs, reps = [], [], [], []
            for i, c in zip(b.column(0).to_pylist(), _counted([utf8(x) for x in b.columns[1:]])):
                ids.append(i)
                reps.append(len(c))
                terms.extend(c)
                tfs.extend(c.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), reps))), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int32())], ["doc_id", "term", "tf"]
            )

    return docs.select(F.col(doc_id).cast("long"), *[F.col(f) for f in fields]).mapInArrow(emit, "doc_id bigint, term string, tf int")


def histograms(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(term, tf, n): in how many records a term occurs tf times."""

    def emit(batches):
        hist: Counter = Counter()

        def out():
            terms, tfs = zip(*hist) if hist else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int32()), pa.array(list(hist.values()), pa.int64())], ["term", "tf", "n"])
            hist.clear()

        for b in batches:
            for c in _counted([utf8(x) for x in b.columns]):
                hist.update(c.items())
            if len(hist) > FLUSH:
                yield from out()
        yield from out()

    return docs.select(*[F.col(f) for f in fields]).mapInArrow(emit, "term string, tf int, n bigint").groupBy("term", "tf").agg(F.sum("n").alias("n"))


def _elite(count, lo, hi, p):
    """Posterior of elite, from the log ratio of both weighted densities; the factorial cancels."""
    d = np.log((1 - p) / p) + count * np.log(lo / hi) + (hi - lo)
    return 1 / (1 + np.exp(np.clip(d, -700, 700)))


class _Histograms:
    """Histograms of several terms, ordered by ``owner``, with the steps of the fit for all of them at once. Parameters are
    the rows logit p, log lo and log hi of an array, with a column for each term."""

    def __init__(self, owner: np.ndarray, k: np.ndarray, n: np.ndarray, terms: int, records: int):
        self.owner, self.k, self.n, self.terms, self.records = owner, k, n, terms, records
        self.df, self.total = self.sums(n), self.sums(n * k)
        self.absent = np.maximum(records - self.df, 0.0)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, x, self.terms)

    def only(self, keep: np.ndarray) -> _Histograms:
        at = keep[self.owner]
        return _Histograms((np.cumsum(keep) - 1)[self.owner[at]], self.k[at], self.n[at], int(keep.sum()), self.records)

    def start(self) -> np.ndarray:
        """lo is half the overall mean, hi the mean among the records that have the term plus a half, p half their share."""
        lo, hi, p = self.total / self.records / 2 + TINY, self.total / self.df + 0.5, np.clip(self.df / self.records / 2, TINY, 1 - 1e-9)
        return np.stack([np.log(p / (1 - p)), np.log(lo), np.log(hi)])

    def posterior(self, x: np.ndarray) -> np.ndarray:
        (lo, hi), p = np.exp(x[1:]), 1 / (1 + np.exp(-x[0]))
        return _elite(self.k, lo[self.owner], hi[self.owner], p[self.owner])

    def step(self, x: np.ndarray) -> np.ndarray:
        """One round of expectation and maximisation."""
        (lo, hi), p = np.exp(x[1:]), 1 / (1 + np.exp(-x[0]))
        r, r0 = self.posterior(x), _elite(0.0, lo, hi, p)
        w = np.clip(self.sums(self.n * r) + self.absent * r0, TINY * self.records, (1 - 1e-9) * self.records)
        y = self.sums(self.n * r * self.k)
        hi, lo = np.maximum(y / w, TINY), np.maximum((self.total - y) / (self.records - w), TINY)
        x = np.stack([np.log(w / (self.records - w)), np.log(lo), np.log(hi)])
        return np.where(lo > hi, np.stack([-x[0], x[2], x[1]]), x)

    def likelihood(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood of each term's histogram, without the factorials."""
        lo, hi = np.exp(x[1:])
        lp, lq = -np.logaddexp(0, -x[0]), -np.logaddexp(0, x[0])
        of = self.owner
        return self.sums(self.n * np.logaddexp((lq - lo)[of] + self.k * x[1][of], (lp - hi)[of] + self.k * x[2][of])) + self.absent * np.logaddexp(lq - lo, lp - hi)

    def newton(self, x: np.ndarray, damp: np.ndarray) -> np.ndarray:
        """A damped Newton step: the information of complete data is diagonal, from it goes what is missing."""
        (lo, hi), p = np.exp(x[1:]), 1 / (1 + np.exp(-x[0]))
        r, r0, of = self.posterior(x), _elite(0.0, lo, hi, p), self.owner
        w, y = self.sums(self.n * r) + self.absent * r0, self.sums(self.n * r * self.k)
        slope = np.stack([w - self.records * p, self.total - y - lo * (self.records - w), y - hi * w])
        full = np.maximum(np.stack([self.records * p * (1 - p), lo * (self.records - w), hi * w]), 1e-300) ** 0.5
        moved, moved0 = (np.ones(len(of)), lo[of] - self.k, self.k - hi[of]), (np.ones(self.terms), lo, -hi)
        open_, open0 = self.n * r * (1 - r), self.absent * r0 * (1 - r0)
        m = np.empty((self.terms, 3, 3))
        for i in range(3):
            for j in range(3):
                m[:, i, j] = (i == j) * (1 + damp) - (self.sums(open_ * moved[i] * moved[j]) + open0 * moved0[i] * moved0[j]) / full[i] / full[j]
        m[np.abs(np.linalg.det(m)) < 1e-300] = np.eye(3)
        return x + np.linalg.solve(m, (slope / full).T[:, :, None])[:, :, 0].T / full


def _fit(h: _Histograms) -> np.ndarray:
    """Parameters where the rounds from the start lead: accelerated steps (SQUAREM), then Newton's for what is slow."""
    x = h.start()
    for _ in range(PLAIN):
        x = h.step(x)
    out, at, reach, rounds = x.copy(), np.arange(h.terms), np.full(h.terms, 4.0), 0
    trust = np.full(h.terms, 16.0)
    while len(at):
        a = h.step(x)
        b = h.step(a)
        r, v = a - x, (b - a) - (a - x)
        norm, bend = np.sqrt((r * r).sum(0)), np.sqrt((v * v).sum(0))
        alpha = norm / np.maximum(bend, 1e-300)
        # what is left of a geometric series of changes is about alpha times the last; one rate is left if both are alike
        done = (norm * np.maximum(alpha, 1) < TOLERANCE) | (norm < STILL) | (b[2] - b[1] < ALIKE)
        if done.any():
            out[:, at[done]] = b[:, done]
            keep = ~done
            h, at, reach, trust, x, a, b, r, v, alpha = h.only(keep), at[keep], reach[keep], trust[keep], x[:, keep], a[:, keep], b[:, keep], r[:, keep], v[:, keep], alpha[keep]
            if not len(at):
                break
        alpha = np.clip(alpha, 1, reach)
        y = x + 2 * alpha * r + alpha * alpha * v
        if rounds > EXTRAPOLATED and rounds % 2:
            y = h.newton(b, 1 / trust)
            y = np.where(np.isfinite(y).all(0), y, b)
        y[0] = np.clip(y[0], LOGIT_LEAST, LOGIT_MOST)
        y[1:] = np.clip(y[1:], np.log(TINY), 700)
        # the rates may come near each other but must not change places
        near = y[2] - y[1] < 0.1 * (b[2] - b[1])
        y[:, near] = np.stack([y[0], y[2] - 0.05 * (b[2] - b[1]), y[2] + 0.05 * (b[2] - b[1])])[:, near]
        y = h.step(y)
        known = h.likelihood(b)
        good = h.likelihood(y) >= known - 1e-13 * np.abs(known)
        x = np.where(good, y, b)
        if rounds > EXTRAPOLATED and rounds % 2:
            trust = np.clip(np.where(good, trust * 16, trust / 16), 1e-3, 1e12)
        else:
            reach = np.where(good, np.where(alpha >= reach, reach * 4, reach), np.maximum(alpha / 4, 2.0))
        rounds += 1
        if rounds > MOST:
            raise RuntimeError(f"the mixture of {len(at)} terms has not converged after {MOST} accelerated rounds")
    return out


def fit_two_poisson(owner: np.ndarray, tf: np.ndarray, n: np.ndarray, terms: int, records: int) -> np.ndarray:
    """Posterior of the elite component for each histogram entry; ``owner`` numbers the term of an entry.

    The share p of elite records, their rate hi and the other rate lo are fitted for all terms at once, each until what is
    left of its changes is estimated below TOLERANCE (in logit p, log lo and log hi); then only the others go on. Equal
    histograms are fitted once. Where no second rate makes a term's counts likelier, both rates become one and every
    count has the same posterior, the p at which they met."""
    order = np.lexsort((tf, owner))
    k, n_ = tf[order].astype(float), n[order].astype(float)
    ends = np.cumsum(np.bincount(owner, minlength=terms))
    kinds: dict[bytes, int] = {}
    kind = np.empty(terms, np.int64)
    first, a = [], 0
    for t, b in enumerate(ends):
        kind[t] = kinds.setdefault(k[a:b].tobytes() + n_[a:b].tobytes(), len(kinds))
        if kind[t] == len(first):
            first.append((a, b))
        a = b
    lens = np.array([b - a for a, b in first])
    at = np.concatenate([np.arange(a, b) for a, b in first])
    h = _Histograms(np.repeat(np.arange(len(first)), lens), k[at], n_[at], len(first), records)
    post, begins = h.posterior(_fit(h)), np.cumsum(lens) - lens
    out = np.empty(len(k))
    starts = ends - np.bincount(owner, minlength=terms)
    out[order] = post[begins[kind[owner[order]]] + np.arange(len(k)) - starts[owner[order]]]
    return out


def scores(hist: DataFrame, records: int) -> DataFrame:
    """(term, tf, df, elite, weight) for each entry of the histograms."""

    def fit(batches):
        for b in batches:
            hs = b.column(1)
            lens = np.diff(hs.offsets.to_numpy())
            if not len(lens):
                continue
            flat = hs.flatten()
            tf, n = flat.field("tf").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lens)), lens)
            df = np.bincount(owner, n, len(lens)).astype(np.int64)
            post = fit_two_poisson(owner, tf, n, len(lens), records)
            weight = np.round(tf * np.log(records / df[owner]), 9)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner)), pa.array(tf.astype(np.int32)), pa.array(df[owner]), pa.array(np.round(post, 9)), pa.array(weight)], ["term", "tf", "df", "elite", "weight"]
            )

    # the distinct counts of one term are few (they are bounded by its largest count), whatever the number of records
    terms = hist.groupBy("term").agg(F.collect_list(F.struct("tf", "n")).alias("h"))
    return terms.mapInArrow(fit, "term string, tf int, df bigint, elite double, weight double")


def term_scores(docs: DataFrame, doc_id: str, fields: list[str], frequent: float = 0.001, least_df: int = 1, told: int = FREQUENT_ROWS) -> DataFrame:
    """(doc_id, term, tf, df, elite, weight) for every term of every record that at least ``least_df`` records have."""
    records = docs.count()
    if not records:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, term string, tf int, df bigint, elite double, weight double")
    scored = materialize(scores(histograms(docs, fields), records).filter(F.col("df") >= least_df), "scores")
    occ = occurrences(docs, doc_id, fields).filter("doc_id is not null")
    bar = max(1, int(records * frequent))
    hot = scored.filter(F.col("df") > bar)
    if hot.count() > told:
        bar = hot.orderBy(F.desc("df")).select("df").limit(told).agg(F.min("df").alias("b")).first().b
        hot = scored.filter(F.col("df") > bar)
    seen = occ.join(F.broadcast(hot), ["term", "tf"], "left")
    # what the broadcast knows is done; the rest, no term of it in more than ``bar`` records, is joined by shuffle
    known = seen.filter("df is not null")
    rest = seen.filter("df is null").select("doc_id", "term", "tf").join(scored.filter(F.col("df") <= bar), ["term", "tf"])
    cols = ["doc_id", "term", "tf", "df", "elite", "weight"]
    return known.select(*cols).unionByName(rest.select(*cols))


def best_terms(scored: DataFrame, by: str = "weight") -> DataFrame:
    """(doc_id, term) with the highest score; of equal scores, the term smallest by code points."""
    return scored.groupBy("doc_id").agg(F.min(F.struct((-F.col(by)).alias("s"), "term")).alias("m")).select("doc_id", F.col("m.term").alias("term"), (-F.col("m.s")).alias("score"))
