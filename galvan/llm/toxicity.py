"""Toxicity by a factorization machine over hashed terms.

Terms are words (runs of letters, digits and underscores in lower case) and their first four to seven letters, hashed into
2^18 buckets. The model is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j over the buckets that a text has, so a pair of terms can mean
more than either alone, also where neither means anything by itself. x is 1, or sqrt(SCALED / n) for a text of n > SCALED buckets, as sums
over thousands of terms would drown everything else.

It is trained on at most SAMPLE labelled rows (those of the smallest hashes of doc_id), over all buckets that these have. First the weights:
logistic loss with an L1 penalty for each bucket in proportion to the noise of its gradient, sqrt(2 ln buckets) * sqrt(share of texts * p * (1 - p) /
rows), so that what few texts have comes in if it tells enough; no bucket is left out beforehand. The problem is convex and solved to its optimum, by
accelerated proximal steps on the buckets whose gradients exceed their penalties, until none is left that does. Then AdaGrad for the factors and
for what the weights are to change beside them, both shrunk towards zero (group L1 and L1) for every step that passes, whether a bucket is in the
batch or not. Whether the found weights are fitted again without L1, and the epoch (the weights alone, unless it
gains more than a standard error), are those of the least loss on every eighth row, which is not trained on. Then every whole text is scored.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read. Labels, language, source and doc_id are no
inputs of a score.

Defined results: a null or empty text has no terms and gets the score of the intercept; repeated doc_ids and repeated rows give a row each,
repeated labels count once, as toxic if any is, with the text of the smallest hash if a labelled doc_id has several; without labels every score
is 0.05; a null doc_id is not held out; an empty table gives no rows; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, written

BUCKETS = 1 << 18
SAMPLE = 20_000
SCALED = 300
#: Ridge of weights that are fitted again; epochs without a gain after which no more follow.
RIDGE, PATIENCE = 5.0, 2
RANK, RATE, BATCH = 8, 0.1, 128
#: Batches that are trained on, as whole epochs, and epochs at least and at most.
STEPS, EPOCHS = 1200, (6, 24)
#: Shrinkage of weights at first and at last, and of factors.
SHRINK_FIRST, SHRINK_LAST, SHRINK_FACTORS = 0.015, 0.003, 0.003
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")


class Terms(dict):
    """word -> its buckets; with `chosen`, the places of the chosen ones among them."""

    def __init__(self, chosen: dict[int, int] | None = None) -> None:
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        found = {xxhash.xxh3_64_intdigest("w " + word) % BUCKETS} | {xxhash.xxh3_64_intdigest("p " + word[:k]) % BUCKETS for k in range(4, 8) if len(word) >= k}
        if self.chosen is not None:
            found = {self.chosen[b] for b in found if b in self.chosen}
        self[word] = out = tuple(found)
        return out


def active(text: str, terms: Terms) -> np.ndarray:
    """The distinct terms of a text, sorted."""
    found: set[int] = set()
    for t in map(terms.__getitem__, set(_WORD.findall(text.lower()))):
        if t:
            found.update(t)
    return np.array(sorted(found), np.int64)


class Machine:
    """A factorization machine for terms that a text has or not."""

    def __init__(self, n: int, prior: float, seed: int = 7) -> None:
        self.w0 = float(np.log(prior / (1 - prior)))
        self.w = np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (n, RANK))

    def _parts(self, ids: np.ndarray, offsets: np.ndarray):
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        x = np.minimum(1, np.sqrt(SCALED / np.maximum(n, 1)))[doc]
        vx = self.v[ids] * x[:, None]
        sums = np.zeros((len(n), RANK))
        if len(ids):
            sums[n > 0] = np.add.reduceat(vx, offsets[:-1][n > 0], axis=0)
        return doc, x, vx, sums, self.w0 + np.bincount(doc, self.w[ids] * x, len(n)) + 0.5 * ((sums * sums).sum(1) - np.bincount(doc, (vx * vx).sum(1), len(n)))

    def logits(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logits of texts whose terms are ids[offsets[i]:offsets[i+1]]."""
        return np.clip(self._parts(ids, offsets)[-1], -30, 30)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Machine:
        """From the weights that it has: factors, and what they ask of the weights."""
        rng = np.random.default_rng(seed)
        joined = lambda part: (np.concatenate([*(rows[k] for k in part), np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(rows[k]) for k in part])]).astype(np.int64))
        g0, gw, gv = 1e-5, np.full(len(self.w), 1e-5), np.full(self.v.shape, 1e-5)
        given, last = self.w.copy(), np.zeros(len(self.w), np.int64)
        checked, trained = parts_of(len(rows))
        kept = np.zeros(len(self.w), bool)
        for k in trained:
            kept[rows[k]] = True
        seen = np.flatnonzero(kept)
        self.v[~kept] = 0

        def losses() -> np.ndarray:
            return log_losses(np.concatenate([*(self.logits(*joined(checked[i : i + BATCH])) for i in range(0, len(checked), BATCH)), np.zeros(0)]), y[checked])

        def shrunk(used: np.ndarray, steps: np.ndarray, shrink: float) -> None:
            d = self.w[used] - given[used]
            self.w[used] = given[used] + np.sign(d) * np.maximum(np.abs(d) - shrink * steps * RATE / np.sqrt(gw[used]), 0)
            size = np.maximum(np.sqrt((self.v[used] ** 2).sum(1)), 1e-12)
            self.v[used] *= np.maximum(0, 1 - SHRINK_FACTORS * steps * (RATE / 2 / np.sqrt(gv[used])).mean(1) / size)[:, None]

        factors, self.v = self.v, np.zeros_like(self.v)
        plain = losses()
        best = plain.mean(), self.w0, self.w.copy(), self.v.copy()
        self.v = factors
        epochs = min(max(round(STEPS * BATCH / max(len(trained), 1)), EPOCHS[0]), EPOCHS[1])
        now = since = 0
        for epoch in range(epochs):
            shrink = max(SHRINK_LAST, SHRINK_FIRST * (1 - epoch / (0.7 * epochs)))
            order = rng.permutation(trained)
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                now += 1
                ids, offsets = joined(part)
                used, at = np.unique(ids, return_inverse=True)
                shrunk(used, now - 1 - last[used], shrink)  # for the steps since a bucket was last there
                doc, x, vx, sums, z = self._parts(ids, offsets)
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                dw = np.bincount(at, e[doc] * x, len(used))
                d = (e[doc] * x)[:, None] * (sums[doc] - vx)
                dv = np.stack([np.bincount(at, d[:, f], len(used)) for f in range(RANK)], 1)
                g0 += e.sum() ** 2
                self.w0 -= RATE * e.sum() / np.sqrt(g0)
                gw[used] += dw * dw
                self.w[used] -= RATE / np.sqrt(gw[used]) * dw
                gv[used] += dv * dv
                self.v[used] -= RATE / 2 / np.sqrt(gv[used]) * dv
                shrunk(used, np.ones(len(used)), shrink)
                last[used] = now
            shrunk(seen, now - last[seen], shrink)
            last[seen] = now
            found = losses()
            gain = plain - found
            if found.mean() < best[0] and gain.mean() > gain.std() / len(gain) ** 0.5:  # beyond what chance gives so few rows
                best, since = (found.mean(), self.w0, self.w.copy(), self.v.copy()), 0
            else:
                since += 1
            if since >= PATIENCE and epoch >= EPOCHS[0]:
                break
        _, self.w0, self.w, self.v = best
        return self


def parts_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows to check, rows to train on)."""
    return np.arange(0, n, 8), np.flatnonzero(np.arange(n) % 8)


def log_losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


class Weights:
    """Logistic regression of some rows on all their buckets, with an L1 penalty for each. Rows are gone through some at a time, so that no
    array but theirs has a number for each of their terms."""

    TERMS = 500_000

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, prior: float) -> None:
        n = np.array([len(r) for r in rows], np.int64)
        self.rows, self.n, self.y, self.prior = rows, n, y, prior
        self.scale = np.minimum(1, np.sqrt(SCALED / np.maximum(n, 1)))
        self.share = self._summed(self.scale * self.scale) / max(len(rows), 1)

    def _parts(self):
        """(first row, row behind the last, their terms, the row of each)."""
        a, sums = 0, np.concatenate([[0], np.cumsum(self.n)])
        while a < len(self.n):
            b = max(a + 1, int(np.searchsorted(sums, sums[a] + self.TERMS, "right")) - 1)
            yield a, b, np.concatenate(self.rows[a:b]), np.repeat(np.arange(a, b), self.n[a:b])
            a = b

    def _summed(self, of_row: np.ndarray) -> np.ndarray:
        """Of each bucket the sum over the rows that have it."""
        out = np.zeros(BUCKETS)
        for _, _, ids, doc in self._parts():
            out += np.bincount(ids, of_row[doc], BUCKETS)
        return out

    def logits(self, w0: float, w: np.ndarray) -> np.ndarray:
        z = np.full(len(self.n), w0)
        for a, b, ids, doc in self._parts():
            z[a:b] += np.bincount(doc - a, w[ids], b - a)[: b - a] * self.scale[a:b]
        return np.clip(z, -30, 30)

    def penalties(self, strength: float) -> np.ndarray:
        return strength * np.sqrt(self.share * self.prior * (1 - self.prior) / max(len(self.y), 1))

    def _solved(self, w0: float, w: np.ndarray, some: np.ndarray, penalty: np.ndarray, ridge: float, steps: int = 400) -> float:
        """Puts the optimum over the buckets `some` into w and gives the intercept: FISTA on columns of one scale."""
        n = len(self.y)
        place = np.full(BUCKETS, -1)
        place[some] = np.arange(len(some))
        found = [(np.zeros(0, np.int64),) * 2]
        for _, _, ids, rows in self._parts():
            here = place[ids] >= 0
            found.append((place[ids[here]], rows[here]))
        at, doc = (np.concatenate(f) for f in zip(*found, strict=True))
        scale = np.sqrt(self.share[some])
        x, cost = self.scale[doc] / scale[at], penalty[some] / scale
        v = np.random.default_rng(1).normal(0, 1, len(some) + 1)
        size = 1.0
        for _ in range(30):
            z = v[-1] + np.bincount(doc, v[at] * x, n)
            v = np.append(np.bincount(at, z[doc] * x, len(some)), z.sum()) / n
            size = float(np.linalg.norm(v))
            v /= max(size, 1e-12)
        rate = 1 / (0.25 * size * 1.05 + ridge)
        u = np.append(w[some] * scale, w0)
        ahead, t = u, 1.0
        for _ in range(steps):
            z = np.clip(ahead[-1] + np.bincount(doc, ahead[at] * x, n), -30, 30)
            e = (1 / (1 + np.exp(-z)) - self.y) / n
            new = ahead - rate * np.append(np.bincount(at, e[doc] * x, len(some)) + ridge * ahead[:-1], e.sum())
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * cost, 0)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, moved, t = new + (t - 1) / after * (new - u), np.abs(new - u).max(), after
            u = new
            if moved < 1e-6:
                break
        w[some] = u[:-1] / scale
        return float(u[-1])

    def fitted(self, strength: float, start: tuple[float, np.ndarray] | None = None) -> tuple[float, np.ndarray]:
        """(intercept, weights) of the least penalised loss."""
        penalty = self.penalties(strength)
        w0, w = start if start else (float(np.log(self.prior / (1 - self.prior))), np.zeros(BUCKETS))
        w = w.copy()
        some = np.flatnonzero(w)
        for _ in range(20):
            e = 1 / (1 + np.exp(-self.logits(w0, w))) - self.y
            gradient = np.abs(self._summed(e * self.scale)) / max(len(self.y), 1)
            more = np.setdiff1d(np.flatnonzero((gradient > 1.001 * penalty) & (self.share > 0)), some)
            if not len(more):
                break
            some = np.union1d(some, more)
            w0 = self._solved(w0, w, some, penalty, 0.0)
        return w0, w

    def again(self, w0: float, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The weights that aren't zero without L1, with a little ridge."""
        w, some = w.copy(), np.flatnonzero(w)
        return (self._solved(w0, w, some, np.zeros(BUCKETS), RIDGE / max(len(self.y), 1)), w) if len(some) else (w0, w)


def fitted(rows: list[np.ndarray], y: np.ndarray) -> Machine:
    """The whole model of rows of bucket numbers."""
    prior = min(max(float(y.mean()), 0.01), 0.99)
    checked, trained = parts_of(len(rows))
    part = Weights([rows[i] for i in trained], y[trained], prior)
    test = Weights([rows[i] for i in checked], y[checked], prior)
    # the largest of so many gradients of mere noise is about so many standard deviations from zero
    strength = np.sqrt(2 * np.log(max(int((part.share > 0).sum()), 2)))
    first = part.fitted(strength)
    best = min(((log_losses(test.logits(*f), y[checked]).mean(), k, f) for k, f in enumerate((first, part.again(*first)))), key=lambda x: x[:2])
    machine = Machine(BUCKETS, prior)
    machine.w0, machine.w = best[2]
    return machine.fit(rows, y)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, int], Machine]:
    """The buckets that matter, and the fitted model over these."""
    known = labels.filter(~held_out("doc_id")).filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows are broadcast
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    # a labelled doc_id may have any number of rows: one each is chosen before they meet
    chosen_text = F.min_by(F.struct("toxic", "text"), F.struct(F.xxhash64("text"), "text")).alias("r")
    texts = written(texts.groupBy("doc_id").agg(chosen_text).select("doc_id", "r.toxic", "r.text"), "toxic-sample")

    def make():
        terms = Terms()
        return lambda part, batch: {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "terms": [active(t, terms) for t in part]}

    rows = map_texts(texts, make, "doc_id bigint, toxic int, terms array<int>").toArrow()  # `sample` rows at most
    if not len(rows):
        return {}, Machine(0, 0.05)
    terms = rows.column("terms").combine_chunks()
    flat, offsets = terms.values.to_numpy(), terms.offsets.to_numpy()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    whole = fitted([flat[offsets[i] : offsets[i + 1]] for i in order.tolist()], rows.column("toxic").to_numpy()[order].astype(float))
    some = np.flatnonzero((whole.w != 0) | (whole.v != 0).any(1))  # what the others have adds nothing
    machine = Machine(0, 0.5)
    machine.w0, machine.w, machine.v = whole.w0, whole.w[some], whole.v[some]
    return {b: i for i, b in enumerate(some.tolist())}, machine


def scores(docs: DataFrame, chosen: dict[int, int], machine: Machine) -> DataFrame:
    """doc_id, score of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast((chosen, machine.w0, machine.w, machine.v))

    def make():
        chosen, w0, w, v = model.value
        m = Machine(0, 0.5)
        m.w0, m.w, m.v = w0, w, v
        terms = Terms(chosen)

        def f(texts, batch):
            rows = [active(t, terms) for t in texts]
            z = m.logits(np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))
            return {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-z))}

        return f

    return map_texts(docs.select(F.col("doc_id").cast("bigint"), "text"), make, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scores(docs, *train(docs, labels, sample))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
