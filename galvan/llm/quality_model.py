"""Quality classifier by co-training.

Two views of a document that share no input: its content (shares of character classes, common words and hashed words, repetition, word
lengths; no lengths of the whole) and its page metadata (source, language and n_chars as the table has them). A logistic regression over binned
features is trained on each view. In each round both score all unlabelled documents, and each hands its most confident ones (until SHARE
of the unlabelled documents is reached, CONFIDENT or more, in the proportion of the classes), with their pseudo-labels, to the other's
training set. At last both are calibrated on labelled documents that neither was trained on (Platt scaling), and a logistic
regression of the calibrated logits combines them to score all documents.

The unlabelled documents never leave their tasks. Cut-offs of confidence come from a histogram of scores, and weights from Newton steps on
summed gradients and curvatures, so a round is a few passes over a table of small numbers. Which rows were handed in earlier rounds follows
from the models and cut-offs of these rounds, so no state is written. All pseudo-labels together weigh half as much as the labels.

Labels of at most LABELLED documents are fitted, those of the smallest hashes of doc_id; bins and calibration come from them.
Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read. No label and no doc_id is an input of a score.

Defined results: a null or empty text is a document without words; null source, language or n_chars is a value of its own; repeated doc_ids
and repeated rows give a row each, repeated labels count once, by the lowest; a null doc_id has no label; a score of 0.5 is predicted good; with
fewer than 20 labelled documents, or one class only, the score is the share of good ones (0.5 without labels); an empty table gives no rows; texts of any length
are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules
from .common import WordHashes, hashed_words, map_texts, of_worker, table, written
from .toxicity import held_out

LABELLED = 10_000
ROUNDS, SHARE, CONFIDENT, STEPS = 5, 0.02, 0.75, 2
BINS, HASHED, WORD_BUCKETS = 12, 64, 16
#: Bins of the histogram of scores.
SCORES = 2000
#: Sums that a task adds up.
FAN = 16
CONTENT = [*(f"share of {c}" for c in quality_rules.CLASSES), "common words", "repeated words", "repeated lines", "letters a word", *(f"words of bucket {i}" for i in range(WORD_BUCKETS))]
SCHEMA = "doc_id bigint, content array<double>, source int, lang int, layout array<double>"


def _hashed(x: str | None) -> int:
    return xxhash.xxh3_64_intdigest("null" if x is None else "v" + x) % HASHED


def _views():
    base, cache = quality_rules._features(), of_worker("words", WordHashes)

    def f(texts, batch):
        b = base(texts, batch)
        chars, words, n = np.array(b["chars"], float).reshape(-1, 8), np.array(b["words"], float).reshape(len(texts), -1), np.asarray(b["n_words"], float)
        total = np.maximum(chars.sum(1), 1)
        lines = np.array([t.count("\n") + 1 for t in texts], float)
        some = np.maximum(n, 1)
        h, offsets = hashed_words([t.split() for t in texts], cache)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        buckets = np.bincount(doc * WORD_BUCKETS + (h % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=len(texts) * WORD_BUCKETS).reshape(len(texts), WORD_BUCKETS)
        content = np.column_stack([chars / total[:, None], 1 - words[:, 0] / some, b["n_repeat_words"] / some, np.array(b["n_dup_lines"]) / lines, b["word_chars"] / some, buckets / np.maximum(buckets.sum(1, keepdims=True), 1)])
        size = np.log1p(np.array([-0.5 if x is None else max(x, 0) for x in batch.column("n_chars").to_pylist()], float))
        return {"doc_id": batch.column("doc_id"), "content": list(content), "source": [_hashed(x) for x in batch.column("source").to_pylist()], "lang": [_hashed(x) for x in batch.column("lang").to_pylist()], "layout": list(size[:, None])}

    return f


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def curvature(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient and, row by row, curvature of the logistic likelihood, one after another. x: places that are one in each row."""
    n = len(w)
    g, h = np.zeros(n), np.zeros((n, n))
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        dense = np.zeros((len(part), n), np.float32)
        np.put_along_axis(dense, part, 1, 1)
        p = sigmoid(w[part].sum(1))
        g += dense.T @ (weight[i : i + 4096] * (y[i : i + 4096] - p))
        h += (dense * (weight[i : i + 4096] * p * (1 - p))[:, None].astype(np.float32)).T @ dense
    return np.concatenate([g, h.ravel()])


def stepped(w: np.ndarray, sums: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights after a Newton step with a ridge."""
    n = len(w)
    return w + np.linalg.solve(sums[n:].reshape(n, n) + ridge * np.eye(n), sums[:n] - ridge * w)


class Binner:
    """Numbers -> places of one-hot features, by quantiles; hashed values have places of their own, and place 0 is the intercept."""

    def __init__(self, numbers: np.ndarray, n_hashed: int) -> None:
        self.edges = [np.unique(np.quantile(numbers[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(numbers.shape[1])]
        self.size = 1 + BINS * numbers.shape[1] + HASHED * n_hashed

    def places(self, numbers: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        k = len(self.edges)
        binned = [1 + BINS * j + np.searchsorted(e, numbers[:, j], "right") for j, e in enumerate(self.edges)]
        return np.column_stack([np.zeros(len(numbers), np.int64), *binned, *(1 + BINS * k + HASHED * j + hashed[:, j] for j in range(hashed.shape[1]))]).astype(np.int64)


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of y on the columns of z and 1."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    w[:-1] = 1 / max(1, x.shape[1] - 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


class Handed(NamedTuple):
    """A round: both models' weights and, of each view, the score up to which and from which its documents were handed on."""

    weights: list[np.ndarray]
    cuts: list[tuple[float, float]]


def pseudo(views: list[np.ndarray], history: list[Handed], i: int) -> np.ndarray:
    """What view i was handed by the other: 1, 0, or -1 for nothing."""
    out = np.full(len(views[0]), -1, np.int8)
    for r in history:
        p = sigmoid(r.weights[1 - i][views[1 - i]].sum(1))
        low, high = r.cuts[1 - i]
        out = np.where(out >= 0, out, np.where(p >= high, 1, np.where(p <= low, 0, -1))).astype(np.int8)
    return out


def cutoffs(scores: np.ndarray, share: float, most: float) -> tuple[float, float]:
    """(up to, from) which scores are handed on, from their histogram: bins from both ends until `most` of them are reached, of each
    class its share. Equal scores go together."""
    total, edges = scores.sum(), np.arange(SCORES + 1) / SCORES
    down = int(np.searchsorted(np.cumsum(scores), most * total * (1 - share))) + 1
    up = int(np.searchsorted(np.cumsum(scores[::-1]), most * total * share)) + 1
    return min(edges[min(down, SCORES)] - 1e-12, 1 - CONFIDENT), max(edges[max(SCORES - up, 0)], CONFIDENT)


class CoTrained:
    """Two models, their calibration and combination."""

    def __init__(self, content: np.ndarray, meta: np.ndarray, hashed: np.ndarray, y: np.ndarray) -> None:
        """Trains on labelled rows, but for each fifth."""
        self.binners = [Binner(content, 0), Binner(meta, 2)]
        self.views, self.y = self.places(content, meta, hashed), y.astype(float)
        self.calibration = np.arange(0, len(y), 5)
        self.train = np.setdiff1d(np.arange(len(y)), self.calibration)
        self.share = float(self.y[self.train].mean())
        self.weights = [np.zeros(b.size) for b in self.binners]
        self.history: list[Handed] = []
        for _ in range(8):
            self.step([0.0, 0.0])

    def step(self, more: list) -> None:
        """A Newton step on the labelled rows and the sums over handed ones."""
        for i in (0, 1):
            own = curvature(self.weights[i], self.views[i][self.train], self.y[self.train], np.ones(len(self.train)))
            self.weights[i] = stepped(self.weights[i], own + more[i])

    def calibrate(self) -> CoTrained:
        y = self.y[self.calibration]
        z = np.column_stack([w[v[self.calibration]].sum(1) for w, v in zip(self.weights, self.views, strict=True)])
        self.scales = [platt(z[:, [i]], y) for i in (0, 1)]
        self.both = platt(self._scaled(z), y)
        del self.views, self.y, self.calibration, self.train
        return self

    def places(self, content, meta, hashed) -> list[np.ndarray]:
        return [self.binners[0].places(content, hashed[:, :0]), self.binners[1].places(meta, hashed)]

    def _scaled(self, z: np.ndarray) -> np.ndarray:
        return np.column_stack([z[:, i] * s[0] + s[1] for i, s in enumerate(self.scales)])

    def scores(self, content, meta, hashed) -> np.ndarray:
        """Of the content, of the metadata, of both."""
        z = self._scaled(np.column_stack([w[v].sum(1) for w, v in zip(self.weights, self.places(content, meta, hashed), strict=True)]))
        return sigmoid(np.column_stack([z, z @ self.both[:-1] + self.both[-1]]))


def summed(pool: DataFrame, f: Callable[[list[np.ndarray]], np.ndarray], binners: list[Binner], size: int) -> np.ndarray:
    """The sum of f over the pool's rows, given by their places in both views. Tasks add up their rows, and then FAN at a time each other's
    sums, until one row is left, which is all that the driver gets."""
    schema = pa.schema([("part", pa.int64()), ("sums", pa.binary())])

    def add(batches):
        from pyspark import TaskContext

        total = np.zeros(size)
        for b in batches:
            content, meta, hashed = _arrays({c: b.column(c).to_pylist() for c in ("content", "source", "lang", "layout")})
            total += f([binners[0].places(content, hashed[:, :0]), binners[1].places(meta, hashed)])
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "sums": [total.tobytes()]}, schema=schema)

    def join(key, t):
        return pa.Table.from_pydict({"part": [key[0].as_py()], "sums": [sum(np.frombuffer(x.as_py()) for x in t.sort_by("part").column("sums")).tobytes()]}, schema=schema)

    rows, left = pool.mapInArrow(add, "part bigint, sums binary"), pool.rdd.getNumPartitions()
    while left > 1:
        rows, left = rows.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(join, "part bigint, sums binary"), -(-left // FAN)
    return sum((np.frombuffer(r.sums) for r in rows.collect()), np.zeros(size))


def exchange(pool: DataFrame, m: CoTrained, rounds: int) -> None:
    """Rounds of handing on pseudo-labels and of training with them."""
    binners, sizes = m.binners, [len(w) ** 2 + len(w) for w in m.weights]
    for _ in range(rounds):
        weights, history = list(m.weights), list(m.history)

        def free(views, weights=weights, history=history):
            out = []
            for i in (0, 1):  # scores of view i where the other has no label yet
                p = sigmoid(weights[i][views[i]].sum(1))[pseudo(views, history, 1 - i) < 0]
                out.append(np.bincount(np.minimum((p * SCORES).astype(int), SCORES - 1), minlength=SCORES))
            return np.concatenate(out).astype(float)

        found = summed(pool, free, binners, 2 * SCORES).reshape(2, SCORES)
        m.history.append(Handed(weights, [cutoffs(found[i], m.share, SHARE) for i in (0, 1)]))
        history = list(m.history)
        counts = summed(pool, lambda v, history=history: np.array([(pseudo(v, history, i) >= 0).sum() for i in (0, 1)], float), binners, 2)
        weight = [min(0.5, 0.5 * len(m.train) / max(c, 1)) for c in counts]
        for _ in range(STEPS):
            weights = list(m.weights)

            def curved(views, weights=weights, history=history):
                out = []
                for i in (0, 1):
                    y = pseudo(views, history, i)
                    out.append(curvature(weights[i], views[i][y >= 0], y[y >= 0].astype(float), np.ones(int((y >= 0).sum()))))
                return np.concatenate(out)

            sums = summed(pool, curved, binners, sum(sizes))
            m.step([sums[: sizes[0]] * weight[0], sums[sizes[0] :] * weight[1]])


def _arrays(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = lambda c, n: np.array(rows[c].tolist() if hasattr(rows[c], "tolist") else rows[c], float).reshape(-1, n)
    return wide("content", len(CONTENT)), wide("layout", 1), np.column_stack([np.asarray(rows["source"]), np.asarray(rows["lang"])]).astype(np.int64)


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, content_score, metadata_score, score, predicted (1: good)."""
    size = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    views = written(map_texts(docs.select(F.col("doc_id").cast("bigint"), "text", "lang", "source", size.alias("n_chars")), _views, SCHEMA), "views")
    known = labels.filter(~held_out("doc_id")).filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)  # at most `labelled` rows are broadcast
    fit = views.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id", kind="stable")
    y = fit.y.to_numpy(int)
    if len(y) < 20 or len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        out = views.select("doc_id", *[F.lit(share).alias(c) for c in ("content_score", "metadata_score", "score")])
    else:
        m = CoTrained(*_arrays(fit), y)
        if rounds:
            exchange(written(views.join(known.select("doc_id"), "doc_id", "left_anti"), "pool"), m, rounds)
        out = _score(views, m.calibrate())  # a few hundred weights, whatever the input
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _score(views: DataFrame, m: CoTrained) -> DataFrame:
    def run(batches):
        for b in batches:
            s = m.scores(*_arrays({c: b.column(c).to_pylist() for c in ("content", "source", "lang", "layout")}))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[:, i]) for i in range(3))], names=["doc_id", "content_score", "metadata_score", "score"])

    return views.mapInArrow(run, "doc_id bigint, content_score double, metadata_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
