"""Operator 3: a quality classifier by positive-unlabelled learning.

The squared loss makes the risk on unlabelled text a quadratic form in the weights, so its second moments, summed in one pass over all
documents, stand for every one of them: no sample of unlabelled text is taken. Two more passes count scores, for the class prior and
for the scale of the scores.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atollkit.llm.common import U, Words, prefix_sums, runs, trim, windows_hash

CELLS = 512
WIDTH = 256 + CELLS + 6
#: Bound of the sample of labelled rows: trusted texts (label 1) that are learnt from.
POSITIVES = 3000
FOLDS = 5
#: Bytes of texts whose features are worked out at once (about 60 bytes of arrays each), and rows of a batch that are taken out of it at once.
RUN, ROWS = 1 << 18, 512
#: Matrices of sums that one task adds up.
FAN_IN = 16
#: Scores are counted in so many equal steps from -3 to 3.
STEPS = 6000


def features(rows: list[bytes]) -> np.ndarray:
    """One row a text: roots of the shares of bytes and of hashed words, sizes, repeated words, word triples and lines."""
    parts = list(feature_runs(rows))
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)


def feature_runs(rows: list[bytes]) -> Iterator[np.ndarray]:
    """The features of consecutive runs of about RUN bytes, each text counted with a kilobyte more, one run in memory at a time."""
    for lo, hi in runs(rows, RUN, per_row=1024):
        yield _features(rows[lo:hi])


def column_runs(texts: pa.Array) -> Iterator[np.ndarray]:
    """feature_runs of an Arrow column, of which a few rows at a time become bytes of Python."""
    for lo in range(0, len(texts), ROWS):
        yield from feature_runs(texts.slice(lo, ROWS).cast(pa.binary()).to_pylist())
    trim()


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, owner))
    o, h = owner[order], h[order]
    new = np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1]))[: len(o)]
    return np.bincount(o[new], minlength=n)


def _features(rows: list[bytes]) -> np.ndarray:
    n = len(rows)
    w = Words(rows)
    owner, count = w.owner(), w.count
    sizes = np.diff(w.at)
    byte_owner = np.repeat(np.arange(n), sizes)
    per_byte = np.bincount(byte_owner * 256 + np.frombuffer(w.raw, np.uint8), minlength=n * 256).reshape(n, 256) / sizes[:, None]
    words = np.maximum(count, 1)
    per_word = np.bincount(owner * CELLS + (w.hash >> U(40)).astype(np.int64) % CELLS, minlength=n * CELLS).reshape(n, CELLS) / words[:, None]
    length = np.bincount(owner, weights=w.end - w.start, minlength=n)
    triples = windows_hash(prefix_sums(w.hash, 1), 3, 1)[: max(0, len(owner) - 2)]
    inside = owner[: len(triples)] == owner[2:] if len(triples) else np.zeros(0, bool)
    t_owner = owner[: len(triples)][inside]
    n_triples = np.bincount(t_owner, minlength=n)
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in rows]
    dup_lines = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    dense = np.stack([
        np.log1p(count), np.log1p(length / words), 1 - _distinct(owner, w.hash, n) / words,
        1 - (_distinct(t_owner, triples[inside], n) + (n_triples == 0)) / np.maximum(n_triples, 1), dup_lines, np.log1p([len(x) for x in lines]),
    ], 1)
    return np.concatenate([np.sqrt(per_byte), np.sqrt(per_word), dense], 1).astype(np.float32)


class Model:
    """Weights (the last one is the bias), the class prior that they were fitted with, and the value at score 0.3 and slope of the score."""

    def __init__(self, weights: np.ndarray, prior: float, edge: float = -0.4, slope: float = 2.118):
        self.weights, self.prior, self.edge, self.slope = weights, prior, edge, slope

    def value(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1].astype(np.float32) + np.float32(self.weights[-1])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.value(x).astype(np.float64) - self.edge) + np.log(0.3 / 0.7)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrated(self, positive: np.ndarray, unlabelled: np.ndarray) -> Model:
        """The same order of texts, with scores by where positives and all unlabelled text lie (values; counts of values).

        By the class prior the positives among unlabelled text begin at one value, all but one in 200 of the known ones lie above another.
        Score 0.3 is a third of the way from the first to the second (which lies too high, as those were learnt from), 0.95 the
        median of the known ones."""
        share = np.cumsum(unlabelled[::-1])[::-1] / max(1, unlabelled.sum())
        begin = np.flatnonzero(share >= self.prior)[-1] / STEPS * 6 - 3 if unlabelled.sum() else -0.4
        low = float(np.quantile(positive, 0.005))
        edge = min(begin + (low - begin) / 3, low)
        wide = float(np.median(positive)) - edge
        return Model(self.weights, self.prior, edge, (np.log(0.95 / 0.05) - np.log(0.3 / 0.7)) / wide if wide > 0 else self.slope)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights, others=[self.prior, self.edge, self.slope])
        return out.getvalue()


@lru_cache(4)
def load(raw: bytes) -> Model:
    x = np.load(io.BytesIO(raw))
    return Model(x["weights"], *(float(v) for v in x["others"]))


def moments(x: np.ndarray) -> np.ndarray:
    """Sums of products of each two features, with a feature that is 1 at the end."""
    one = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    return (one.T @ one).astype(np.float64)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.2, decay: float = 1e-2) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) for the squared loss (1 - y * f)**2 / 4 of a linear f.

    positive and unlabelled are second moments (see moments). Each step goes down the risk, scaled by its curvature; where the
    second part is below 0 it counts as 0 and the first part alone is followed (the non-negative risk of Kiryo et al., 2017)."""
    p, u, ridge = _scaled(positive, unlabelled, decay)
    back = np.linalg.inv(u / 2 + ridge)
    minus = lambda w, m: (m[-1, -1] + 2 * m[-1] @ w + w @ m @ w) / 4
    plus = lambda w: prior * (p[-1, -1] - 2 * p[-1] @ w + w @ p @ w) / 4
    risk = lambda w: plus(w) + max(0.0, minus(w, u) - prior * minus(w, p)) + w @ ridge @ w / 2
    w = np.zeros(len(u))
    now = risk(w)
    for _ in range(steps):
        rest = (u[-1] + u @ w) / 2 - prior * (p[-1] + p @ w) / 2 if minus(w, u) >= prior * minus(w, p) else 0
        step = back @ (prior * (p @ w - p[-1]) / 2 + rest + ridge @ w)
        after = risk(w - rate * step)
        if after > now:
            rate /= 2
            continue
        w, now = w - rate * step, after
    return Model(w, prior)


def _scaled(positive: np.ndarray, unlabelled: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean second moments, and a ridge by each feature's spread."""
    p, u = positive / positive[-1, -1], unlabelled / unlabelled[-1, -1]
    spread = np.diag(u) - u[-1] ** 2 + np.diag(p) - p[-1] ** 2 + 1e-4
    return p, u, np.diag(decay * np.append(spread[:-1], 1e-6))


def told_apart(positive: np.ndarray, unlabelled: np.ndarray, decay: float = 1.0) -> Model:
    """The direction that best tells positives from unlabelled text; no prior is needed for it."""
    p, u, ridge = _scaled(positive, unlabelled, decay)
    return Model(np.linalg.solve((p + u) / 2 + ridge, (p[-1] - u[-1]) / 2), 0.5)


def held_out(doc_id) -> F.Column:
    """Fold 0 of FOLDS by the CRC-32 of the id as text; null ids are in no fold and train nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def total_moments(texts: DataFrame) -> np.ndarray:
    """Second moments of all rows of texts: one matrix a task, then sums of FAN_IN matrices each until few are left."""
    corner = np.triu_indices(WIDTH + 1)

    def first(batches):
        trim()
        total = np.zeros((WIDTH + 1, WIDTH + 1))
        for b in batches:
            for x in column_runs(b.column("text")):
                total += moments(x)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total[corner].tobytes()], pa.binary())], ["part", "sums"])

    def added(key, t):
        total = np.zeros(len(corner[0]))
        for raw in t.sort_by("part").column("sums"):
            total += np.frombuffer(raw.as_buffer())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    left = texts.rdd.getNumPartitions()
    sums = texts.mapInArrow(first, "part long, sums binary")
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        sums = sums.groupBy((F.col("part") % left).alias("to")).applyInArrow(added, "part long, sums binary")
    out = np.zeros((WIDTH + 1, WIDTH + 1))
    for _, raw in sorted(tuple(r) for r in sums.collect()):
        out[corner] += np.frombuffer(raw)
    return out + np.triu(out, 1).T


def counted_scores(texts: DataFrame, model: Model) -> np.ndarray:
    """How many rows of texts have a value in each of STEPS steps: at most STEPS rows leave each task."""
    raw = model.dump()

    def run(batches):
        total = np.zeros(STEPS, np.int64)
        for b in batches:
            for x in column_runs(b.column("text")):
                total += steps_of(load(raw).value(x))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["step", "n"])

    out = np.zeros(STEPS, np.int64)
    for r in texts.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        out[r.step] = r.n
    return out


def steps_of(values: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip((values + 3) * (STEPS / 6), 0, STEPS - 1).astype(np.int64), minlength=STEPS)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from counts of scores of positives that were not learnt from, and of unlabelled text.

    Above any threshold the share of unlabelled text is at least prior times that of positives, and least above it where
    only positives are left: the least ratio over thresholds, each share of positives (a half at
    least) less two sampling errors, is the estimate."""
    n, m = max(1, positive.sum()), max(1, unlabelled.sum())
    p, u = np.cumsum(positive[::-1]) / n, np.cumsum(unlabelled[::-1]) / m
    sure = p - 2 * np.sqrt(p * (1 - p) / n) - 1 / n
    ratio = u[sure > 0.5] / sure[sure > 0.5] if (sure > 0.5).any() else np.ones(1)
    return float(np.clip(ratio.min(), 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> Model:
    """Fit on at most `positives` trusted texts (label 1; those with the smallest hashes of their ids) and on all other text, as far as
    it is not held out.

    Negative labels are not read. The class prior is estimated: half of the positives are told from unlabelled text, the scores
    of the other half against those of all unlabelled text give it. Three passes over all text: moments, scores for the prior, scores
    for the calibration. Without any positive or any unlabelled text the model gives each
    text 0.5."""
    marks = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = marks.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(positives)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # At most `positives` integers: a broadcast of bounded size.
    rows = texts.join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in batches:
            x = np.concatenate([np.zeros((0, WIDTH), np.float32), *column_runs(b.column("text"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "doc_id long, x binary").dropDuplicates(["doc_id"]).collect())
    x = np.array([np.frombuffer(r, np.float32) for _, r in got]).reshape(-1, WIDTH)
    all_ = total_moments(texts.select("text"))
    if not len(x) or all_[-1, -1] == 0:
        return Model(np.zeros(WIDTH + 1), 0.5)
    half = np.arange(len(x)) % 2 == 0 if len(x) > 1 else np.ones(1, bool)
    first = told_apart(moments(x[half]), all_)
    prior = estimated_prior(steps_of(first.value(x[~half] if len(x) > 1 else x)), counted_scores(texts.select("text"), first))
    model = fit(moments(x), all_, prior)
    return model.calibrated(model.value(x), counted_scores(texts.select("text"), model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' rows as a struct (doc) with their score in 0 to 1: one pass, no shuffle.

    Score reads the whole text alone; null counts as empty and gets a score too."""
    raw = model.dump()
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trim()
        for t in texts:
            yield pa.array(np.concatenate([np.zeros(0), *(load(raw).score(x) for x in column_runs(t))]), pa.float64())

    return rows.select("doc", F.arrow_udf(run, "double")("text").alias("score"))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their own columns."""
    return score(docs, train(docs, labels)).where(F.col("score") >= threshold).select("doc.*")
