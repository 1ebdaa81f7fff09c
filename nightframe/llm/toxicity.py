"""Toxicity by classifier chains (operator 5).

Categories are predicted in order; each category's linear model also reads the
probabilities of those before it. For training these are out-of-fold: the
labelled rows fall into folds by a hash of their id, and a row's probability
comes from the model that has not seen its fold, so a later model learns from
what earlier ones really predict.

Features are sets of hashed words, word beginnings and word endings of the whole
text (A-Z lower-cased, split at everything but letters), so a text's length does
not weigh on its score. Which features a model may use is chosen by a test of
association over ALL labelled rows, computed in Spark; the weights, with an L1
penalty and then free of it, are fitted on the driver to at most ``max_rows`` labelled rows, drawn by
a hash of their id, each reduced to its chosen features.

Categories come from the labels: ``low_quality`` (quality 0), ``toxic`` and
``severe`` (both). A document is rejected where ``toxic`` has a probability of
at least ``THRESHOLD``.

Nulls and texts without words have no features and get the models' base rates;
labels without an id, text or value are ignored; ids with several labels or
texts count each pair; repeated rows get equal scores; without labels every
probability is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .textbytes import LOWER, SpanHash, mix, runs, slices, word_spans

#: Labelled rows that the weights are fitted to, at most.
MAX_ROWS = 10_000
FOLDS = 5
#: Features of a model, at most, and labelled documents that a feature must be in.
MAX_FEATURES = 1024
KEPT = 200
#: Labels that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
MIN_DOCS = 4
THRESHOLD = 0.5
CATEGORIES = ("low_quality", "toxic", "severe")
BREAKS = np.ones(256, bool)
BREAKS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Beginnings and endings of words, in bytes.
HEADS = (4, 5, 6, 7)
TAILS = (5,)


def features(data: np.ndarray, offsets: np.ndarray):
    """Words once for all rows that have them: (row of each word, its number, number of each feature's word, feature).

    A slice's rows share most words, so the parts are hashed for distinct words only.
    """
    starts, ends, first = word_spans(data, offsets, BREAKS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    span = SpanHash(data, LOWER)
    whole, at, number = np.unique(span.of(starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[at], ends[at]
    words, out = [np.arange(len(whole))], [whole]
    for k in HEADS:
        at = np.flatnonzero(ends - starts > k)
        words.append(at)
        out.append(mix(span.of(starts[at], starts[at] + k) ^ np.uint64(k)))
    for k in TAILS:
        at = np.flatnonzero(ends - starts > k)
        words.append(at)
        out.append(mix(span.of(ends[at] - k, ends[at]) ^ np.uint64(100 + k)))
    return row, number, np.concatenate(words), np.concatenate(out)


def spread(row: np.ndarray, number: np.ndarray, word: np.ndarray, feature: np.ndarray, n_features: int):
    """Distinct (row, feature) for numbered features of words."""
    order = np.argsort(word, kind="stable")
    word, feature = word[order], feature[order]
    lo, hi = np.searchsorted(word, number, "left"), np.searchsorted(word, number, "right")
    size = hi - lo
    has = np.flatnonzero(size)
    lo, size = lo[has], size[has]
    key = np.unique(np.repeat(row[has], size) * n_features + feature[np.repeat(lo, size) + runs(size)])
    return key // n_features, key % n_features


@dataclass
class Linear:
    """A logistic model over chosen features and the chain's earlier probabilities."""

    bias: float = -40.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chain: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, row: np.ndarray, feature: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        score = np.bincount(row, self.weights[feature], n) if len(row) else np.zeros(n)
        score = score + self.bias + before[:, : len(self.chain)] @ self.chain
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def _descend(row, feature, n, width, before, y, l1: float, l2: float, steps: int) -> Linear:
    """Accelerated proximal gradient of the logistic loss with an L1 and L2 penalty."""
    chain = before.shape[1]
    if not n or not y.any():
        return Linear(weights=np.zeros(width), chain=np.zeros(chain))
    w = np.zeros(width + chain + 1)
    z, t = w.copy(), 1.0
    per_row = np.bincount(row, minlength=n).max() if len(row) else 0
    rate = 4.0 / (1 + chain + min(per_row, 64))
    for _ in range(steps):
        score = (np.bincount(row, z[feature], n) if len(row) else np.zeros(n)) + before @ z[width:-1] + z[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) / n
        grad = np.concatenate([np.bincount(feature, error[row], width) if len(row) else np.zeros(width), before.T @ error, [error.sum()]])
        new = z - rate * (grad + l2 * z)
        new[:width] = np.sign(new[:width]) * np.maximum(np.abs(new[:width]) - rate * l1, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return Linear(float(w[-1]), w[:width], w[width:-1])


def fit(row, feature, n, width, before, y, ridge: float = 0.2, rounds: int = 12) -> Linear:
    """Sparse weights in two steps: an L1 penalty chooses features, Newton steps with a small ridge set their weights."""
    first = _descend(row, feature, n, width, before, y, 6e-4, 1e-5, 200)
    if not n or not y.any():
        return first
    kept = np.sort(np.argsort(-np.abs(first.weights), kind="stable")[:KEPT])
    kept = kept[np.abs(first.weights[kept]) > 1e-3]
    number = np.full(width, -1)
    number[kept] = np.arange(len(kept))
    x = np.zeros((n, len(kept) + before.shape[1] + 1), np.float64)
    at = np.flatnonzero(number[feature] >= 0) if len(row) else np.zeros(0, np.int64)
    x[row[at], number[feature[at]]] = 1
    x[:, len(kept) : -1] = before
    x[:, -1] = 1
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = np.zeros(width)
    weights[kept] = w[: len(kept)]
    return Linear(float(w[-1]), weights, w[len(kept) : -1])


@dataclass
class Chain:
    """Trained chain: sorted hashes of its features and a model for each category."""

    names: tuple[str, ...]
    hashes: np.ndarray
    models: list[Linear]

    def entries(self, data: np.ndarray, offsets: np.ndarray):
        """(row, feature number) of a slice."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, number, word, h = features(data, offsets)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        keep = self.hashes[at] == h
        return spread(row, number, word[keep], at[keep], len(self.hashes))

    def predict(self, row, feature, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.predict(row, feature, n, out)
        return out


def _targets(labels: DataFrame, key: str) -> DataFrame:
    """(doc_id, y array<int>) of complete labels."""
    low, toxic = (F.col("quality") == 0), (F.col("toxic") == 1)
    rows = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return rows.select(F.col(key).cast("long").alias("doc_id"), F.array(*(c.cast("int") for c in (low, toxic, low & toxic))).alias("y")).distinct()


def association(labelled: DataFrame, n_rows: int, positives: list[int], max_features: int, min_docs: int) -> np.ndarray:
    """Sorted hashes of the features that go with or against a category most, over all labelled rows."""
    k = len(positives)

    def run(batches):
        for batch, data, offsets in slices(batches, "text", 4 << 20):
            row, number, word, h = features(data, offsets)
            h, feature = np.unique(h, return_inverse=True)
            row, feature = spread(row, number, word, feature, max(1, len(h)))
            y = np.array(batch.column("y").to_pylist(), np.int64).reshape(-1, k)[row]
            n = np.bincount(feature, minlength=len(h))
            sums = [np.bincount(feature, y[:, j], len(h)).astype(np.int64) for j in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), *(pa.array(x) for x in sums)], ["h", "n", *(f"p{j}" for j in range(k))])

    counts = labelled.mapInArrow(run, "h long, n long, " + ", ".join(f"p{j} long" for j in range(k))).groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", *(f"p{j}" for j in range(k))))).filter(F.col("n") >= min_docs)
    scores = [F.abs(F.col(f"p{j}") - F.col("n") * (p / n_rows)) / F.sqrt(F.col("n") * max(p / n_rows * (1 - p / n_rows), 1e-9)) for j, p in enumerate(positives)]
    best = counts.select("h", F.greatest(*scores).alias("score")).orderBy(F.desc("score"), "h").limit(max_features)
    return np.sort(np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, folds: int = FOLDS, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> Chain:
    """The chain for the labelled documents."""
    k = len(CATEGORIES)
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    targets = scratch.written(_targets(labels, key), "targets")
    if targets.count() <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    labelled = scratch.written(rows.join(targets, "doc_id"), "labelled")
    stats = labelled.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.col("y")[j]), F.lit(0)).alias(f"p{j}") for j in range(k))).first()
    n_rows, positives = stats["n"], [stats[f"p{j}"] for j in range(k)]
    if not n_rows:
        return Chain(CATEGORIES, np.zeros(0, np.uint64), [Linear() for _ in CATEGORIES])
    chain = Chain(CATEGORIES, association(labelled, n_rows, positives, max_features, min_docs), [])
    # the sample: the max_rows rows with the least hashes of id and text, each as its few chosen features
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    labelled = labelled.withColumn("draw", draw)
    share = int(min(1.0, 1.2 * max_rows / n_rows) * (1 << 20))

    def reduce_rows(batches):
        for batch, data, offsets in slices(batches, "text"):
            row, f = chain.entries(data, offsets)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(f.astype(np.int32))), batch.column("draw")], ["doc_id", "y", "f", "draw"])

    def sampled(rows):
        fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds))
        rows = rows.mapInArrow(reduce_rows, "doc_id long, y array<int>, f array<int>, draw long").withColumn("fold", fold)
        return rows.orderBy("draw", "doc_id", "f", "y").limit(max_rows).collect()

    # rows of few ids and texts may all lie beyond the share of hashes that is looked at first
    sample = sampled(labelled.filter(F.col("draw") <= share)) or sampled(labelled)
    n, width = len(sample), len(chain.hashes)
    y = np.array([r["y"] for r in sample], np.float64).reshape(n, k)
    fold = np.array([r["fold"] for r in sample], np.int64)
    row = np.repeat(np.arange(n), [len(r["f"]) for r in sample])
    feature = np.array([x for r in sample for x in r["f"]], np.int64)
    out_of_fold = np.zeros((n, k))
    for j in range(k):
        for f in range(folds):
            inside, outside = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            number = np.zeros(n, np.int64)
            number[outside] = np.arange(len(outside))
            e = fold[row] != f
            model = fit(number[row[e]], feature[e], len(outside), width, out_of_fold[outside, :j], y[outside, j])
            number[inside] = np.arange(len(inside))
            out_of_fold[inside, j] = model.predict(number[row[~e]], feature[~e], len(inside), out_of_fold[inside])
        chain.models.append(fit(row, feature, n, width, out_of_fold[:, :j], y[:, j]))
    return chain


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, p_<category>..., toxic_pred) of every row; ``keep``: the columns to return instead of the key."""
    keep = keep or [key]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = [f"p_{c}" for c in chain.names]

    def run(batches):
        for batch, data, offsets in slices(batches, text):
            p = chain.predict(*chain.entries(data, offsets), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(p[:, j]) for j in range(len(names)))], [*keep, *names])

    wanted = list(dict.fromkeys([*keep, text]))
    return docs.select(*wanted).mapInArrow(run, f"{fields}, " + ", ".join(f"{c} double" for c in names)).withColumn("rejected", F.col("p_toxic") >= THRESHOLD)


def reject(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The documents that the chain doesn't reject, with their own columns."""

    def run(batches):
        for batch, data, offsets in slices(batches, text):
            p = chain.predict(*chain.entries(data, offsets), batch.num_rows)[:, chain.names.index("toxic")]
            yield batch.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
