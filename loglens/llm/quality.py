"""Quality classifier with hierarchical empirical Bayes over sites.

1. A logistic regression over words (hashed, present or not) and shares of character
   classes (binned) gives every document its own evidence for each label. It is fitted on
   about TRAIN_ROWS labelled documents, chosen by a hash of their id, whole texts.
2. Every document adds to its path and host its label, or without one its probability.
   Grouped sums give each label's mean per path, per host and over all; the spread of the
   means beyond chance gives the strength of the prior by moments. A host's posterior mean
   is shrunk to the global mean, a path's to its host's: sparse sites stay near their parent.
3. A document's posterior log-odds are its own evidence less the global prior plus the
   path's posterior, from which its own share is left out.

Scoring is done in the scan task; sites are grouped sums over slim rows, pre-aggregated, so
one site may hold any share of the rows.

Edge cases: null text is empty; null hosts and paths are sites of their own; labels that are
null are not used, repeated labels of a document are averaged; without labels of both values
the evidence is 0 and the posterior that of the sites; rows are scored one by one, so repeated
rows repeat; ids that repeat share their labels; a null id has none; other columns are not touched.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Chunk, find_words, numbers, segment_sums, text_chunks, written

TRAIN_ROWS = 8000
BUCKETS = 1 << 20
#: A feature is used that at least so many documents of the sample hold, and whose share of
#: positive ones is so many standard errors from that of all.
LEAST_DOCS, LEAST_Z = 3, 4.0
RIDGE = 0.3
STEPS = 300
LABELS = ("quality", "toxic")

_U = np.uint64
_CLASSES = np.zeros((5, 256), dtype=np.uint8)
_CLASSES[0, 65:91] = 1                                                             # capitals
_CLASSES[1, 48:58] = 1                                                             # digits
_CLASSES[2, [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()"]] = 1   # symbols
_CLASSES[3, [32, *range(9, 14)]] = 1                                               # white space
_CLASSES[4, 128:] = 1                                                              # beyond ASCII
_BINS = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
N_FEATURES = BUCKETS + (len(_CLASSES) + 1) * 16


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the features that each row has, each once."""
    w = find_words(chunk, ALNUM_WORDS)
    packed = (w.doc.astype(_U) << _U(24)) | (w.hashes % _U(BUCKETS))
    packed.sort()
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
    size = np.maximum(np.diff(chunk.offsets), 1)
    rows, found = [(packed >> _U(24)).astype(np.int64)], [(packed & _U(0xFFFFFF)).astype(np.int64)]
    every = np.arange(len(chunk))
    for k, lut in enumerate(_CLASSES):
        share = segment_sums(lut[chunk.data].astype(np.int32), chunk.offsets) / size
        rows.append(every)
        found.append(BUCKETS + 16 * k + np.searchsorted(_BINS, share, side="left"))
    rows.append(every)
    found.append(BUCKETS + 16 * len(_CLASSES) + np.minimum(np.log2(size).astype(np.int64), 15))
    return np.concatenate(rows), np.concatenate(found)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic_regression(row: np.ndarray, feature: np.ndarray, y: np.ndarray, n_features: int) -> tuple[float, np.ndarray]:
    """Intercept and weights by gradient steps with momentum and scaled by feature (Adam)."""
    weights, bias = np.zeros(n_features), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, STEPS + 1):
        gap = sigmoid(bias + np.bincount(row, weights=weights[feature], minlength=len(y))) - y
        g = np.append(np.bincount(feature, weights=gap[row], minlength=n_features) + RIDGE * weights, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - t / (STEPS + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        weights, bias = weights - step[:-1], bias - step[-1]
    return bias, weights


def _fit(table: pa.Table) -> pa.Table:
    """Rows (label number, feature, weight) from rows (text, labels); feature -1 is the intercept."""
    rows, found, n = [], [], 0
    for chunk in text_chunks(iter(table.to_batches())):
        r, f = features(chunk)
        rows.append((r + n).astype(np.int32))
        found.append(f.astype(np.int32))
        n += len(chunk)
    row, feature = np.concatenate(rows), np.concatenate(found)
    del rows, found
    out = []
    for k, label in enumerate(LABELS):
        y = table.column(label).to_numpy(zero_copy_only=False).astype(float)
        known = ~np.isnan(y)
        use = known[row]
        r, f = (np.cumsum(known) - 1)[row[use]], feature[use]
        y = y[known]
        if len(y) and 0 < y.mean() < 1:
            count, positive = np.bincount(f, minlength=N_FEATURES), np.bincount(f, weights=y[r], minlength=N_FEATURES)
            error = np.sqrt(np.maximum(count * y.mean() * (1 - y.mean()) * (1 - count / len(y)), 1e-9))
            kept = np.flatnonzero((count >= LEAST_DOCS) & (np.abs(positive - count * y.mean()) >= LEAST_Z * error))
            number = np.full(N_FEATURES, -1)
            number[kept] = np.arange(len(kept))
            some = number[f] >= 0
            bias, weights = logistic_regression(r[some], number[f][some], y, len(kept))
            out.append((np.full(len(kept) + 1, k), np.append(-1, kept), np.append(bias, weights)))
    if not out:
        out = [(np.empty(0, np.int64),) * 3]
    k, f, w = (np.concatenate(x) for x in zip(*out))
    return pa.table({"label": pa.array(k, pa.int64()), "feature": pa.array(f, pa.int64()), "weight": pa.array(w, pa.float64())})


def labels_of(labels: DataFrame, id_col: str) -> DataFrame:
    """One row (id, quality, toxic) a document."""
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.avg(x).alias(x) for x in LABELS])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (label, feature; the last column is the intercept) of the document classifier."""
    known = labels_of(labels, id_col)
    total = max(1, known.count())
    some = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, train_rows / total) * (1 << 30))
    text = docs.select(F.col(id_col).alias("id"), "text").filter(F.col("id").isNotNull())
    sample = text.join(F.broadcast(some), "id").select("text", *[F.round(x).alias(x) for x in LABELS], F.lit(0).alias("one"))
    model = np.zeros((len(LABELS), N_FEATURES + 1))
    table = sample.groupBy("one").applyInArrow(_fit, "label long, feature long, weight double").toArrow()
    model[numbers(table.column("label")), numbers(table.column("feature"))] = numbers(table.column("weight"), np.float64)
    return model


def evidence(model: np.ndarray, chunk: Chunk) -> np.ndarray:
    """Log-odds of each label for each row."""
    row, feature = features(chunk)
    return np.stack([w[-1] + np.bincount(row, weights=w[feature], minlength=len(chunk)) for w in model])


def _strength(groups: DataFrame, n: str, k: str, parent: str) -> float:
    """Weight of the parent's mean, in documents, by moments: from the spread of the groups'
    means around their parents' beyond what chance gives."""
    within = F.col(parent) * (1 - F.col(parent))
    s = groups.agg(F.sum(F.col(n) * (F.col(k) / F.col(n) - F.col(parent)) ** 2).alias("spread"), F.sum(within).alias("chance"), F.sum(n).alias("n"),
                   F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(n) * within).alias("within")).first()
    if not s["n"] or not s["within"]:
        return 1.0
    size, mean_within = s["n"] - s["nn"] / s["n"], s["within"] / s["n"]
    share = max((s["spread"] - s["chance"]) / size if size > 0 else 0.0, 0.0) / mean_within
    return float(min(1e6, max(1.0, 1 / share - 1))) if share > 0 else 1e6


def _logit(p: F.Column) -> F.Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """Row of ``docs`` by row: ``id_col``, host, path, and for quality and toxic the document's own
    probability (_own), its host's and path's posterior mean (_host, _path) and its posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for chunk in text_chunks(batches):
            each = evidence(shared.value, chunk)
            yield pa.RecordBatch.from_arrays([chunk.column(c) for c in ("id", "host", "path")] + [pa.array(e, pa.float64()) for e in each],
                                             names=["id", "host", "path", *[f"{x}_odds" for x in LABELS]])

    slim = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), "text")
    rows = slim.mapInArrow(run, f"id {kind}, host string, path string, " + ", ".join(f"{x}_odds double" for x in LABELS))
    rows = rows.join(labels_of(labels, id_col), "id", "left")
    for x in LABELS:
        own = 1 / (1 + F.exp(-F.col(f"{x}_odds")))
        rows = rows.withColumn(f"{x}_own", own).withColumn(f"{x}_seen", F.coalesce(F.col(x), own)).drop(x)
    rows = written(rows, "evidence")
    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{x}_seen").alias(f"{x}_k") for x in LABELS]), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"{x}_k").alias(f"{x}_host_k") for x in LABELS])
    all_ = paths.agg(F.sum("n"), *[F.sum(f"{x}_k") for x in LABELS]).first()
    total = all_[0] or 1
    for k, x in enumerate(LABELS):
        mean = (all_[k + 1] or 0.0) / total
        prior = F.lit(float(mean))
        a = _strength(hosts.withColumn("mean", prior), "host_n", f"{x}_host_k", "mean")
        hosts = hosts.withColumn(f"{x}_prior", prior).withColumn(f"{x}_host", (F.col(f"{x}_host_k") + a * prior) / (F.col("host_n") + a))
    sites = paths.withColumnRenamed("host", "h").join(hosts, F.col("h").eqNullSafe(F.col("host"))).drop("host")
    for x in LABELS:
        b = _strength(sites, "n", f"{x}_k", f"{x}_host")
        sites = sites.withColumn(f"{x}_path", (F.col(f"{x}_k") + b * F.col(f"{x}_host")) / (F.col("n") + b)).withColumn(f"{x}_b", F.lit(b))
    sites = sites.withColumnRenamed("path", "p")
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    for x in LABELS:
        rest = (F.col(f"{x}_k") - F.col(f"{x}_seen") + F.col(f"{x}_b") * F.col(f"{x}_host")) / (F.col("n") - 1 + F.col(f"{x}_b"))
        odds = F.col(f"{x}_odds") - _logit(F.col(f"{x}_prior")) + _logit(rest)
        out = out.withColumn(x, 1 / (1 + F.exp(-odds)))
    return out.select(F.col("id").alias(id_col), "host", "path", *[c for x in LABELS for c in (f"{x}_own", f"{x}_host", f"{x}_path", x)])


def keep() -> F.Column:
    """Good and not toxic are both the likelier."""
    return (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang",
             train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the labelled documents and score all, with the decision ``keep``."""
    return score(docs, labels, fit(docs, labels, id_col, train_rows), id_col, host_col, path_col).withColumn("keep", keep())
