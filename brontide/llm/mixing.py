"""Operator 6 - mixing to target weights with soft membership.

A classifier fitted on the labelled table gives every document a posterior over the domains; its tokens
count for each domain by that share. Nonnegative document rates w are fitted so that the expected tokens
A w of every domain meet the targets t: minimise (A w - t)' inv(G) (A w - t), G being the sum of tokens p p' over
the documents, by accelerated projected gradient from rates of one. With rates weighed by tokens a gradient step of
length one is the projection on A w = t, so few steps are needed. Each step is one pass over the documents' own
posteriors: the executors apply the steps so far to every document, sum the masses and bring one number a
domain back. The steps end when all targets are met to ``CLOSE`` or the rates no longer change, as for targets that
no rates meet; what then is missing stands in ``target_error``.

The labelled table: doc_id, quality, toxic. Domains: ``toxic`` where toxic is 1, else ``good`` or
``poor`` by quality. A hash of doc_id picks about ``SAMPLE`` labelled rows to fit on.

Edge cases: a null or empty text has no tokens, counts for nothing and still gets a posterior and rate.
A domain without labelled rows has no posterior mass; its target is left out and the others are
scaled up to the whole. With no labelled rows at all, the posteriors are uniform over the domains.
Repeated rows count as often as they occur; a null doc_id is a document like others. Rows of labels
with a null id or nulls in both marks are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brontide.llm import wordhash as wh
from brontide.llm.shared import keyed, whole_rows, written

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.85, "poor": 0.13, "toxic": 0.02}
SAMPLE, DIMS, SHAPES = 4000, 4096, 7
ITERATIONS, CLOSE, STILL = 60, 1e-3, 1e-4
#: Rows whose dense features are held at once.
ROWS = 256


def features(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts of a slice: hashed word counts, square roots scaled to length one, and shapes; and the numbers of words."""
    starts, ends, woffs = wh.word_spans(wh.LOWER[flat], offs, wh.SPACE_WORDS)
    words = wh.word_hashes(wh.LOWER[flat], starts, ends)
    n, size = np.diff(woffs), np.diff(offs)
    x = np.bincount(wh.doc_of(woffs) * DIMS + (words % np.uint64(DIMS)).astype(np.int64), minlength=len(n) * DIMS).reshape(len(n), DIMS)
    used = (x > 0).sum(axis=1)
    x = np.sqrt(x, dtype=np.float32)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6)
    sums = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offs])
    per = np.maximum(size, 1)
    letters = ((flat | 32) >= 97) & ((flat | 32) <= 122) | (flat >= 128)
    shapes = np.stack([sums((flat >= 65) & (flat <= 90)) / per, sums((flat >= 48) & (flat <= 57)) / per, sums(~letters & (flat > 32) & ~((flat >= 48) & (flat <= 57))) / per, sums(flat == 10) / per, n / per, used / np.maximum(n, 1), np.log1p(n) / 10], axis=1)
    return np.hstack([x, (shapes * 3).astype(np.float32)]), n


class Classifier:
    """Multinomial logistic regression, fitted by gradient descent with momentum."""

    def __init__(self, domains: int):
        self.W = np.zeros((DIMS + SHAPES, domains), dtype=np.float32)
        self.b = np.zeros(domains, dtype=np.float32)
        self.open = np.zeros(domains, dtype=bool)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 250) -> Classifier:
        count = np.bincount(y, minlength=len(self.b))
        self.open = count > 0
        self.b = np.where(self.open, np.log(np.maximum(count, 1) / len(y)), -1e9).astype(np.float32)
        target = np.eye(len(self.b), dtype=np.float32)[y]
        vw, vb = np.zeros_like(self.W), np.zeros_like(self.b)
        for _ in range(steps):
            miss = self.posteriors(x) - target
            vw = 0.9 * vw - 4.0 * (x.T @ miss / len(y) + 2e-5 * self.W)
            vb = 0.9 * vb - 1.0 * miss.mean(axis=0)
            self.W += vw
            self.b += np.where(self.open, vb, 0).astype(np.float32)
        return self

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.W + self.b
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(axis=1, keepdims=True)


def _sparse(batches):
    for batch in batches:
        at, value = [], []
        for _, flat, offs in wh.slices(batch.column(1), rows=ROWS):
            x, _ = features(flat, offs)
            for row in x:
                own = np.flatnonzero(row)
                at.append(own)
                value.append(row[own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["domain", "at", "value"])


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """On about ``sample`` labelled rows; their sparse features, at most DIMS numbers each, come to the driver."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    labels = labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).where("id is not null and domain is not null")
    share = min(1.0, sample / max(1, labels.count()))
    picked = labels.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id"), "id").limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("domain", "text").mapInArrow(_sparse, "domain int, at array<int>, value array<float>").collect()
    model = Classifier(len(DOMAINS))
    if not rows:
        return model
    x = np.zeros((len(rows), DIMS + SHAPES), dtype=np.float32)
    for k, row in enumerate(rows):
        x[k, row["at"]] = row["value"]
    return model.fit(x, np.array([row["domain"] for row in rows]))


def _soft(model):
    def run(batches):
        for batch in batches:
            tokens, parts = [], []
            for _, flat, offs in wh.slices(batch.column(1), rows=ROWS):
                x, n = features(flat, offs)
                tokens.append(n)
                parts.append(model.value.posteriors(x))
            p = np.concatenate(parts) if parts else np.zeros((0, len(DOMAINS)))
            p = p.astype(np.float64)
            p /= p.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(DOMAINS), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), lists], names=["doc_id", "n_tokens", "posteriors"])

    return run


def rates(p: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Of posteriors (N, K), after the steps so far: each moves against its K numbers from the point ahead and is cut at zero.
    Also the next point ahead, from which the next gradient is taken."""
    w = ahead = np.ones(len(p))
    for move, momentum in steps:
        new = np.maximum(0, ahead - p @ move)
        w, ahead = new, new + momentum * (new - w)
    return w, ahead


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS))


def _masses(steps):
    """Sums over documents: tokens by domain at the rates after the steps, the same at the point ahead, and the last step's squared change."""

    def run(batches):
        total, change = np.zeros((2, len(DOMAINS))), 0.0
        for batch in batches:
            p, tokens = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            w, ahead = rates(p, steps)
            total += np.stack([(tokens * x) @ p for x in (w, ahead)])
            change += float(tokens @ (w - rates(p, steps[:-1])[0]) ** 2) if steps else 0.0
        yield pa.RecordBatch.from_arrays([pa.array(range(len(DOMAINS)), pa.int32()), pa.array(total[0]), pa.array(total[1]), pa.array([change] + [0.0] * (len(DOMAINS) - 1))], names=["domain", "mass", "ahead", "change"])

    return run


def fit_rates(soft: DataFrame, targets: dict[str, float], iterations: int = ITERATIONS, close: float = CLOSE) -> tuple[list[tuple[np.ndarray, float]], float]:
    """The steps of accelerated projected gradient descent, begun anew where the error grows, over the documents soft (posteriors,
    n_tokens), and the largest miss of a domain as a share of all tokens."""

    def masses(steps):
        rows = soft.select("posteriors", "n_tokens").mapInArrow(_masses(steps), "domain int, mass double, ahead double, change double").groupBy("domain").agg(*[F.sum(c).alias(c) for c in ("mass", "ahead", "change")]).collect()
        out = np.zeros((2, len(DOMAINS)))
        for r in rows:
            out[:, r["domain"]] = r["mass"], r["ahead"]
        return *out, sum(r["change"] for r in rows)

    now, ahead, _ = masses([])
    total = now.sum()
    aim = np.array([targets.get(d, 0.0) if m > 0 else 0.0 for d, m in zip(DOMAINS, now, strict=True)])
    if total <= 0 or aim.sum() <= 0:
        return [], 0.0
    want = aim / aim.sum() * total
    both = [(k, j) for k in range(len(DOMAINS)) for j in range(len(DOMAINS))]
    gram = soft.select(*[F.sum(F.col("n_tokens") * F.col("posteriors")[k] * F.col("posteriors")[j]).alias(f"g{k}{j}") for k, j in both]).first()
    inverse = np.linalg.pinv(np.array([gram[f"g{k}{j}"] for k, j in both]).reshape(len(DOMAINS), -1), rcond=1e-9, hermitian=True)
    steps: list[tuple[np.ndarray, float]] = []
    pace, last = 1.0, np.inf
    while True:
        miss = now - want
        # a domain whose target is zero is held to a hundredth of the whole
        if len(steps) == iterations or np.abs(miss / np.where(want > 0, want, total / 100)).max() < close:
            break
        error = miss @ inverse @ miss
        if error > last:
            pace = 1.0
        last, faster = error, (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        steps.append((inverse @ (ahead - want), (pace - 1) / faster))
        pace = faster
        now, ahead, change = masses(steps)
        if np.sqrt(change / total) < STILL:
            break
    return steps, float(np.abs(now - want).max() / total)


def _rated(steps):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(_matrix(batch.column(2)), steps)[0])], names=[*batch.schema.names, "rate"])

    return run


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs' columns as one struct ``row``, n_tokens, posteriors (in the order of DOMAINS), rate and target_error, a row for each document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_classifier(docs, labels, sample))
    kept = whole_rows(docs)
    soft = written(kept.mapInArrow(_soft(model), keyed(kept, "n_tokens long, posteriors array<double>")).withColumnRenamed("doc_id", "row"))
    steps, error = fit_rates(soft, targets or TARGETS)
    return soft.mapInArrow(_rated(steps), StructType([*soft.schema.fields, StructField("rate", DoubleType())])).withColumn("target_error", F.lit(error))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, domain (of the largest posterior), a posterior for each domain, and the rate."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mix(docs.select("doc_id", "text"), labels)
    best = F.array_position("posteriors", F.array_max("posteriors"))
    return out.select("row.doc_id", "n_tokens", F.element_at(F.array(*map(F.lit, DOMAINS)), best.cast("int")).alias("domain"), *[F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "target_error")
