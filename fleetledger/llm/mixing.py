"""Mixing to target weights where the domain of a document is not known but likely.

A classifier learned from a labelled table gives each document a posterior over domains. Every document then gets a
rate, how often it is taken, such that the expected tokens of each domain meet their targets: nonnegative least squares,
solved by accelerated projected gradient steps. Residuals are weighed by the inverse of the domains' second moments, so
that a rare domain and one that resembles another converge as fast as the rest. Each step is one pass that sums rate x tokens x posterior over all
documents; what goes back to them is one number per domain, so a document's rate follows from its own posterior and
the steps so far, and no table of rates is kept between the passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import Workspace, text_hash, text_slices, with_labels
from fleetledger.llm.words import Words, mix, words_of

BUCKETS = 1 << 16
#: Labelled documents that the posterior is calibrated on, the first by a hash of the id.
CALIBRATION_ROWS = 20_000
STEPS = 60
TOLERANCE = 1e-5
#: Domains of the labelled table, and the shares of tokens they are to have.
TARGETS = {"ordinary": 0.94, "poor": 0.03, "toxic": 0.03}


def domain_of_label():
    """toxic before poor; the rest is ordinary; null without either label."""
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    return F.when(
        known, F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("ordinary")
    )


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets per word: one of the word in lower case, one of its last three bytes and first byte's kind."""
    whole = (words.hashes() % np.uint64(BUCKETS // 2)).astype(np.int64)
    tail = np.zeros(len(words.start), np.uint64)
    for j in range(1, 4):
        at = np.maximum(words.end - j, words.start)
        tail = tail * np.uint64(256) + words.data[at]
    kind = words.data[words.start] if len(words.start) else tail
    kind = (kind >= 65).astype(np.uint64) + (kind >= 97).astype(np.uint64)
    end = (mix(tail * np.uint64(4) + kind) % np.uint64(BUCKETS // 2)).astype(np.int64)
    return whole, end + BUCKETS // 2


def domain_counts(docs: DataFrame, domains: list[str]) -> np.ndarray:
    """docs: text, domain. The counts of each bucket in each domain."""
    code = {d: i for i, d in enumerate(domains)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = words_of(batch.column("text"))
            own = np.array([code[d] for d in batch.column("domain").to_pylist()], np.int64)[words.doc]
            both = np.concatenate([own * BUCKETS + f for f in features(words)])
            count = np.bincount(both, minlength=BUCKETS * len(domains))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["place", "n"])

    found = docs.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS * len(domains))
    counts[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(len(domains), BUCKETS)


def likelihoods(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """docs: doc_id, text_hash, text. Replaces text by tokens (words) and likely: per domain the mean log-probability of
    the text's buckets, above that under all domains together."""
    table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    pooled = counts.sum(axis=0)
    table = (table - np.log((pooled + 0.5) / (pooled.sum() + 0.5 * BUCKETS))).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in text_slices(batches):
            words = words_of(batch.column("text"))
            n = batch.num_rows
            tokens = np.bincount(words.doc, minlength=n)
            whole, end = features(words)
            likely = np.stack(
                [np.bincount(words.doc, t[whole] + t[end], n) / np.maximum(tokens, 1) for t in table], axis=1
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(tokens, pa.int64()),
                    pa.array(likely.tolist(), pa.list_(pa.float64())),
                ],
                names=["doc_id", "text_hash", "tokens", "likely"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, tokens long, likely array<double>")


def softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ w
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 400) -> np.ndarray:
    """Weights of k classes over standardised features and a constant, by accelerated gradient steps with a small
    ridge; returned for the features as they are."""
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.concatenate([(x - centre) / spread, np.ones((len(x), 1))], axis=1)
    goal = np.eye(k)[y]
    rate = 1 / (0.5 * np.linalg.norm(design.T @ design / len(x), 2) + 1e-4)
    w = before = np.zeros((design.shape[1], k))
    for step in range(steps):
        ahead = w + step / (step + 3) * (w - before)
        z = np.exp(design @ ahead - (design @ ahead).max(axis=1, keepdims=True))
        slope = design.T @ (z / z.sum(axis=1, keepdims=True) - goal) / len(x) + 1e-4 * ahead
        before, w = w, ahead - rate * slope
    plain = w[:-1] / spread[:, None]
    return np.concatenate([plain, (w[-1] - centre @ plain)[None]])


def rates(posterior: np.ndarray, residuals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rate of each row after the given steps: from 1, each step against the gradient and not below 0, with the
    momentum of accelerated gradients. Second, the point ahead at which the next residual is taken."""
    rate = ahead = np.ones(len(posterior))
    for step, residual in enumerate(residuals):
        new = np.maximum(ahead - posterior @ residual, 0)
        ahead = new + step / (step + 3) * (new - rate)
        rate = new
    return rate, ahead


def _sums(rows: DataFrame, k: int, size: int, of) -> tuple[np.ndarray, float]:
    """Sums over all rows of of(posteriors, tokens), an array of the given size, and of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, tokens = np.zeros(size), 0.0
        for batch in batches:
            if batch.num_rows:
                t = batch.column("tokens").to_numpy().astype(np.float64)
                sums += of(np.array(batch.column("posterior").flatten()).reshape(-1, k), t)
                tokens += t.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([tokens])], names=["sums", "tokens"]
        )

    found = rows.select("tokens", "posterior").mapInArrow(run, "sums array<double>, tokens double")
    every = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
    total = found.agg(*every, F.sum("tokens").alias("t")).first()
    return np.array([total[f"s{i}"] or 0.0 for i in range(size)]), float(total["t"] or 0.0)


def mix_to_targets(
    docs: DataFrame, labels: DataFrame, work: Workspace, targets: dict[str, float] | None = None
) -> DataFrame:
    """Rates of docs (doc_id, text; other columns play no part) so that the expected tokens of each domain are its
    target share of all tokens. labels: doc_id, quality, toxic.

    Returns per row doc_id, text_hash, tokens (words), posterior (an array in the order of the domains), rate and copies (the rate
    rounded up or down by a hash of the id, so that copies are the rate in the mean). Without words, null or empty, a
    text has no say: its posterior follows from the fit and it has no tokens. Repeated rows each have the same rate. An
    id labelled twice takes its largest labels. Domains without a labelled document, and all if fewer than two have
    one, are left out and the other targets keep their proportions; then, as with an empty table, rates are 1. A target
    that no document can supply is met as nearly as least squares allow.
    """
    targets = targets or TARGETS
    label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    label = label.select("doc_id", domain_of_label().alias("domain"))
    label = label.where(F.col("domain").isin(*targets))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash())
    seen = {r["domain"] for r in base.select("doc_id").join(label, "doc_id").select("domain").distinct().collect()}
    domains = [d for d in targets if d in seen]
    k = len(domains)
    if k < 2:
        plain = likelihoods(base, np.ones((1, BUCKETS))).select(
            "doc_id", "text_hash", "tokens", F.array(F.lit(1.0)).alias("posterior")
        )
        return plain.withColumns({"rate": F.lit(1.0), "copies": F.lit(1).cast("long")})
    rows = work.save(likelihoods(base, domain_counts(with_labels(base, label).select("text", "domain"), domains)), "likelihoods")
    known = rows.where(F.col("tokens") > 0).join(label, "doc_id")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").select("likely", "domain").limit(CALIBRATION_ROWS).toArrow()
    x = np.array(sample.column("likely").to_pylist(), np.float64).reshape(-1, k)
    y = np.array([domains.index(d) for d in sample.column("domain").to_pylist()], np.int64)
    weights = fit_softmax(x, y, k) if len(x) else np.zeros((k + 1, k))

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = np.array(batch.column("likely").flatten()).reshape(-1, k)
            posterior = softmax(likely, weights)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "text_hash", "tokens")),
                    pa.array(posterior.tolist(), pa.list_(pa.float64())),
                ],
                names=["doc_id", "text_hash", "tokens", "posterior"],
            )

    rows = work.save(
        rows.select("doc_id", "text_hash", "tokens", "likely").mapInArrow(
            posteriors, "doc_id long, text_hash long, tokens long, posterior array<double>"
        ),
        "posteriors",
    )
    share = np.array([targets[d] for d in domains])
    share = share / share.sum()
    moments, tokens = _sums(rows, k, k * k, lambda p, t: ((p * t[:, None]).T @ p).ravel())
    inverse = np.linalg.pinv(moments.reshape(k, k) / max(tokens, 1.0), rcond=1e-6, hermitian=True)
    residuals: list[np.ndarray] = []
    while tokens and len(residuals) < STEPS:
        sums, _ = _sums(rows, k, k, lambda p, t: (rates(p, residuals)[1] * t) @ p)
        residual = sums / tokens - share
        if np.abs(residual).max() < TOLERANCE:
            break
        residuals.append(inverse @ residual)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior = np.array(batch.column("posterior").flatten()).reshape(-1, k)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_hash", "tokens", "posterior")), pa.array(rates(posterior, residuals)[0])],
                names=["doc_id", "text_hash", "tokens", "posterior", "rate"],
            )

    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 32)) / float(1 << 32)
    return rows.mapInArrow(rated, "doc_id long, text_hash long, tokens long, posterior array<double>, rate double").withColumn(
        "copies", F.floor(F.col("rate") + chance)
    )
