"""Language identification by character models of one language each.

Two thirds of the documents teach: those whose crc32 of the id leaves 0 modulo 3 are counted, those that leave 2 set
the limit of rejection. The rest is held out."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import Workspace, crc_of_id, text_slices
from fleetledger.llm.kneser import (
    MAX_ENTRIES, Model, Rest, distinct_words, learn, letters, rest_of, row_numbers, unsure_words, word_counts,
)
from fleetledger.llm.words import words_of

FOLDS, HELD_OUT, LIMIT_FOLD = 3, 1, 2
#: Of documents like those learned, the share that rejection may lose.
REJECTED = 0.001
UNKNOWN = "und"
#: Nats per document that make one nat of the score: characters of one word are not independent.
COOLING = 8.0


def summed(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, fold, text. Returns row, doc_id, fold, sums (per class, of the words that tasks can score), size
    (characters of all words) and unsure (the other words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = shared.value, row_numbers()
        for batch in text_slices(batches):
            words = words_of(letters(batch.column("text")))
            first, place, _ = distinct_words(words, np.zeros(len(words.start), np.int64))
            total, _, size, sure = model.sure_score([words.text(i) for i in first.tolist()])
            n = batch.num_rows
            known = np.where(sure[:, None], total, 0)
            sums = np.zeros((n, len(model.classes)))
            for i in range(len(model.classes) if len(place) else 0):
                sums[:, i] = np.bincount(words.doc, known[place, i], n)
            length = np.bincount(words.doc, size[place], n).astype(np.int64) if len(place) else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(itertools.islice(number, n)), pa.int64()), batch.column("doc_id"), batch.column("fold"),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(model.classes), pa.int32()), pa.array(sums.ravel())),
                    pa.array(length), unsure_words(words, first, place, sure, n),
                ],
                names=["row", "doc_id", "fold", "sums", "size", "unsure"],
            )

    return docs.mapInArrow(
        run, "row long, doc_id long, fold long, sums array<double>, size long, unsure array<struct<word string, n long>>"
    )


def scored(docs: DataFrame, model: Model, rest: Rest | None, work: Workspace) -> DataFrame:
    """docs: doc_id, fold, text. Returns doc_id, fold, lang_pred, score, entropy (nats a character; null for und)."""
    sums = summed(docs, model)
    if rest is not None:
        sums = work.save(sums, "sums")
        each = range(len(model.classes))
        more = rest_of(rest, sums.select("row", "unsure"), model.classes).groupBy("row")
        more = more.agg(F.array(*(F.sum(F.col("totals")[i] * F.col("n")) for i in each)).alias("more"))
        none = F.array(*(F.lit(0.0) for _ in each))
        sums = sums.drop("unsure").join(more, "row", "left").withColumn("more", F.coalesce("more", none))
        sums = sums.withColumn("sums", F.zip_with("sums", "more", lambda a, b: a + b))
    classes = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not classes or not n:
                names, score, entropy = [UNKNOWN] * n, np.zeros(n), [None] * n
            else:
                sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(n, len(classes))
                length = batch.column("size").to_numpy()
                best = np.argmax(sums, axis=1)
                top = sums[np.arange(n), best]
                score = 1 / np.exp((sums - top[:, None]) / COOLING).sum(axis=1)
                some = length > 0
                names = [classes[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                entropy = [-t / c if c else None for t, c in zip(top.tolist(), length.tolist(), strict=True)]
                score = np.where(some, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("fold"), pa.array(names, pa.string()),
                    pa.array(score, pa.float64()), pa.array(entropy, pa.float64()),
                ],
                names=["doc_id", "fold", "lang_pred", "score", "entropy"],
            )

    return sums.select("doc_id", "fold", "sums", "size").mapInArrow(
        run, "doc_id long, fold long, lang_pred string, score double, entropy double"
    )


def identify(docs: DataFrame, work: Workspace, limit: int = MAX_ENTRIES) -> DataFrame:
    """The language of every text of docs (doc_id, text, lang; other columns play no part).

    Returns per row doc_id, held_out, lang_pred (a learned value of lang, or und if the text is null or has no letter),
    score (0 to 1: how far the best language leads), entropy (nats a character under the best), rejected (its entropy
    is above the limit of that language: the .999 quantile of the limit fold). Equal entropies go to the first language
    by name. limit: n-grams of an order that tasks hold; the result does not depend on it. Rows are scored one by one, repeated ones alike; a null id is taken as an empty one. With nothing to learn
    from, every row is und with score 0.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id(F.col("doc_id")) % FOLDS).alias("fold"), "text", "lang"
    )
    taught = base.where((F.col("fold") != HELD_OUT) & (F.col("fold") != LIMIT_FOLD) & F.col("lang").isNotNull())
    words = word_counts(taught.select(F.col("lang").alias("cls"), "text"), only_letters=True)
    model, rest = learn(work, words, limit)
    rows = work.save(scored(base.select("doc_id", "fold", "text"), model, rest, work), "scored")
    limits = (
        rows.where((F.col("fold") == LIMIT_FOLD) & F.col("entropy").isNotNull())
        .groupBy("lang_pred")
        .agg(F.percentile_approx("entropy", 1 - REJECTED, 10_000).alias("limit"))
    )
    return rows.join(F.broadcast(limits), "lang_pred", "left").select(
        "doc_id",
        (F.col("fold") == HELD_OUT).alias("held_out"),
        "lang_pred",
        "score",
        "entropy",
        F.coalesce(F.col("entropy") > F.col("limit"), F.lit(True)).alias("rejected"),
    )
