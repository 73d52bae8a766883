"""Quality rules: counts of a text, and bands of its perplexity under a model of its language.

The model of a language is counted over the documents of it that the labelled table calls good; a fifth of those
(crc32 of the id modulo 5) is not counted but sets the bands. A document's logarithm of perplexity is its mean over all
characters. The band of a language lies around the median of the band documents; its half-width is WIDTH standard
deviations of such a mean, which are larger for short texts: one part of the variance is that between documents, the
other that of single characters over their number. Below the band lies text that repeats itself, above it text that is
not of the language: symbols, capitals, tables, noise."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import Workspace, crc_of_id, text_hash, text_slices, with_labels
from fleetledger.llm.kneser import MAX_ENTRIES, Model, Rest, distinct_words, learn, rest_of, row_numbers, unsure_words, word_counts
from fleetledger.llm.words import Words, mix, words_of

FOLDS, BAND_FOLD = 5, 0
#: Of the model that takes texts without language or of a language without good documents.
ANY = "*"
WIDTH = 6.0
#: Least standard deviation of means between documents, in nats a character.
LEAST_SPREAD = 0.02
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
_SPACE = " \t\n\x0b\x0c\r"

COUNTS = "doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[bounds])


def _repeated_words(words: Words) -> np.ndarray:
    """Per text the words that lie in a window of WINDOW words found twice or more in it."""
    h, n = words.hashes(), len(words.start)
    texts = len(words.bounds) - 1
    starts = n - WINDOW + 1
    if starts <= 0:
        return np.zeros(texts, np.int64)
    key = mix(words.doc[:starts].astype(np.uint64) + np.uint64(1))
    for j in range(WINDOW):
        key = key * np.uint64(0xD6E8FEB86659FD93) + h[j : j + starts]
    whole = np.flatnonzero(words.doc[:starts] == words.doc[WINDOW - 1 :])
    _, place, count = np.unique(key[whole], return_inverse=True, return_counts=True)
    twice = whole[count[place] > 1]
    edges = np.zeros(n + 1, np.int64)
    edges[twice] += 1
    np.subtract.at(edges, twice + WINDOW, 1)
    return np.bincount(words.doc[np.cumsum(edges)[:n] > 0], minlength=texts)


def _repeated_lines(texts: list[str | None]) -> list[int]:
    found = []
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip(_SPACE)] if text and "\n" in text else []
        found.append(len(lines) - len(set(lines)))
    return found


def summed(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text_hash, text, lang. Returns the counts and, per text, cls (the model that took it) and place (its
    number), total and squares (sums over the characters of the words that tasks can score), size (characters of all
    words), unsure (the other words), row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = COUNTS + ", cls string, place int, total double, squares double, size long, unsure array<struct<word string; n long>>, row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = shared.value, row_numbers()
        place_of = {c: i for i, c in enumerate(model.classes)}
        for batch in text_slices(batches):
            words = words_of(batch.column("text"))
            n = batch.num_rows
            inside = np.zeros(len(words.data) + 1, np.int8)
            inside[words.start] += 1
            np.subtract.at(inside, words.end, 1)
            points = (np.cumsum(inside[:-1]) > 0) & ((words.data & 0xC0) != 0x80)
            chosen = [c if c in place_of else ANY for c in batch.column("lang").to_pylist()]
            column = np.array([place_of.get(c, 0) for c in chosen], np.int64)
            sums, square_sums, size = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            first, place, _ = distinct_words(words, np.zeros(len(words.start), np.int64))
            sure = np.ones(len(first), bool)
            if len(words.start) and model.classes:
                total, squares, length, sure = model.sure_score([words.text(i) for i in first.tolist()])
                own, known = column[words.doc], sure[place]
                size = np.bincount(words.doc, length[place], n).astype(np.int64)
                sums = np.bincount(words.doc, np.where(known, total[place, own], 0), n)
                square_sums = np.bincount(words.doc, np.where(known, squares[place, own], 0), n)
            symbols = np.isin(words.data, np.frombuffer(SYMBOLS, np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(np.bincount(words.doc, minlength=n), pa.int64()),
                    pa.array(_per_text(points, words.bounds), pa.int64()),
                    pa.array(_per_text(symbols, words.bounds), pa.int64()),
                    pa.array(_repeated_lines(batch.column("text").to_pylist()), pa.int64()),
                    pa.array(_repeated_words(words), pa.int64()),
                    pa.array(chosen, pa.string()), pa.array(column, pa.int32()), pa.array(sums), pa.array(square_sums), pa.array(size),
                    unsure_words(words, first, place, sure, n), pa.array(list(itertools.islice(number, n)), pa.int64()),
                ],
                names=[x.split()[0] for x in types.split(", ")],
            )

    return docs.mapInArrow(run, types.replace(";", ","))


def measured(docs: DataFrame, model: Model, rest: Rest | None, work: Workspace) -> DataFrame:
    """docs: doc_id, text_hash, text, lang. Returns the counts and, per text, cls (the model that took it), mean and
    variance of the log-probabilities of its characters, and their number."""
    rows = summed(docs, model)
    if rest is not None:
        rows = work.save(rows, "sums")
        own = {c: F.sum(F.get(c, F.col("place")) * F.col("n")).alias(f"more_{c}") for c in ("totals", "squares")}
        more = rest_of(rest, rows.select("row", "place", "unsure"), model.classes).groupBy("row").agg(*own.values())
        rows = rows.join(more, "row", "left").withColumns({
            "total": F.col("total") + F.coalesce("more_totals", F.lit(0.0)),
            "squares": F.col("squares") + F.coalesce("more_squares", F.lit(0.0)),
        })
    some = F.greatest("size", F.lit(1))
    mean = F.col("total") / some
    return rows.select(
        *[x.split()[0] for x in COUNTS.split(", ")], "cls", mean.alias("mean"), (F.col("squares") / some - mean * mean).alias("variance"), "size"
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(rows: DataFrame) -> DataFrame:
    """(cls, centre, between, within) from the rows of the band documents: the median of the means, the robust variance between
    documents, and the mean variance of single characters."""
    used = rows.where((F.col("size") > 0) & ~base_failed())
    used = used.withColumnRenamed("cls", "own").select(
        F.explode(F.array(F.col("own"), F.lit(ANY))).alias("cls"), "mean", "variance", "size"
    )
    centre = used.groupBy("cls").agg(F.percentile_approx("mean", 0.5, 10_000).alias("centre"))
    apart = F.abs(F.col("mean") - F.col("centre"))
    return (
        used.join(F.broadcast(centre), "cls")
        .groupBy("cls", "centre")
        .agg(
            F.percentile_approx(apart, 0.5, 10_000).alias("mad"),
            F.avg("variance").alias("within"),
        )
        .select("cls", "centre", F.pow(F.greatest(1.4826 * F.col("mad"), F.lit(LEAST_SPREAD)), 2).alias("between"), "within")
    )


def judge(docs: DataFrame, labels: DataFrame, work: Workspace, limit: int = MAX_ENTRIES) -> DataFrame:
    """Counts and verdict of every text of docs (doc_id, text, lang; other columns play no part). labels: doc_id,
    quality. limit: n-grams of an order that tasks hold; the result does not depend on it.

    Returns per row doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    log_perplexity (nats a character, null without words), low and high (the band), text_hash. Null text counts as empty: no words,
    so base_failed. A language without good documents, and a null one, take the model of all good documents. Several
    labels of one id count as the best of them. Without any good document nothing is known and the base rules alone
    decide. Repeated rows are judged alike; a null id is a row like others that has no label.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    good = good.where("quality = 1").select("doc_id")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", text_hash())
    band = crc_of_id(F.col("doc_id")) % FOLDS == BAND_FOLD
    taught = with_labels(base.where(~band), good).select(F.coalesce("lang", F.lit(ANY)).alias("cls"), "text")
    words = work.save(word_counts(taught, only_letters=False), "words")
    pooled = words.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ANY).alias("cls"), "word", "n")
    model, rest = learn(work, words.where(F.col("cls") != ANY).union(pooled), limit)
    rows = work.save(measured(base, model, rest, work), "measured")
    spread = WIDTH * F.sqrt(F.col("between") + F.col("within") / F.greatest("size", F.lit(1)))
    inside = F.col("mean").between(F.col("centre") - spread, F.col("centre") + spread)
    return rows.join(F.broadcast(bands(rows.where(band).join(good, "doc_id"))), "cls", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(inside, F.lit(True))).alias("kept"),
        F.when(F.col("size") > 0, -F.col("mean")).alias("log_perplexity"),
        (-F.col("centre") - spread).alias("low"),
        (-F.col("centre") + spread).alias("high"),
        "text_hash",
    )
