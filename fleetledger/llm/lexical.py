"""Ranked lexical search of a set of queries over all documents, by presence masks.

A query's terms are numbered; a document's mask has a bit for each term it holds. Documents of one mask are a group. A
group's score can't exceed the sum of its terms' greatest scores, nor its terms' weights times the greatest saturation
that its shortest document and the most frequent term allow. Groups are evaluated in descending order of this bound, and
once the bound lies strictly below the least of the best scores so far, no group left can hold a better document.

Queries are read in blocks of bounded size. For each block one pass over the texts writes, per document, its length and
the block's terms in it; a second pass over these ranks each task's documents, carrying the best scores from batch to
batch, and Spark ranks what the tasks found. Nothing but a block's terms and their weights is sent to the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetledger.llm.common import Workspace, text_slices
from fleetledger.llm.words import MARKS, Words, words_of

#: Fixed value: what a term is.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bounds of a block of queries: distinct terms, bytes of text, queries. A query beyond them is a block of its own.
BLOCK_TERMS, BLOCK_BYTES, BLOCK_QUERIES = 1 << 16, 1 << 22, 1 << 12
#: Groups evaluated at first, and by how much a step grows.
FIRST_STEP = 8
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


def blocks(queries: Iterable[tuple[int | None, str | None]]) -> Iterator[list[tuple[int | None, dict[str, int]]]]:
    """(id, times of each term) of the queries, in blocks of bounded size."""
    block: list[tuple[int | None, dict[str, int]]] = []
    terms: set[str] = set()
    size = 0
    for query_id, text in queries:
        times = Counter(terms_of(text))
        bytes_here = 4 * sum(map(len, times))
        full = len(terms) + len(times) > BLOCK_TERMS or size + bytes_here > BLOCK_BYTES or len(block) >= BLOCK_QUERIES
        if block and full:
            yield block
            block, terms, size = [], set(), 0
        block.append((query_id, dict(times)))
        terms.update(times)
        size += bytes_here
    if block:
        yield block


@dataclass
class Vocabulary:
    """The terms of a block, found by hash and confirmed by their bytes. number: the place of each hash in terms."""

    terms: list[str]
    hashes: np.ndarray
    number: np.ndarray
    data: np.ndarray
    start: np.ndarray

    @classmethod
    def build(cls, terms: list[str]) -> Vocabulary:
        found = words_of(pa.array(terms, pa.string()), between=MARKS)
        h = found.hashes()
        order = np.argsort(h, kind="stable")
        return cls(terms, h[order], order, found.data, np.append(found.start, len(found.data)))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The positions of the words that are terms, and the number of their terms."""
        if not len(words.start) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = words.hashes()
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == h)
        number = self.number[place[at]]
        size = words.end[at] - words.start[at]
        same = size == self.start[number + 1] - self.start[number]
        at, number, size = at[same], number[same], size[same]
        if not len(at):
            return at, number
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        equal = words.data[np.repeat(words.start[at], size) + step] == self.data[np.repeat(self.start[number], size) + step]
        sure = np.logical_and.reduceat(equal, first)
        return at[sure], number[sure]


def postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs: doc_id, text. Per row doc_id, n (its terms with repeats), and the block's terms in it with their numbers of
    times, by term number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = words_of(batch.column("text"), lower=True, between=MARKS)
            at, number = vocabulary.find(words)
            key = words.doc[at].astype(np.int64) * len(vocabulary.terms) + number
            key, times = np.unique(key, return_counts=True)
            doc = key // max(len(vocabulary.terms), 1)
            offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.bincount(words.doc, minlength=batch.num_rows).astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array((key - doc * len(vocabulary.terms)).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ],
                names=["doc_id", "n", "terms", "times"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def weight(documents: int, holding: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * holding + 1)))


def length_factor(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 75 + (75 n N) div L of documents with n terms; in unbounded integers where the product needs them."""
    wide = n.astype(object) if len(n) and 75 * int(n.max()) * documents >= 1 << 63 else n
    return 25 + (75 * wide * documents // max(total, 1)).astype(np.int64)


def saturation(times: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 8 * factor)


@dataclass
class Query:
    """numbers: the query's terms in the block; weights: weight of each, as often as it stands in the query."""

    numbers: np.ndarray
    weights: np.ndarray


class Best:
    """The k best (score, id) so far; a missing id comes after all others."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.unnamed = np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, unnamed: np.ndarray) -> None:
        held = score > 0
        score, doc, unnamed = (
            np.concatenate([old, new[held]])
            for old, new in ((self.score, score), (self.doc, doc), (self.unnamed, unnamed))
        )
        order = np.lexsort((doc, unnamed, -score))[: self.k]
        self.score, self.doc, self.unnamed = score[order], doc[order], unnamed[order]

    @property
    def floor(self) -> int:
        """What a document must reach to matter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


def masks(presence: list[np.ndarray], rows: int) -> np.ndarray:
    """A row of 64-bit words for each document, with a bit for each list of rows that it is in."""
    out = np.zeros((rows, (len(presence) + 63) // 64), np.uint64)
    for j, at in enumerate(presence):
        out[at, j // 64] |= np.uint64(1) << np.uint64(j % 64)
    return out


def _groups(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct masks, the rows in the order of their masks, and where each mask's rows begin."""
    order = np.lexsort(mask.T) if mask.shape[1] > 1 else np.argsort(mask[:, 0], kind="stable")
    held = mask[order]
    new = np.append(True, (held[1:] != held[:-1]).any(1))
    first = np.flatnonzero(new)
    return held[first], order, first


class Slice:
    """A batch of documents with its postings by term."""

    def __init__(self, batch: pa.RecordBatch, documents: int, total: int):
        self.unnamed = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        self.doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        self.factor = length_factor(batch.column("n").to_numpy(zero_copy_only=False), documents, total)
        lists = batch.column("terms")
        sizes = np.diff(lists.offsets.to_numpy())
        term = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        self.row = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.times = batch.column("times").flatten().to_numpy(zero_copy_only=False)[order]
        self.term = term[order]

    def rank(self, query: Query, best: Best) -> int:
        """Adds the documents of this slice to the best of a query; returns how many were evaluated."""
        lo = np.searchsorted(self.term, query.numbers)
        hi = np.searchsorted(self.term, query.numbers, "right")
        presence = [self.row[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        mask = masks(presence, len(self.doc))
        held = np.flatnonzero(mask.any(1))
        if not len(held):
            return 0
        distinct, order, first = _groups(mask[held])
        rows = held[order]
        shortest = np.minimum.reduceat(self.factor[rows], first)
        most = np.array([self.times[a:b].max(initial=1) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        alone = query.weights * saturation(most, self.factor[rows].min())
        bound, weights = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for j in range(len(presence)):
            bit = (distinct[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
            bound += bit * alone[j]
            weights += bit * query.weights[j]
        bound = np.minimum(bound, weights * saturation(most.max(), shortest))
        by_bound = np.argsort(-bound, kind="stable")
        sizes = np.diff(np.append(first, len(rows)))
        table = np.zeros((len(self.doc), len(presence)), np.int64)
        for j, at in enumerate(presence):
            table[at, j] = self.times[lo[j] : hi[j]]
        at, step, seen = 0, FIRST_STEP, 0
        while at < len(by_bound) and bound[by_bound[at]] >= best.floor:
            now = by_bound[at : at + step]
            now = now[bound[now] >= best.floor]
            size = sizes[now]
            mine = rows[np.repeat(first[now] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            score = (saturation(table[mine], self.factor[mine][:, None]) * query.weights).sum(1)
            best.add(score, self.doc[mine], self.unnamed[mine])
            at, step, seen = at + len(now), step * 2, seen + len(mine)
        return seen


def _ranked(rows: DataFrame, queries: list[Query], documents: int, total: int, k: int) -> DataFrame:
    """The k best documents of each task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for batch in batches:
            if batch.num_rows:
                part = Slice(batch, documents, total)
                for query, mine in zip(queries, best, strict=True):
                    part.rank(query, mine)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best)), [len(b.score) for b in best])),
                pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.unnamed for b in best])),
                pa.array(np.concatenate([b.score for b in best])),
            ],
            names=["query", "doc_id", "score"],
        )

    found = rows.where("size(terms) > 0").select("doc_id", "n", "terms", "times").mapInArrow(
        run, "query long, doc_id long, score long"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    queries: DataFrame,
    work: Workspace,
    k: int = 10,
    query_id: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """The k best documents of docs (doc_id, text) for every row of queries; other columns play no part, whatever their
    names. Returns (item_id, rank, doc_id, score), ranks from 1, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Only scores above 0
    count, so a null, empty or termless query has no row, nor has one whose terms no document holds; null and empty texts
    match nothing and don't count as documents. Repeated documents are ranked each, a missing id after all others;
    repeated queries are answered each. Empty tables give an empty result. Scores are 64-bit integers; the weight of a
    term is computed in doubles once.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = queries.select(F.col(query_id).cast("long"), F.col(query_text).cast("string"))
    out = None
    for block in blocks((r[0], r[1]) for r in wanted.toLocalIterator()):
        terms = sorted({t for _, times in block for t in times})
        if not terms:
            continue
        rows = work.save(postings(base, Vocabulary.build(terms)), "postings")
        size = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("total")).first()
        # at most a row for each term of the block
        held = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(terms), np.int64)
        for r in held:
            weights[r["term"]] = weight(size.documents, r["count"])
        number = {t: i for i, t in enumerate(terms)}
        asked = []
        for _, times in block:
            numbers = np.array(sorted(number[t] for t in times), np.int64)
            asked.append(Query(numbers, np.array([times[terms[i]] * int(weights[i]) for i in numbers], np.int64)))
        ids = docs.sparkSession.createDataFrame(
            [(i, query) for i, (query, _) in enumerate(block)], "query long, item_id long"
        )
        found = _ranked(rows, asked, size.documents or 0, size.total or 0, k).join(F.broadcast(ids), "query")
        found = work.save(found.select("item_id", "rank", "doc_id", "score"), "ranked")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
