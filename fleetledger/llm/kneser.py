"""Interpolated modified Kneser-Ney models over the characters of words, one per class, counted by Spark.

A word is taken alone, between a begin and an end mark: each character is predicted from up to four before it. Counting
is in two steps, words per class and then n-grams of those words, so that the n-grams of a frequent word are taken
once. An n-gram is a 60-bit number, 12 bits a character (code points above 2047 share 2048 slots), and so its context
and its suffix are shifts and masks, which SQL can group by.

Nothing is left out of the model. Tasks hold all of an order that has at most MAX_ENTRIES n-grams; of a larger one they
hold those with at least a share of 1 / MAX_ENTRIES of its counts, and what these end with, so that what is collected and
broadcast is bounded whatever the corpus. A word that meets an n-gram outside is not scored there but by joins with the
whole tables (:func:`word_scores`). Probabilities are the same on both ways.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import Workspace, text_slices
from fleetledger.llm.hasharray import HashArray
from fleetledger.llm.words import Words, mix, words_of

ORDER = 5
BITS = 12
BEGIN, END = 1, 2
SLOTS = 1 << BITS
MAX_ENTRIES = 1 << 20


def letters(column: pa.Array) -> pa.Array:
    """Lower case, with one space for each run of other characters than letters."""
    return pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), r"[^\p{L}]+", " ")


def distinct_words(words: Words, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """groups: a small number for each word. Returns the first position of each distinct (group, word), the place of
    each word among these, and how often each occurs."""
    keys = words.hashes() ^ mix(groups.astype(np.uint64) + np.uint64(1))
    _, first, place, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, place, count


def word_counts(docs: DataFrame, only_letters: bool) -> DataFrame:
    """docs: cls, text. Returns (cls, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            column = letters(batch.column("text")) if only_letters else batch.column("text")
            words = words_of(column)
            classes = pc.dictionary_encode(batch.column("cls"))
            group = classes.indices.to_numpy(zero_copy_only=False)[words.doc] if len(words.doc) else words.doc
            first, _, count = distinct_words(words, group)
            yield pa.RecordBatch.from_arrays(
                [
                    classes.dictionary.take(pa.array(group[first], pa.int32())),
                    pa.array([words.text(i) for i in first.tolist()], pa.string()),
                    pa.array(count, pa.int64()),
                ],
                names=["cls", "word", "n"],
            )

    found = docs.mapInArrow(run, "cls string, word string, n long")
    return found.groupBy("cls", "word").agg(F.sum("n").alias("n"))


def grams_of(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams that end at each predicted character of each word: an array for each order 1..ORDER, the order that
    the word's beginning allows there, and the offset of each word (one more than words)."""
    marked = [chr(BEGIN) + w + chr(END) for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    code = np.where(code < 2048, np.maximum(code, 1), 2048 + code % 2048)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    within = np.arange(len(code)) - np.repeat(bounds[:-1], sizes)
    grams = [code]
    for n in range(1, ORDER):
        longer = grams[-1].copy()
        longer[n:] += code[:-n] << (BITS * n)
        grams.append(longer)
    keep = within > 0
    return [g[keep] for g in grams], np.minimum(within[keep] + 1, ORDER), bounds - np.arange(len(bounds))


def raw_counts(words: DataFrame) -> DataFrame:
    """words: cls, word, n. Returns (cls, gram, n) of the longest n-gram at each character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("cls").to_pylist()
            weight = batch.column("n").to_numpy()
            grams, order, bounds = grams_of(batch.column("word").to_pylist())
            longest = np.choose(order - 1, grams) if len(order) else order
            each = np.repeat(np.arange(len(names)), np.diff(bounds))
            codes = {c: i for i, c in enumerate(dict.fromkeys(names))}
            group = np.array([codes[c] for c in names], np.int64)[each]
            for c, i in codes.items():
                of = group == i
                gram, place = np.unique(longest[of], return_inverse=True)
                count = np.bincount(place, weights=weight[each[of]], minlength=len(gram)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(gram), pa.string()), pa.array(gram), pa.array(count)], names=["cls", "gram", "n"]
                )

    found = words.mapInArrow(run, "cls string, gram long, n long")
    return found.groupBy("cls", "gram").agg(F.sum("n").alias("n"))


def adjusted_counts(raw: DataFrame) -> DataFrame:
    """(cls, level, gram, n): plain counts where nothing can stand before, and elsewhere the number of distinct
    characters found before."""
    level = {ORDER: raw.where(F.col("gram") >= 1 << (BITS * (ORDER - 1)))}
    for n in range(ORDER - 1, 0, -1):
        plain = raw.where((F.col("gram") >= 1 << (BITS * (n - 1))) & (F.col("gram") < 1 << (BITS * n)))
        before = level[n + 1].groupBy("cls", F.col("gram").bitwiseAND((1 << (BITS * n)) - 1).alias("gram"))
        level[n] = plain.union(before.agg(F.count("*").alias("n")))
    out = None
    for n, counts in level.items():
        part = counts.select("cls", F.lit(n).alias("level"), "gram", "n")
        out = part if out is None else out.union(part)
    return out


@dataclass
class Model:
    """For each order the probability of every known n-gram under every class, and the backoff weight of every known
    context, both as logarithms in sorted hash arrays."""

    classes: list[str]
    grams: list[HashArray]
    contexts: list[HashArray]
    #: Whether the tables are those of the whole model.
    whole: bool = True

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word and class the sum of log-probabilities, and the sum of their squares; per word their number."""
        return self.sure_score(words)[:3]

    def sure_score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """score(), and per word whether the whole model gives the same: it does where every longest n-gram is here."""
        grams, order, bounds = grams_of(words)
        sure = np.full(len(order), self.whole)
        total = np.zeros((len(order), len(self.classes)), np.float32)
        todo = np.arange(len(order))
        for n in range(ORDER, 0, -1):
            here = todo[order[todo] >= n]
            later = todo[order[todo] < n]
            row = self.grams[n].find(grams[n - 1][here])
            known = row >= 0
            total[here[known]] += self.grams[n].values[row[known]]
            sure[here[known & (order[here] == n)]] = True
            missed = here[~known]
            context = self.contexts[n].find(grams[n - 1][missed] >> BITS)
            total[missed[context >= 0]] += self.contexts[n].values[context[context >= 0]]
            todo = np.concatenate([missed, later])
        total[todo] -= np.float32(np.log(SLOTS))
        if not len(words):
            return total, total, np.zeros(0, np.int64), sure
        return (
            np.add.reduceat(total, bounds[:-1], axis=0),
            np.add.reduceat(total * total, bounds[:-1], axis=0),
            np.diff(bounds),
            np.logical_and.reduceat(sure, bounds[:-1]),
        )


@dataclass
class Rest:
    """The whole tables of a model that tasks hold in part: (cls, level, gram, u) and (cls, level, context, w)."""

    shares: DataFrame
    weights: DataFrame


def _discounts(counts: DataFrame) -> DataFrame:
    """(cls, level, d1, d2, d3): the discounts of modified Kneser-Ney from the numbers of n-grams counted once to four
    times; one half where these are missing."""
    often = counts.groupBy("cls", "level").agg(
        *(F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"t{i}") for i in range(1, 5))
    )
    y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1))
    d = []
    for i in range(1, 4):
        value = i - (i + 1) * y * F.col(f"t{i + 1}") / F.greatest(F.col(f"t{i}"), F.lit(1))
        usable = (F.col(f"t{i}") > 0) & (value > 0) & (value < i)
        d.append(F.when(usable, value).otherwise(0.5 * i).alias(f"d{i}"))
    return often.select("cls", "level", *d)


def shares(counts: DataFrame) -> DataFrame:
    """(cls, level, gram, u): the discounted share of each n-gram in its context."""
    context = F.shiftright("gram", BITS).alias("context")
    totals = counts.groupBy("cls", "level", context).agg(F.sum("n").alias("total"))
    n = F.col("n")
    discount = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    return (
        counts.withColumn("context", context)
        .join(totals, ["cls", "level", "context"])
        .join(F.broadcast(_discounts(counts)), ["cls", "level"])
        .select("cls", "level", "gram", (F.greatest(n - discount, F.lit(0.0)) / F.col("total")).alias("u"))
    )


def backoffs(shares: DataFrame) -> DataFrame:
    """(cls, level, context, w): what the shares leave of each context's mass."""
    left = F.least(F.greatest(1 - F.sum("u"), F.lit(1e-6)), F.lit(1.0))
    return shares.groupBy("cls", "level", F.shiftright("gram", BITS).alias("context")).agg(left.alias("w"))


def held_grams(counts: DataFrame, limit: int) -> DataFrame | None:
    """(level, gram): what tasks hold where an order has more n-grams than limit; None if none has. An n-gram's
    probability rests on those it ends with, so these are held too: at most ORDER x limit."""
    seen = counts.groupBy("level", "gram").agg(F.sum("n").alias("all"))
    sizes = seen.groupBy("level").agg(F.count("*").alias("size"), F.sum("all").alias("all")).collect()
    if all(r["size"] <= limit for r in sizes):
        return None
    large = F.lit(False)
    for r in sizes:
        if r["size"] > limit:
            large = large | ((F.col("level") == r["level"]) & (F.col("all") * limit < r["all"]))
    ends = F.array(*(
        F.when(F.col("level") >= n, F.struct(F.lit(n).alias("level"), F.col("gram").bitwiseAND((1 << (BITS * n)) - 1).alias("gram")))
        for n in range(1, ORDER + 1)
    ))
    return seen.where(~large).select(F.explode(F.array_compact(ends)).alias("end")).select("end.*").distinct()


def _codes(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    coded = pc.dictionary_encode(column.combine_chunks())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def assemble(found: pa.Table, left: pa.Table, whole: bool = True) -> Model:
    """The model from shares() and backoffs(): p = share + backoff weight x p of the shorter context, from the lowest
    order up."""
    names, cls = _codes(found.column("cls"))
    classes = sorted(names)
    place_of = np.array([classes.index(c) for c in names], np.int64)
    cls = place_of[cls] if len(names) else np.zeros(0, np.int64)
    left_names, left_cls = _codes(left.column("cls"))
    left_cls = np.array([classes.index(c) for c in left_names], np.int64)[left_cls] if left_names else cls
    level, gram, u = (found.column(c).to_numpy() for c in ("level", "gram", "u"))
    left_level, left_context, w = (left.column(c).to_numpy() for c in ("level", "context", "w"))
    model = Model(classes, [HashArray.build(np.zeros(0, np.int64), np.zeros((0, len(classes)), np.float32))], [], whole)
    model.contexts.append(model.grams[0])
    for n in range(1, ORDER + 1):
        at, at_left = level == n, left_level == n
        keys, place = np.unique(gram[at], return_inverse=True)
        own = np.zeros((len(keys), len(classes)))
        own[place, cls[at]] = u[at]
        contexts, place = np.unique(left_context[at_left], return_inverse=True)
        weight = np.ones((len(contexts), len(classes)))
        weight[place, left_cls[at_left]] = w[at_left]
        of = np.searchsorted(contexts, keys >> BITS)
        shorter = np.full((len(keys), len(classes)), -np.log(SLOTS))
        if n > 1:
            shorter = _below(model, keys & ((1 << (BITS * (n - 1))) - 1), n - 1)
        p = own + weight[of] * np.exp(shorter)
        model.grams.append(HashArray.build(keys, np.log(p).astype(np.float32)))
        model.contexts.append(HashArray.build(contexts, np.log(weight).astype(np.float32)))
    return model


def _below(model: Model, keys: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros((len(keys), len(model.classes)))
    todo = np.arange(len(keys))
    for k in range(n, 0, -1):
        now = keys[todo] & ((1 << (BITS * k)) - 1)
        row = model.grams[k].find(now)
        total[todo[row >= 0]] += model.grams[k].values[row[row >= 0]]
        todo, now = todo[row < 0], now[row < 0]
        context = model.contexts[k].find(now >> BITS)
        total[todo[context >= 0]] += model.contexts[k].values[context[context >= 0]]
    total[todo] -= np.log(SLOTS)
    return total


def learn(work: Workspace, words: DataFrame, limit: int = MAX_ENTRIES) -> tuple[Model, Rest | None]:
    """words: cls, word, n. The model that tasks hold, and the whole tables if that is a part of them."""
    raw = work.save(raw_counts(words), "grams")
    counts = work.save(adjusted_counts(raw), "counts")
    held = held_grams(counts, limit)
    if held is None:
        found = shares(counts).toArrow()
        own = pa.table({"cls": found.column("cls"), "level": found.column("level"), "context": pa.array(found.column("gram").to_numpy() >> BITS), "u": found.column("u")})
        left = own.group_by(["cls", "level", "context"]).aggregate([("u", "sum")])
        w = np.clip(1 - left.column("u_sum").to_numpy(), 1e-6, 1)
        return assemble(found, left.drop_columns("u_sum").append_column("w", pa.array(w))), None
    held = work.save(held, "held")
    rest = work.save(shares(counts), "shares")
    left = backoffs(rest)
    contexts = held.select("level", F.shiftright("gram", BITS).alias("context")).distinct()
    model = assemble(
        rest.join(held, ["level", "gram"]).select(*rest.columns).toArrow(),
        left.join(contexts, ["level", "context"]).select(*left.columns).toArrow(),
        whole=False,
    )
    return model, Rest(rest, left)


def train(work: Workspace, words: DataFrame) -> Model:
    """words: cls, word, n. The model of few n-grams, all held."""
    return learn(work, words)[0]


def unsure_words(words: Words, first: np.ndarray, place: np.ndarray, sure: np.ndarray, texts: int) -> pa.Array:
    """Per text the words that the held tables cannot score, with their numbers; place leads each word to its distinct one
    at first."""
    odd = np.flatnonzero(~sure[place]) if len(place) else np.zeros(0, np.int64)
    pairs, count = np.unique(words.doc[odd] * np.int64(len(first) + 1) + place[odd], return_counts=True)
    doc, of = pairs // (len(first) + 1), pairs % (len(first) + 1)
    name = {i: words.text(first[i]) for i in np.unique(of).tolist()}
    items = pa.StructArray.from_arrays([pa.array([name[i] for i in of.tolist()], pa.string()), pa.array(count, pa.int64())], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(texts + 1)), pa.int32()), items)


def row_numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives."""
    return itertools.count((TaskContext.get().partitionId()) << 40)


def word_scores(rest: Rest, words: DataFrame, classes: list[str]) -> DataFrame:
    """words: word, distinct. Returns word, totals and squares: per class, in order, the sum of log-probabilities under
    the whole model and the sum of their squares. An n-gram meets its shares and the weight of its context by joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word")
            grams, order, bounds = grams_of(names.to_pylist())
            word = np.repeat(np.arange(len(names)), np.diff(bounds))
            at = np.arange(len(order)) - bounds[word] if len(order) else order
            for n in range(1, ORDER + 1):
                here = np.flatnonzero(order >= n)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(word[here])), pa.array(at[here], pa.int64()), pa.array(np.full(len(here), n), pa.int32()),
                        pa.array(grams[n - 1][here]), pa.array(grams[n - 1][here] >> BITS),
                    ],
                    names=["word", "at", "level", "gram", "context"],
                )

    tried = words.mapInArrow(run, "word string, at long, level int, gram long, context long")

    def by_class(table: DataFrame, key: str, value: str) -> DataFrame:
        wanted = tried.select("level", key).distinct()
        found = table.join(wanted, ["level", key], "left_semi").groupBy("level", key)
        return found.agg(F.map_from_entries(F.collect_list(F.struct("cls", value))).alias(value))

    met = tried.join(by_class(rest.shares, "gram", "u"), ["level", "gram"], "left")
    met = met.join(by_class(rest.weights, "context", "w"), ["level", "context"], "left")
    steps = met.groupBy("word", "at").agg(F.collect_list(F.struct("level", "u", "w")).alias("steps"))
    # maps have no order, so steps are compared by their levels
    ordered = F.array_sort("steps", lambda a, b: a["level"] - b["level"])

    def logarithm(c: Column) -> Column:
        def step(p: Column, s: Column) -> Column:
            return F.coalesce(s["u"][c], F.lit(0.0)) + F.coalesce(s["w"][c], F.lit(1.0)) * p

        return F.log(F.aggregate("steps", F.lit(1.0 / SLOTS), step))

    each = steps.withColumn("steps", ordered).select("word", F.transform(F.array(*map(F.lit, classes)), logarithm).alias("log"))
    return each.groupBy("word").agg(
        F.array(*(F.sum(F.col("log")[i]) for i in range(len(classes)))).alias("totals"),
        F.array(*(F.sum(F.col("log")[i] * F.col("log")[i]) for i in range(len(classes)))).alias("squares"),
    )


def rest_of(rest: Rest, rows: DataFrame, classes: list[str]) -> DataFrame:
    """rows: row, unsure (words with their numbers), and others. Returns their columns with word, n, totals and squares, a
    row for each such word."""
    words = rows.select("*", F.explode("unsure").alias("of")).select(*[c for c in rows.columns if c != "unsure"], "of.word", "of.n")
    return words.join(word_scores(rest, words.select("word").distinct(), classes), "word")
