"""Near duplicates by bottom-k sketches.

One hash function orders all word shingles; a text retains its k least. Inverted lists over the retained values
generate the overlaps, the union sketch of a pair (the k least of both) estimates its similarity and filters, and the
full sets decide.

No list becomes all its pairs:

* Texts of one shingle set are one class, and only classes are compared.
* A value that no other class retains makes no list. Each class enters the lists of its rarest values only: a pair
  within the threshold shares at least m of k retained values, so the k - m + 1 rarest of either side hold a shared one.
* Every list first becomes a star around its most central class (the one whose values are the most frequent, the smaller
  of equal ones: the original of a group of edited copies). Lists that still span several components after these links
  are confirmed become stars again, on full sets, around other classes, component after component joining, for as long
  as that finds links and pairs would outnumber the entries of the lists. Only what then still spans components gives
  pairs, and only across components.

The bound m is the largest with a binomial tail of TAIL below it, so a pair at the very threshold is missed with that
probability, and any more similar pair with less.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import Workspace, text_hash, text_slices
from fleetledger.llm.components import components
from fleetledger.llm.words import shingle_sets, words_of

SKETCH_SIZE = 48
TAIL = 1e-7
#: Lists become stars again while they would give more pairs than this for each of their entries.
PAIRS_AN_ENTRY = 4


def least_overlap(k: int, threshold: Fraction, tail: float = TAIL) -> int:
    """The most retained values that a pair at the threshold shares but for a probability of tail."""
    p, total = float(threshold), 0.0
    for m in range(k + 1):
        total += comb(k, m) * p**m * (1 - p) ** (k - m)
        if total > tail:
            return max(m, 1)
    return k


def _digest(values: np.ndarray) -> bytes:
    return blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, shingle_words: int, size: int) -> DataFrame:
    """docs: doc_id, text. Adds per row the set size, the class (a digest of the set; null without words) and the
    retained values in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(words_of(batch.column("text"), lower=True), shingle_words)
            kept = [s[:size] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            values = np.concatenate(kept).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                names=["doc_id", "text_hash", "n_shingles", "cls", "sketch"],
            )

    return docs.select("doc_id", "text", text_hash()).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, cls binary, sketch array<long>"
    )


def _text_key():
    """Where a class's text is found: the id, or a hash of the text of a row without one."""
    return F.coalesce("doc_id", text_hash()).alias("text_key")


def _union_estimate(pairs: DataFrame, k: int, least: int) -> DataFrame:
    """Keeps pairs whose union sketch shares enough: the k least values of both sides are a sketch of the union. A
    union below k values is complete, and its share of least falls in proportion. Values compare unsigned, as they
    were ordered: adding the least long turns one order into the other."""
    return (
        pairs.withColumn("both", F.array_union("sketch", "other"))
        .withColumn("union", F.slice(F.array_sort(F.transform("both", lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))), 1, k))
        .withColumn(
            "shared",
            F.size(
                F.array_intersect(
                    "union", F.transform(F.array_intersect("sketch", "other"), lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))
                )
            ),
        )
        .where(F.col("shared") * k >= least * F.size("union"))
        .drop("both", "union", "shared")
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int, threshold: Fraction) -> DataFrame:
    """pairs: u, v, u_key, v_key. Joins both texts, builds the full sets again and keeps pairs within the threshold. A
    row whose text has another digest than its class (another row of the same id) is no pair."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=16)
        def of(text: str) -> tuple[bytes, np.ndarray]:
            values = shingle_sets(words_of(pa.array([text]), lower=True), shingle_words)[0]
            return _digest(values), values

        for batch in batches:
            keep = []
            for u, v, a, b in zip(*(batch.column(c) for c in ("u", "v", "u_text", "v_text")), strict=True):
                (da, x), (db, y) = of(a.as_py() or ""), of(b.as_py() or "")
                shared = 0
                if da == u.as_py() and db == v.as_py():
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared > 0 and down * shared >= up * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def side(name: str) -> DataFrame:
        return texts.select(F.col("text_key").alias(f"{name}_key"), F.col("text").alias(f"{name}_text"))

    return (
        pairs.join(side("u"), "u_key").join(side("v"), "v_key").select("u", "v", "u_text", "v_text")
        .mapInArrow(run, "u binary, v binary")
    )


def near_duplicates(
    docs: DataFrame,
    work: Workspace,
    threshold: Fraction = Fraction(85, 100),
    shingle_words: int = 5,
    sketch_size: int = SKETCH_SIZE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Components of texts linked by a Jaccard similarity of at least the threshold over distinct word shingles.

    Words are split at ASCII white space, A-Z lower-cased; fewer words than a shingle are one shingle. Returns a row
    for each input row: doc_id, n_shingles (set size), component_id (least id of the component), kept (the id is that
    least one). Other columns of docs play no part, whatever their names. Null and empty texts have an empty set and
    are linked with nothing. Rows with equal ids and texts are one another's copies, and all that bear the least id are
    kept. A row without id takes the component of its copies and isn't kept; with no id in the whole component,
    component_id is null. An empty table gives an empty result. A further column, text_hash, is xxhash64 of the text.
    """
    base = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    rows = work.save(sketches(base, shingle_words, sketch_size), "sketches")
    classes = work.save(
        rows.where(F.col("cls").isNotNull())
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min("text_hash").alias("any_hash"),
            F.first("n_shingles").alias("n"),
            F.first("sketch").alias("sketch"),
        )
        .select("cls", "least_id", F.coalesce("least_id", "any_hash").alias("text_key"), "n", "sketch"),
        "classes",
    )
    texts = base.select(_text_key(), "text")
    least = least_overlap(sketch_size, threshold)
    lists = work.save(_postings(classes, sketch_size, least), "lists")

    def fits() -> F.Column:
        small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
        return small * threshold.denominator >= large * threshold.numerator

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """pairs: (u, v) of classes, distinct."""
        mine = classes.select(F.col("cls").alias("u"), F.col("text_key").alias("u_key"), "sketch")
        theirs = classes.select(
            F.col("cls").alias("v"), F.col("text_key").alias("v_key"), F.col("sketch").alias("other")
        )
        likely = _union_estimate(pairs.join(mine, "u").join(theirs, "v"), sketch_size, least)
        likely = work.save(likely.select("u", "v", "u_key", "v_key"), f"{name}-likely")
        return work.save(_confirmed(likely, texts, shingle_words, threshold), f"{name}-links")

    centre = lists.groupBy("value").agg(F.max(F.struct("central", (-F.col("n")).alias("smaller"), "cls", "n")).alias("c"))
    stars = (
        lists.join(
            centre.select("value", F.col("c.cls").alias("other_cls"), F.col("c.n").alias("other_n")), "value"
        )
        .where((F.col("cls") != F.col("other_cls")) & fits())
        .select(F.col("cls").alias("u"), F.col("other_cls").alias("v"))
        .distinct()
    )
    links = confirm(stars, "star")
    parts = work.save(components(work, links), "parts")
    moved = _across(work, classes, texts, work.save(_open_classes(lists, parts), "open"), shingle_words, threshold)
    named = classes.select(F.col("cls").alias("node"), "least_id").join(parts, "node", "left")
    named = named.select("node", "least_id", F.coalesce("root", "node").alias("root"))
    if moved is not None:
        to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
        named = named.join(to, "root", "left").select("node", "least_id", F.coalesce("to", "root").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = work.save(named.join(ids, "root").select(F.col("node").alias("cls"), "component_id"), "named")
    return (
        rows.select("doc_id", "n_shingles", "cls", "text_hash")
        .join(named, "cls", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "text_hash",
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
        .select("doc_id", "n_shingles", "component_id", "kept", "text_hash")
    )


def _postings(classes: DataFrame, k: int, least: int) -> DataFrame:
    """(value, cls, n, central): each class under its rarest shared values. s retained values of which any partner
    shares m = ceil(s * least / k): values that no other class has come first, so that s - m + 1 less their number are
    left for lists."""
    values = classes.select("cls", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(often, "value")
    ranked = shared.groupBy("cls", "n", "s").agg(
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("by_df"), F.sum(F.log2("df")).alias("central")
    )
    lists = F.col("s") - F.ceil(F.col("s") * least / k) + 1 - (F.col("s") - F.size("by_df"))
    return (
        ranked.withColumn("lists", lists.cast("int"))
        .where("lists > 0")
        .select("cls", "n", "central", F.explode(F.slice("by_df", F.lit(1), F.col("lists"))).alias("entry"))
        .select(F.col("entry.value").alias("value"), "cls", "n", "central")
    )


def _open_classes(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """(cls, part): the classes in lists that span several components, with their component."""
    marked = lists.join(parts.withColumnRenamed("node", "cls"), "cls", "left").select(
        "value", "cls", F.coalesce("root", "cls").alias("part")
    )
    spans = marked.groupBy("value").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    return marked.join(spans.select("value"), "value", "left_semi").select("cls", "part").distinct()


def _across(
    work: Workspace, classes: DataFrame, texts: DataFrame, open_classes: DataFrame, shingle_words: int, threshold: Fraction
) -> DataFrame | None:
    """Where links between full sets of open classes take their components: (node, root) of every component that any link
    joins to others, or nothing if there is no such link.

    Each set is ordered by frequency, rarest first. Two sets of sizes n and l within the threshold t share at least
    t (n + l) / (1 + t) values, so the first n - t n + 1 of each hold a shared one, and a value at positions i and j
    leaves room for that many only if enough values follow it on both sides. An edited copy's own values come first
    and soon leave no room. Where many classes of a list are linked across components, stars join these before any pairs
    are made, each star one pair an entry: the work stays in proportion to the lists."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(words_of(batch.column("text"), lower=True), shingle_words)
            same = [_digest(s) == c for s, c in zip(sets, batch.column("cls").to_pylist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            full = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("part"), full], ["cls", "part", "full"])
            yield out.filter(pa.array(same, pa.bool_()))

    found = open_classes.join(classes.select("cls", "text_key"), "cls").join(texts, "text_key")
    sets = work.save(
        found.select("cls", "part", "text").mapInArrow(run, "cls binary, part binary, full array<long>"), "open-sets"
    ).dropDuplicates(["cls"])
    values = sets.select("cls", "part", F.size("full").alias("n"), F.explode("full").alias("value"))
    often = values.groupBy("value").agg(
        F.count("*").alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi")
    )
    ranked = (
        values.join(often.where("df > 1"), "value")
        .groupBy("cls", "part", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "value", F.expr("lo <> hi").alias("wide")))).alias("by_df"))
        .withColumn("own", F.col("n") - F.size("by_df"))
        .withColumn("lists", (F.col("n") - F.ceil(F.col("n") * up / down) + 1 - F.col("own")).cast("int"))
        .where("lists > 0")
    )
    lists = work.save(
        ranked.select("cls", "part", "n", "own", F.posexplode(F.slice("by_df", F.lit(1), F.col("lists"))))
        .where("col.wide")
        .select("cls", "part", "n", "own", (F.col("n") - F.col("own") - F.col("pos")).alias("room"), F.col("col.value").alias("value")),
        "open-lists",
    )

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs of entries of one value, those within the threshold: u, v and their components."""
        likely = (
            pairs.where("part <> other_part")
            .where(F.least("n", "other_n") * down >= F.greatest("n", "other_n") * up)
            .where(F.least("room", "other_room") * (up + down) >= (F.col("n") + F.col("other_n")) * up)
            .select(F.col("cls").alias("u"), F.col("other_cls").alias("v"), "part", "other_part")
            .dropDuplicates(["u", "v"])
        )
        mine = sets.select(F.col("cls").alias("u"), F.col("full").alias("x"))
        theirs = sets.select(F.col("cls").alias("v"), F.col("full").alias("y"))
        fits = F.size(F.array_intersect("x", "y")) * (up + down) >= (F.size("x") + F.size("y")) * up
        found = work.save(likely, f"{name}-pairs").join(mine, "u").join(theirs, "v").where(fits)
        return work.save(found.select("u", "v", "part", "other_part"), f"{name}-links")

    def others(rows: DataFrame) -> DataFrame:
        return rows.select("value", *(F.col(c).alias(f"other_{c}") for c in ("cls", "part", "n", "room")))

    def joined(moved: DataFrame | None, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All moves so far with those of new links behind them, and the new ones alone."""
        new = components(work, links.select(F.col("part").alias("u"), F.col("other_part").alias("v")))
        if moved is None:
            return new, new
        then = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
        on = moved.join(then, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return work.save(on.union(new.join(moved.select("node"), "node", "left_anti")), "moved"), new

    moved, turn = None, 0
    while True:
        spread = lists.groupBy("value", "part").agg(F.count("*").alias("m")).groupBy("value").agg(
            F.count("*").alias("parts"), F.sum("m").alias("entries"), F.sum(F.col("m").cast("double") ** 2).alias("within")
        )
        wide = spread.where("parts > 1")
        lists = work.save(lists.join(wide.select("value"), "value", "left_semi"), "open-lists")
        size = wide.agg(
            F.sum("entries").alias("entries"), F.sum((F.col("entries").cast("double") ** 2 - F.col("within")) / 2).alias("pairs")
        ).first()
        if not size.entries or size.pairs <= PAIRS_AN_ENTRY * size.entries:
            break
        # the class with the fewest values of its own first, then any
        order = F.col("own") / F.col("n") if not turn else F.xxhash64("value", "cls", F.lit(turn))
        centre = lists.withColumn("order", order).groupBy("value").agg(
            F.min(F.struct("order", "cls", "part", "n", "room")).alias("c")
        )
        more = confirmed(lists.join(others(centre.select("value", "c.*")), "value"), "round")
        turn += 1
        if more.isEmpty():
            break
        moved, new = joined(moved, more)
        placed = lists.join(new.withColumnRenamed("node", "part"), "part", "left")
        lists = work.save(placed.withColumn("part", F.coalesce("root", "part")).drop("root"), "open-lists")
    if size.entries:
        more = confirmed(lists.join(others(lists), "value").where("cls < other_cls"), "open")
        if not more.isEmpty():
            moved, _ = joined(moved, more)
    return moved
