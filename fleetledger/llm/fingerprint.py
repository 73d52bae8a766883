"""Document fingerprints by threshold-scaled sketches, from SQL functions alone.

The sketch of a text holds every shingle hash below a fixed fraction of all hashes, so it grows with the text, and
intersections of sketches estimate intersections of texts however unequal they are. Sketches merge: the union of two is
the sketch of both texts together. A text without a hash below the fraction keeps its least one, which a merge treats
like any other and drops when a hash below the fraction is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetledger.llm.common import Workspace, text_or_empty

SHINGLE_WORDS = 5
#: One hash in SCALE is retained.
SCALE = 8
#: Ids that one window orders; and as many such groups that one window of the next level orders.
GROUP = 256


def _limit(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale


def words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D, A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, size: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """The retained hashes in order. Fewer words than a shingle are one shingle; no word, no hash."""

    def of(w: Column) -> Column:
        count = F.size(w)
        at = F.sequence(F.lit(0), F.greatest(count - size, F.lit(0)))
        every = F.transform(at, lambda i: F.xxhash64(*(w[i + j] for j in range(size))))
        few = F.array(F.xxhash64(w))
        hashes = F.when(count >= size, every).when(count > 0, few).otherwise(F.array().cast("array<bigint>"))
        return _retained(hashes, scale)

    return _bound(words(text), of)


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _retained(hashes: Column, scale: int) -> Column:
    def of(h: Column) -> Column:
        below = F.filter(h, lambda x: x < _limit(scale))
        least = F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())
        return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).otherwise(least)

    return _bound(hashes, of)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together, from their sketches."""
    return _retained(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; two empty sketches are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; all of an empty one."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def as_text(hashes: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _edited(text: Column, other: Column) -> Column:
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def _compared(rows: DataFrame) -> DataFrame:
    """rows: sketch, edited_sketch, next_sketch. Adds the likenesses."""
    return rows.withColumns(
        {
            "near_edited": likeness(F.col("sketch"), F.col("edited_sketch")),
            "near_next": likeness(F.col("sketch"), F.col("next_sketch")),
            "of_edited": containment(F.col("sketch"), F.col("edited_sketch")),
        }
    )


def _with_edited(rows: DataFrame) -> DataFrame:
    """rows: text, after_text. Adds the hash and sketch of the edited text."""
    edited = _edited(F.col("text"), F.col("after_text"))
    known = F.col("after_text").isNotNull()
    return rows.withColumns(
        {"edited_sha256": F.sha2(edited.cast("binary"), 256), "edited_sketch": F.when(known, sketch(edited))}
    )


def _heads(placed: DataFrame) -> DataFrame:
    """(grp, spare, after): for each group the first row of the next group that has rows, and of the first group for the
    last. Group numbers are ordered in two levels: a window for every GROUP of them, and one over the topmost, which are
    one for GROUP * GROUP ids."""
    firsts = placed.where("place = 1").select(
        "grp", "spare", F.struct(F.col("text").alias("after_text"), F.col("sketch").alias("next_sketch")).alias("after")
    )
    groups = firsts.select("grp", "spare", F.floor(F.col("grp") / GROUP).alias("top"))
    inside = Window.partitionBy("top").orderBy("grp", "spare")
    groups = groups.withColumn("next_group", F.lead(F.struct("grp", "spare")).over(inside))
    tops = groups.groupBy("top").agg(F.min(F.struct("grp", "spare")).alias("start"))
    lowest = tops.agg(F.min(F.struct("top", "start")).alias("m")).select(F.col("m.start").alias("lowest"))
    tops = tops.withColumn("next_start", F.lead("start").over(Window.orderBy("top"))).join(F.broadcast(lowest))
    tops = tops.select("top", F.coalesce("next_start", "lowest").alias("next_start"))
    goals = groups.join(tops, "top").select("grp", "spare", F.coalesce("next_group", "next_start").alias("goal"))
    return goals.join(firsts.select(F.struct("grp", "spare").alias("goal"), "after"), "goal").drop("goal")


def fingerprints(docs: DataFrame, work: Workspace) -> DataFrame:
    """Fingerprints of docs (doc_id, text; other columns play no part), of each text edited, and of the next one.

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of the next document's
    by ascending id; the first follows the last. Returns per row doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and of_edited (the share of this text's shingles estimated in the edited
    one). A null text is an empty one, whose fingerprint is the empty string. Rows of one id follow each other by a hash
    of the text; equal rows are each other's next. Rows without id come first, by that hash. A table of one row is its
    own next.

    Rows are ordered in groups of GROUP consecutive ids, each in a window of its own; only the last row of a group looks
    to the first of the next. Rows without id are spread over GROUP groups.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    tie = F.xxhash64("text")
    base = base.withColumns(
        {
            "tie": tie,
            "grp": F.coalesce(F.floor(F.col("doc_id") / GROUP), F.lit(-(1 << 56))),
            "spare": F.when(F.col("doc_id").isNull(), F.shiftright(tie, 56)).otherwise(0).cast("int"),
        }
    )
    inside = Window.partitionBy("grp", "spare").orderBy("doc_id", "tie")
    placed = base.withColumns({"after_text": F.lead("text").over(inside), "place": F.row_number().over(inside)})
    # sketches are made behind the shuffle, and the next one's taken by a second window over the same order
    placed = _with_edited(placed).withColumn("sketch", sketch(F.col("text")))
    edge = F.col("after_text").isNull() | (F.col("place") == 1)
    placed = placed.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "sketch", "edited_sha256", "edited_sketch", "tie",
        # a text is kept only where the next group, or the one before, has yet to meet it
        F.when(edge, F.col("text")).alias("text"), "grp", "spare", "place",
    )
    placed = _compared(placed.withColumn("next_sketch", F.lead("sketch").over(inside))).drop("next_sketch", "tie")
    placed = work.save(placed, "placed")
    ends = placed.where("edited_sha256 IS NULL").drop("edited_sha256", "edited_sketch")
    ends = ends.join(_heads(placed), ["grp", "spare"]).select("*", "after.*")
    ends = _compared(_with_edited(ends)).select(placed.columns)
    rows = placed.where("edited_sha256 IS NOT NULL").union(ends)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "of_edited",
    )
