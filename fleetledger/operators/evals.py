"""Evaluation: grounding, recall, verdicts, paired statistics, planted markers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetledger.functions.binding import let, unnest
from fleetledger.functions.text import lines_of, ratio
from fleetledger.operators.ordered import running_total_before

WORD = r"[A-Za-z0-9]+"
# Words of a marker, its first and last aside, that make up its anchor.
ANCHOR_WORDS = 3
GRAM_CHARS = 4


def grounding(declared: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each owner's declared paths that exist. ``declared`` has ``repo_id`` and ``path``."""
    known = inventory.select("repo_id", "path", F.lit(True).alias("exists"))
    counted = declared.join(known, ["repo_id", "path"], "left").groupBy(*keys).agg(
        F.count("*").alias("declared"), F.count_if(F.col("exists").isNull()).alias("missing")
    )
    return counted.withColumn("grounded_ratio", ratio(F.col("declared") - F.col("missing"), F.col("declared")))


def focus_grounding(refs: DataFrame, units: DataFrame) -> DataFrame:
    """Focus references with no unit at exactly that path, id and range."""
    key = ["repo_id", "path", "unit_id", "start", "end"]
    return refs.join(units.select(*key), key, "left_anti")


def recall(expected: DataFrame, named: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Expected files a prompt names, over those expected files that are on disk.

    ``expected`` and ``named`` have ``keys`` and ``path``; ``inventory`` has ``repo_id, path``.
    """
    present = expected.join(inventory.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    hits = named.select(*keys, "path", F.lit(True).alias("named")).distinct()
    counted = expected.select(*keys).distinct().join(
        present.join(hits, [*keys, "path"], "left")
        .groupBy(*keys)
        .agg(F.count("*").alias("total"), F.count("named").alias("hit")),
        keys,
        "left",
    )
    filled = counted.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("hit", F.coalesce("hit", F.lit(0)))
    return filled.withColumn("recall", ratio(F.col("hit"), F.col("total"))).withColumn(
        "failed", (F.col("total") > 0) & (F.col("hit") == 0)
    )


def new_rows(baseline: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Distinct ``after`` rows the baseline lacks."""
    return after.select(*key).distinct().join(baseline.select(*key), key, "left_anti")


def pairwise_verdicts(positional: DataFrame) -> DataFrame:
    """A winner only where both presentation orders name the same arm.

    ``positional`` has ``pair_id, dimension, ordering, first_arm, second_arm, winner, margin``.
    """
    arm = (
        F.when(F.col("winner") == "tie", "tie")
        .when(F.col("winner") == "first", F.col("first_arm"))
        .otherwise(F.col("second_arm"))
    )
    judged = positional.withColumn("arm", arm)
    pivoted = judged.groupBy("pair_id", "dimension").agg(
        F.max(F.when(F.col("ordering") == 0, F.col("arm"))).alias("ab"),
        F.max(F.when(F.col("ordering") == 1, F.col("arm"))).alias("ba"),
        F.max(F.when(F.col("ordering") == 0, F.col("margin"))).alias("ab_margin"),
    )
    stable = F.col("ab") == F.col("ba")
    return pivoted.select(
        "pair_id",
        "dimension",
        F.when(stable & (F.col("ab") != "tie"), F.col("ab")).alias("winner"),
        stable.alias("order_stable"),
        F.when(stable, F.col("ab_margin")).otherwise("none").alias("margin"),
    )


def paired_arms(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per task with the value of each arm side by side."""
    return runs.groupBy(*keys).agg(
        *[F.max(F.when(F.col("arm") == arm, F.col(value))).alias(arm) for arm in ("bootstrap", "control")]
    )


def paired_efficiency(pairs: DataFrame) -> DataFrame:
    """Mean, median, range and wins of the per-pair ratio bootstrap / control."""
    both = pairs.where(F.col("bootstrap").isNotNull() & F.col("control").isNotNull())
    rated = both.select(
        F.lit(1).alias("all"),
        ratio(F.col("bootstrap"), F.col("control")).alias("ratio"),
        (F.col("bootstrap") <= F.col("control")).alias("won"),
    )
    summed = rated.groupBy("all").agg(
        F.count("*").alias("pairs"),
        F.count("ratio").alias("rated"),
        F.avg("ratio").alias("mean_ratio"),
        F.min("ratio").alias("min_ratio"),
        F.max("ratio").alias("max_ratio"),
        F.count_if("won").alias("wins"),
    )
    # The median is found by counting, so the ratios are never sorted in one task.
    counts = rated.where("ratio IS NOT NULL").groupBy("all", "ratio").agg(F.count("*").alias("n"))
    ranked = running_total_before(
        counts, ["all"], [F.col("ratio")], F.col("n"), F.floor(F.col("ratio") * 100), "before"
    ).join(summed.select("all", "rated"), "all")

    def at(position: Column) -> Column:
        covered = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
        return F.max(F.when(covered, F.col("ratio")))

    middle = ranked.groupBy("all").agg(
        ((at(F.floor((F.col("rated") - 1) / 2)) + at(F.floor(F.col("rated") / 2))) / 2).alias("median_ratio")
    )
    return summed.join(middle, "all", "left").drop("all", "rated")


def _per_task(runs: DataFrame) -> DataFrame:
    log_tokens = F.ln("tokens")

    def arm(name: str, value: Column) -> Column:
        return F.avg(F.when(F.col("arm") == name, value))

    return runs.groupBy("task").agg(
        (arm("bootstrap", F.col("passed").cast("int")) - arm("control", F.col("passed").cast("int"))).alias("pass_diff"),
        (arm("bootstrap", log_tokens) - arm("control", log_tokens)).alias("log_diff"),
    )


def arm_effects(runs: DataFrame) -> DataFrame:
    """Mean over tasks of the pass-rate difference, and the geometric-mean token ratio."""
    return _per_task(runs).agg(
        F.avg("pass_diff").alias("pass_rate_difference"), F.exp(F.avg("log_diff")).alias("geometric_mean_ratio")
    )


def variance_split(runs: DataFrame) -> DataFrame:
    """Within-task and between-task standard deviation of log tokens, per arm."""
    per_task = runs.groupBy("arm", "task").agg(
        F.count("*").alias("n"), F.var_samp(F.ln("tokens")).alias("variance"), F.avg(F.ln("tokens")).alias("mean")
    )
    weight = F.col("n") - 1
    return per_task.groupBy("arm").agg(
        F.sqrt(F.sum(F.col("variance") * weight) / F.sum(F.when(F.col("variance").isNotNull(), weight))).alias("within"),
        F.stddev_samp("mean").alias("between"),
    )


#: Tasks of one block of the resample, about so many, while blocks are no more than BLOCKS; then blocks grow. A task is
#: four numbers, so that a block of a million is 32 MB.
BLOCK_TASKS, BLOCKS = 1024, 1024
_WORD = (1 << 64) - 1
_SUMS = "draw int, block int, total double"
_COUNTS = ("n_bootstrap", "k_bootstrap", "n_control", "k_control")


def _block_picks(sizes: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """How many of a draw's picks fall on each block: as many picks as there are tasks, each task equally likely."""
    random = np.random.Generator(np.random.Philox(key=[seed & _WORD, draw]))
    return random.multinomial(int(sizes.sum()), sizes / sizes.sum())


def _block_total(
    counts: np.ndarray, picks: int, draw: int, block: int, seed: int, alike: np.ndarray | None = None
) -> float:
    """Sum of the pass-rate differences of the tasks picked in a block; ``counts`` has the columns of ``_COUNTS``. A task
    picked w times has its repeats resampled w times, which passes a binomial number of w x n of them. With ``alike``, a
    row stands for so many tasks of equal counts: which of them is picked makes no difference, only how often."""
    random = np.random.Generator(np.random.Philox(key=[seed & _WORD, draw], counter=[0, 0, 1, block]))
    if alike is None:
        times = np.bincount(random.integers(0, len(counts), picks), minlength=len(counts))
    else:
        times = random.multinomial(picks, alike / alike.sum())
    n_b, k_b, n_c, k_c = counts[times > 0].T
    times = times[times > 0]
    return float((random.binomial(times * n_b, k_b / n_b) / n_b - random.binomial(times * n_c, k_c / n_c) / n_c).sum())


def bootstrap_interval(runs: DataFrame, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Interval of the pass-rate difference from a seeded two-level resample: tasks with replacement, then repeats within
    each task and arm. Tasks without runs in both arms are left out.

    Runs are reduced to run and pass counts per task, and tasks are dealt to blocks by a hash. Picking tasks with
    replacement is picking blocks by their sizes and then tasks within the block: each draw's picks are dealt to the
    blocks first, and every block adds up its own part of every draw. So a block's tasks meet no others, two numbers
    per draw and block are shuffled, and the result depends on the tasks and the seed alone, not on how rows are dealt.
    The driver holds a size for each block. Tasks of equal counts can stand for each other; where they make no more than
    half as many rows, blocks hold such classes with their sizes, so that a draw costs as much as there are different
    counts, not tasks.
    """
    counts = runs.groupBy("task").agg(
        *[F.count_if(F.col("arm") == arm).alias(f"n_{arm}") for arm in ("bootstrap", "control")],
        *[F.count_if((F.col("arm") == arm) & F.col("passed")).alias(f"k_{arm}") for arm in ("bootstrap", "control")],
    ).where("n_bootstrap > 0 AND n_control > 0")
    return _interval(counts, draws, seed, level)


def _interval(counts: DataFrame, draws: int, seed: int, level: float) -> DataFrame:
    difference = F.col("k_bootstrap") / F.col("n_bootstrap") - F.col("k_control") / F.col("n_control")
    equal = counts.groupBy(*_COUNTS).agg(F.count("*").alias("alike"))
    whole = equal.agg(
        F.count("*").alias("classes"),
        F.coalesce(F.sum("alike"), F.lit(0)).alias("tasks"),
        # a decimal sum, whose last digit does not depend on the shuffle
        F.try_divide(F.sum(difference.cast("decimal(20,18)") * F.col("alike")).cast("double"), F.sum("alike")).alias("estimate"),
    ).first()
    gathered = 2 * whole.classes <= whole.tasks
    key = _COUNTS if gathered else ("task",)
    rows = equal if gathered else counts.withColumn("alike", F.lit(1).cast("long"))
    blocks = min(BLOCKS, max(1, -(-(whole.classes if gathered else whole.tasks) // BLOCK_TASKS)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, np.int64)
    for r in dealt.groupBy("block").agg(F.sum("alike").alias("tasks")).collect():
        sizes[r["block"]] = r["tasks"]

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.column("id").to_pylist():
                picks = _block_picks(sizes, d, seed)
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(blocks), pa.int32()), "draw": pa.array([d] * blocks, pa.int32()), "picks": picks})

    def totals(key: tuple[int], rows: pa.Table, picks: pa.Table) -> pa.Table:
        block = key[0].as_py()
        rows, picks = rows.sort_by("name"), picks.sort_by("draw")
        held = np.stack([rows.column(c).to_numpy() for c in _COUNTS], 1)
        alike = rows.column("alike").to_numpy() if gathered else None
        dealt_out = zip(picks.column("draw").to_pylist(), picks.column("picks").to_pylist(), strict=True) if len(held) else ()
        sums = [(d, _block_total(held, n, d, block, seed, alike)) for d, n in dealt_out]
        return pa.table({
            "draw": pa.array([d for d, _ in sums], pa.int32()), "block": pa.array([block] * len(sums), pa.int32()), "total": pa.array([t for _, t in sums], pa.float64()),
        })

    # few bytes and much work: a stated number of partitions, which adaptive execution leaves as they are
    apart = dealt.select("block", F.concat_ws(" ", *key).alias("name"), *_COUNTS, "alike").repartition(blocks, "block")
    every = counts.sparkSession.range(1, (draws if whole.tasks else 0) + 1).mapInArrow(picked, "block int, draw int, picks long").repartition(blocks, "block")
    per_block = apart.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(totals, _SUMS)
    # sums of doubles in the blocks' order, so that the last digit does not depend on the shuffle
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "total"))), lambda x: x["total"])
    stat = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x) / max(whole.tasks, 1)
    per_draw = per_block.groupBy("draw").agg(stat.alias("stat"))
    tail = (1 - level) / 2
    return per_draw.agg(
        F.lit(whole.estimate).cast("double").alias("estimate"),
        F.percentile("stat", tail).alias("lo"),
        F.percentile("stat", 1 - tail).alias("hi"),
    )


def _runs(words: Column, length: int) -> Column:
    """Every run of ``length`` consecutive words."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + n) for n in range(length)]))


def _anchors(words: Column, lengths: range) -> Column:
    """Distinct runs of consecutive words, of each of the given lengths."""
    return F.array_distinct(let(words, lambda w: F.concat(*[_runs(w, n) for n in lengths])))


def _marker_anchor(inner: Column) -> Column:
    """The longest-spelled run of a marker's inner words, at the greatest run length they allow."""

    def choose(w: Column) -> Column:
        runs = F.when(F.size(w) >= 3, _runs(w, 3)).when(F.size(w) == 2, _runs(w, 2)).otherwise(w)
        return F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]

    return let(inner, choose)


def marker_lines(texts: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line, content, marker_id, marker``: every line that contains a marker.

    A line holding a marker holds the marker's inner words whole, so the two meet on one run of inner
    words; markers without inner words meet on their first characters. Every pair is then tested exactly.
    The finer-grained meetings are separate joins: when no marker needs one, its side is empty and
    adaptive execution drops it before the lines are exploded.
    """
    lines = unnest(texts, keys, lines_of(F.col("text")), ["pos", "content"]).where("content <> ''")
    words = F.regexp_extract_all("marker", F.lit(f"({WORD})"), 1)
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    usable = markers.where((F.length("marker") > 0) & ~F.col("marker").contains("\n"))
    split = usable.withColumn("anchor", _marker_anchor(inner))
    anchor_words = F.size(F.split("anchor", " "))
    by_long = split.where(anchor_words == ANCHOR_WORDS)
    by_short = split.where(anchor_words < ANCHOR_WORDS)
    by_gram = split.where("anchor IS NULL").withColumn("gram_chars", F.least(F.length("marker"), F.lit(GRAM_CHARS)))
    row_keys = [*keys, "pos", "content"]
    line_words = F.regexp_extract_all("content", F.lit(f"({WORD})"), 1)
    long_runs = unnest(lines, row_keys, _anchors(line_words, range(ANCHOR_WORDS, ANCHOR_WORDS + 1)), ["anchor"])
    short_runs = unnest(lines, row_keys, _anchors(line_words, range(1, ANCHOR_WORDS)), ["anchor"])
    word_hits = long_runs.join(by_long, "anchor").unionByName(short_runs.join(by_short, "anchor"))
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(GRAM_CHARS)),
            lambda n: F.transform(F.sequence(F.lit(1), F.length("content")), lambda i: F.col("content").substr(i, n)),
        )
    )
    gram_hits = unnest(lines, row_keys, F.array_distinct(grams), ["anchor"]).join(
        by_gram.withColumn("anchor", F.expr("substring(marker, 1, gram_chars)")), "anchor"
    )
    columns = [*row_keys, "marker_id", "marker"]
    return word_hits.select(*columns).unionByName(gram_hits.select(*columns)).where(
        F.contains(F.col("content"), F.col("marker"))
    ).withColumn("line", F.col("pos") + 1).drop("pos")


def marker_occurrences(texts: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """Every occurrence of every marker, overlapping ones included, attributed when wholly inside a
    quotation that the line introduces."""
    hits = marker_lines(texts, markers, keys)
    starts = F.filter(
        F.sequence(F.lit(1), F.length("content") - F.length("marker") + 1),
        lambda i: F.col("content").substr(i, F.length("marker")) == F.col("marker"),
    )
    rows = unnest(hits, [*keys, "line", "content", "marker_id", "marker"], starts, ["start"])
    end = F.col("start") + F.length("marker") - 1
    inside = F.exists(quoted_spans(F.col("content")), lambda s: (F.col("start") >= s["start"]) & (end <= s["end"]))
    return rows.select(*keys, "line", "marker_id", "start", inside.alias("attributed"))


# How an attributed quotation is introduced.
QUOTED_LITERAL = r'"(?:[^"\\]|\\.)*"'
NOTE_LINE = r"^[│|\s]*(?:Note: )?Quoted from "
SUMMARY_LABEL = "quoted: "


def quoted_spans(line: Column) -> Column:
    """``array<struct<start, end>>``: 1-based character ranges of the introduced quotations of a line."""
    literals = F.regexp_extract_all(line, F.lit(f"({QUOTED_LITERAL})"), 1)

    def walk(acc: Column, literal: Column) -> Column:
        at = _instr_from(line, literal, acc["after"])
        return let(at, lambda start: F.struct(
            (start + F.length(literal)).alias("after"),
            F.concat(acc["spans"], F.array(F.struct(
                start.alias("literal_at"), (start + 1).alias("start"), (start + F.length(literal) - 2).alias("end")
            ))).alias("spans"),
        ))

    none = F.array().cast("array<struct<literal_at:int,start:int,end:int>>")
    found = F.aggregate(
        literals, F.struct(F.lit(1).alias("after"), none.alias("spans")), walk, lambda acc: acc["spans"]
    )
    is_note = line.rlike(NOTE_LINE)

    def introduced(span: Column) -> Column:
        before = line.substr(F.lit(1), span["literal_at"] - 1)
        return before.endswith(SUMMARY_LABEL) | (is_note & (before.endswith(": ") | before.endswith("§ ")))

    return F.filter(found, introduced)


def _instr_from(text: Column, part: Column, start: Column) -> Column:
    """1-based position of ``part`` at or after ``start``."""
    return (F.instr(text.substr(start, F.length(text)), part) + start - 1).cast("int")


def agreement(prompt_side: DataFrame, manifest_side: DataFrame) -> DataFrame:
    """Whether a prompt and its manifest agree: equal prompt hash and equal unit sets.

    Both sides have ``repo_id, prompt_hash, unit_ref``, one row per unit (null for none).
    """
    sides = prompt_side.withColumn("side", F.lit(1)).unionByName(manifest_side.withColumn("side", F.lit(2)))
    per_unit = sides.groupBy("repo_id", "unit_ref").agg(F.sum("side").alias("sides"), F.countDistinct("prompt_hash").alias("hashes"))
    return per_unit.groupBy("repo_id").agg(
        F.bool_and((F.col("sides") == 3) | F.col("unit_ref").isNull()).alias("same_units"),
    ).join(
        sides.groupBy("repo_id").agg((F.countDistinct("prompt_hash") == 1).alias("same_prompt")), "repo_id"
    )
