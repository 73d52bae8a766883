"""The two-level resample against plain ones."""

import random
import statistics
import time

import numpy as np
import pytest

from fleetledger.operators import evals

RUNS = "task string, arm string, passed boolean"


def make_runs(seed, tasks, repeats=6):
    rng = random.Random(seed)
    rows = []
    for t in range(tasks):
        base = rng.random()
        for arm, rate in (("bootstrap", min(1, base + 0.1)), ("control", base)):
            rows += [(f"t{t}", arm, rng.random() < rate) for _ in range(rng.randint(1, repeats))]
    return rows


def counts_of(rows):
    """(n, k) of both arms per task, of tasks with both."""
    found = {}
    for task, arm, passed in rows:
        found.setdefault(task, {}).setdefault(arm, []).append(passed)
    return {t: (len(a["bootstrap"]), sum(a["bootstrap"]), len(a["control"]), sum(a["control"])) for t, a in found.items() if len(a) == 2}


def plain_interval(counts, draws, rng, level=0.95):
    """Slot by slot and repeat by repeat, as the resample is defined."""
    tasks = list(counts.values())
    stats = []
    for _ in range(draws):
        total = 0.0
        for _ in tasks:
            nb, kb, nc, kc = rng.choice(tasks)
            total += sum(rng.randrange(nb) < kb for _ in range(nb)) / nb - sum(rng.randrange(nc) < kc for _ in range(nc)) / nc
        stats.append(total / len(tasks))
    return np.quantile(stats, [(1 - level) / 2, (1 + level) / 2])


def closed_form_error(counts):
    """Standard deviation of the resampled mean: spread between tasks and binomial spread within them."""
    diffs = [kb / nb - kc / nc for nb, kb, nc, kc in counts.values()]
    inner = [kb / nb * (1 - kb / nb) / nb + kc / nc * (1 - kc / nc) / nc for nb, kb, nc, kc in counts.values()]
    return ((statistics.pvariance(diffs) + statistics.fmean(inner)) / len(diffs)) ** 0.5


def test_interval_agrees_with_a_plain_resample(spark):
    rows = make_runs(1, 60)
    counts = counts_of(rows)
    got = evals.bootstrap_interval(spark.createDataFrame(rows, RUNS), 5000, 7).first()
    error = closed_form_error(counts)
    assert got.estimate == pytest.approx(statistics.fmean(kb / nb - kc / nc for nb, kb, nc, kc in counts.values()))
    lo, hi = plain_interval(counts, 2000, random.Random(3))
    assert abs(got.lo - lo) < 0.2 * error and abs(got.hi - hi) < 0.2 * error
    assert abs(got.lo - (got.estimate - 1.96 * error)) < 0.2 * error


def test_blocks_add_up_to_the_same_law(spark, monkeypatch):
    """Cut into many blocks, the resample has the same spread as in one."""
    rows = make_runs(2, 300)
    runs = spark.createDataFrame(rows, RUNS)
    whole = evals.bootstrap_interval(runs, 3000, 7).first()
    monkeypatch.setattr(evals, "BLOCK_TASKS", 20)
    cut = evals.bootstrap_interval(runs, 3000, 7).first()
    error = closed_form_error(counts_of(rows))
    assert whole.estimate == pytest.approx(cut.estimate)
    assert abs(whole.lo - cut.lo) < 0.2 * error and abs(whole.hi - cut.hi) < 0.2 * error


def test_result_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(evals, "BLOCK_TASKS", 10)
    rows = make_runs(3, 80)
    first = evals.bootstrap_interval(spark.createDataFrame(rows, RUNS).repartition(1), 200, 7).first()
    random.Random(1).shuffle(rows)
    again = evals.bootstrap_interval(spark.createDataFrame(rows, RUNS).repartition(7), 200, 7).first()
    other = evals.bootstrap_interval(spark.createDataFrame(rows, RUNS), 200, 8).first()
    assert tuple(first) == tuple(again) and tuple(first) != tuple(other)


def test_draws_equal_plain_sums_of_the_same_picks(spark, monkeypatch):
    """Brute force: every draw, block and task in plain loops from the same generators."""
    monkeypatch.setattr(evals, "BLOCK_TASKS", 8)
    rows = make_runs(4, 40)
    counts = counts_of(rows)
    from pyspark.sql import functions as F

    blocks = -(-len(counts) // 8)
    frame = spark.createDataFrame([(t,) for t in counts], "task string")
    of = {r.task: r.b for r in frame.select("task", F.pmod(F.xxhash64("task"), F.lit(blocks)).alias("b")).collect()}
    members = [sorted(t for t in counts if of[t] == b) for b in range(blocks)]
    sizes = np.array([len(m) for m in members])
    stats = []
    for draw in range(1, 101):
        picks, total = evals._block_picks(sizes, draw, 7), 0.0
        assert picks.sum() == len(counts)
        for b, names in enumerate(members):
            if names:
                total += evals._block_total(np.array([counts[t] for t in names]), int(picks[b]), draw, b, 7)
        stats.append(total / len(counts))
    got = evals.bootstrap_interval(spark.createDataFrame(rows, RUNS), 100, 7).first()
    assert [got.lo, got.hi] == pytest.approx(np.quantile(stats, [0.025, 0.975]).tolist())


def test_no_tasks_and_one_sided_tasks(spark):
    for rows in ([], [("t", "control", True)]):
        got = evals.bootstrap_interval(spark.createDataFrame(rows, RUNS), 50, 7).first()
        assert got.estimate is None and got.lo is None and got.hi is None
    certain = [("t", "bootstrap", True), ("t", "control", False)]
    assert tuple(evals.bootstrap_interval(spark.createDataFrame(certain, RUNS), 50, -7).first()) == (1.0, 1.0, 1.0)


def test_tasks_of_equal_counts_are_resampled_together(spark, monkeypatch):
    """Many tasks of few different counts: the law of the plain resample, at the cost of the counts."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(evals, "BLOCK_TASKS", 4)
    few = make_runs(5, 12)
    rows = [(f"{t}-{i}", arm, passed) for i in range(20) for t, arm, passed in few]
    got = evals.bootstrap_interval(spark.createDataFrame(rows, RUNS), 3000, 7).first()
    counts = counts_of(rows)
    error = closed_form_error(counts)
    assert got.estimate == pytest.approx(statistics.fmean(kb / nb - kc / nc for nb, kb, nc, kc in counts.values()))
    lo, hi = plain_interval(counts, 1000, random.Random(3))
    assert abs(got.lo - lo) < 0.3 * error and abs(got.hi - hi) < 0.3 * error
    assert abs(got.lo - (got.estimate - 1.96 * error)) < 0.2 * error
    monkeypatch.undo()
    number = F.col("id") % 4
    runs = spark.range(800_000).select(
        F.floor(F.col("id") / 4).alias("task"), F.when(number < 2, "bootstrap").otherwise("control").alias("arm"), (F.pmod(F.xxhash64("id"), F.lit(2)) == 0).alias("passed")
    )
    start = time.time()
    assert evals.bootstrap_interval(runs, 5000, 7).first().estimate is not None
    assert time.time() - start < 40
