"""The bucketed ordered helpers against plain Python, with buckets small enough to cross."""

import random

import pytest
from pyspark.sql import functions as F

from fleetledger.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [("ab"[rng.random() < 0.8], i, rng.choice([None, rng.randint(1, 9)])) for i in rng.sample(range(200), 120)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, o long, v long")


def expected(rows, step):
    out = {}
    for key in "ab":
        ours = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for n, row in enumerate(ours):
            out[(key, row[1])] = step(ours, n)
    return out


def got(df):
    return {(r["k"], r["o"]): r["out"] for r in df.collect()}



def bucket():
    return F.floor(F.col("o") / 7)


def test_running_total_before(frame, rows):
    filled = frame.withColumn("v", F.coalesce("v", F.lit(0)))
    df = ordered.running_total_before(filled, ["k"], [F.col("o")], F.col("v"), bucket(), "out")
    assert got(df) == expected(rows, lambda ours, n: sum(r[2] or 0 for r in ours[:n]))


def test_ordinal(frame, rows):
    assert got(ordered.ordinal(frame, ["k"], [F.col("o")], bucket(), "out")) == expected(rows, lambda _, n: n + 1)


def test_carry_last(frame, rows):
    df = ordered.carry_last(frame, ["k"], [F.col("o")], F.col("v"), bucket(), "out")
    assert got(df) == expected(
        rows, lambda ours, n: next((r[2] for r in reversed(ours[: n + 1]) if r[2] is not None), None)
    )


def test_next_value(frame, rows):
    df = ordered.next_value(frame, ["k"], [F.col("o")], F.col("v"), bucket(), "out")
    assert got(df) == expected(rows, lambda ours, n: ours[n + 1][2] if n + 1 < len(ours) else None)
