"""Resharding by minimum-cost flow.

Documents lie in old shards of uneven sizes; each new shard has a capacity. A flow from shards with too much to shards
with too little says how many bytes go where: of all plans it costs least, a byte that stays being free. Blocks of
documents are then chosen to make up the flow, and only these move; files of shards that neither give nor take stay as
they are.

A block holds texts that hash alike, so copies of a text lie and move together. A block that exceeds the share of a shard
that may stay together moves in parts, split by text; only the copies of a text that exceeds that share by itself are
split by ids. The number of parts is bounded by the parameters, so the plan is made on the driver from their sizes
alone."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetledger.llm.common import Workspace

SHARDS = 24
#: Blocks of an old shard; parts of a shard's capacity of which one bounds a part; and one bounds what stays together.
BLOCKS = 2048
SPLIT = 64
TOGETHER = 4
FIXED_BYTES = 8


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Amounts (from, to) that serve all demand from supply at the least cost, by successive shortest paths with
    potentials. cost: nonnegative, per unit. Sums must agree."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    arcs: list[list[int]] = []  # to, room, cost; the reverse arc is at index ^ 1
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, price])
        out[b].append(len(arcs))
        arcs.append([a, 0, -price])

    for i, amount in enumerate(supply):
        add(source, i, amount, 0)
    for j, amount in enumerate(demand):
        add(n + j, sink, amount, 0)
    first = len(arcs)
    for i in range(n):
        for j in range(m):
            add(i, n + j, min(supply[i], demand[j]), cost[i][j])
    potential = [0] * len(out)
    while True:
        best: list[float] = [float("inf")] * len(out)
        best[source] = 0
        through = [-1] * len(out)
        heap = [(0, source)]
        while heap:
            far, a = heapq.heappop(heap)
            if far > best[a]:
                continue
            for e in out[a]:
                b, room, price = arcs[e]
                reach = far + price + potential[a] - potential[b]
                if room and reach < best[b]:
                    best[b], through[b] = reach, e
                    heapq.heappush(heap, (reach, b))
        if through[sink] < 0:
            break
        potential = [p + int(b) if b < float("inf") else p for p, b in zip(potential, best, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(through[at])
            at = arcs[through[at] ^ 1][0]
        amount = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= amount
            arcs[e ^ 1][1] += amount
    flow = {}
    for i in range(n):
        for j in range(m):
            sent = arcs[first + 2 * (i * m + j) + 1][1]
            if sent:
                flow[i, j] = sent
    return flow


def plan(blocks: list[tuple[int, int, int]], capacities: list[int]) -> list[int]:
    """blocks: (old shard, key, bytes). The new shard of each block, when shard i may hold capacities[i], of which the
    sum is all bytes. From each shard with too much the largest blocks that still fit its surplus leave, down to the
    smallest, each to the shard that the flow from there still owes most, if it fits there. What stays off the
    capacities is less than the smallest blocks."""
    held = [0] * len(capacities)
    own = defaultdict(list)
    for at, (shard, key, size) in enumerate(blocks):
        held[shard] += size
        own[shard].append((-size, key, at))
    surplus = [max(h - c, 0) for h, c in zip(held, capacities, strict=True)]
    lack = [max(c - h, 0) for h, c in zip(held, capacities, strict=True)]
    flow = min_cost_flow(surplus, lack, [[0 if i == j else 1 for j in range(len(lack))] for i in range(len(surplus))])
    place = [shard for shard, _, _ in blocks]
    for shard in range(len(capacities)):
        left = surplus[shard]
        goals = {j: amount for (i, j), amount in flow.items() if i == shard}
        for size, _, at in sorted(own[shard]):
            to = max(goals, key=lambda j: (goals[j], -j), default=-1)
            if to >= 0 and 0 < -size <= min(left, goals[to]):
                place[at] = to
                left += size
                goals[to] += size
    return place


def reshard(
    docs: DataFrame, work: Workspace, shards: int = SHARDS, blocks: int = BLOCKS, old_shard: Column | None = None
) -> DataFrame:
    """New shards of docs (doc_id, text; other columns play no part) with sizes near equal (law bytes).

    old_shard: where a row lies now, 0 to shards - 1; by default a hash of its text. Returns per row doc_id, size (UTF-8
    bytes of the text, null: none, plus 8), text_crc32, law, old_shard, shard, slot (0, 1, ... in each shard, by block
    and then id), grown_shard (null). Rows of equal text lie in one shard if they do so now, unless that text alone holds
    more than 1 / TOGETHER of a shard. Repeated rows are rows of their own. A null text and an empty one count alike. An empty table has no rows to place.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    text = F.xxhash64(raw)
    old = old_shard if old_shard is not None else F.pmod(text, F.lit(shards))
    rows = work.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.length(raw) + FIXED_BYTES).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            old.cast("int").alias("old_shard"),
            F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int").alias("bucket"),
            text.alias("text_key"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = max(1, total // (shards * SPLIT))
    sizes = rows.groupBy("old_shard", "bucket").agg(F.sum("size").alias("bytes"))
    parts = sizes.select("old_shard", "bucket", F.ceil(F.col("bytes") / limit).cast("int").alias("parts"))
    # at most shards x TOGETHER texts are larger than what stays together
    large = rows.groupBy("text_key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * (TOGETHER * shards) > total)
    large = large.select("text_key", F.lit(True).alias("large"))
    spread = F.when(F.col("large"), F.xxhash64("doc_id", F.lit(1))).otherwise(F.xxhash64("text_key", F.lit(2)))
    # at most shards x blocks rows; the parts add at most shards x SPLIT
    split = (
        rows.join(F.broadcast(parts), ["old_shard", "bucket"])
        .join(F.broadcast(large), "text_key", "left")
        .withColumn("part", F.pmod(spread, F.col("parts")).cast("int"))
    )
    split = work.save(split.drop("text_key", "large", "parts"), "blocks")
    found = split.groupBy("old_shard", "bucket", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    listed = sorted((r["old_shard"], r["bucket"], r["part"], r["bytes"], r["n"]) for r in found.collect())
    capacities = [total // shards + (i < total % shards) for i in range(shards)]
    whole: dict[tuple[int, int], int] = defaultdict(int)
    for old, bucket, _, size, _ in listed:
        whole[old, bucket] += size
    units: dict[tuple[int, int, int], int] = defaultdict(int)
    unit_of = []
    for old, bucket, part, size, _ in listed:
        unit_of.append((old, bucket, part if whole[old, bucket] * TOGETHER * shards > total else -1))
        units[unit_of[-1]] += size
    goal = dict(zip(units, plan([(u[0], at, n) for at, (u, n) in enumerate(units.items())], capacities), strict=True))
    place = [goal[u] for u in unit_of]
    first: dict[int, int] = defaultdict(int)
    placed = []
    for (old, bucket, part, _, n), shard in zip(listed, place, strict=True):
        placed.append((old, bucket, part, shard, first[shard]))
        first[shard] += n
    moves = docs.sparkSession.createDataFrame(placed, "old_shard int, bucket int, part int, shard int, first long")
    within = Window.partitionBy("old_shard", "bucket", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        split.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(moves), ["old_shard", "bucket", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "old_shard", "shard",
            (F.col("first") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Writes the files of all shards that gave or took documents, below path in shard=<n>, replacing these and no
    other; returns their numbers. docs: doc_id and any columns, ids unique; placed: the result of reshard. docs must
    not be read from path itself: Spark can't replace files that it is reading."""
    moved = placed.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard"))
    touched = sorted(r[0] for r in moved.distinct().collect())
    rows = docs.join(placed.where(F.col("shard").isin(touched)).select("doc_id", "shard", "slot"), "doc_id")
    (
        rows.repartitionByRange(max(len(touched), 1), "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .drop("slot")
        .write.partitionBy("shard")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )
    return touched


def rewritten(docs: DataFrame, work: Workspace, **options) -> DataFrame:
    """reshard() with its files: those of all shards that gave or took documents are written, each row with its text and
    slot, and what the result says of these rows is read from them. Rows of other shards stay where they are.

    docs: doc_id, text; ids may be missing or repeated. Rows of equal id and text are the same text, which is shuffled
    once, to its places.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size, crc = (F.length(raw) + FIXED_BYTES).cast("long"), F.crc32(raw)
    placed = work.save(reshard(docs, work, **options), "placed")
    moved = placed.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard"))
    touched = sorted(r[0] for r in moved.distinct().collect())
    key = ["__id", "__size", "__crc", "__none"]
    names = {"__size": F.col("size"), "__crc": F.col("text_crc32")}

    def keyed(rows: DataFrame, more: dict[str, Column]) -> DataFrame:
        number = F.col("doc_id").cast("long")
        return rows.withColumns({"__id": F.coalesce(number, F.lit(0)), "__none": number.isNull(), **more})

    texts = keyed(docs.select("doc_id", "text"), {"__size": size, "__crc": crc}).drop("doc_id").dropDuplicates(key)
    affected = keyed(placed.where(F.col("shard").isin(touched)), names).select(*key, "doc_id", "old_shard", "shard", "slot")
    path = f"{work.folder}/shards"
    rows = affected.join(texts, key).select("doc_id", "old_shard", "slot", "text", "shard")
    rows.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    files = docs.sparkSession.read.schema("doc_id long, old_shard int, slot long, text string, shard int").parquet(path)
    read = files.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "old_shard", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return read.union(placed.where(~F.col("shard").isin(touched)).select(read.columns))
