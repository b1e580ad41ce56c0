"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) sorted by size enter the bin with the tightest remaining capacity, found in a balanced
tree. To stay bounded at any input size this runs in two steps of the same kind:

1. Tasks, as many as the rows need (``TASKS`` at most), pack their share of the groups into crates of a fixed small
   capacity (a shard's capacity divided by ``crates_per_shard``); each task keeps its open crates in a balanced tree.
   Groups over a crate's capacity, of which there are no more than crates, stay out of them.
2. The crates, at most two of each capacity and one more for each task whatever the input, and the groups over a crate's
   capacity enter the shards by the same rule, each whole, at the smallest capacity of the shards that a search finds.

So every group that fits a shard lies in one. Only a group that is larger than a whole shard (all bytes over the number of
shards), and so fits none, is spread over several by whole rows, in chunks that go through the crates. Slots are ranks
within a shard from range partitions and their counts, so neither a group nor a crate or shard is one task's.

Defined results: a null text has no bytes and is grouped with the empty text; ids may repeat or be null (each row
gets its own slot); an empty table gives an empty result; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.operators.selection import placed_within

from .common import ship, stored, table

CRATES_PER_SHARD = 512
#: Rows for each packing task, and packing tasks at most.
ROWS_PER_TASK, TASKS = 250_000, 4096


class Remaining:
    """AVL tree of (remaining capacity, bin), for the tightest bin that still holds a size."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None  # node: [key, left, right, height]

    @staticmethod
    def _fix(n: list) -> list:
        high = lambda x: x[3] if x else 0

        def turned(n: list, a: int, b: int) -> list:
            up = n[a]
            n[a], up[b] = up[b], n
            n[3] = 1 + max(high(n[1]), high(n[2]))
            up[3] = 1 + max(high(up[1]), high(up[2]))
            return up

        for a, b in ((1, 2), (2, 1)):
            if high(n[a]) > high(n[b]) + 1:
                if high(n[a][b]) > high(n[a][a]):
                    n[a] = turned(n[a], b, a)
                return turned(n, a, b)
        n[3] = 1 + max(high(n[1]), high(n[2]))
        return n

    def add(self, key: tuple) -> None:
        def put(n):
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = put(n[side])
            return self._fix(n)

        self.root = put(self.root)

    def remove(self, key: tuple) -> None:
        def cut(n, key):
            if key == n[0]:
                if not (n[1] and n[2]):
                    return n[1] or n[2]
                least = n[2]
                while least[1]:
                    least = least[1]
                n[0] = least[0]
                n[2] = cut(n[2], least[0])
            else:
                side = 1 if key < n[0] else 2
                n[side] = cut(n[side], key)
            return self._fix(n)

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple | None:
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[1]
            else:
                n = n[2]
        return best


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, for sizes in decreasing order; one over the capacity has a bin to itself."""
    tree, bins, out = Remaining(), 0, []
    for s in sizes:
        found = tree.tightest(s)
        if found is None:
            found = (capacity, bins)
            bins += 1
        else:
            tree.remove(found)
        left = found[0] - s
        if left > 0:
            tree.add((left, found[1]))
        out.append(found[1])
    return out


def least_capacity(sizes: list[int], bins: int) -> tuple[int, list[int]]:
    """A capacity at which the sizes, in decreasing order, enter so many bins, and their bins: found by doubling steps, then by halving what lies between it and one that failed, to 1 part in 4096."""
    total = sum(sizes)
    low = max([-(-total // bins), *sizes[:1], 1])
    fine = step = max(1, low >> 12)
    fits = lambda got: max(got, default=-1) < bins
    at, failed = low, low - 1
    while not fits(got := best_fit(sizes, at)):
        at, failed, step = at + step, at, step * 2
    while at - failed > fine:
        middle = (at + failed) // 2
        if fits(now := best_fit(sizes, middle)):
            at, got = middle, now
        else:
            failed = middle
    return at, got


def crates(sizes: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """(g, chunk, n, bytes) with a crate for each row of sizes: bins of the capacity, packed by each task on its own."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        tree, made = Remaining(), 0
        for pdf in batches:
            out = []
            for s in pdf["bytes"].tolist():
                found = tree.tightest(s)
                if found is None:
                    found = (capacity, made)
                    made += 1
                else:
                    tree.remove(found)
                if found[0] > s:
                    tree.add((found[0] - s, found[1]))
                out.append(first + found[1])
            yield pdf.assign(crate=out)

    ordered = sizes.repartition(tasks, "g", "chunk").sortWithinPartitions(F.desc("bytes"), "g", "chunk")
    return ordered.mapInPandas(pack, "g binary, chunk int, n long, bytes long, crate long")


def shard(docs: DataFrame, shards: int = 40, group: Column | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, crates_per_shard: int = CRATES_PER_SHARD) -> DataFrame:
    """Each row of docs with its size, crc32, shard and gapless slot; groups (by default equal texts) stay whole."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(text_col, F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.unhex(F.sha2(text if group is None else group.cast("string"), 256)).alias("g"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    full = max(1, -(-total // shards))
    small = max(1, full // crates_per_shard)
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # Of groups over a crate's capacity there are at most shards * crates_per_shard, whatever the input.
    large = stored(groups.filter(F.col("bytes") > small), "shard-large")
    whole, wide = large.filter(F.col("bytes") <= full), large.filter(F.col("bytes") > full)
    chunks = wide.select("g", F.ceil(F.col("bytes") / small).cast("int").alias("chunks"))
    rest = rows.join(F.broadcast(whole.select("g")), "g", "left_anti").join(F.broadcast(chunks), "g", "left")
    rest = rest.withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), "chunks").cast("int")))
    units = rest.groupBy("g", "chunk").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    boxed = stored(crates(units, small, min(TASKS, max(1, -(-n // ROWS_PER_TASK)))), "shard-crates")
    # At most two crates of each capacity, one more for each task, and the large groups: no more rows than the parameters allow.
    items = boxed.groupBy("crate").agg(F.sum("bytes").alias("bytes")).select("crate", F.lit(None).cast("binary").alias("g"), "bytes")
    items = items.unionByName(whole.select(F.lit(None).cast("long").alias("crate"), "g", "bytes")).orderBy(F.desc("bytes"), "crate", "g").toPandas()
    _, items["shard"] = least_capacity(items["bytes"].tolist(), shards)
    by_crate = spark.createDataFrame([(int(c), int(s)) for c, s, g in zip(items["crate"], items["shard"], items["g"]) if g is None], "crate long, shard int")
    by_group = spark.createDataFrame([(bytes(g), int(s)) for s, g in zip(items["shard"], items["g"]) if g is not None], "g binary, shard int")
    kept = ["id", "size", "crc", "row", "shard"]
    placed = rest.join(boxed.select("g", "chunk", "crate"), ["g", "chunk"]).join(F.broadcast(by_crate), "crate").select(kept).unionByName(rows.join(F.broadcast(by_group), "g").select(kept))
    return placed_within(placed, "shard", ["id", "crc", "size", "row"], "place").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40)


QUERIES = {"op10_sharding": op10_sharding}
