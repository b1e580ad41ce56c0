"""Hard-negative mining: slot-decomposed selection.

An anchor's positives are its nearest rows of its own label. Every positive asks for the nearest rows of other labels
whose score lies in a window that its own score sets, so an anchor asks overlapping windows:

1. The upper limits of an anchor's positives cut the scores into disjoint slots; a row falls into one slot or none.
2. A task multiplies its rows, block by block, by a broadcast batch of anchors and keeps the first k of each anchor and
   slot. What comes later is held against the k-th so far, so few rows are ever ordered.
3. Tasks' lists meet in a shuffle by anchor and slot, and the first k stay.
4. A window that begins at a positive's upper limit is its slot and all below: the slots are merged from the top down,
   the first k taken, and those under the window's lower limit left out.

The positives are found by the same job with one slot and the rows of the anchor's label. Anchors are a stated query set;
they meet all rows in batches of at most ``ANCHOR_BYTES``, one pass over the rows each. Scores are exact integers: one
product of matrices in double precision where no sum can reach 2 ** 49, whole numbers of any size beyond.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a shorter vector
counts as filled up with zeros; rows are told apart as rows, so rows of one id are candidates, anchors and positives each
on their own; a null id comes last among ties and is no anchor; an anchor without positives gives no row; a score over 64
bits raises; an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import ship, stored, table

#: Anchors of one pass: bytes of their vectors, and so many at most.
ANCHOR_BYTES, ANCHORS = 16 << 20, 32_768
#: Anchors and rows that are multiplied at a time.
BLOCK, ROWS = 512, 4096
#: Rows for each task.
ROWS_PER_TASK = 200_000
NO_ID = (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers held as doubles, exactly, as 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**49:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    exact = whole(a) @ whole(b).T
    if exact.size and max(exact.max(), -exact.min()) >= 1 << 63:
        raise OverflowError("a score exceeds 64 bits")
    return exact.astype(np.int64)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """One row for each list, filled up with zeros."""
    lengths, values = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


class Slots:
    """The first k of each anchor and slot among the rows seen so far: more score first, then the smaller id."""

    def __init__(self, anchors: dict, k: int, same: bool) -> None:
        self.a, self.k, self.same = anchors, k, same
        n, slots = anchors["upper"].shape
        self.bar = np.full((n, slots + 1), np.iinfo(np.int64).min)  # the k-th score so far
        self.bar[:, 0] = np.iinfo(np.int64).max  # slot 0 lies above all limits
        self.kept = [np.zeros(0, dtype=np.int64) for _ in range(5)]  # anchor, slot, score, id, row

    def add(self, x: np.ndarray, label: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        found = [self.kept]
        for at in range(0, len(self.a["row"]), BLOCK):
            own = slice(at, at + BLOCK)
            if self.same and not np.isin(self.a["label"][own], label).any():
                continue
            s = products(self.a["x"][own], x)
            fits = (self.a["label"][own, None] == label[None, :]) == self.same
            fits &= s >= self.a["least"][own, None]
            slot = np.zeros(s.shape, dtype=np.int8)
            for upper in self.a["upper"][own].T:
                slot += s <= upper[:, None]
            fits &= (slot > 0) & (s >= np.take_along_axis(self.bar[own], slot, axis=1))
            if self.same:
                fits &= self.a["row"][own, None] != row[None, :]
            i, j = np.nonzero(fits)
            found.append([i + at, slot[i, j].astype(np.int64), s[i, j], ids[j], row[j]])
        if len(found) == 1:
            return
        anchor, slot, score, ids, row = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((row, ids, -score, slot, anchor))
        group = anchor[order] * 128 + slot[order]
        first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, dtype=bool)
        rank = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        order = order[rank < self.k]
        self.kept = [c[order] for c in (anchor, slot, score, ids, row)]
        last = order[rank[rank < self.k] == self.k - 1]
        self.bar[anchor[last], slot[last]] = score[last]


def best(rows: DataFrame, anchors: dict, k: int, same: bool) -> DataFrame:
    """(anchor, slot, score, id, row, rank): the first k rows of each anchor (its place in the batch) and slot."""
    width = anchors["x"].shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, step = Slots(sent.value, k, same), 64
        for b in batches:
            x, (label, ids, row) = matrix(b.column("x"), width), (b.column(c).to_numpy() for c in ("label", "id", "row"))
            at = 0
            while at < len(x):
                part = slice(at, at + step)
                slots.add(x[part], label[part], ids[part], row[part])
                at, step = at + step, min(ROWS, step * 2)  # the first rows set the bars
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in slots.kept], names=["anchor", "slot", "score", "id", "row"])

    found = rows.mapInArrow(scan, "anchor long, slot long, score long, id long, row long")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each positive of each anchor the first rows of other labels that score between ``low`` and ``high`` (fractions) of the positive's score."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    own = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.when(sound, x).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    ).filter("label IS NOT NULL AND x IS NOT NULL")
    n = vectors.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    own = own.withColumn("x", F.transform("x", lambda c: F.floor(c * scale).cast("double") if scale else c)).repartition(tasks).withColumn("row", F.monotonically_increasing_id())
    rows = stored(own, "negatives-rows")
    width, asked = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.count_if("asks")).first()
    batches = max(1, -(-asked // max(1, min(ANCHORS, ANCHOR_BYTES // (8 * max(1, width))))))
    out = None
    for b in range(batches):
        some = rows.filter("asks").filter(F.pmod(F.xxhash64("row"), F.lit(batches)) == b).orderBy("row").toPandas()
        batch = {"x": np.zeros((len(some), max(1, width))), "row": some["row"].to_numpy(np.int64), "label": some["label"].to_numpy(np.int64)}
        for i, v in enumerate(some["x"]):
            batch["x"][i, : len(v)] = v
        top = np.iinfo(np.int64)
        free = batch | {"upper": np.full((len(some), 1), top.max), "least": np.full(len(some), top.min)}
        chosen = stored(best(rows, free, positives, True).select("anchor", "rank", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "negatives-positives")
        # Positives come in order of their scores, so their upper limits descend, and a positive's rank is its slot.
        near = chosen.toPandas()
        upper, least = np.full((len(some), positives), top.min), np.full(len(some), top.max)
        for anchor, rank, score in zip(near["anchor"], near["rank"], near["positive_score"]):
            upper[anchor, rank - 1] = int(score) * high[0] // high[1]
            least[anchor] = min(int(least[anchor]), -(-int(score) * low[0] // low[1]))
        hard = stored(best(rows, batch | {"upper": upper, "least": least}, negatives, False), "negatives-slots")
        names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(some["id"])], "anchor long, anchor_id long")
        part = windows(chosen, hard, negatives, low).join(F.broadcast(names), "anchor")
        out = part if out is None else out.unionByName(part)
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def windows(chosen: DataFrame, hard: DataFrame, k: int, low: tuple[int, int]) -> DataFrame:
    """The answers of all windows of an anchor from its slots: for each positive its slot and those below it, merged from the top."""
    slots = hard.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "slot"))).alias("n"))
    first = F.slice(F.filter("n", lambda c: c["slot"] >= F.col("slot_from")), 1, k)
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  a score times a fraction's part may exceed 64 bits
    inside = F.filter(first, lambda c: -wide(c["o"]) * low[1] >= wide(F.col("positive_score")) * low[0])
    asked = chosen.withColumnRenamed("rank", "slot_from").join(slots, "anchor")
    found = asked.select("anchor", "positive_id", "positive_score", F.posexplode(inside).alias("at", "c"))
    return found.select("anchor", "positive_id", "positive_score", (F.col("at") + 1).alias("rank"), F.col("c.id").alias("negative_id"), (-F.col("c.o")).alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=changed)


SQL = {
    "op13_hard_negatives": """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r AS asker, a.vec_id AS anchor_id, v.r, v.vec_id, v.label = a.label AS same, list_inner_product(a.v, v.v)::BIGINT AS score FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asker ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.asker, p.r ORDER BY n.score DESC, n.vec_id) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.asker = p.asker AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
    WHERE rank <= 10
    """
}
QUERIES = {"op13_hard_negatives": op13_hard_negatives}
