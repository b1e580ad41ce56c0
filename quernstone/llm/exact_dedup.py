"""Exact dedup through an extendible-hash index on shared files.

1. Every row gets a 63-bit hash of its normalised text; the narrow rows (no text) are written to the shared folder.
2. The directory doubles until no bucket holds more distinct keys than ``capacity``: a bucket with more is split
   in two by one more bit of the hash. The directory has at most 2 ** max_depth slots, whatever the input; a bucket
   that is still too full then simply stays longer.
3. Rows whose hash occurs once are unique. The texts of the others go, combined within each map task, to the
   owner task of their bucket's key range. An owner walks its keys in order, chains the texts of one hash and
   compares their bytes. So a group of copies of any size reaches its owner as one row per map task.
4. The chains (the index's data pages) are written to the shared folder. A row finds its entry by its hash and, within
   the chain, by the SHA-256 of the bytes that the owner compared. Entries of the largest groups, a bounded number, are
   broadcast, so that no task gets all rows of a hot text; rows of the others meet theirs in a shuffle.

Defined results: a null text counts as empty; rows with equal texts form one group, also when their ids repeat;
of a group the row with the longest original text, then the smallest id, stays (a repeated id that wins stays as
often as it occurs); a null id comes before all others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import scalar, ship, stored

#: What normalisation deletes: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
HASH_BITS = 63
#: A set of ids up to this many is broadcast (8 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Entries of the index that are broadcast, those of the largest groups, at most.
HOT_GROUPS = 20_000
#: Bytes of text that a map task holds before it hands on what it has combined.
COMBINE_BYTES = 32 << 20


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def text_hash(norm: Column, bits: int = HASH_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - bits)


def grow_directory(cells: dict[int, int], cell_depth: int, capacity: int) -> list[tuple[int, int]]:
    """Buckets (prefix, local depth) over counts of keys by their first cell_depth bits.

    Starts from one bucket; an overfull one is split by its next bit, which doubles the directory
    whenever its local depth is the directory's own.
    """
    level, depth, done = dict(cells), cell_depth, []
    sums = [level]
    while depth:
        up: dict[int, int] = {}
        for prefix, n in level.items():
            up[prefix >> 1] = up.get(prefix >> 1, 0) + n
        level, depth = up, depth - 1
        sums.append(level)
    sums.reverse()
    todo = [(0, 0)]
    while todo:
        prefix, local = todo.pop()
        if sums[local].get(prefix, 0) > capacity and local < cell_depth:
            todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            done.append((prefix, local))
    return sorted(done, key=lambda b: b[0] << (cell_depth - b[1]))


def directory(keys: DataFrame, capacity: int, max_depth: int, bits: int) -> tuple[DataFrame, int]:
    """Slots (slot, bucket) of the directory, and the number of bits that lead to a slot."""
    n = scalar(keys.agg(F.count("*")))
    depth = min(max_depth, bits, max(0, (2 * n // capacity).bit_length() + 1))
    cells = dict(keys.groupBy(F.shiftright("h", bits - depth).cast("int").alias("cell")).count().collect())  # at most 2 ** max_depth
    buckets = grow_directory(cells, depth, capacity)
    slots = [(s, i) for i, (prefix, local) in enumerate(buckets) for s in range(prefix << (depth - local), (prefix + 1) << (depth - local))]
    spark = keys.sparkSession
    return spark.createDataFrame(pd.DataFrame(slots, columns=["slot", "bucket"]), "slot int, bucket int"), depth


def _before(length: int, i: int | None, best_length: int, best_id: int | None) -> bool:
    """Whether the row of this length and id stays rather than the other: the longer one, then the smaller id, null first."""
    return (-length, i is not None, i or 0) < (-best_length, best_id is not None, best_id or 0)


COMBINED = {"bucket": pa.int32(), "h": pa.int64(), "norm": pa.string(), "n": pa.int64(), "best_len": pa.int32(), "best_id": pa.int64()}
PAGES = {"bucket": pa.int32(), "h": pa.int64(), "chain": pa.int32(), "n": pa.int64(), "best_len": pa.int32(), "best_id": pa.int64(), "sha": pa.binary()}


def _batch(rows: list[tuple], kind: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.values())], list(kind))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a map task, one row for each text: a third of all rows may be one text."""
    seen: dict[tuple, list] = {}
    held = 0
    for batch in batches:
        for b, h, t, length, i in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "norm", "best_len", "best_id"))):
            now = seen.get((b, h, t))
            if now is None:
                seen[b, h, t] = [1, length, i]
                held += len(t)
            else:
                now[0] += 1
                if _before(length, i, *now[1:]):
                    now[1:] = length, i
        if held > COMBINE_BYTES:
            yield _batch([(*k, *v) for k, v in seen.items()], COMBINED)
            seen.clear()
            held = 0
    if seen:
        yield _batch([(*k, *v) for k, v in seen.items()], COMBINED)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's keys come in order of (bucket, hash): chain the texts of a hash, comparing bytes."""
    key, chain, rows = None, [], []

    def close() -> None:
        rows.extend((*key, k, *v[1:]) for k, v in enumerate(chain))

    for batch in batches:
        for b, h, t, n, length, i in zip(*(batch.column(c).to_pylist() for c in COMBINED)):
            t = t.encode("utf-8", "surrogatepass")
            if (b, h) != key:
                if key is not None:
                    close()
                key, chain = (b, h), []
            for entry in chain:
                if entry[0] == t:
                    entry[1] += n
                    if _before(length, i, *entry[2:4]):
                        entry[2:4] = length, i
                    break
            else:
                chain.append([t, n, length, i, hashlib.sha256(t).digest()])
        if len(rows) > 20_000:
            yield _batch(rows, PAGES)
            rows = []
    if key is not None:
        close()
    if rows:
        yield _batch(rows, PAGES)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 128, max_depth: int = 20, bits: int = HASH_BITS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, bucket (null for unique texts), chain."""
    ship(docs.sparkSession)
    norm = normalised(F.col(text_col))
    own = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"), F.length(F.coalesce(text_col, F.lit(""))).alias("len"))
    rows = stored(own.select("id", text_hash(F.col("norm"), bits).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), "len"), "dedup-rows")
    shared = stored(rows.groupBy("h").agg(F.count("*").alias("rows")).filter("rows > 1").select("h"), "dedup-keys")
    slots, depth = directory(shared, capacity, max_depth, bits)
    ids = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "h", "left_semi").select(F.col("id").alias("some_id")).distinct()
    ids = stored(ids, "dedup-ids")
    few = ids.count() <= BROADCAST_ROWS
    wanted = (
        own.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("some_id")), "left_semi")
        .select(text_hash(F.col("norm"), bits).alias("h"), "norm", F.col("len").alias("best_len"), F.col("id").alias("best_id"))
        .withColumn("slot", F.shiftright("h", bits - depth).cast("int"))
        .join(F.broadcast(slots), "slot")  # at most 2 ** max_depth rows
        .select("bucket", "h", "norm", "best_len", "best_id")
    )
    combined = wanted.mapInArrow(_combine, "bucket int, h long, norm string, n long, best_len int, best_id long")
    # An owner has whole buckets: each is a range of keys.
    owned = combined.repartition("bucket").sortWithinPartitions("bucket", "h")
    index = stored(owned.mapInArrow(_own, "bucket int, h long, chain int, n long, best_len int, best_id long, sha binary"), "dedup-index")
    index = index.select("h", "sha", F.col("n").alias("copies"), "best_id", "bucket", "chain")
    hot = stored(index.filter("copies > 1").orderBy(F.desc("copies"), "h", "chain").limit(HOT_GROUPS), "dedup-hot")
    known = F.broadcast(hot.select("h", "sha"))
    cold = rows.join(known, ["h", "sha"], "left_anti").join(index.join(known, ["h", "sha"], "left_anti"), ["h", "sha"], "left")
    found = rows.join(F.broadcast(hot), ["h", "sha"]).unionByName(cold)
    keep_id = F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("best_id"))
    return found.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), keep_id.eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain"
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op1_exact_dedup": r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
    k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
    """
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
