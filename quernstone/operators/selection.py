"""Which rows stay, in which split, how often and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.functions.audit import stable_hash
from quernstone.tables import stored


#: Keys that occur more than once are broadcast up to this many; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def key_digest(keys: list[str]) -> Column:
    """32 bytes that tell apart the values of the key columns, nulls too."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(part(F.col(k)) for k in keys)), 256))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows with equal keys the first in order stays; the second result is the log of those removed.

    Keys are counted by their digests, combined within map tasks; only rows whose key occurs again are looked at further,
    so a very common key fills no task.
    """
    marked = rows.withColumns({"_d": key_digest(keys), "_o": F.struct(*order)})
    again = marked.groupBy("_d").agg(F.count("*").alias("_n"), F.min("_o").alias("_first")).filter("_n > 1").drop("_n")
    again = stored(again, "repeated")
    side = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    joined = marked.join(side, "_d", "left")
    alone, won = F.col("_first").isNull(), F.col("_o").eqNullSafe(F.col("_first"))
    # Rows alike in keys and order: any one of them stays.
    winners = joined.filter(~alone & won).withColumn("_n", F.row_number().over(Window.partitionBy("_d").orderBy("_o")))
    kept = joined.filter(alone).unionByName(winners.filter("_n = 1").drop("_n"))
    removed = joined.filter(~alone & ~won).unionByName(winners.filter("_n > 1").drop("_n"))
    return kept.select(rows.columns), removed.select(rows.columns)


def repeated(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The second and later occurrences."""
    return first_wins(rows, keys, order)[1]


def placed_within(rows: DataFrame, by: str, order: list[str], rank: str = "position") -> DataFrame:
    """Adds a gapless rank from 1 within each value of ``by``: range partitions by (by, order), counts of earlier partitions, ranks within.

    A value of ``by`` is dealt to as many tasks as its rows need.
    """
    spread = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    spread = stored(spread, "ranks")  # ranges are sampled, so a second run could draw them elsewhere
    counts = spread.groupBy(F.col("_p").alias("_q"), F.col(by).alias("_value")).agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    # A row for each value and partition that holds some of it.
    before = F.sum("_c").over(Window.partitionBy("_value").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select("_q", "_value", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "counts")
    side = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    placed = spread.join(side, (F.col("_p") == F.col("_q")) & F.col(by).eqNullSafe(F.col("_value")))
    return placed.withColumn(rank, F.col("_i") + 1 + F.col("_shift")).select(*rows.columns, rank)


def running_within(rows: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the earlier rows of each value of ``by``: range partitions by (by, order), sums within them, and what earlier partitions sum up to.

    A value of ``by`` is dealt to as many tasks as its rows need.
    """
    ranged = stored(rows.withColumn("_x", F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(by, *order).withColumn("_p", F.spark_partition_id()), "running")
    sums = ranged.groupBy(F.col("_p").alias("_q"), F.col(by).alias("_value")).agg(F.sum("_x").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("_value").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    carried = stored(sums.select("_q", "_value", F.coalesce(before, F.lit(0)).alias("_carried")), "carried")  # a row for each value and partition that holds some of it
    side = F.broadcast(carried) if carried.count() <= BROADCAST_ROWS else carried
    within = F.sum("_x").over(Window.partitionBy("_p", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = ranged.withColumn("_own", F.coalesce(within, F.lit(0))).join(side, (F.col("_p") == F.col("_q")) & F.col(by).eqNullSafe(F.col("_value")))
    return summed.select(*rows.columns, (F.col("_own") + F.col("_carried")).alias(name))


#: Rows of a stratum that are counted by (hash, key) at once when the place is known to lie among them.
DIRECT_ROWS = 200_000


def kth_by_hash(rows: DataFrame, by: str, hash_col: str, key: str, share: float, bits: int = 32) -> DataFrame:
    """(_stratum, _h, _k): hash and key of the row at place round(share * n) in each stratum, in order of (hash, key); none where that place is 0.

    Radix selection: rows are counted by 16 more bits of the hash a time, combined within map tasks, and only the prefix
    that holds the place is looked at further, until few rows share it; these are counted by hash and key. No row is
    sorted or moved; a count has 65,536 rows a stratum at most, or the distinct rows of one prefix.
    """
    narrow = rows.select(F.col(by).alias("_s"), F.col(hash_col).cast("long").alias("_h"), F.col(key).alias("_k"))
    whole, left, known, shift = Window.partitionBy("_s"), narrow, [], bits

    def holding(parts: list[Column]) -> DataFrame:
        """Of the counts by stratum and parts those that hold the place, which is counted from their first row on."""
        names = [f"_part{i}" for i in range(len(parts))]
        counts = left.select("_s", *known, *(p.alias(n) for p, n in zip(parts, names))).groupBy("_s", *names, *known).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(whole.orderBy(*(F.col(n).asc_nulls_first() for n in names)))
        place = F.col("_place") if known else F.floor(F.sum("_c").over(whole) * F.lit(share) + 0.5)
        here = counts.withColumns({"_upto": upto, "_want": place}).filter((F.col("_want") > F.col("_upto") - F.col("_c")) & (F.col("_want") <= F.col("_upto")))
        return stored(here.select("_s", *names, "_c", (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_place")), "bound")

    most = None
    while shift > 0 and (most is None or most > DIRECT_ROWS):
        shift -= 16
        part = F.shiftright("_h", shift)
        found = holding([part])
        strata, most = found.agg(F.count("*"), F.coalesce(F.max("_c"), F.lit(0))).first()
        side = found.select(F.col("_s").alias("_fs"), F.col("_part0").alias("_fa"), "_place")
        side = F.broadcast(side) if strata <= BROADCAST_ROWS else side
        left, known = narrow.join(side, F.col("_s").eqNullSafe(F.col("_fs")) & (part == F.col("_fa"))), ["_place"]
    return holding([F.col("_h"), F.col("_k")]).select(F.col("_s").alias("_stratum"), F.col("_part0").alias("_h"), F.col("_part1").alias("_k"))


def split_by_hash(rows: DataFrame, by: str, hash_col: str, key: str, share: float = 0.10) -> DataFrame:
    """Adds split: in each stratum the first round(share * n) rows by (hash, key) are 'valid', the rest 'train'; rows alike in both go together.

    What is looked for is one bound for each stratum, by radix selection over hashes of 32 bits.
    """
    bounds = kth_by_hash(rows, by, hash_col, key, share).select("_stratum", F.struct("_h", "_k").alias("_bound"))
    side = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds
    within = F.struct(F.col(hash_col).cast("long").alias("_h"), F.col(key).alias("_k")) <= F.col("_bound")
    joined = rows.join(side, F.col(by).eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("split", F.when(within, "valid").otherwise("train")).select(*rows.columns, "split")


def stratified_split(rows: DataFrame, by: str, key: Column, text: Column, share: float = 0.10) -> DataFrame:
    """split_by_hash over the stable hash of key and text."""
    hashed = stored(rows.withColumns({"_stable": stable_hash(key, text), "_key": key}), "hashed")
    return split_by_hash(hashed, by, "_stable", "_key", share).drop("_stable", "_key")


def interleave_by_hash(rows: DataFrame, modes: DataFrame, by: str, hash_col: str, key: str) -> DataFrame:
    """Round-robin over modes (mode, position) by (hash, key): adds round and mode_position; rows of other modes go, explicitly.

    The order (round, mode_position) is total; no global sort is needed until something is written.
    """
    known = rows.join(F.broadcast(modes.select(F.col("mode").alias("_mode"), F.col("position").alias("mode_position"))), F.col(by) == F.col("_mode")).drop("_mode")
    return placed_within(known, by, [hash_col, key], "round")


def interleave(rows: DataFrame, modes: DataFrame, by: str, key: Column, text: Column) -> DataFrame:
    """interleave_by_hash over the stable hash of key and text."""
    hashed = stored(rows.withColumns({"_stable": stable_hash(key, text), "_key": key}), "hashed")  # ranges are sampled: don't hash twice
    return interleave_by_hash(hashed, modes, by, "_stable", "_key").drop("_stable", "_key")


def replicate(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row ``weight`` times, with its copy number from 1."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), weight.cast("int"))))


def corpus_weight(mode: Column, hard: list[str], long: bool = False, correction: str = "tashih") -> Column:
    """1 for corrections; 4 and 3 for hard and other modes of short texts, 3 and 2 of long ones."""
    strong, other = (3, 2) if long else (4, 3)
    return F.when(mode == correction, 1).when(mode.isin(*hard), strong).otherwise(other)


def boost(rows: DataFrame, key: str, weight: Column, suffix: str = "-v") -> DataFrame:
    """Copies with a key of their own: the i-th copy's key ends in suffix and i; the first row keeps its key."""
    return replicate(rows, weight).withColumn(key, F.when(F.col("copy") == 1, F.col(key)).otherwise(F.concat(key, F.lit(suffix), F.col("copy") - 1))).drop("copy")


def systematic_sample(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Every floor(n / size)-th row by an indexed order, then the first ``size`` of them; adds position and sample_no, both from 1.

    Positions come from counts of ranges, so no task sees all rows.
    """
    placed = with_positions(rows, order)
    n = placed.count()
    step = max(1, n // size)
    some = placed.filter((F.col("position") - 1) % step == 0).filter(F.col("position") <= step * size)
    return some.withColumn("sample_no", F.floor((F.col("position") - 1) / step) + 1)


def with_positions(rows: DataFrame, order: str) -> DataFrame:
    """Adds position, gapless from 1 in the order of a column: range partitions, their counts, then ranks within each."""
    spread = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    spread = stored(spread, "positions")  # ranges are sampled, so a second run could draw them elsewhere
    counts = spread.groupBy("_p").agg(F.count("*").alias("_c"))
    # One row for each partition, however many rows there are.
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return spread.join(F.broadcast(before), "_p").withColumn("position", F.col("_i") + 1 + F.col("_before")).drop("_p", "_i", "_before")


def head_tail(rows: DataFrame, head: int, position: str = "sample_no") -> DataFrame:
    """Adds split: the first ``head`` of a sample are 'valid'."""
    return rows.withColumn("split", F.when(F.col(position) <= head, "valid").otherwise("train"))


def holdout(rows: DataFrame, key: str, test: DataFrame, valid: DataFrame) -> DataFrame:
    """Adds split by the source id, the last part of a key: 'test' or 'valid' where these tables (id) hold it, test first; else 'train'."""
    held = test.select(F.col("id"), F.lit("test").alias("_split")).unionByName(valid.select("id", F.lit("valid").alias("_split"))).groupBy("id").agg(F.min("_split").alias("_split"))
    held = stored(held, "held")
    side = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    joined = rows.withColumn("id", F.element_at(F.split(key, r"\|"), -1)).join(side, "id", "left")
    return joined.withColumn("split", F.coalesce("_split", F.lit("train"))).select(*rows.columns, "split")


def limit_per_group(rows: DataFrame, by: str, order: list[Column | str], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def seeded_order(key: Column, seed: int = 7) -> Column:
    """Order by this for a repeatable shuffle; a limit after it is a repeatable sample."""
    return F.xxhash64(key, F.lit(seed))


def padded(n: Column, width: int) -> Column:
    """The number with zeros before it up to ``width`` digits; a longer one stays whole."""
    digits = n.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def sequential_ids(rows: DataFrame, order: str, prefix: str, width: int = 4) -> DataFrame:
    return with_positions(rows, order).withColumn("id", F.concat(F.lit(prefix), padded(F.col("position"), width)))


def window_of(rows: DataFrame, order: str, start: int, limit: int) -> DataFrame:
    placed = with_positions(rows, order)
    return placed.filter(F.col("position").between(start + 1, start + limit))


def expected_keys(rows: DataFrame, by: str, order: str, prefix: str, width: int = 3) -> DataFrame:
    """Adds expected_key: prefix, number within the mode, and the mode."""
    placed = placed_within(rows, by, [order], "_n")
    return placed.withColumn("expected_key", F.concat(F.lit(prefix), padded(F.col("_n"), width), F.lit("|"), F.col(by))).drop("_n")
