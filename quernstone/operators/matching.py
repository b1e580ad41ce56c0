"""Logical joins between records, ledgers, logs and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def assert_none(bad: DataFrame, what: str) -> None:
    """Raises if there is any row; shows one."""
    found = bad.take(1)
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")


def pair_up(references: DataFrame, candidates: DataFrame, key: str = "key", check: list[str] = ("input",)) -> DataFrame:
    """Inner join on a key that must be unique on both sides and known on the left, with equal checked columns."""
    for side, name in ((references, "references"), (candidates, "candidates")):
        assert_none(side.groupBy(key).count().filter("count > 1"), f"repeated key in {name}")
    assert_none(candidates.join(references, key, "left_anti"), "candidate without reference")
    right = candidates.select(key, *(F.col(c).alias(f"candidate_{c}") for c in candidates.columns if c != key))
    joined = references.join(right, key)
    for c in check:
        assert_none(joined.filter(~F.col(c).eqNullSafe(F.col(f"candidate_{c}"))).select(key), f"{c} differs")
    return joined


def with_dimension(rows: DataFrame, dimension: DataFrame, on: str, default: str | None = None) -> DataFrame:
    """Left join with a small dimension; unknown values get the default's row where one is named, and are refused otherwise."""
    if default is None:
        assert_none(rows.join(F.broadcast(dimension.select(on)), on, "left_anti").select(on), f"unknown {on}")
        return rows.join(F.broadcast(dimension), on)
    known = F.broadcast(dimension.select(F.col(on).alias("_known")))
    named = rows.join(known, F.col(on) == F.col("_known"), "left").withColumn(on, F.coalesce("_known", F.lit(default))).drop("_known")
    return named.join(F.broadcast(dimension), on, "left")


def approved(flags: DataFrame, ledger: DataFrame, reviewable: list[str]) -> DataFrame:
    """Adds approved: a reviewable flag whose record's digest and category the ledger (key, digest, categories) holds."""
    entry = ledger.select(F.col("key").alias("_k"), F.col("digest").alias("_d"), "categories").dropDuplicates(["_k"])
    joined = flags.join(entry, F.col("key") == F.col("_k"), "left")
    yes = F.col("category").isin(*reviewable) & (F.col("digest") == F.col("_d")) & F.array_contains("categories", F.col("category"))
    return joined.withColumn("approved", F.coalesce(yes, F.lit(False))).drop("_k", "_d", "categories")


def not_done(todo: DataFrame, log: DataFrame, key: str = "key", done: Column | None = None) -> DataFrame:
    """Rows whose key the log doesn't hold as done; by default only successes count, so failures are tried again."""
    return todo.join(log.filter(done if done is not None else F.col("status") == "ok").select(key).distinct(), key, "left_anti")


def leaked(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one split whose keys occur in the other; it must be empty."""
    return rows.join(other.select(*keys).distinct(), keys, "left_semi")


def assert_no_leak(splits: dict[str, DataFrame], pairs: list[tuple[str, str]], keys: list[str]) -> None:
    for a, b in pairs:
        assert_none(leaked(splits[a], splits[b], keys).select(*keys), f"{a} leaks into {b}")


def with_latest(rows: DataFrame, log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value replaced by that of the last log row of the key, where there is one."""
    last = log.groupBy(key).agg(F.max_by(F.col(value), F.col(order)).alias("_new"))
    return rows.join(last, key, "left").withColumn("updated", F.col("_new").isNotNull()).withColumn(value, F.coalesce("_new", F.col(value))).drop("_new")


def update_outputs(rows: DataFrame, log: DataFrame, order: str, key: str = "key", status: str = "ok") -> DataFrame:
    """Output and the assistant's message of each record replaced by the last log row of its key among those of the status."""
    new = with_latest(rows, log.filter(F.col("status") == status).select(key, order, "output"), key, order, "output")
    if "messages" not in rows.columns:
        return new
    swapped = F.transform("messages", lambda m, i: F.when(i == 1, m.withField("content", F.col("output"))).otherwise(m))
    return new.withColumn("messages", F.when(F.col("updated"), swapped).otherwise(F.col("messages")))


def with_fallbacks(references: DataFrame, candidates: DataFrame, key: str = "key") -> DataFrame:
    """key, mode, input, reference, candidate: each the first of its columns that is not null, on either side; missing columns count as null.

    A reference without a candidate, differing inputs and an empty text are refused.
    """
    has = lambda df, c, side: df[c].alias(f"{side}_{c}") if c in df.columns else F.lit(None).cast("string").alias(f"{side}_{c}")
    left = references.select(key, *(has(references, c, "r") for c in ("mode", "input", "reference", "output")))
    right = candidates.select(key, *(has(candidates, c, "c") for c in ("mode", "input", "candidate", "output")))
    assert_none(left.join(right, key, "left_anti").select(key), "no candidate")
    both = left.join(right, key)
    full = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    assert_none(both.filter(full("r_input") & full("c_input") & (F.col("r_input") != F.col("c_input"))).select(key), "input differs")
    chosen = both.select(key, F.coalesce("r_mode", "c_mode", F.lit("unknown")).alias("mode"), F.coalesce("r_input", "c_input", F.lit("")).alias("input"), F.coalesce("r_reference", "r_output", F.lit("")).alias("reference"), F.coalesce("c_candidate", "c_output", F.lit("")).alias("candidate"))
    assert_none(chosen.filter("input = '' OR reference = '' OR candidate = ''").select(key), "missing text")
    return chosen


def without_ids(entries: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Entries but those deleted."""
    return entries.join(gone.select(key).distinct(), key, "left_anti")


def cleared(entries: DataFrame) -> DataFrame:
    return entries.limit(0)


def in_categories(rows: DataFrame, categories: DataFrame, mode: str = "mode") -> DataFrame:
    """Rows beside each category (category, mode) that their mode belongs to; the table of categories is a dimension."""
    return rows.join(F.broadcast(categories.select(F.col("mode").alias("_m"), "category")), F.col(mode) == F.col("_m")).drop("_m")


def paired_by_hash(lessons: DataFrame, base: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """Each lesson meets one base row, chosen by a hash of its key; positions on the base side make it an equi-join."""
    from .selection import with_positions

    placed = with_positions(base.withColumn("_o", F.xxhash64(F.col(key), F.lit(seed))), "_o").drop("_o")
    n = placed.count()
    if not n:
        return lessons.limit(0).crossJoin(base.limit(0))
    slot = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(n)) + 1
    right = placed.select("position", *(F.col(c).alias(f"base_{c}") for c in base.columns))
    return lessons.withColumn("position", slot).join(right, "position").drop("position")


def first_value_by(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(by).agg(F.min_by(F.col(value), F.col(order)).alias(value))


def circuit_breaker(results: DataFrame, order: str, skipped: Column, run: int = 3, by: str | None = None) -> DataFrame:
    """Adds position (from 1) and circuit_open: rows after the first ``run`` consecutive skipped ones, of all rows or of each value of ``by``.

    Positions come from ranges; skipped positions in a row are found by joins of shifted copies, and the breaking position
    is one value for each group, so neither a window nor a group is one task's.
    """
    from .selection import BROADCAST_ROWS, placed_within, with_positions

    from quernstone.tables import stored

    placed = with_positions(results, order) if by is None else placed_within(results, by, [order])
    group = F.lit("") if by is None else F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))
    placed = placed.withColumns({"_s": F.coalesce(skipped, F.lit(False)), "_g": group})
    bad = placed.filter("_s").select("_g", "position")
    runs = bad
    for k in range(1, run):
        runs = runs.join(bad.select("_g", (F.col("position") + k).alias("position")), ["_g", "position"], "left_semi")
    first = stored(runs.groupBy("_g").agg(F.min("position").alias("_first")), "broken")
    side = F.broadcast(first) if by is None or first.count() <= BROADCAST_ROWS else first
    joined = placed.join(side, "_g", "left").withColumn("circuit_open", F.coalesce(F.col("position") > F.col("_first"), F.lit(False)))
    return joined.select(*results.columns, "position", "circuit_open")


def failure_budget(attempts: DataFrame, by: str, order: str, failed: Column, budget: int = 10) -> DataFrame:
    """Attempts up to and with the one that uses up the budget of failures, for each group; a group is no task of its own."""
    from .selection import running_within

    return running_within(attempts, by, [order], failed.cast("int"), "_f").filter(F.col("_f") < budget).drop("_f")


def first_success(attempts: DataFrame, request: str, priority: str, value: str, ok: Column) -> DataFrame:
    """For each request the value of the successful attempt of least priority: ordered failover."""
    return attempts.groupBy(request).agg(F.min_by(F.when(ok, F.col(value)), F.when(ok, F.col(priority))).alias(value), F.min(F.when(ok, F.col(priority))).alias(priority))


def newest(rows: DataFrame, order: str, n: int = 40) -> DataFrame:
    """The newest rows: a report of fixed size."""
    return rows.orderBy(F.desc(order)).limit(n)


def search(rows: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows of which any column holds the term; a blank term finds all, others aren't trimmed."""
    if not term.strip():
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(term)), F.lit(False))
    return rows.filter(hit)
