"""Operators that must not depend on one task or on quadratic work."""

import random

import pytest
from pyspark.sql import Window, functions as F

from quernstone.functions import audit as q
from quernstone.operators import matching, selection


def test_fnv_of_many_lengths(spark):
    rng = random.Random(1)
    texts = ["", None, "é😀", "x" * 5000, *("".join(rng.choice("abc سلام😀\x00") for _ in range(rng.randint(0, 90))) for _ in range(300))]

    def plain(t):
        h = 2166136261
        for c in t:
            h = (h ^ ord(c)) * 16777619 % (1 << 32)
        return h

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", q.fnv1a("t").alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_matches_like_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        some = lambda: list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 12))})
        a, b, least = some(), some(), rng.choice([3, 4, 5])
        want = sum(any(x == y or (len(x) >= least and len(y) >= least and (x in y or y in x)) for y in b) for x in a)
        assert q.matched_of(a, b, least) == want


def test_matches_of_long_texts_are_quick():
    import time

    rng = random.Random(3)
    words = lambda: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(20_000)]
    began = time.time()
    q.matched_of(words(), words(), 4)
    assert time.time() - began < 5  # all pairs would be 400 million comparisons


@pytest.mark.parametrize(("spans", "direct"), [(1, 200_000), (50, 5), (1 << 32, 0), (1 << 32, 200_000)])
def test_radix_selection_like_ranks(spark, spans, direct, monkeypatch):
    """Strata of all sizes, hashes with ties down to all alike, repeated keys, a null stratum."""
    monkeypatch.setattr(selection, "DIRECT_ROWS", direct)
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["b", None]), rng.randrange(spans), f"k{rng.randint(0, 400)}") for _ in range(1500)] + [("one", 5, "x"), ("four", 1, "y"), ("four", 1, "y"), ("four", 2, "y"), ("four", 3, "z")]
    df = spark.createDataFrame(rows, "m string, h long, key string")
    got = selection.split_by_hash(df, "m", "h", "key", 0.3).collect()
    want = {}
    for m in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == m)
        k = int(len(own) * 0.3 + 0.5)
        want[m] = sum(x <= own[k - 1] for x in own) if k else 0
    assert {m: sum(r["m"] == m and r["split"] == "valid" for r in got) for m in want} == want and len(got) == len(rows)
    assert selection.split_by_hash(df.limit(0), "m", "h", "key").count() == 0


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 2 else rng.choice(["a", "b", None]), i, rng.choice([0, 1, None])) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "u string, i int, x int").repartition(6)
    got = {r["i"]: r["s"] for r in selection.running_within(df, "u", ["i"], F.col("x"), "s").collect()}
    want, sums = {}, {}
    for u, i, x in sorted(rows, key=lambda r: r[1]):
        want[i] = sums.get(u, 0)
        sums[u] = sums.get(u, 0) + (x or 0)
    assert got == want
    kept = matching.failure_budget(df, "u", "i", F.col("x") == 1, 7)
    plain = df.withColumn("f", F.coalesce(F.sum(F.coalesce((F.col("x") == 1).cast("int"), F.lit(0))).over(Window.partitionBy("u").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("f < 7")
    assert {r["i"] for r in kept.collect()} == {r["i"] for r in plain.collect()}


def test_circuit_breaker_of_groups(spark):
    """A hot group, a null group, one that never breaks, and nulls among the flags."""
    rng = random.Random(6)
    rows = [("hot" if i % 2 else rng.choice(["a", "b", None]), i, rng.choice([True, False, False, None])) for i in range(1200)] + [("calm", 5000 + i, False) for i in range(5)] + [("short", 6000, True), ("short", 6001, True)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "u string, i int, s boolean").repartition(5)
    got = {r["i"]: (r["position"], r["circuit_open"]) for r in matching.circuit_breaker(df, "i", F.col("s"), by="u").collect()}
    want, seen = {}, {}
    for u, i, s in sorted(rows, key=lambda r: r[1]):
        n, run, broken = seen.get(u, (0, 0, False))
        want[i] = (n + 1, broken)
        run = run + 1 if s else 0
        seen[u] = (n + 1, run, broken or run >= 3)
    assert got == want


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    """A file of one row group has as many partitions as its bytes give, but one of them has all rows."""
    from quernstone.queries import spread

    path = str(tmp_path / "one")
    spark.range(40_000).selectExpr("id", "md5(cast(id as string)) AS x").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= 4
        counts = [r["count"] for r in spread(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(counts) == 40_000 and max(counts) < 10_000


def test_splits_grow_with_the_files(spark, tmp_path):
    from quernstone.queries_tables import in_small_splits

    path = str(tmp_path / "large")
    spark.range(400_000).selectExpr("repeat('x', 100) AS value").coalesce(1).write.text(path)
    seen = []
    in_small_splits(spark, path, lambda: (lambda df: (seen.append(df.rdd.getNumPartitions()), df)[1])(spark.read.text(path)))
    assert seen[0] <= 10 * spark.sparkContext.defaultParallelism  # 640 of 64 KB


def test_stream_rows_are_written_by_many_tasks(spark, monkeypatch):
    from quernstone.streaming import stateful

    seen = []
    monkeypatch.setattr("quernstone.tables.new_path", lambda spark, name, f=__import__("quernstone.tables", fromlist=["x"]).new_path: seen.append(f(spark, name)) or seen[-1])
    df = spark.range(0, 4000, 1, 4).selectExpr("cast(id % 7 as string) AS speaker", "1L AS session", "id AS event_no", "0 AS result_index", "true AS is_final", "cast(id as string) AS transcript")
    got = stateful.newest_text(stateful.run_over_files(spark, df, stateful.dictation_stream, 3)).collect()
    assert sorted((r["speaker"], r["text"]) for r in got) == sorted((str(k), str(max(i for i in range(4000) if i % 7 == k))) for k in range(7))
    source = next(p for p in seen if "/stream-source-" in p)
    files = spark.read.option("recursiveFileLookup", "true").parquet(source).inputFiles()
    assert len(files) == 12  # four tasks, three batches; one file a batch before
