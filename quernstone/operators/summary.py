"""Counts, rates, votes, gates and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def count_by(rows: DataFrame, by: str, every: DataFrame | None = None) -> DataFrame:
    """n by value; with ``every`` (a small table of the column) zero for values that don't occur, and no others."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counts if every is None else F.broadcast(every.select(by)).join(counts, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def folded_reason(reason: Column, prefixes: list[str]) -> Column:
    """Reasons with a detail fold into their prefix."""
    out = reason
    for p in prefixes:
        out = F.when(reason.startswith(p), p).otherwise(out)
    return out


def coverage(rows: DataFrame, by: str, hit: Column, every: DataFrame | None = None) -> DataFrame:
    """Share of hits by value, 3 digits; null for a value of ``every`` without rows."""
    got = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 3).alias("coverage"))
    return got if every is None else F.broadcast(every.select(by)).join(got, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"), "coverage")


def coverage_by_profile(rows: DataFrame, by: str, hits: dict[str, Column]) -> DataFrame:
    """(profile, by, n, coverage): the share of hits of each profile, 3 digits, in one pass over the rows."""
    got = rows.groupBy(by).agg(F.count("*").alias("n"), *(F.round(F.avg(c.cast("double")), 3).alias(f"_{i}") for i, c in enumerate(hits.values())))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.col(f"_{i}").alias("coverage")) for i, p in enumerate(hits)))).alias("c")
    return got.select(by, "n", each).select("c.profile", by, "n", "c.coverage")


def gate(records: DataFrame, issues: DataFrame, modes: DataFrame, hard_modes: list[str], most: float = 0.10, least: float = 0.75) -> DataFrame:
    """One row: counts, meaning-review rate, the four tests and the status of an evaluation.

    records (key, mode), issues (key, mode, category, severity), modes (mode).
    """
    total = records.agg(F.count("*").alias("records"))
    found = issues.agg(F.count_if(F.col("severity") == "hard").alias("hard_issues"), F.count_if(F.col("category") == "meaning-review").alias("meaning_issues"))
    misses = issues.filter("category = 'register-review'").groupBy("mode").agg(F.count("*").alias("misses"))
    voice = count_by(records, "mode", modes).join(misses, "mode", "left").withColumn("voice", F.round((F.col("n") - F.coalesce("misses", F.lit(0))) / F.nullif(F.col("n"), F.lit(0)), 3))
    per_mode = voice.agg(F.min(F.col("n") > 0).alias("all_modes"), F.coalesce(F.min(F.when(F.col("mode").isin(*hard_modes), F.coalesce(F.col("voice") >= least, F.lit(False)))), F.lit(False)).alias("voice_ok"))
    one = total.crossJoin(found).crossJoin(per_mode)  # three rows of one
    one = one.withColumn("meaning_rate", F.round(F.col("meaning_issues") / F.nullif(F.col("records"), F.lit(0)), 3))
    tests = {"no_hard_issues": F.col("hard_issues") == 0, "meaning_ok": F.coalesce(F.col("meaning_rate") <= most, F.lit(False)), "voice_ok": F.col("voice_ok"), "all_modes": F.col("all_modes")}
    passed = tests["no_hard_issues"] & tests["meaning_ok"] & tests["voice_ok"] & tests["all_modes"]
    return one.select("records", "hard_issues", "meaning_issues", "meaning_rate", *(c.alias(n) for n, c in tests.items()), F.when(passed, "PASS").otherwise("FAIL").alias("status"))


def fold_votes(votes: DataFrame, expected: int, key: str = "key") -> DataFrame:
    """votes (key, vote, status, verdict, score, reason, error) to one row a key: verdict, mean score, agreement, reasons.

    Scores are summed in the order of the votes, not as tasks deliver them: where a mean ends in a half, the last bit of the
    sum decides which way it is rounded.
    """
    judged = F.col("status") == "judged"
    scores = F.transform(F.array_sort(F.collect_list(F.when(judged & F.col("score").isNotNull(), F.struct("vote", F.col("score").cast("double").alias("score"))))), lambda x: x["score"])
    got = votes.groupBy(key).agg(
        F.count_if(judged).alias("judged"),
        F.array_sort(F.collect_set(F.when(judged, F.col("verdict")))).alias("verdicts"),
        scores.alias("scores"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(judged, F.struct("vote", "reason")))), lambda x: x["reason"])), " | ").alias("reasons"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~judged, F.struct("vote", "error")))), lambda x: x["error"]), " | ").alias("errors"),
    )
    one = F.size("verdicts") == 1
    mean = F.aggregate("scores", F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size("scores"), F.lit(0))
    return got.select(
        key,
        F.when(F.col("judged") == 0, "SKIP").when(one, F.get("verdicts", F.lit(0))).otherwise("UNCERTAIN").alias("verdict"),
        F.floor(mean + 0.5).cast("long").alias("score"),
        F.when(F.col("judged") == expected, one).alias("agreement"),
        F.when(F.col("judged") == 0, F.col("errors")).otherwise(F.col("reasons")).alias("reason"),
    )


VERDICTS = {"passed": "PASS", "failed": "FAIL", "uncertain": "UNCERTAIN", "skipped": "SKIP"}


def judge_partials(results: DataFrame) -> DataFrame:
    """One row of counts that add up over any division of the results."""
    return results.agg(F.count("*").alias("completed"), *(F.count_if(F.col("verdict") == v).alias(n) for n, v in VERDICTS.items()))


def judge_report_of(partials: DataFrame, requested: int | None = None) -> DataFrame:
    """The report from the counts of all divisions."""
    got = partials.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("completed", *VERDICTS)))
    got = got.withColumn("judged", F.col("completed") - F.col("skipped")).withColumn("requested", F.lit(requested) if requested is not None else F.col("completed"))
    whole = F.col("completed") == F.col("requested")
    status = F.when((F.col("judged") == 0) & whole, "UNAVAILABLE").when(whole & (F.col("skipped") == 0), "COMPLETE").otherwise("PARTIAL")
    return got.withColumn("pass_rate", F.round(F.col("passed") / F.nullif(F.col("judged"), F.lit(0)), 4)).withColumn("status", status)


def judge_report(results: DataFrame, requested: int | None = None) -> DataFrame:
    """One row: judged, passed, failed, uncertain, skipped, pass rate and status."""
    return judge_report_of(judge_partials(results), requested)


def worst(results: DataFrame, key: str = "key", n: int = 5) -> DataFrame:
    """The worst judged results: failures first, then low scores (50 where missing)."""
    severity = F.when(F.col("verdict") == "FAIL", 0).when(F.col("verdict") == "UNCERTAIN", 1).otherwise(2)
    return results.filter("verdict <> 'SKIP'").orderBy(severity, F.coalesce("score", F.lit(50)), key).limit(n)


def sentence_frequency(rows: DataFrame, sentences: Column) -> DataFrame:
    """(digest, n): how often each sentence occurs, by the 32 bytes of its SHA-256, so whole sentences don't move."""
    return rows.select(F.explode(F.transform(sentences, lambda s: F.unhex(F.sha2(s, 256)))).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))


def distinct_counts(rows: DataFrame, columns: list[str], sentences: dict[str, Column] | None = None) -> DataFrame:
    """(name, n): the exact number of distinct values of each column, and of distinct sentences and their highest count.

    Values are told apart by SHA-256, so whole texts don't move.
    """
    named = lambda one: one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in one.columns))).alias("x")).select("x.*")
    parts = [named(rows.agg(*(F.countDistinct(F.sha2(F.col(c).cast("string"), 256)).alias(f"unique_{c}") for c in columns)))] if columns else []
    for name, s in (sentences or {}).items():
        counted = rows.select(F.explode(F.transform(s, lambda x: F.sha2(x, 256))).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
        parts.append(named(counted.agg(F.count("*").alias(f"unique_{name}"), F.coalesce(F.max("n"), F.lit(0)).alias(f"max_{name}"))))
    return reduce(DataFrame.unionByName, parts)


def categories_by_key(flags: DataFrame) -> DataFrame:
    return flags.groupBy("key").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def expectation_flags(counts: DataFrame, expected: DataFrame, by: str = "mode") -> DataFrame:
    """Values whose count n isn't the expected one."""
    both = expected.join(counts, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.filter(F.col("n") != F.col("expected")).select(by, "n", "expected")


def order_digests(rows: DataFrame, by: str, position: str, digest: str, levels: int = 4) -> DataFrame:
    """(by, digest): one digest of the rows' digests of each value of ``by`` that depends on their positions (gapless from 1 within it), in bounded memory.

    Blocks of 1,024 digests in a row are joined and digested, then the blocks, so many times; four levels hold 10 ** 12 rows.
    """
    level = rows.select(by, F.col(position).cast("long").alias("_n"), F.col(digest).alias("digest"))
    for _ in range(levels):
        blocks = level.groupBy(by, F.floor((F.col("_n") - 1) / 1024).alias("_b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
        level = blocks.select(by, (F.col("_b") + 1).alias("_n"), "digest")
    return level.select(by, "digest")


def order_digest(rows: DataFrame, position: str, line: Column) -> DataFrame:
    """One digest of all rows that depends on their order, in bounded memory."""
    own = rows.select(F.lit(0).alias("all"), F.col(position).alias("n"), F.sha2(F.concat(F.col(position).cast("string"), F.lit("\n"), line), 256).alias("d"))
    return order_digests(own, "all", "n", "d").select("digest")


def progress(rows: DataFrame, most: int = 99) -> DataFrame:
    """Weighted progress of loads (loaded, total)."""
    share = F.sum("loaded") / F.nullif(F.sum(F.greatest("total", "loaded")), F.lit(0))
    return rows.agg(F.least(F.lit(most), F.floor(F.coalesce(share, F.lit(0.0)) * 100)).alias("percent"))
