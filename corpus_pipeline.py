"""A cleaning pipeline over documents: each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

A row is kept or dropped by its own id and text; a null id is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone import tables
from quernstone.llm import common, exact_dedup, language_id, ngram_join, packing, quality

#: A language is accepted from this score on; scores of the languages add up to 1.
LEAST_SCORE = 0.4
#: Ids to drop are broadcast up to this many; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, dropped: DataFrame, keys: dict) -> DataFrame:
    """docs without the rows that match dropped in all keys (name: expression over docs)."""
    columns = docs.columns
    dropped = common.stored(dropped.distinct(), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    rows = docs.select(F.struct("*").alias("_row"), *(e.alias(f"_{k}") for k, e in keys.items()))
    match = [F.col(f"_{k}").eqNullSafe(side[k]) for k in keys]
    rows = rows.join(side, match, "left_anti")
    return rows.select(*(F.col("_row")[c].alias(c) for c in columns))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("_row"))
    judged = quality.judge(rows, common.table(spark, sf_dir, "labels"), F.col("source"), quality.section(), keep=["_row"])
    return judged.filter("accepted").select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    rows = docs.select("doc_id", "text", "lang", F.struct("*").alias("_row"))
    found = language_id.identify(rows, ~language_id.held_out(), keep=["_row"])
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = common.stored(exact_dedup.exact_dedup(docs), "exact")
    dropped = found.filter(~F.coalesce("kept", F.lit(True))).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    sha = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    rest = _without(docs, dropped, {"id": F.col("doc_id"), "sha": sha})
    # Rows of one id and one text are told apart by nothing that the rule names: the first is as good as any.
    twice = found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1").take(1)
    return rest.withColumn("_sha", sha).dropDuplicates(["doc_id", "_sha"]).drop("_sha") if twice else rest


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = common.stored(ngram_join.near_duplicates(docs).select("doc_id", "text_hash", "kept"), "near")
    dropped = found.filter("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("t"))
    return _without(docs, dropped, {"id": F.col("doc_id"), "t": F.xxhash64(F.coalesce("text", F.lit("")))})


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.byte_bpe())


STAGES = [("quality", judge_quality), ("language", identify_language), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = common.table(spark, sf_dir, "documents"), tables.made()
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        tables.release(spark, at, docs)  # what the stage stored on its way, and its input
    return docs


#: Classifiers, MinHash and tokens can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
