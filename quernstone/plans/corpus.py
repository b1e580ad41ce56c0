"""Corpus preparation: rebuild, quarantine, split, dedupe by priority, weight, check for leaks, interleave, manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.functions.guards import poison_reason
from quernstone.operators import matching, selection, summary


def messages(system: Column, before: Column, output: Column) -> Column:
    """Two turns; the system text is folded into the user's."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", F.concat(system, F.lit("\n\n"), before)), turn("assistant", output))


def rebuild(records: DataFrame, modes: DataFrame, rules: str = "") -> DataFrame:
    """Records with register, system and messages built anew from the live dimension; stored ones are discarded."""
    known = matching.with_dimension(records.select("key", "mode", "input", "output"), modes.select("mode", "register", "instruction"), "mode")
    system = F.concat("instruction", F.lit("\n\n" + rules))
    return known.select("key", "mode", "register", system.alias("system"), "input", "output", messages(system, F.col("input"), F.col("output")).alias("messages"))


def quarantine(records: DataFrame, source: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good records, and a log (source, key, mode, reason) of the others."""
    judged = records.withColumn("reason", reason)
    return judged.filter("reason = ''").drop("reason"), judged.filter("reason <> ''").select(F.lit(source).alias("source"), "key", "mode", "reason")


def prepare(sources: dict[str, DataFrame], curated: DataFrame, modes: DataFrame, hard_modes: list[str], share: float = 0.10, long: bool = False, native: str | None = None, version: str = "v2", hard: DataFrame | None = None) -> dict[str, DataFrame]:
    """train, valid, rejected, duplicates and manifest.

    sources: records (key, mode, input, output) by name, names ending in '_valid' for validation, in priority order;
    the curated records are split by stable hash, come last in priority and are weighted after the dedupe. ``version``
    says how reasons are named and which splits, the ``hard`` records among them from v3 on, must share nothing.
    """
    extra = {} if native is None else {"native": native}
    reason = poison_reason(F.col("output"), F.col("input"), version=version, **extra)
    kept, rejected = {}, []
    for name, records in sources.items():
        kept[name], bad = quarantine(records, name, reason)
        rejected.append(bad)
    halves = selection.stratified_split(curated, "mode", F.col("key"), F.col("input"), share)

    def joined(split: str) -> DataFrame:
        parts = [r.select("key", "mode", "input", "output", F.lit(i).alias("priority"), F.lit(n).alias("source")) for i, (n, r) in enumerate(kept.items()) if n.endswith("_valid") == (split == "valid")]
        parts.append(halves.filter(F.col("split") == split).select("key", "mode", "input", "output", F.lit(len(kept)).alias("priority"), F.lit("curated").alias("source")))
        return reduce(DataFrame.unionByName, parts)

    out, removed = {}, []
    for split in ("train", "valid"):
        unique, again = selection.first_wins(joined(split), ["mode", "input"], ["priority", "key"])
        out[split] = unique
        removed.append(again.select("source", "key", "mode", F.lit("duplicate mode/input").alias("reason")))
    nothing = out["valid"].limit(0)
    check_leaks({**out, "codex_valid": out["valid"].filter("source = 'curated'"), "hard": nothing if hard is None else hard}, version)
    weight = F.when(F.col("source") == "curated", selection.corpus_weight(F.col("mode"), hard_modes, long)).otherwise(1)
    out["train"] = selection.replicate(out["train"], weight)
    order = modes.filter("in_pipeline").select("mode", "position")
    for split in ("train", "valid"):
        out[split] = selection.interleave(out[split], order, "mode", F.col("key"), F.col("input"))
    log = reduce(DataFrame.unionByName, rejected) if rejected else curated.limit(0).select(F.lit("").alias("source"), "key", "mode", F.lit("").alias("reason"))
    copies = reduce(DataFrame.unionByName, removed)
    return out | {"rejected": log, "duplicates": copies, "manifest": manifest(out, log, copies, modes, sources)}


#: Which splits must not share (mode, input), by version of the preparation.
LEAKS = {"v2": [("codex_valid", "train")], "v3": [("valid", "train"), ("hard", "train"), ("hard", "valid")], "v4": [("train", "hard"), ("valid", "hard"), ("valid", "train")]}


def check_leaks(splits: dict[str, DataFrame], version: str) -> None:
    """Raises if a pair of splits that the version names shares (mode, input)."""
    matching.assert_no_leak(splits, LEAKS[version], ["mode", "input"])


def manifest(splits: dict[str, DataFrame], rejected: DataFrame, duplicates: DataFrame, modes: DataFrame, sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """(part, name, n, digest): rows by split and mode, rejects by reason, removed copies by source, total and accepted by source;
    for each split the digest of its rows in order (round, mode_position)."""
    every = modes.filter("in_pipeline").select("mode")
    parts = [summary.count_by(rows, "mode", every).select(F.lit(split).alias("part"), F.col("mode").alias("name"), "n") for split, rows in splits.items()]
    reason = summary.folded_reason(F.col("reason"), ["foreign-script letter"])
    parts.append(rejected.groupBy(reason.alias("name")).agg(F.count("*").alias("n")).select(F.lit("rejected").alias("part"), "name", "n"))
    parts.append(duplicates.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).select(F.lit("duplicates").alias("part"), "name", "n"))
    bad = rejected.groupBy("source").agg(F.count("*").alias("bad"))
    for name, rows in (sources or {}).items():
        total = rows.agg(F.count("*").alias("total")).withColumn("source", F.lit(name)).join(F.broadcast(bad), "source", "left")  # one row
        parts.append(total.select(F.lit("total").alias("part"), F.col("source").alias("name"), F.col("total").alias("n")))
        parts.append(total.select(F.lit("accepted").alias("part"), F.col("source").alias("name"), (F.col("total") - F.coalesce("bad", F.lit(0))).alias("n")))
    counts = reduce(DataFrame.unionByName, parts).withColumn("digest", F.lit(None).cast("string"))
    for split, rows in splits.items():
        if "round" in rows.columns:
            lines = rows.select(F.struct("round", "mode_position", "key").alias("_o"), F.sha2(F.concat_ws("\n", "key", "mode", "input", "output"), 256).alias("_d")).withColumn("_all", F.lit(0))
            digest = summary.order_digests(selection.placed_within(lines, "_all", ["_o"]), "_all", "position", "_d")
            counts = counts.unionByName(digest.select(F.lit("digest").alias("part"), F.lit(split).alias("name"), F.lit(None).cast("long").alias("n"), "digest"))
    return counts


def corrections(pairs: DataFrame, size: int = 3000, head: int = 60) -> DataFrame:
    """(line_no, src, tgt) to a systematic sample of sound pairs with split-qualified keys."""
    from quernstone.functions.chars import trim
    from quernstone.functions.guards import is_correction_pair

    good = pairs.filter(is_correction_pair(F.col("src"), F.col("tgt")))
    some = selection.head_tail(selection.systematic_sample(good, "line_no", size), head)
    key = F.concat(F.lit("corr-"), F.col("split"), F.lit("-"), F.col("sample_no").cast("string"))
    return some.select(key.alias("key"), F.lit("tashih").alias("mode"), trim(F.col("src")).alias("input"), trim(F.col("tgt")).alias("output"), "split")
