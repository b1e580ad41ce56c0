"""Audits: records to flag rows, flags against a ledger, evaluations to a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quernstone.functions import audit as q
from quernstone.functions.guards import echoes, foreign_letter, numbers_kept, repeated_fragment
from quernstone.functions.chars import trim
from quernstone.operators import matching, selection, summary

REVIEWABLE = ["meaning-review", "register-review"]


def flags_of(records: DataFrame, modes: DataFrame, profile: q.Profile, fragments: bool = True) -> DataFrame:
    """(key, mode, category, detail) for records (key, mode, system, input, output, messages); order within a key by line.

    Repeated keys, inputs and outputs are flagged from the second occurrence on, in the order of key.
    """
    rows = records.join(F.broadcast(modes.select("mode", "marker_regex", "overlap_threshold", "instruction")), "mode", "left")
    before, output = F.col("input"), F.col("output")
    flag = lambda holds, category, detail: F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(category).alias("category"), F.lit(detail).alias("detail")))
    ratio = q.length_ratio(before, output)
    correction = F.col("mode") == "tashih"
    all_flags = F.array(
        flag(F.col("marker_regex").isNull(), "schema", "unknown mode"),
        flag(~q.rebuilt(F.col("messages"), F.col("system"), before, output), "schema", "messages do not reconstruct system/input/output"),
        flag(foreign_letter(output, profile.script) != "", "foreign-script", "letter outside the native script"),
        flag(output.rlike("[0-9]"), "foreign-script", "ASCII digit in output"),
        flag(echoes(output, "v1", F.col("instruction")), "prompt-echo", "output resembles an instruction"),
        flag(~numbers_kept(before, output), "meaning-anchor", "missing number"),
        flag(q.negation_lost(before, output), "meaning-review", "negation may be missing"),
        flag(q.overlap(before, output, profile) < F.coalesce("overlap_threshold", F.lit(profile.weak_below)), "meaning-review", "low token overlap"),
        flag(trim(before) == trim(output), "meaning-anchor", "output is identical to input"),
        flag(q.repeated_sentence(output), "repetition", "repeated sentence"),
        flag(repeated_fragment(output, 12) if fragments else F.lit(False), "repetition", "repeated long fragment"),
        flag(correction & ~ratio.between(0.72, 1.35), "register-review", "length ratio suggests rewriting"),
        flag(~correction & ~q.marked(output, F.col("marker_regex"), F.lit(False)), "register-review", "missing register signal"),
        flag(q.colloquial_in_formal(F.col("mode"), output), "register-review", "colloquial token may remain in formal register"),
    )
    own = rows.select("key", "mode", F.explode(F.filter(all_flags, lambda x: x.isNotNull())).alias("f")).select("key", "mode", "f.*")
    twice = [selection.repeated(records, [c], ["key"]).select("key", "mode", F.lit("duplicate").alias("category"), F.lit(f"duplicate {c}").alias("detail")) for c in ("input", "output")]
    return own.unionByName(twice[0]).unionByName(twice[1])


def long_flags(records: DataFrame, modes: DataFrame) -> DataFrame:
    """(key, mode, category): the flags that long records get besides: bounds of sentences and lengths, echoes of another set, fragments of 18 places, tokens in common."""
    rows = records.join(F.broadcast(modes.select("mode", "marker_regex")), "mode", "left")
    before, output = F.col("input"), F.col("output")
    told = F.regexp_replace(before, r"\Aاین چند جمله[^.؟!]*[.؟!]\s*", "")
    flag = lambda holds, category: F.when(F.coalesce(holds, F.lit(False)), category)
    found = F.array(
        flag(echoes(output, "v3"), "meta-echo"),
        flag(repeated_fragment(output, 18), "repetition"),
        flag(~numbers_kept(before, output), "meaning"),
        flag(q.overlap(told, output, q.PROFILES["v3"]) < q.PROFILES["v3"].weak_below, "meaning-review"),
        flag(~q.marked(output, F.col("marker_regex"), F.lit(False)), "register-review"),
        flag(q.coverage(before, output) != "", "coverage"),
    )
    return rows.select("key", "mode", F.explode(F.concat(q.sentence_bounds(before, output), F.filter(found, lambda x: x.isNotNull()))).alias("category"))


def digests(records: DataFrame) -> DataFrame:
    return records.select("key", q.record_digest(F.col("mode"), F.col("input"), F.col("output"), F.col("system")).alias("digest"))


def ledger_of(flags: DataFrame, records: DataFrame) -> DataFrame:
    """A review ledger (key, digest, categories) of all reviewable flags."""
    return summary.categories_by_key(flags.filter(F.col("category").isin(REVIEWABLE))).join(digests(records), "key")


def resolve(flags: DataFrame, records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Flags with approved: digest-bound approvals of reviewable categories."""
    return matching.approved(flags.join(digests(records), "key", "left"), ledger, REVIEWABLE)


def evaluate(evaluations: DataFrame, modes: DataFrame, hard_modes: list[str], profile: q.Profile, fragments: bool = True) -> tuple[DataFrame, DataFrame]:
    """Issues (key, mode, category, detail, severity) and the one-row verdict for (key, mode, input, teacher, output)."""
    rows = evaluations.join(F.broadcast(modes.select("mode", "marker_regex")), "mode", "left")
    voiced = q.marked(F.col("output"), F.coalesce("marker_regex", F.lit("(?!)")), F.col("mode") == "shaeraneh")
    found = q.gate_issues(F.col("input"), F.col("teacher"), F.col("output"), F.col("mode"), voiced, profile, fragments=fragments)
    issues = rows.select("key", "mode", F.explode(found).alias("i")).select("key", "mode", "i.*")
    return issues, summary.gate(evaluations, issues, modes.filter("in_pipeline").select("mode"), hard_modes)
