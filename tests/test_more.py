"""Skewed groups, numbered lines of split files, streams that end, sinks, lessons and small operators."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quernstone.functions import audit as q, guards as g, lexicon
from quernstone.operators import matching, selection, summary
from quernstone.plans import audit, corpus, lessons
from quernstone.plans.modes import modes
from quernstone.sources import readers, writers
from quernstone.streaming import deltas


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_first_wins_of_a_hot_key(spark, monkeypatch, broadcast):
    monkeypatch.setattr(selection, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None, f"t{i}"]), None if i % 50 == 0 else "m") for i in range(600)] + [(0, "hot", "m"), (7, "twin", "m"), (7, "twin", "m")]
    df = spark.createDataFrame(rows, "id int, text string, mode string").repartition(5)
    kept, removed = selection.first_wins(df, ["mode", "text"], ["id"])
    best = {}
    for i, t, m in rows:
        best[m, t] = min(best.get((m, t), i), i)
    assert {((r["mode"], r["text"]), r["id"]) for r in kept.collect()} == set(best.items())
    assert kept.count() == len(best) and kept.count() + removed.count() == len(rows)


def test_ranks_within_skewed_groups(spark):
    rows = [(None if i % 97 == 0 else "big" if i % 3 else f"g{i % 5}", (i * 7919) % 5000) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(7)
    got = selection.placed_within(df, "g", ["x"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["x"], r["position"]))
    assert sum(map(len, groups.values())) == 5000
    for own in groups.values():
        assert [p for _, p in sorted(own)] == list(range(1, len(own) + 1))


def test_split_sizes_and_ties(spark):
    rows = [("a", i % 40, f"k{i % 40}") for i in range(400)] + [("b", 1, "k")] * 3 + [(None, i, f"n{i}") for i in range(15)]
    df = spark.createDataFrame(rows, "mode string, h int, key string")
    got = {(r["mode"], r["split"]): r["n"] for r in selection.split_by_hash(df, "mode", "h", "key").groupBy("mode", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", "valid"): 40, ("a", "train"): 360, ("b", "train"): 3, (None, "valid"): 2, (None, "train"): 13}
    parts = selection.split_by_hash(df, "mode", "h", "key").select("mode", "h", "key", "split").distinct()
    assert parts.groupBy("mode", "h", "key").count().filter("count > 1").count() == 0  # rows alike go together


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    lines = [f"line {i}" + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "big.txt").write_text("\r\n".join(lines) + "\n")
    (tmp_path / "none.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path))
        got = sorted((r["line_no"], r["line"]) for r in rows.collect())
        assert rows.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(lines, 1))


def wait_for(spark, name, done):
    until = time.time() + 120
    while time.time() < until:
        got = [tuple(r) for r in spark.table(name).collect()]
        if done(got):
            return got
        time.sleep(1)
    return got


def test_stream_ends_by_timeout_and_late_deltas_are_dropped(spark, tmp_path):
    schema = "request_id string, seq long, text string, done boolean, error string"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(0, [("a", 1, "x", False, None), ("b", 2, "q", True, None), ("b", 1, "p", False, None), ("c", 1, "bad", False, "lost")])
    out = deltas.collect_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), timeout="3 seconds")
    query = out.writeStream.format("memory").queryName("ends").outputMode("update").start()
    try:
        got = wait_for(spark, "ends", lambda rows: ("a", "x", "timeout") in rows)
        assert {("a", "x", "open"), ("a", "x", "timeout"), ("b", "pq", "done"), ("c", "bad", "error")} <= set(got)
        put(1, [("a", 2, "late", False, None), ("b", 3, "late", False, None), ("d", 1, "new", True, None)])
        got = wait_for(spark, "ends", lambda rows: ("d", "new", "done") in rows)
        assert not [r for r in got if "late" in r[1]]
    finally:
        query.stop()


def test_candidate_replies(spark):
    cases = {
        '{"choices": [{"message": {"content": "a"}}]}': "a",
        '{"candidates": [{"content": {"parts": [{"text": "b"}]}}]}': "b",
        '[{"role": "user", "content": "x"}, {"role": "assistant", "content": "c"}]': "c",
        '{"messages": [{"role": "assistant", "content": "x"}, {"role": "assistant", "content": "d"}, {"role": "user", "content": "y"}]}': "d",
        '[{"generated_text": "e"}]': "e",
        '[{"generated_text": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "f"}]}]': "f",
        '{"output": "g"}': "g",
        "no json": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "reply string").select("reply", readers.assistant_text(F.col("reply")).alias("said"))
    assert {r["reply"]: r["said"] for r in rows.collect()} == cases
    raw = 'data: {"candidates": [{"content": {"parts": [{"text": "x"}]}}]}\n\n'
    assert spark.createDataFrame([(raw,)], "raw string").select(deltas.parse_sse(F.col("raw"))[0]["text"]).first()[0] == "x"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", ""), (2, "b", "bad")], "x int, y string, reason string")
    writers.append_jsonl(rows, str(tmp_path / "log"), ["x", "y"])
    writers.append_jsonl(rows, str(tmp_path / "log"), ["x", "y"])
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert not writers.write_unless_empty(rows.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert writers.write_unless_empty(rows, str(tmp_path / "some"))
    writers.write_two_ways(rows, "reason = ''", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert [r["x"] for r in spark.read.json(str(tmp_path / "good")).collect()] == [1]
    assert [r["reason"] for r in spark.read.json(str(tmp_path / "bad")).collect()] == ["bad"]
    unknown = spark.createDataFrame([(3, "c", None)], "x int, y string, reason string")
    writers.write_two_ways(unknown, "reason = ''", str(tmp_path / "yes"), str(tmp_path / "no"))
    assert [r["x"] for r in spark.read.json(str(tmp_path / "no")).collect()] == [3]
    assert writers.write_audit(rows, spark.createDataFrame([("FAIL", 2)], "status string, n int"), str(tmp_path / "audit")) == "FAIL"
    assert spark.read.json(str(tmp_path / "audit" / "verdict")).first()["n"] == 2 and spark.read.json(str(tmp_path / "audit" / "flags")).count() == 2
    assert writers.versioned("/data/", "7") == "/data/run=7"


def test_settings_and_retries(spark):
    got = spark.createDataFrame([('{"mode": "rasmi"}',), ("broken",)], "stored string").select(readers.with_defaults(F.col("stored"), "mode string, size string", {"mode": "tashih", "size": "1"}).alias("s"))
    assert sorted((r["s"]["mode"], r["s"]["size"]) for r in got.collect()) == [("rasmi", "1"), ("tashih", "1")]
    rows = spark.createDataFrame([("متن", "x"), ("a б", "متن"), ("a б", "б")], "first string, again string")
    kept = rows.select(deltas.validated(F.col("first"), F.col("again"), lambda c: ~c.rlike(g.CORRUPT), g.strip_corrupt).alias("v"))
    assert [r["v"] for r in kept.collect()] == ["متن", "متن", "a "]


def test_lessons(spark):
    base = spark.createDataFrame([(f"b{i}", "one two three four") for i in range(20)], "key string, text string")
    said = lessons.repetition_lessons(spark.createDataFrame([("l1", "خیلی"), ("l2", "نه")], "key string, word string"), "word", 3)
    assert sorted(r["input"] for r in said.collect()) == ["خیلی", "خیلی خیلی", "خیلی خیلی خیلی", "نه", "نه نه", "نه نه نه"]
    mixed = lessons.mixed_in(said, base, "key", F.col("base_text")).collect()
    assert len(mixed) == 6 and all(r["mixed"] == f"one two {r['input']} three four" for r in mixed)
    some = [r["key"] for r in lessons.seeded_sample(base, F.col("key"), 5).collect()]
    assert len(set(some)) == 5 and some == [r["key"] for r in lessons.seeded_sample(base.repartition(4), F.col("key"), 5).collect()]
    assert sorted(r["key"] for r in selection.window_of(base, "key", 2, 3).collect()) == sorted(sorted(f"b{i}" for i in range(20))[2:5])
    first = matching.first_value_by(spark.createDataFrame([("m", 2, "b"), ("m", 1, "a")], "mode string, n int, v string"), "mode", "v", "n")
    assert [tuple(r) for r in first.collect()] == [("m", "a")]


def test_corrections(spark):
    rows = spark.createDataFrame([(i, f"این متن نادرست {i} است", f"این متن درست {i} است") for i in range(1, 101)] + [(101, "short", "x"), (102, "این متن برابر است", "این متن برابر است")], "line_no long, src string, tgt string")
    got = corpus.corrections(rows, 20, 5).collect()
    assert len(got) == 20 and sum(r["split"] == "valid" for r in got) == 5 and len({r["key"] for r in got}) == 20


def test_leaks_by_version(spark):
    one = spark.createDataFrame([("m", "x")], "mode string, input string")
    two = spark.createDataFrame([("m", "y")], "mode string, input string")
    corpus.check_leaks({"train": one, "valid": two, "hard": two.limit(0)}, "v3")
    with pytest.raises(ValueError, match="hard leaks into valid"):
        corpus.check_leaks({"train": one, "valid": two, "hard": two}, "v3")
    with pytest.raises(ValueError, match="valid leaks into hard"):
        corpus.check_leaks({"train": one, "valid": two, "hard": two}, "v4")


def test_preparation_v3(spark):
    rows = [(f"k{i}", m, f"متن شماره {i} است", f"خروجی خوب {'۱۲۳'[i % 3]} است") for i, m in enumerate(["rasmi", "edari"] * 20)]
    base = spark.createDataFrame(rows, "key string, mode string, input string, output string")
    bad = spark.createDataFrame([("b1", "rasmi", "متن", "سلام hello"), ("b2", "rasmi", "متن", "تکرار تکرار بلند " * 3)], base.schema)
    curated = base.withColumns({"key": F.concat(F.lit("c"), "key"), "input": F.concat("input", F.lit(" تازه"))})
    out = corpus.prepare({"train": base.unionByName(bad)}, curated, modes(spark), ["rasmi"], version="v3", hard=base.limit(0))
    assert {r["key"]: r["reason"] for r in out["rejected"].collect()} == {"b1": "foreign-script letter", "b2": "repetition"}
    found = {(r["part"], r["name"]): (r["n"], r["digest"]) for r in out["manifest"].collect()}
    assert found["total", "train"][0] == 42 and found["accepted", "train"][0] == 40
    assert len(found["digest", "train"][1]) == 64 and found["digest", "train"] != found["digest", "valid"]
    with pytest.raises(ValueError, match="hard leaks"):
        corpus.prepare({"train": base}, curated, modes(spark), ["rasmi"], version="v3", hard=base.limit(1))


def test_long_audit(spark):
    rows = spark.createDataFrame([("a", "lati", "یک. دو. سه.", "داداش یک. دو. سه."), ("b", "lati", "یک.", "متن را به زبان دیگر نوشت و باز هم نوشت و نوشت.")], "key string, mode string, input string, output string")
    found = {(r["key"], r["category"]) for r in audit.long_flags(rows, modes(spark)).collect()}
    assert not [x for x in found if x[0] == "a"]
    assert {("b", "long-input"), ("b", "coverage"), ("b", "meta-echo"), ("b", "register-review")} <= found


def test_first_audits_tokens(spark):
    rows = spark.createDataFrame([("کتاب‌هایی درباره‌ی این مدرسه‌ها می‌خوانم", "کتاب و مدرسه")], "x string, y string")
    got = q.with_audit_overlap(rows, "x", "y", "o").withColumn("t", q.audit_tokens(F.col("x"))).first()
    assert "کتاب" in got["t"] and "مدرسه" in got["t"] and "این" not in got["t"] and 0 < got["o"] < 1


def test_fields_and_prompts(spark):
    rows = spark.createDataFrame([(json.dumps({"b": 1, "a": 2}),)], "line string").withColumn("fields", F.json_object_keys("line"))
    got = rows.select(q.schema_flag(F.col("fields"), ["a", "b"]).alias("x"), q.schema_flag(F.col("fields"), ["a", "b"], True).alias("y"), q.schema_flag(F.col("fields"), ["a"]).alias("z")).first()
    assert tuple(got) == (False, True, True)
    said = spark.range(2).select(g.judge_prompt(F.lit("in"), F.lit("ref"), F.lit("cand"), F.col("id")).alias("p")).collect()
    assert len({r["p"] for r in said}) == 2 and all("INPUT: in" in r["p"] and "CANDIDATE: cand" in r["p"] for r in said)


def test_fallbacks_refuse(spark):
    left = spark.createDataFrame([("k", "x", "r")], "key string, input string, output string")
    with pytest.raises(ValueError, match="no candidate"):
        matching.with_fallbacks(left, left.filter("false"))
    with pytest.raises(ValueError, match="input differs"):
        matching.with_fallbacks(left, left.withColumn("input", F.lit("z")))
    with pytest.raises(ValueError, match="missing text"):
        matching.with_fallbacks(left, left.withColumn("output", F.lit("")))
    assert matching.cleared(left).count() == 0


def test_lexicon_table(spark):
    rows = spark.createDataFrame([("r", 1, "b", "c"), ("r", 0, "a", "b"), ("r", 2, "a", "d")], "register string, pos int, k string, v string")
    assert lexicon.from_table(rows) == {"r": [("a", "d"), ("b", "c")]}


def test_order_digests_by_group(spark):
    rows = spark.range(1, 2501).select((F.col("id") % 2).alias("g"), F.floor((F.col("id") + 1) / 2).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    got = {r["g"]: r["digest"] for r in summary.order_digests(rows.repartition(6), "g", "n", "d").collect()}
    assert got == {r["g"]: r["digest"] for r in summary.order_digests(rows, "g", "n", "d").collect()} and len(set(got.values())) == 2


def test_stored_tables_are_released(spark):
    from quernstone import tables

    at = tables.made()
    a = tables.stored(spark.range(5), "one")
    b = tables.stored(a.withColumn("x", F.lit(1)), "two")
    folder = a.inputFiles()[0].rsplit("/", 1)[0]
    assert readers.exists(spark, folder)
    tables.release(spark, at, b)
    assert not readers.exists(spark, folder) and b.count() == 5 and tables.made() == at + 1
