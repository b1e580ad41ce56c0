"""Operators over small tables, and every query against its SQL."""

import functools
import math
import random
import time
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone import queries
from quernstone.functions import audit as q
from quernstone.operators import matching, selection, summary
from quernstone.plans import audit, corpus
from quernstone.plans.modes import HARD_MODES, modes
from quernstone.sources import readers, writers
from quernstone.streaming import deltas

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark_rows, sql_rows):
    columns = sorted(spark_rows.columns)
    assert columns == sorted(sql_rows.columns)
    plain = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).astype(str).values.tolist()))
    assert plain(spark_rows) == plain(sql_rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def records(spark):
    rows = [(f"k{i}", m, f"متن شماره {i % 7} است", f"خروجی خوب {i} است".translate(str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹"))) for i, m in enumerate(["tashih", "rasmi", "edari"] * 20)]
    return spark.createDataFrame(rows, "key string, mode string, input string, output string")


def test_corpus_preparation(spark):
    all_modes = modes(spark)
    base = records(spark)
    bad = spark.createDataFrame([("b1", "rasmi", "متن", "hello"), ("b2", "rasmi", "متن", "خروجی 5")], base.schema)
    curated = base.withColumn("key", F.concat(F.lit("c"), "key")).withColumn("input", F.concat("input", F.lit(" تازه ")).cast("string")).withColumn("input", F.concat("input", "key"))
    out = corpus.prepare({"train": base.unionByName(bad)}, curated, all_modes, HARD_MODES)
    assert {r["key"]: r["reason"] for r in out["rejected"].collect()} == {"b1": "no Persian output", "b2": "ASCII digit in output"}
    train, valid = out["train"], out["valid"]
    assert matching.leaked(valid, train, ["mode", "input"]).count() == 0
    assert valid.count() == 6  # round(0.1 * 20) of each of three modes
    kept = base.select("mode", "input").distinct().count()
    assert out["duplicates"].count() == 60 - kept
    weights = train.filter("source = 'curated'").groupBy("mode").agg(F.max("copy").alias("w"))
    assert {r["mode"]: r["w"] for r in weights.collect()} == {"tashih": 1, "rasmi": 4, "edari": 4}
    manifest = {(r["part"], r["name"]): r["n"] for r in out["manifest"].collect()}
    assert manifest["valid", "adabi"] == 0 and manifest["valid", "rasmi"] == 2


def test_audit_and_ledger(spark):
    rows = corpus.rebuild(records(spark), modes(spark), "rules")
    flags = audit.flags_of(rows, modes(spark), q.PROFILES["gate"])
    assert flags.filter("category = 'schema'").count() == 0
    assert flags.filter("category = 'duplicate'").count() == 60 - 7
    ledger = audit.ledger_of(flags, rows)
    left = audit.resolve(flags, rows, ledger).filter("category IN ('meaning-review', 'register-review') AND NOT approved")
    assert left.count() == 0
    changed = rows.withColumn("output", F.concat("output", F.lit(".")))
    assert audit.resolve(flags, changed, ledger).filter("approved").count() == 0


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", "rasmi", "متن ۱۲", "متن درخواست ۱۲", "متن درخواست ۱۲"), ("b", "rasmi", "متن ۱۲", "متن", "hello 5")], "key string, mode string, input string, teacher string, output string")
    issues, verdict = audit.evaluate(rows, modes(spark), HARD_MODES, q.PROFILES["gate"])
    found = {(r["key"], r["category"]) for r in issues.collect()}
    assert not [x for x in found if x[0] == "a"]
    assert {("b", "no-persian"), ("b", "foreign-script"), ("b", "ascii-digit"), ("b", "lost-number")} <= found
    assert verdict.first()["status"] == "FAIL"


def test_pair_up_refuses(spark):
    a = spark.createDataFrame([("k", "x"), ("l", "y")], "key string, input string")
    assert matching.pair_up(a, a.filter("key = 'k'")).count() == 1
    with pytest.raises(ValueError, match="repeated key"):
        matching.pair_up(a.unionByName(a), a)
    with pytest.raises(ValueError, match="without reference"):
        matching.pair_up(a.filter("key = 'k'"), a)
    with pytest.raises(ValueError, match="differs"):
        matching.pair_up(a, a.withColumn("input", F.lit("z")))


def test_positions_are_gapless(spark):
    got = selection.with_positions(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")), "id").orderBy("id").collect()
    assert [r["position"] for r in got] == list(range(1, 1001))


def test_dimension_default(spark):
    rows = spark.createDataFrame([("rasmi",), ("nowhere",)], "mode string")
    got = matching.with_dimension(rows, modes(spark), "mode", "tashih")
    assert sorted(r["register"] for r in got.collect()) == ["formal", "standard"]
    with pytest.raises(ValueError, match="unknown mode"):
        matching.with_dimension(rows, modes(spark), "mode")


def test_boost_and_limit(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1)], "key string, w int")
    assert sorted(r["key"] for r in selection.boost(rows, "key", F.col("w")).collect()) == ["a", "a-v1", "a-v2", "b"]
    assert selection.limit_per_group(spark.range(10).withColumn("g", F.col("id") % 2), "g", ["id"], 2).count() == 4


def test_order_digest(spark):
    rows = spark.range(1, 3001).select(F.col("id").alias("p"), F.col("id").cast("string").alias("line"))
    one = summary.order_digest(rows.repartition(7), "p", F.col("line")).first()[0]
    assert one == summary.order_digest(rows, "p", F.col("line")).first()[0]
    assert one != summary.order_digest(rows.withColumn("line", F.when(F.col("p") == 5, "x").otherwise(F.col("line"))), "p", F.col("line")).first()[0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\nnot json\n\n{"id": "2", "text": "y"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, text string", "DROPMALFORMED").count() == 2
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id string, text string", "DROPMALFORMED").count() == 0
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, text string").collect()
    good, flags = readers.read_jsonl_flagged(spark, str(tmp_path / "a.jsonl"), "id string, text string")
    assert [r["key"] for r in flags.collect()] == ["line-2"] and [r["line_no"] for r in good.orderBy("line_no").collect()] == [1, 4]
    (tmp_path / "s").write_text("a\nb\nc")
    (tmp_path / "t").write_text("A\nB")
    assert [tuple(r) for r in readers.read_parallel(spark, str(tmp_path / "s"), str(tmp_path / "t")).orderBy("line_no").collect()] == [(1, "a", "A"), (2, "b", "B"), (3, "c", None)]
    feed = spark.createDataFrame([("f", "<rss><item><title><![CDATA[Hi <b>x</b>]]></title><description>d</description></item><item><title>t</title></item></rss>")], "feed string, xml string")
    assert [(r["title"], r["description"]) for r in readers.feed_items(feed).orderBy("item_no").collect()] == [("Hi x", "d"), ("t", "")]


def test_report_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "rasmi", "in", "te\nach", "out"), ("k2", "adabi", "a", "b", "c")], "key string, mode string, input string, teacher string, output string")
    text = "\n".join(r["value"] for r in writers.report_block(rows).collect())
    (tmp_path / "r.txt").write_text(text)
    got = readers.read_report(spark, str(tmp_path / "r.txt")).orderBy("block_no")
    assert [tuple(r)[1:] for r in got.collect()] == [tuple(r) for r in rows.collect()]
    (tmp_path / "bad.txt").write_text("=" * 40 + "\nnothing here")
    with pytest.raises(Exception, match="malformed"):
        readers.read_report(spark, str(tmp_path / "bad.txt")).collect()


def test_ordered_jsonl(spark, tmp_path):
    rows = spark.range(100).select((100 - F.col("id")).alias("p"), F.col("id").alias("x"))
    writers.write_jsonl(rows, str(tmp_path / "o"), "p", ["x"], one_file=True)
    lines = [line for f in sorted((tmp_path / "o").glob("part-*")) for line in f.read_text().split()]
    assert lines[0] == '{"x":99}' and len(lines) == 100


def test_service_retries(spark):
    def send(row):
        if row["id"] == 2:
            raise RuntimeError("down")
        return f"r{row['id']}"

    got = readers.call_service(spark.range(1, 4), send, "id long", tries=2, wait=lambda n: time.sleep(0))
    assert {r["id"]: (r["reply"], r["error"]) for r in got.collect()} == {1: ("r1", None), 2: (None, "RuntimeError: down"), 3: ("r3", None)}
    assert readers.backoff(5) == 15.0


def test_sse(spark):
    raw = 'data: {"text": "a"}\n\ndata: {"text": "b"}\n\ndata: {"done": true}\n\ndata: {"text": "cut'
    got = spark.createDataFrame([(raw,)], "raw string").select(deltas.parse_sse(F.col("raw")).alias("e")).first()["e"]
    assert [(e["text"], e["done"]) for e in got] == [("a", False), ("b", False), ("", True)]


def test_resumable_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, f"v{i}") for i in range(10)], "key long, v string")
    rows.coalesce(2).write.parquet(str(tmp_path / "in"))
    run = lambda: deltas.run_resumable(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    rows.withColumn("key", F.col("key") + 3).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(8))


def test_delta_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x", False, None), ("a", 2, "y", True, None), ("b", 1, "z", False, None)], "request_id string, seq bigint, text string, done boolean, error string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = deltas.collect_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("delta_out").outputMode("update").start()
    until = time.time() + 90  # a stream with timeouts keeps running, so wait for its rows
    while spark.table("delta_out").count() < 2 and time.time() < until and query.isActive:
        time.sleep(0.5)
    query.stop()
    got = {r["request_id"]: (r["text"], r["state"]) for r in spark.table("delta_out").collect()}
    assert got == {"a": ("xy", "done"), "b": ("z", "open")}


def test_long_numbers_stay_whole(spark):
    rows = spark.range(1, 1241).select("id", F.lit("en").alias("lang"))
    keys = {r["id"]: r["expected_key"] for r in selection.expected_keys(rows, "lang", "id", "codexv3").collect()}
    assert len(set(keys.values())) == 1240 and keys[7] == "codexv3007|en" and keys[1234] == "codexv31234|en"
    ids = {r["n"]: r["id"] for r in selection.sequential_ids(rows.select(F.col("id").alias("n")), "n", "web", 2).collect()}
    assert len(set(ids.values())) == 1240 and ids[7] == "web07" and ids[1234] == "web1234"


def test_mean_of_votes_in_their_order(spark):
    """Means that end in a half, whose sums differ in the last bit by order: that of the votes counts, however rows lie."""
    rng = random.Random(11)
    keys = []
    for n in (rng.randint(20, 80) for _ in range(40)):
        cents = [rng.randrange(2000, 30000) for _ in range(n)]
        cents[0] += (50 * n - sum(cents)) % (100 * n)
        keys.append([c / 100 for c in cents])
    want = {k: math.floor(functools.reduce(lambda a, b: a + b, own, 0.0) / len(own) + 0.5) for k, own in enumerate(keys)}
    assert any(want[k] != math.floor(sum(Fraction(round(100 * x), 100) for x in own) / len(own) + Fraction(1, 2)) for k, own in enumerate(keys))
    rows = [(k, i, "judged", "PASS", x, "", "") for k, own in enumerate(keys) for i, x in enumerate(own)] + [(99, 0, "skipped", "PASS", 5.0, "", ""), (98, 0, "judged", "PASS", None, "", "")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        votes = spark.createDataFrame(rows, "key int, vote int, status string, verdict string, score double, reason string, error string").repartition(7)
        assert {r["key"]: r["score"] for r in summary.fold_votes(votes, 2).collect()} == want | {98: None, 99: None}
