"""Files in splits, parts with a manifest, reports kept current, retries and the calendar."""

import datetime

import pytest
from pyspark.sql import functions as F

from quernstone.functions import calendar
from quernstone.operators import summary
from quernstone.sources import readers, writers
from quernstone.streaming import deltas


@pytest.fixture()
def splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_report_in_splits(spark, tmp_path, splits):
    blocks = [(f"k{i}", "rasmi", f"متن\nدوم {i}", "=" * 31 + f" t{i}", f"o{i}\n== x") for i in range(40)]
    text = "".join("=" * (32 + i % 40) + (" \r\n" if i % 3 else "\n") + f"{k}  (mode: {m})\nINPUT : {a}\nTEACHER (9B): {b}\nSMALL (2B) : {c}\n" for i, (k, m, a, b, c) in enumerate(blocks)) + "=" * 64 + "\n"
    (tmp_path / "r.txt").write_text(text)
    got = readers.read_report(spark, str(tmp_path / "r.txt"))
    assert got.rdd.getNumPartitions() > 5
    assert [tuple(r)[1:] for r in got.orderBy("block_no").collect()] == blocks
    assert spark.createDataFrame([(text,)], "t string").select(F.explode(readers.parse_report(F.col("t"))).alias("b")).select("b.key").count() == 40
    (tmp_path / "bad.txt").write_text(text + "no block at all\n")
    with pytest.raises(Exception, match="malformed"):
        readers.read_report(spark, str(tmp_path / "bad.txt")).collect()


def test_feed_in_splits(spark, tmp_path, splits):
    items = [(f"title {i}", f"<b>text</b> {i} &amp;") for i in range(50)]
    (tmp_path / "f.xml").write_text("<rss><channel><title>feed</title>" + "\n".join(f"<item>\n<title><![CDATA[{a}]]></title><description>{b}</description></item>" for a, b in items) + "</channel></rss>")
    got = readers.read_feed(spark, str(tmp_path / "f.xml"))
    assert got.rdd.getNumPartitions() > 5
    assert [(r["title"], r["description"]) for r in got.orderBy("piece_no").collect()] == [(a, f"text {i}") for i, (a, _) in enumerate(items)]


def test_parts_and_their_manifest(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_parts(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_parts(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") + 1).alias("position"), F.concat(F.lit("é "), "id").alias("x")).repartition(7)
    manifest = writers.write_jsonl_parts(rows, f"{tmp_path}/o", "position", ["x"]).orderBy("part").collect()
    lines = [f'{{"x":"é {i}"}}' for i in range(1000)]
    assert len(manifest) > 1 and sum(m["lines"] for m in manifest) == 1000 and sum(m["bytes"] for m in manifest) == sum(len(x.encode()) + 1 for x in lines)
    at = 0
    for m in manifest:  # parts hold the lines of one file, in order
        assert m["offset"] == at
        own = (tmp_path / "o" / m["part"]).read_text().splitlines()
        assert own == lines[at : at + m["lines"]]
        at += m["lines"]
    back = readers.read_jsonl_parts(spark, f"{tmp_path}/o", "x string").orderBy("line_no").collect()
    assert [(r["line_no"], r["x"]) for r in back] == [(i + 1, f"é {i}") for i in range(1000)]
    (tmp_path / "o" / manifest[0]["part"]).write_text('{"x":"less"}\n')
    (tmp_path / "o" / f".{manifest[0]['part']}.crc").unlink()
    with pytest.raises(ValueError, match="manifest"):
        readers.read_jsonl_parts(spark, f"{tmp_path}/o", "x string")


def test_failed_task_leaves_no_output(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") + 1).alias("position"), F.when(F.col("id") == 70, F.raise_error(F.lit("broke"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="broke"):
        writers.write_jsonl_parts(rows, f"{tmp_path}/o", "position", ["x"])
    assert not list((tmp_path / "o").glob("part-*")) and not (tmp_path / "o" / "_manifest").exists()


def test_report_after_repeated_batches(spark, tmp_path):
    rows = [(f"k{i}", ["PASS", "FAIL", "UNCERTAIN", "SKIP"][i % 4 if i % 3 else 0]) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, verdict string")
    read = lambda: spark.read.json(f"{tmp_path}/r/report").first().asDict()
    for epoch, (a, b) in enumerate(((0, 20), (20, 35), (35, 50))):
        deltas.keep_report(df.filter(F.substring("key", 2, 9).cast("int").between(a, b - 1)), epoch, f"{tmp_path}/r", 50)
        assert read()["completed"] == b and read()["status"] == "PARTIAL"
    before = read()
    deltas.keep_report(df.filter(F.substring("key", 2, 9).cast("int").between(20, 34)), 1, f"{tmp_path}/r", 50)
    assert {k: v for k, v in read().items() if k != "epoch"} == {k: v for k, v in before.items() if k != "epoch"}
    want = summary.judge_report(df, 50).first().asDict()
    assert {k: read()[k] for k in want} == want


def test_calls_are_tried_again_by_status(spark):
    asked = {}

    def refused(status):
        error = RuntimeError(f"status {status}")
        error.status = status
        return error

    def send(row):
        asked[row["id"]] = asked.get(row["id"], 0) + 1
        if row["id"] == "busy" and asked["busy"] < 3:
            raise refused(429)
        if row["id"] == "denied":
            raise refused(401)
        if row["id"] == "slow":
            raise TimeoutError("slow")
        if row["id"] == "bug":
            raise ValueError("bug")
        return f"said {row['id']}"

    rows = spark.createDataFrame([(x,) for x in ("fine", "busy", "denied", "slow", "bug")], "id string").coalesce(1)
    got = {r["id"]: (r["reply"], r["error"] is not None, r["tries"]) for r in readers.call_service(rows, send, "id string", wait=lambda n: 0).collect()}
    assert got == {"fine": ("said fine", False, 1), "busy": ("said busy", False, 3), "denied": (None, True, 1), "slow": (None, True, 3), "bug": (None, True, 1)}


def test_calendar(spark):
    known = [("2024-03-20", (1403, 1, 1)), ("2025-03-20", (1403, 12, 30)), ("2025-03-21", (1404, 1, 1)), ("1979-02-11", (1357, 11, 22)), ("1970-01-01", (1348, 10, 11)), ("2021-03-20", (1399, 12, 30)), ("2000-09-22", (1379, 7, 1))]
    rows = spark.createDataFrame([(datetime.date.fromisoformat(d),) for d, _ in known] + [(None,)], "d date")
    got = {str(r["d"]): r["s"] and tuple(r["s"]) for r in rows.select("d", calendar.solar_hijri(F.col("d")).alias("s")).collect()}
    assert {d: got[d] for d, _ in known} == dict(known)
    days = spark.range(-30000, 40000).select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    s = days.withColumn("s", calendar.solar_hijri(F.col("d"))).select("d", "s.*")
    assert s.filter(~calendar.from_solar_hijri(F.col("year"), F.col("month"), F.col("day")).eqNullSafe(F.col("d"))).count() == 0
    none = spark.createDataFrame([(1404, 12, 30), (1403, 13, 1), (1403, 7, 31), (1403, 1, 0)], "y int, m int, d int")
    assert [r[0] for r in none.select(calendar.from_solar_hijri(F.col("y"), F.col("m"), F.col("d"))).collect()] == [None] * 4
    at = spark.createDataFrame([(datetime.datetime(2024, 3, 20, 9, 5),)], "t timestamp").select(calendar.said_date(F.col("t"))).first()[0]
    assert at == "۱ فروردین ۱۴۰۳،‏ ۹:۰۵"
