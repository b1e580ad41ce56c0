"""Writers. Ordered output is range-partitioned by position, so files in name order hold rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def json_line(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("*", F.to_json(F.struct(*columns)).alias("line"))


def write_jsonl(rows: DataFrame, path: str, position: str, columns: list[str], one_file: bool = False, mode: str = "overwrite") -> None:
    """JSON lines in the order of ``position``. One file is one task, for small outputs; else files sort by name (see write_jsonl_parts)."""
    lines = json_line(rows, columns)
    placed = lines.orderBy(position).coalesce(1) if one_file else lines.repartitionByRange(position).sortWithinPartitions(position)
    placed.select(F.col("line").alias("value")).write.mode(mode).text(path)


def write_jsonl_parts(rows: DataFrame, path: str, position: str, columns: list[str]) -> DataFrame:
    """JSON lines in the order of ``position`` (gapless from 1) as parts in the order of their names, and their manifest: part, offset, lines, bytes, digest.

    Tasks write the parts; they become visible when all are written, so a failed job leaves none. The manifest is made
    from what then lies there and written last: no manifest, no output. Its digests depend on every line and its number;
    nothing is gathered in one task.
    """
    from quernstone.operators.summary import order_digests
    from quernstone.sources.readers import numbered_lines

    spark, root = rows.sparkSession, path.rstrip("/")
    write_jsonl(rows, root, position, columns, mode="errorifexists")
    lines = numbered_lines(spark, f"{root}/part-*").withColumn("part", F.element_at(F.split("file", "/"), -1))
    sums = lines.groupBy("part").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    before = F.coalesce(F.sum("lines").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    digests = order_digests(lines.select("part", "line_no", F.sha2("line", 256).alias("d")), "part", "line_no", "d")
    manifest = sums.withColumn("offset", before).join(digests, "part").select("part", "offset", "lines", "bytes", "digest")
    manifest.write.mode("errorifexists").json(f"{root}/_manifest")
    return spark.read.schema(manifest.schema).json(f"{root}/_manifest")


def append_jsonl(rows: DataFrame, path: str, columns: list[str]) -> None:
    json_line(rows, columns).select(F.col("line").alias("value")).write.mode("append").text(path)


def write_unless_empty(rows: DataFrame, path: str) -> bool:
    """Writes JSON lines only if there is a row."""
    if not rows.take(1):
        return False
    rows.write.mode("overwrite").json(path)
    return True


def write_two_ways(rows: DataFrame, accepted: str, good: str, bad: str) -> None:
    """Accepted rows to one place, the others, also those where it is unknown, to another."""
    rows.filter(accepted).drop("reason").write.mode("append").json(good)
    rows.filter(f"NOT coalesce({accepted}, false)").write.mode("append").json(bad)


def report_block(rows: DataFrame) -> DataFrame:
    """value: an evaluation report's block for each record (key, mode, input, teacher, output)."""
    return rows.select(
        F.concat_ws(
            "\n",
            F.lit("=" * 64),
            F.concat("key", F.lit("  (mode: "), "mode", F.lit(")")),
            F.concat(F.lit("INPUT : "), "input"),
            F.concat(F.lit("TEACHER (9B): "), "teacher"),
            F.concat(F.lit("SMALL (2B) : "), "output"),
        ).alias("value")
    )


def write_audit(flags: DataFrame, verdict: DataFrame, path: str) -> str:
    """An audit's report: its flags and its one-row verdict as JSON in two folders; returns the status, which a job turns into its exit code."""
    flags.write.mode("overwrite").json(f"{path.rstrip('/')}/flags")
    row = verdict.limit(1)
    row.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/verdict")
    return row.first()["status"]


def versioned(path: str, run: str) -> str:
    """A directory of its own for each run, instead of moving an older output away."""
    return f"{path.rstrip('/')}/run={run}"
