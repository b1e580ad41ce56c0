"""Readers. Line numbers count within a file from 1; a file may be read in many splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quernstone.functions.chars import trim
from quernstone.functions.guards import strip_html


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines; FAILFAST stops at a malformed line, DROPMALFORMED skips it. Blank lines are skipped; a missing file is
    empty when malformed lines are dropped."""
    if mode == "DROPMALFORMED" and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", mode).json(path)


def numbered_lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """file, line_no (from 1), line: every line of the files with its number, or every piece between two separators.

    Files are read in splits. A split's lines are counted, and the counts of a file's earlier splits are added, so a file
    of any size is as many tasks as it has splits.
    """
    text = F.regexp_replace("value", "\r$", "").alias("line")
    lines = spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_i"), text)
    splits = lines.groupBy(F.col("file").alias("_file"), F.col("_start").alias("_at")).agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    before = F.sum("_c").over(Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_file", "_at", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))  # a row for each split
    placed = lines.join(F.broadcast(splits), (F.col("file") == F.col("_file")) & (F.col("_start") == F.col("_at")))
    return placed.select("file", (F.col("_i") + 1 + F.col("_shift")).alias("line_no"), "line")


def read_jsonl_flagged(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed records with line_no and their field names in order, and a flag row for every malformed line."""
    lines = numbered_lines(spark, path).filter(F.length(trim(F.col("line"))) > 0)
    names = F.json_object_keys("line")
    parsed = lines.withColumn("record", F.from_json("line", schema)).withColumn("fields", names)
    bad = F.col("fields").isNull()
    flags = parsed.filter(bad).select(F.concat(F.lit("line-"), F.col("line_no").cast("string")).alias("key"), F.lit("schema").alias("category"), F.lit("invalid JSON").alias("detail"))
    return parsed.filter(~bad).select("line_no", "fields", "record.*"), flags


def read_jsonl_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line_no (over all parts, from 1) and the records of what writers.write_jsonl_parts wrote; parts that are not those of the manifest raise."""
    said = spark.read.json(f"{path.rstrip('/')}/_manifest").select("part", "offset", "lines")
    lines = numbered_lines(spark, f"{path.rstrip('/')}/part-*").withColumn("part", F.element_at(F.split("file", "/"), -1))
    found = lines.groupBy("part").agg(F.count("*").alias("found"))
    wrong = said.join(found, "part", "full").filter("lines IS DISTINCT FROM found").take(1)
    if wrong:
        raise ValueError(f"not what the manifest says: {wrong[0].asDict()}")
    placed = lines.join(F.broadcast(said.drop("lines")), "part")  # a row for each part
    return placed.select((F.col("line_no") + F.col("offset")).alias("line_no"), F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("line_no", "r.*")


def read_parallel(spark: SparkSession, source: str, target: str) -> DataFrame:
    """line_no, src, tgt: two files joined by line number; lines that the target lacks give null."""
    a = numbered_lines(spark, source).select("line_no", F.col("line").alias("src"))
    b = numbered_lines(spark, target).select("line_no", F.col("line").alias("tgt"))
    return a.join(b, "line_no", "left")


def _item(block: Column) -> tuple[Column, Column]:
    """title and description of an <item>'s inside, tags stripped."""
    inside = lambda tag: F.regexp_extract(block, rf"(?s)<{tag}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1)
    return strip_html(inside("title")).alias("title"), strip_html(inside("description")).alias("description")


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """title and description (tags stripped) of every <item> of each feed, in order, beside the feed's other columns."""
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item>(.*?)</item>"), 1)
    rows = feeds.select(*(c for c in feeds.columns if c != xml), F.posexplode(blocks).alias("item_no", "_b"))
    return rows.select("*", *_item(F.col("_b"))).drop("_b")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """file, piece_no, title, description of every <item> of feed files of any size, which are read in splits.

    Pieces end where an item does; what stands before the item is left out. A last item that is cut off counts as one.
    """
    pieces = numbered_lines(spark, path, "</item>").filter(F.contains("line", F.lit("<item>")))
    return pieces.select("file", F.col("line_no").alias("piece_no"), *_item(F.regexp_extract("line", r"(?s)<item>(.*)", 1)))


#: A line of so many of these and more ends a block of a report.
RULE = "=" * 32


def report_fields(block: Column) -> Column:
    """struct(key, mode, input, teacher, output) of a report's block, trimmed; a malformed one raises."""
    part = lambda pattern, k=1: trim(F.regexp_extract(block, pattern, k))
    header = r"(?m)^(.+?)\s+\(mode:\s*([^)]+)\)\s*$"
    patterns = {
        "input": r"(?ms)^INPUT\s*:\s*(.*?)(?=^TEACHER \(9B\):)",
        "teacher": r"(?ms)^TEACHER \(9B\):\s*(.*?)(?=^SMALL \(2B\)\s*:)",
        "output": r"(?ms)^SMALL \(2B\)\s*:\s*(.*)\z",
    }
    sound = block.rlike(header)
    for p in patterns.values():
        sound = sound & block.rlike(p)
    fields = [part(header).alias("key"), part(header, 2).alias("mode"), *(part(p).alias(n) for n, p in patterns.items())]
    return F.when(sound, F.struct(*fields)).otherwise(F.raise_error(F.concat(F.lit("malformed evaluation block: "), F.substring(block, 1, 120))).cast("struct<key: string, mode: string, input: string, teacher: string, output: string>"))


def parse_report(text: Column) -> Column:
    """array of struct(key, mode, input, teacher, output) from an evaluation report; a malformed block raises."""
    blocks = F.filter(F.transform(F.split(text, r"(?m)^={32,}\s*$"), trim), lambda b: F.length(b) > 0)
    return F.transform(blocks, report_fields)


def read_report(spark: SparkSession, path: str, *also: str) -> DataFrame:
    """block_no (in order within its file), key, mode, input, teacher, output of report files of any size, which are read in splits; ``also`` may name file.

    A piece begins behind the first 32 characters of a rule, and what is left of the rule goes. A line that begins like a
    rule and goes on with other text makes a malformed block, which raises.
    """
    pieces = numbered_lines(spark, path, "\n" + RULE)
    block = F.when(F.col("line_no") == 1, F.regexp_replace("line", r"\A={32}", "")).otherwise(F.col("line"))
    rest = trim(F.regexp_replace(block, r"\A=*[^\S\n]*(\n|\z)", "")).alias("b")
    return pieces.select("file", F.col("line_no").alias("block_no"), rest).filter("length(b) > 0").select("file", "block_no", report_fields(F.col("b")).alias("b")).select(*also, "block_no", "b.*")


def with_defaults(stored: Column, schema: str, defaults: dict[str, str]) -> Column:
    """Settings from a JSON text; bad JSON and missing fields give the defaults."""
    got = F.from_json(stored, schema)
    return F.struct(*(F.coalesce(got[k], F.lit(v)).alias(k) for k, v in defaults.items()))


#: Statuses of a service that it is worth to ask again after.
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)


def retryable(error: Exception) -> bool:
    """Whether to ask again: by the error's status, where it has one; else for errors of the network and of time."""
    status = getattr(error, "status", None)
    return status in RETRYABLE if status is not None else isinstance(error, (ConnectionError, TimeoutError, OSError))


def call_service(requests: DataFrame, send, schema: str, tries: int = 3, wait=None, again=retryable) -> DataFrame:
    """Replies of an injected callable, row by row within each partition, with retries; columns reply, error and tries are added.

    ``send`` takes a row's dict and returns a string. An error that ``again`` holds for is tried again after
    ``wait(n)`` seconds (``backoff`` by default), all others at once become the row's error. ``schema`` is that of the
    requests. Partitions bound how many calls run at a time.
    """
    pause = wait or backoff

    def run(batches):
        import time

        for pdf in batches:
            got = []
            for row in pdf.to_dict("records"):
                reply, error, n = None, None, 0
                while n < tries:
                    n += 1
                    try:
                        reply, error = send(row), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever the service raises becomes a row
                        error = f"{type(e).__name__}: {e}"
                        if not again(e):
                            break
                        if n < tries:
                            time.sleep(pause(n) or 0)
                got.append((reply, error, n))
            yield pdf.assign(**{c: [g[i] for g in got] for i, c in enumerate(("reply", "error", "tries"))})

    return requests.mapInPandas(run, f"{schema}, reply string, error string, tries int")


def backoff(n: int, base: float = 1.5, cap: float = 15.0) -> float:
    """Seconds before try n + 1."""
    return min(cap, base * 2 ** (n - 1))


def assistant_text(reply: Column) -> Column:
    """The answer in a model's JSON reply, whatever its shape; of a list of messages the last one that the assistant said."""
    paths = ["$.choices[0].message.content", "$.choices[0].delta.content", "$.candidates[0].content.parts[0].text", "$.message.content", "$.output", "$.text"]
    said = lambda messages: F.element_at(F.filter(messages, lambda m: m["role"] == "assistant"), -1)["content"]
    kind = "array<struct<role: string, content: string>>"
    many = F.coalesce(*(F.when(F.exists(x, lambda m: m["role"] == "assistant"), said(x)) for x in (F.from_json(reply, kind), F.from_json(F.get_json_object(reply, "$.messages"), kind), F.from_json(F.get_json_object(reply, "$.generated_text"), kind), F.from_json(F.get_json_object(reply, "$[0].generated_text"), kind))))
    return F.coalesce(many, *(F.get_json_object(reply, p) for p in paths), F.get_json_object(reply, "$.generated_text"), F.get_json_object(reply, "$[0].generated_text"))
