"""More registered queries: rules whose inputs are derived from the tables, with the rule itself written again in SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quernstone.functions import audit, calendar, guards, lexicon
from quernstone.operators import matching, summary
from quernstone.plans import audit as plan_audit, corpus, modes
from quernstone.queries import OVERLAP, PAIRS, PERSIAN_PAIRS, PLAIN, RATIO, STRIPPED, pairs, persian_pairs, query, records, table
from quernstone.streaming import deltas, stateful
from quernstone.tables import new_path, stored

#: Lexicons of real size: 13 of 235 entries and one of 5,000, from the words of the documents; a fifth of the values are
#: two words, and half of these are keys again, so passes see what longer keys wrote.
LEXICONS, ENTRIES, LARGE = 13, 235, 5000
WORDS = "(SELECT word, row_number() OVER (ORDER BY md5(word)) - 1 AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents))"
ENTRY_ROWS = f"""w AS MATERIALIZED (SELECT * FROM {WORDS} WHERE n < {LARGE + 3 * LEXICONS}),
    c AS (SELECT a.n, a.word AS k, b.word AS v1, c.word AS v2, d.word AS v3 FROM w a JOIN w b ON b.n = a.n + {LEXICONS} JOIN w c ON c.n = a.n + {2 * LEXICONS} JOIN w d ON d.n = a.n + {3 * LEXICONS} WHERE a.n < {LARGE}),
    e AS (SELECT n, 2 * n AS pos, k, CASE WHEN n % 5 = 0 THEN v1 || ' ' || v2 ELSE v1 END AS v FROM c UNION ALL SELECT n, 2 * n + 1, v1 || ' ' || v2, v3 FROM c WHERE n % 10 = 0),
    r AS (SELECT {LEXICONS} AS register, * FROM e UNION ALL SELECT n % {LEXICONS}, * FROM e WHERE n < {LEXICONS * ENTRIES}),
    l AS (SELECT register, list({{'k': k, 'v': v, 't': ''}} ORDER BY length(k) DESC, pos) AS entries FROM r GROUP BY register)"""


def real_lexicons(spark, sf_dir):
    """The table (register, pos, k, v)."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("word")).distinct()
    first = words.withColumn("h", F.md5("word")).orderBy("h").limit(LARGE + 3 * LEXICONS)
    w = stored(first.select("word", (F.row_number().over(Window.orderBy("h")) - 1).alias("n")), "lexicon-words")  # of that many rows
    at = lambda k: w.select((F.col("n") - k * LEXICONS).alias("n"), F.col("word").alias(f"v{k}"))
    c = w.filter(F.col("n") < LARGE).withColumnRenamed("word", "k").join(at(1), "n").join(at(2), "n").join(at(3), "n")
    two = F.concat_ws(" ", "v1", "v2")
    e = c.select("n", (2 * F.col("n")).alias("pos"), "k", F.when(F.col("n") % 5 == 0, two).otherwise(F.col("v1")).alias("v"))
    e = e.unionByName(c.filter("n % 10 = 0").select("n", (2 * F.col("n") + 1).alias("pos"), two.alias("k"), F.col("v3").alias("v")))
    named = lambda rows, register: rows.select(register.cast("string").alias("register"), "pos", "k", "v")
    return named(e, F.lit(LEXICONS)).unionByName(named(e.filter(F.col("n") < LEXICONS * ENTRIES), F.col("n") % LEXICONS))


@query(f"""WITH {ENTRY_ROWS},
    d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS t FROM documents),
    f AS (SELECT doc_id, list_reduce(list_prepend({{'k': '', 'v': '', 't': ' ' || replace(t, ' ', '  ') || ' '}}, entries), lambda a, e: {{'k': '', 'v': '', 't': replace(a.t, ' ' || replace(e.k, ' ', '  ') || ' ', ' ' || replace(e.v, ' ', '  ') || ' ')}}).t AS t
        FROM d JOIN l ON register = doc_id % {LEXICONS + 1})
    SELECT doc_id, sha256(replace(trim(t), '  ', ' ')) AS output_sha256, length(replace(trim(t), '  ', ' ')) AS n_chars FROM f""")
def lexicons_of_real_size(spark, sf_dir):
    """Every document edited by one of 14 lexicons that come from a table of 8,000 entries."""
    edit = lexicon.replacing(lexicon.from_table(real_lexicons(spark, sf_dir)))
    text = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", edit(text, (F.col("doc_id") % (LEXICONS + 1)).cast("string"))["text"].alias("output"))
    return rows.select("doc_id", F.sha2("output", 256).alias("output_sha256"), F.length("output").cast("long").alias("n_chars"))


# Streams: run over the tables' rows in several batches


@query(r"""SELECT conv_id::VARCHAR AS request_id, regexp_replace(coalesce(string_agg(text, '' ORDER BY turn), ''), '^\s+|\s+$', '', 'g') AS text, CASE WHEN conv_id % 4 = 1 THEN 'broke' END AS error FROM conversations GROUP BY conv_id""")
def sse_stream(spark, sf_dir):
    """Each conversation as the bytes of a server-sent event stream, cut every 53 bytes, arriving in any order in three batches."""
    event = F.concat(F.lit("data: "), F.to_json(F.struct("text")), F.lit("\n\n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))), lambda x: x["e"]), "")
    late = "\n\n".join(["", 'data: {"text": "late"}', ""])
    end = F.when(F.col("conv_id") % 4 == 0, 'data: {"done": true}' + late).when(F.col("conv_id") % 4 == 1, 'data: {"error": "broke"}' + late).when(F.col("conv_id") % 4 == 2, "data: [DONE]\n\n").otherwise("data: {}")
    bodies = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("said")).select(F.col("conv_id").cast("string").alias("request_id"), F.encode(F.concat("said", end), "UTF-8").alias("body"))
    pieces = F.sequence(F.lit(0), F.floor((F.length("body") - 1) / 53).cast("int"))
    chunks = bodies.select("request_id", F.posexplode(F.transform(pieces, lambda i: F.substring(F.col("body"), i * 53 + 1, F.lit(53)))).alias("seq", "chunk"), F.size(pieces).alias("n"))
    chunks = chunks.select("request_id", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == F.col("n") - 1).alias("last"))
    return stateful.sse_text(stateful.run_over_files(spark, chunks, lambda s: stateful.sse_stream(s, 0), 3))


@query("""WITH e AS (SELECT conv_id % 97 AS speaker, conv_id AS session, turn, turn // 2 AS r, role = 'assistant' AS is_final, trim(coalesce(text, '')) AS t FROM conversations),
    n AS (SELECT speaker, max(session) AS session FROM e GROUP BY speaker), o AS (SELECT e.* FROM e JOIN n USING (speaker, session)),
    f AS (SELECT speaker, string_agg(t, ' ' ORDER BY r) AS final, list(r) AS settled FROM (SELECT speaker, r, arg_max(t, turn) AS t FROM o WHERE is_final GROUP BY speaker, r) GROUP BY speaker),
    i AS (SELECT speaker, arg_max(r, turn) AS r, arg_max(t, turn) AS t FROM o WHERE NOT is_final GROUP BY speaker)
    SELECT n.speaker::VARCHAR AS speaker, n.session, concat_ws(' ', nullif(final, ''), CASE WHEN NOT coalesce(list_contains(settled, i.r), false) THEN nullif(i.t, '') END) AS text FROM n LEFT JOIN f USING (speaker) LEFT JOIN i USING (speaker)""")
def dictation_stream(spark, sf_dir):
    """Conversations as dictation of 97 speakers: a session each, the assistant's turns final, arriving in any order in three batches."""
    c = table(spark, sf_dir, "conversations")
    events = c.select((F.col("conv_id") % 97).cast("string").alias("speaker"), F.col("conv_id").cast("long").alias("session"), F.col("turn").cast("long").alias("event_no"), F.floor(F.col("turn") / 2).cast("int").alias("result_index"), (F.col("role") == "assistant").alias("is_final"), F.col("text").alias("transcript"))
    return stateful.newest_text(stateful.run_over_files(spark, events, stateful.dictation_stream, 3))


@query("""WITH e AS (SELECT user_id, (event_id % 3)::INTEGER AS p, floor(value * 2000)::BIGINT AS ms, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'end' WHEN 'signup' THEN 'error' ELSE 'delta' END AS kind, event_type AS t FROM events),
    w AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id, p ORDER BY ms, seq) AS gap, row_number() OVER (PARTITION BY user_id, p ORDER BY ms, seq) AS n FROM e),
    c AS (SELECT user_id, coalesce(min(p) FILTER (n = 2 AND kind <> 'error' AND gap <= 30000), 3) AS p FROM w GROUP BY user_id),
    a AS (SELECT w.*, CASE WHEN n > 2 AND gap > 30000 THEN 'timeout' WHEN kind = 'delta' THEN 'open' WHEN kind = 'error' THEN 'error' ELSE 'done' END AS state FROM w JOIN c USING (user_id, p) WHERE n > 1),
    k AS (SELECT *, min(n) FILTER (state <> 'open') OVER (PARTITION BY user_id) AS stop FROM a),
    s AS (SELECT user_id, coalesce(string_agg(t, '' ORDER BY n) FILTER (state IN ('open', 'done')), '') AS text, arg_max(state, n) AS state FROM k WHERE stop IS NULL OR n <= stop GROUP BY user_id)
    SELECT c.user_id::VARCHAR AS request_id, c.p AS priority, coalesce(s.text, '') AS text, CASE s.state WHEN 'open' THEN 'timeout' ELSE coalesce(s.state, 'failed') END AS state FROM c LEFT JOIN s USING (user_id)""")
def failover(spark, sf_dir):
    """Events as what three backends say to each user's request: their times from the value, the first row of a backend its start."""
    kind = F.when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "signup", "error").otherwise("delta")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("request_id"), (F.col("event_id") % 3).cast("int").alias("priority"), F.timestamp_millis(F.floor(F.col("value") * 2000)).alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("text"), F.lit(3).alias("backends")
    )
    return stateful.failover_batch(rows)


# Sources and sinks: rows written as the reference's file formats and read back from many splits

SQUEEZED = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


#: Bytes of a split, at most.
MOST_SPLIT = 32 << 20


def in_small_splits(spark, path, make):
    """What make returns, read in splits of 64 KB, so that the small files here are many tasks too; of large ones in larger splits, eight for each core."""
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    spark.conf.set(conf, min(MOST_SPLIT, max(64 << 10, size // (8 * spark.sparkContext.defaultParallelism))))
    try:
        return stored(make(), "read")
    finally:
        spark.conf.set(conf, before)


@query(f"SELECT doc_id::VARCHAR AS key, lang AS mode, sha256({SQUEEZED.format('text')}) AS input_sha256, source AS teacher, length({SQUEEZED.format('text')}) AS output FROM documents WHERE length({SQUEEZED.format('text')}) > 0")
def report_round_trip(spark, sf_dir):
    """Documents as blocks of an evaluation report in one file of many splits, read back block by block."""
    from quernstone.sources import readers, writers

    text = F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("mode"), text.alias("input"), F.col("source").alias("teacher"), F.length(text).cast("string").alias("output")).filter("length(input) > 0")
    path = new_path(spark, "report")
    writers.report_block(rows).write.text(path)
    back = in_small_splits(spark, path, lambda: readers.read_report(spark, path))
    return back.select("key", "mode", F.sha2("input", 256).alias("input_sha256"), "teacher", F.col("output").cast("long").alias("output"))


@query(f"SELECT url AS title, sha256(text) AS description_sha256 FROM {STRIPPED} JOIN pages USING (page_id)")
def feed_round_trip(spark, sf_dir):
    """Pages as items of feeds of many splits, read back item by item."""
    from quernstone.sources import readers

    item = F.concat(F.lit("<item><title>"), "url", F.lit("</title>\n<description><![CDATA["), "html", F.lit("]]></description></item>"))
    path = new_path(spark, "feed")
    table(spark, sf_dir, "pages").select(item.alias("value")).write.text(path)
    back = in_small_splits(spark, path, lambda: readers.read_feed(spark, path))
    return back.select("title", F.sha2("description", 256).alias("description_sha256"))


@query("SELECT round(count(*) FILTER (value >= 50) / nullif(count(*), 0), 4) AS pass_rate, count(*) AS completed, count(*) FILTER (value >= 50) AS passed, 'COMPLETE' AS status FROM events")
def report_kept_current(spark, sf_dir):
    """Events as judged results that a stream brings in batches; the report that lies there after the last."""
    path, source = new_path(spark, "judged"), new_path(spark, "results")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.when(F.col("value") >= 50, "PASS").otherwise("FAIL").alias("verdict"))
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    deltas.run_reported(stream, path, new_path(spark, "checkpoint"))
    report = spark.read.schema("completed long, passed long, pass_rate double, status string").json(f"{path}/report")
    return report.select("pass_rate", "completed", "passed", "status")


# Calendar

DAYS = "(date_diff('day', DATE '1970-01-01', {d}) + 492268)"
FIRST = "(365 * ({y} - 1) + floor((8 * {y} + 21) / 33.0)::BIGINT)"
SOLAR = f"""(SELECT d, y, CASE WHEN n < 186 THEN n // 31 ELSE (n - 6) // 30 END AS m, n FROM (SELECT d, y, k - {FIRST.format(y='y')} AS n FROM (
    SELECT d, {DAYS.format(d='d')} AS k, floor((33 * {DAYS.format(d='d')} + 3) / 12053.0)::BIGINT + 1 AS y FROM (SELECT DISTINCT ts::DATE AS d FROM events UNION SELECT DISTINCT o_orderdate::DATE FROM orders))))"""


@query(f"SELECT d::VARCHAR AS date, y AS year, m + 1 AS month, n - CASE WHEN m < 6 THEN m * 31 ELSE m * 30 + 6 END + 1 AS day, d::VARCHAR AS back FROM {SOLAR}")
def solar_hijri_days(spark, sf_dir):
    """Every day of events and orders in the Solar Hijri calendar, and back."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).union(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate"))).distinct()
    s = days.select("d", calendar.solar_hijri(F.col("d")).alias("s")).select("d", "s.*")
    back = calendar.from_solar_hijri(F.col("year"), F.col("month"), F.col("day"))
    return s.select(F.col("d").cast("string").alias("date"), *(F.col(c).cast("long").alias(c) for c in ("year", "month", "day")), back.cast("string").alias("back"))


# Register markers of three profiles from a table

#: Words of a marker by profile: the most frequent words of a language of so many letters or more.
PROFILE_WORDS = {"gate": (2, 4), "audit": (4, 5), "long audit": (8, 6)}
MARKER_ROWS = " UNION ALL ".join(
    f"SELECT '{p}' AS profile, lang AS mode, '(?i)(' || string_agg(w, '|' ORDER BY n DESC, w) || ')' AS pattern FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM (SELECT lang, w, count(*) AS n FROM words WHERE length(w) >= {least} GROUP BY lang, w)) WHERE k <= {k} GROUP BY lang" for p, (k, least) in PROFILE_WORDS.items()
)


def marker_rows(spark, sf_dir):
    """The table (profile, mode, pattern)."""
    words = table(spark, sf_dir, "documents").select(F.col("lang").alias("mode"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("w"))
    counts = stored(words.groupBy("mode", "w").agg(F.count("*").alias("n")), "marker-words")
    out = None
    for profile, (k, least) in PROFILE_WORDS.items():
        first = counts.filter(F.length("w") >= least).withColumn("k", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("n"), "w"))).filter(F.col("k") <= k)
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), "|")
        own = first.groupBy("mode").agg(said.alias("s")).select(F.lit(profile).alias("profile"), "mode", F.concat(F.lit("(?i)("), "s", F.lit(")")).alias("pattern"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH words AS MATERIALIZED (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM documents), m AS MATERIALIZED ({MARKER_ROWS})
    SELECT profile, mode, count(*) AS n, round(avg(regexp_matches(text, pattern)::INT::DOUBLE), 3) AS coverage FROM documents JOIN m ON m.mode = lang GROUP BY profile, mode""")
def marker_profiles(spark, sf_dir):
    """Coverage of each language by the markers of three profiles, which come from a table."""
    markers = modes.markers_from_table(marker_rows(spark, sf_dir))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("mode"), "text").filter("mode IS NOT NULL")
    return summary.coverage_by_profile(rows, "mode", {p: audit.voiced(F.col("mode"), F.col("text"), m) for p, m in markers.items()})


# Rows of bad lines, schemas, prompts, replies and later profiles


@query("SELECT 'kept' AS what, count(*) AS n, sum(doc_id)::BIGINT AS total FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'flagged', count(*), 0 FROM documents WHERE doc_id % 7 = 0")
def malformed_lines(spark, sf_dir):
    """Every seventh record cut off in the middle: one reader skips these lines, another makes flags of them."""
    from quernstone.sources import readers

    line = F.to_json(F.struct("doc_id", "lang"))
    path = new_path(spark, "lines")
    table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 4)).otherwise(line).alias("value")).write.text(path)
    good = readers.read_jsonl(spark, path, "doc_id long, lang string", "DROPMALFORMED")
    _, flags = readers.read_jsonl_flagged(spark, path, "doc_id long, lang string")
    kept = good.filter("doc_id IS NOT NULL").agg(F.lit("kept").alias("what"), F.count("lang").alias("n"), F.sum("doc_id").alias("total"))
    return kept.unionByName(flags.agg(F.lit("flagged").alias("what"), F.count("*").alias("n"), F.lit(0).cast("long").alias("total")))


@query("SELECT doc_id, doc_id % 3 = 2 AS other_fields, doc_id % 3 <> 0 AS other_order FROM documents")
def schema_flags(spark, sf_dir):
    """Records whose lines hold the fields in order, in another order, or not all of them."""
    line = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct("doc_id", "lang", "source"))).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct("lang", "doc_id", "source"))).otherwise(F.to_json(F.struct("doc_id", "lang")))
    fields, want = F.json_object_keys(line), ["doc_id", "lang", "source"]
    return table(spark, sf_dir, "documents").select("doc_id", audit.schema_flag(fields, want).alias("other_fields"), audit.schema_flag(fields, want, ordered=True).alias("other_order"))


@query(f"""SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN 'Look for meaning that was lost.' ELSE 'Look for meaning that was added.' END || chr(10) || chr(10) || 'INPUT: ' || input || chr(10) || chr(10) || 'REFERENCE: ' || output || chr(10) || chr(10) || 'CANDIDATE: ' || output || '!') AS prompt_sha256 FROM {PAIRS}""")
def judge_prompts(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.sha2(guards.judge_prompt(F.col("input"), F.col("output"), F.concat("output", F.lit("!")), F.col("turn")), 256).alias("prompt_sha256"))


def _later_tokens_sql(column: str, profile: audit.Profile) -> str:
    runs = f"regexp_extract_all(lower({column}), '[\\p{{Arabic}}،؛؟ـ\\x{{064B}}-\\x{{0655}}\\x{{0670}}]{{{profile.least},}}')"
    cut = f"list_transform({runs}, lambda x: regexp_replace(translate(x, 'يىك', 'ییک'), '({'|'.join(profile.suffixes)})$', ''))"
    stops = "[" + ", ".join(f"'{w}'" for w in profile.stop) + "]::VARCHAR[]"
    return f"array_to_string(list_sort(list_distinct(list_filter({cut}, lambda x: length(x) >= {profile.least} AND NOT list_contains({stops}, x)))), ' ')"


@query("SELECT o_orderkey, " + ", ".join(f"{_later_tokens_sql('output', p)} AS {n}" for n, p in audit.PROFILES.items()) + f" FROM {PERSIAN_PAIRS}")
def later_tokens(spark, sf_dir):
    """Tokens of the gate's profile and of the two later audits."""
    said = lambda p: F.array_join(F.array_sort(audit.tokens(F.col("output"), p)), " ")
    return persian_pairs(spark, sf_dir).select("o_orderkey", *(said(p).alias(n) for n, p in audit.PROFILES.items()))


@query("SELECT doc_id, lang FROM documents")
def appended_lines(spark, sf_dir):
    """JSON lines appended in two runs and read back, failing at a malformed line."""
    from quernstone.sources import readers, writers

    rows, path = table(spark, sf_dir, "documents"), new_path(spark, "appended")
    for k in range(2):
        writers.append_jsonl(rows.filter(F.col("doc_id") % 2 == k), path, ["doc_id", "lang"])
    return readers.read_jsonl(spark, path, "doc_id long, lang string")


SHAPES = ['{"choices": [{"message": {"content": %s}}]}', '{"candidates": [{"content": {"parts": [{"text": %s}]}}]}', '{"message": {"content": %s}}', '{"output": %s}', '[{"generated_text": %s}]', '[{"role": "user", "content": "no"}, {"role": "assistant", "content": %s}]']


@query("SELECT conv_id, turn, text AS said FROM conversations WHERE text IS NOT NULL AND text <> ''")
def assistant_texts(spark, sf_dir):
    """The answer in replies of six shapes."""
    from quernstone.sources import readers

    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND text <> ''")
    content = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)\A\{"text":(.*)\}\z', 1)
    shape = F.get(F.array(*map(F.lit, SHAPES)), ((F.col("conv_id") + F.col("turn")) % len(SHAPES)).cast("int"))
    reply = F.concat(F.substring_index(shape, "%s", 1), content, F.substring_index(shape, "%s", -1))
    return rows.select("conv_id", "turn", readers.assistant_text(reply).alias("said"))


ONE_LINE = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


@query(rf"""SELECT conv_id, turn, trim(CASE WHEN regexp_matches(x, '\A[«"“'']+(.*?)[»"”'']\z') THEN regexp_extract(x, '\A[«"“'']+(.*?)[»"”'']\z', 1) ELSE x END) AS bare FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '«' || {ONE_LINE} || '»' WHEN 1 THEN '"' || {ONE_LINE} || '" said' ELSE {ONE_LINE} END AS x FROM conversations)""")
def unwrapped_quotes(spark, sf_dir):
    x = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
    framed = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("«"), x, F.lit("»"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('"'), x, F.lit('" said'))).otherwise(x)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", guards.unwrap_quotes(framed).alias("bare"))


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER w AS position, value < 20 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, s AND lag(s, 1, false) OVER w AND lag(s, 2, false) OVER w AS three FROM e WINDOW w AS (PARTITION BY user_id ORDER BY position))
    SELECT event_id, user_id, position, coalesce(position > min(position) FILTER (three) OVER (PARTITION BY user_id), false) AS circuit_open FROM r""")
def circuit_breaker_by_user(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return matching.circuit_breaker(rows, "event_id", F.col("value") < 20, by="user_id").select("event_id", "user_id", "position", "circuit_open")


@query("SELECT lang || '|' || d.doc_id AS key, sha256(lang || chr(0) || text || chr(0) || source || chr(0)) AS digest, CASE WHEN toxic = 1 THEN 'meaning-review,register-review' ELSE 'meaning-review' END AS categories FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def review_ledger(spark, sf_dir):
    """The ledger of a review: each labelled record's digest and the flags that a reviewer may approve; broken schemas aren't among them."""
    rows = records(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    flags = rows.select("key", F.explode(F.when(F.col("toxic") == 1, F.array(*map(F.lit, ("register-review", "meaning-review", "schema")))).otherwise(F.array(F.lit("schema"), F.lit("meaning-review")))).alias("category"))
    kept = plan_audit.ledger_of(flags, rows.select("key", "mode", F.col("text").alias("input"), F.col("source").alias("output"), F.lit("").alias("system")))
    return kept.select("key", "digest", F.array_join(F.array_sort("categories"), ",").alias("categories"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 <> 0 THEN 'good' ELSE 'bad' END AS place, CASE WHEN n_chars % 3 <> 0 THEN NULL ELSE 'in ' || lang END AS why FROM documents")
def two_ways(spark, sf_dir):
    """Rows written to where they belong, accepted or rejected with a reason, and read back; a place for no row isn't made."""
    from quernstone.sources import writers

    good, bad, none = (new_path(spark, name) for name in ("good", "bad", "none"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat(F.lit("in "), "lang").alias("reason"))
    writers.write_two_ways(rows, "n_chars % 3 <> 0", good, bad)
    if writers.write_unless_empty(rows.filter("doc_id < 0 AND doc_id >= 0"), none):
        raise ValueError("a place for no row")
    read = lambda path, place: spark.read.schema("doc_id long, reason string").json(path).select("doc_id", F.lit(place).alias("place"), F.col("reason").alias("why"))
    return read(good, "good").unionByName(read(bad, "bad"))


@query(r"SELECT doc_id, sha256(regexp_replace(translate(coalesce(text, ''), 'aeoEO', 'жд漢かक'), '[\p{Cyrillic}\p{Han}\p{Hiragana}\p{Katakana}\p{Devanagari}]', '', 'g')) AS rest_sha256 FROM documents")
def corrupt_script_removed(spark, sf_dir):
    """Documents with letters of five foreign scripts in the places of some of their own."""
    damaged = F.translate(F.coalesce("text", F.lit("")), "aeoEO", "жд漢かक")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(guards.strip_corrupt(damaged), 256).alias("rest_sha256"))


MODE_ROWS = ", ".join(f"({i}, '{m}', {0.14 if t is None else t}::DOUBLE)" for i, (m, _, _, t) in enumerate(modes.MODES))


@query(f"SELECT conv_id, turn, mode FROM (SELECT *, {RATIO} AS ratio FROM {OVERLAP}) JOIN (VALUES {MODE_ROWS}) m(i, mode, least) ON i = (conv_id + turn) % {len(modes.MODES)} WHERE ratio < least")
def low_overlap_by_mode(spark, sf_dir):
    """Turns of all modes with the audit's flag of few tokens in common, each mode by its own bound; modes without one by the profile's."""
    mode = F.get(F.array(*(F.lit(m) for m, *_ in modes.MODES)), ((F.col("conv_id") + F.col("turn")) % len(modes.MODES)).cast("int"))
    rows = pairs(spark, sf_dir).select(F.concat_ws("|", "conv_id", "turn").alias("key"), mode.alias("mode"), F.lit("").alias("system"), "input", "output")
    told = rows.withColumn("messages", corpus.messages(F.col("system"), F.col("input"), F.col("output")))
    flags = plan_audit.flags_of(told, modes.modes(spark), PLAIN, fragments=False).filter("detail = 'low token overlap'")
    at = F.split("key", "[|]")
    return flags.select(at[0].cast("long").alias("conv_id"), at[1].cast("int").alias("turn"), "mode")
