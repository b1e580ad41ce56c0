"""The registered queries over the library's own operators, and the SQL that gives the same rows.

The driver's tables stand in for the corpora: documents are records (lang is the mode), labels a review ledger,
benchmark a hard test set, pages web sources, conversations pairs of input and output, events votes and logs. Persian
rules run on sentences built from orders by templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone import ship
from quernstone.functions import audit as q, chars, guards as g, lexicon, text as t
from quernstone.operators import matching, selection, summary
from quernstone.plans import corpus, edits, modes
from quernstone.streaming import deltas
from quernstone.tables import new_path, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}
LATIN = r"\p{IsLatin}"
PLAIN = q.Profile(script=LATIN, suffixes=(), stop=("the", "and", "of", "to"))
FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(lang || '|' || doc_id || chr(0) || text, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that works on each of them, at most.
TASK_ROWS = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan; dealt anew where some task would get more than twice its share (small tables, large row groups).

    A scan has as many tasks with rows as its files have row groups, whatever its number of partitions, so rows are counted.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    counts = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]  # a row for each task of the scan
    n = sum(counts)
    tasks = max(cores, min(8 * cores, n // 500), -(-n // TASK_ROWS))
    return rows if max(counts, default=0) * tasks <= 2 * n else rows.repartition(tasks)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("|"), F.col("doc_id").cast("string")).alias("key"), F.col("lang").alias("mode"), "source", "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a user followed by one of the assistant."""
    c = table(spark, sf_dir, "conversations")
    a = spread(c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input")))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return a.join(b, ["conv_id", "turn"])


PAIRS = "(SELECT a.conv_id, a.turn, a.text AS input, b.text AS output FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"
RECORDS = "(SELECT doc_id, lang || '|' || doc_id AS key, lang AS mode, source, text FROM documents)"


@query(f"SELECT doc_id, mode FROM (SELECT *, row_number() OVER (PARTITION BY mode, text ORDER BY doc_id) AS n FROM {RECORDS}) WHERE n = 1")
def dedupe_first_wins(spark, sf_dir):
    return selection.first_wins(records(spark, sf_dir), ["mode", "text"], ["doc_id"])[0].select("doc_id", "mode")


@query(f"SELECT doc_id, mode, 'duplicate mode/input' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY mode, text ORDER BY doc_id) AS n FROM {RECORDS}) WHERE n > 1")
def dedupe_removed_log(spark, sf_dir):
    return selection.first_wins(records(spark, sf_dir), ["mode", "text"], ["doc_id"])[1].select("doc_id", "mode", F.lit("duplicate mode/input").alias("reason"))


def _tripled(rows: str, key: str, text: str, least: int) -> str:
    """Keys of the rows in whose text some fragment of ``least`` places or more stands three times in a row.

    With a period of p, as many grams of ``least`` places in a row equal those p further on as 2 * p places have.
    """
    grams = f"(SELECT k, i, substring(x, i, {least}) AS gram FROM (SELECT {key} AS k, {text} AS x, unnest(range(1, length({text}) - {least - 2})) AS i FROM {rows}))"
    pairs = f"(SELECT a.k, a.i, b.i - a.i AS p FROM {grams} a JOIN {grams} b ON a.k = b.k AND a.gram = b.gram AND b.i - a.i >= {least})"
    return f"(SELECT k FROM (SELECT k, p, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS island FROM {pairs}) GROUP BY k, p, island HAVING count(*) >= 2 * p - {least - 1})"


PAIR_KEY = "conv_id || '/' || turn"
POISON = (
    r"""(SELECT conv_id, turn, CASE WHEN NOT regexp_matches(output, '\p{Latin}') THEN 'no Persian output'
    WHEN regexp_matches(output, '[^\P{L}\p{Latin}]') THEN 'foreign-script letter "' || regexp_extract(output, '([^\P{L}\p{Latin}])', 1) || '"'
    WHEN regexp_matches(output, '[0-9]') THEN 'ASCII digit in output' WHEN regexp_matches(output, '\[[^\]\n]{2,}\]|【[^】\n]{2,}】') THEN 'placeholder output'
    WHEN """
    + f"{PAIR_KEY} IN {_tripled(PAIRS, PAIR_KEY, 'output', 12)}"
    + " THEN 'repeated long fragment' WHEN length(output) > greatest(600, 6 * length(input)) THEN 'extreme output length' ELSE '' END AS reason FROM "
    + PAIRS
    + ")"
)


def _poison(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", g.poison_reason(F.col("output"), F.col("input"), native=LATIN).alias("reason"))


@query(f"SELECT * FROM {POISON}")
def poison_reasons(spark, sf_dir):
    return _poison(spark, sf_dir)


@query(f"SELECT CASE WHEN reason LIKE 'foreign-script letter%' THEN 'foreign-script letter' ELSE reason END AS reason, count(*) AS n FROM {POISON} GROUP BY 1")
def poison_summary(spark, sf_dir):
    return _poison(spark, sf_dir).select(summary.folded_reason(F.col("reason"), ["foreign-script letter"]).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, {PAIR_KEY} IN {_tripled(PAIRS, PAIR_KEY, 'output', 12)} AS repeated FROM {PAIRS}")
def poison_with_repetition(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", g.repeated_fragment(F.col("output"), 12).alias("repeated"))


#: The beginning of each turn, twice or three times, alone and inside other text.
CASES = """(SELECT conv_id, turn, conv_id || '/' || turn AS n, CASE WHEN turn % 2 = 0 THEN 'before ' ELSE '' END || repeat(substring(coalesce(text, ''), 1, (5 + (7 * turn + conv_id) % 20)::INTEGER), (2 + (conv_id + turn) % 2)::INTEGER) || CASE WHEN conv_id % 3 = 0 THEN ' after' ELSE '' END AS text FROM conversations)"""


@query(f"SELECT conv_id, turn, n IN {_tripled(CASES, 'n', 'text', 12)} AS twelve, n IN {_tripled(CASES, 'n', 'text', 16)} AS sixteen FROM {CASES}")
def repeated_fragments(spark, sf_dir):
    start = F.substring(F.coalesce("text", F.lit("")), F.lit(1), (5 + (7 * F.col("turn") + F.col("conv_id")) % 20).cast("int"))
    text = F.concat(F.when(F.col("turn") % 2 == 0, "before ").otherwise(""), F.repeat(start, (2 + (F.col("conv_id") + F.col("turn")) % 2).cast("int")), F.when(F.col("conv_id") % 3 == 0, " after").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return rows.select("conv_id", "turn", g.repeated_fragment(F.col("text"), 12).alias("twelve"), g.repeated_fragment(F.col("text"), 16).alias("sixteen"))


SPLIT = f"(SELECT doc_id, mode, CASE WHEN row_number() OVER (PARTITION BY mode ORDER BY h, key) <= floor(count(*) OVER (PARTITION BY mode) * 0.1 + 0.5) THEN 'valid' ELSE 'train' END AS split FROM (SELECT r.doc_id, r.key, r.mode, {FNV} AS h FROM {RECORDS} r JOIN documents d ON r.doc_id = d.doc_id))".replace("|| text, ''", "|| d.text, ''").replace("|| doc_id ||", "|| d.doc_id ||")


def _hashed(spark, sf_dir):
    rows = spread(records(spark, sf_dir))
    return stored(rows.select("doc_id", "key", "mode", q.stable_hash(F.col("key"), F.col("text")).alias("hash"), F.sha2("text", 256).alias("digest")), "hashed")


def _split(spark, sf_dir):
    return selection.split_by_hash(_hashed(spark, sf_dir), "mode", "hash", "key")


@query(f"SELECT * FROM {SPLIT}")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "mode", "split")


@query(f"SELECT mode, split, count(*) AS n FROM {SPLIT} GROUP BY mode, split")
def split_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("mode", "split").agg(F.count("*").alias("n"))


LANGS = [("en", 1), ("fr", 2), ("de", 3), ("es", 4)]


@query(f"SELECT r.doc_id, m.p AS mode_position, row_number() OVER (PARTITION BY r.mode ORDER BY {FNV}, r.key) AS round FROM {RECORDS} r JOIN documents d ON r.doc_id = d.doc_id JOIN (VALUES ('en', 1), ('fr', 2), ('de', 3), ('es', 4)) m(mode, p) ON m.mode = r.mode".replace("|| text, ''", "|| d.text, ''").replace("|| doc_id ||", "|| d.doc_id ||"))
def interleave_round_robin(spark, sf_dir):
    langs = spark.createDataFrame(LANGS, "mode string, position int")
    return selection.interleave_by_hash(_hashed(spark, sf_dir), langs, "mode", "hash", "key").select("doc_id", "mode_position", "round")


@query("SELECT d.doc_id, copy FROM documents d JOIN labels l ON d.doc_id = l.doc_id, LATERAL (SELECT unnest(range(1, 1 + CASE WHEN lang = 'es' THEN 1 WHEN quality = 1 THEN 4 ELSE 3 END))::INTEGER AS copy)")
def weighted_replication(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    mode = F.when(F.col("lang") == "es", "tashih").when(F.col("quality") == 1, "rasmi").otherwise("other")
    return selection.replicate(rows, selection.corpus_weight(mode, ["rasmi"])).select("doc_id", "copy")


@query("SELECT page_id, position, CASE WHEN (position - 1) // step < 20 THEN 'valid' ELSE 'train' END AS split FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS position, count(*) OVER () // 50 AS step FROM pages) WHERE (position - 1) % step = 0 AND position <= step * 50")
def systematic_sample(spark, sf_dir):
    rows = selection.systematic_sample(table(spark, sf_dir, "pages").select("page_id"), "page_id", 50)
    return selection.head_tail(rows, 20).select("page_id", "position", "split")


@query("SELECT page_id, 'web' || lpad(n, greatest(6, length(n))::INTEGER, '0') AS id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id)::VARCHAR AS n FROM pages)")
def sequential_ids(spark, sf_dir):
    return selection.sequential_ids(table(spark, sf_dir, "pages").select("page_id"), "page_id", "web", 6).select("page_id", "id")


@query(f"SELECT v.doc_id FROM (SELECT s.doc_id, s.mode, d.text FROM {SPLIT} s JOIN documents d ON s.doc_id = d.doc_id WHERE split = 'valid') v WHERE EXISTS (SELECT 1 FROM {SPLIT} s JOIN documents d ON s.doc_id = d.doc_id WHERE s.split = 'train' AND s.mode = v.mode AND d.text = v.text)")
def leakage_exact(spark, sf_dir):
    rows = _split(spark, sf_dir)
    return matching.leaked(rows.filter("split = 'valid'"), rows.filter("split = 'train'"), ["mode", "digest"]).select("doc_id")


LEDGER = "(SELECT d.doc_id, lang || '|' || d.doc_id AS key, CASE WHEN d.doc_id % 7 = 0 THEN 'stale' ELSE sha256(lang || chr(0) || text || chr(0) || source || chr(0)) END AS digest, CASE WHEN toxic = 1 THEN ['meaning-review', 'register-review'] ELSE ['meaning-review'] END AS categories FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query(f"SELECT d.doc_id, f.category, coalesce(f.category <> 'schema' AND l.digest = sha256(d.lang || chr(0) || d.text || chr(0) || d.source || chr(0)) AND list_contains(l.categories, f.category), false) AS approved FROM documents d CROSS JOIN (VALUES ('meaning-review'), ('register-review'), ('schema')) f(category) LEFT JOIN {LEDGER} l ON l.doc_id = d.doc_id")
def approval_join(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("digest", q.record_digest(F.col("mode"), F.col("text"), F.col("source"), F.lit("")))
    flags = rows.select("doc_id", "key", "digest", F.explode(F.array(*map(F.lit, ("meaning-review", "register-review", "schema")))).alias("category"))
    both = F.array(F.lit("meaning-review"), F.lit("register-review"))
    ledger = rows.join(table(spark, sf_dir, "labels"), "doc_id").select("key", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("digest")).alias("digest"), F.when(F.col("toxic") == 1, both).otherwise(F.slice(both, 1, 1)).alias("categories"))
    return matching.approved(flags, ledger, ["meaning-review", "register-review"]).select("doc_id", "category", "approved")


@query(f"SELECT conv_id, turn, 'rasmi' AS mode, 'Rewrite.' || chr(10) || chr(10) || 'Keep facts.' AS system, 'user' || chr(10) || 'Rewrite.' || chr(10) || chr(10) || 'Keep facts.' || chr(10) || chr(10) || input || chr(10) || 'assistant' || chr(10) || output AS messages FROM {PAIRS}")
def record_rebuild(spark, sf_dir):
    modes = spark.createDataFrame([("rasmi", "formal", "Rewrite.")], "mode string, register string, instruction string")
    rows = pairs(spark, sf_dir).select(F.concat_ws("|", "conv_id", "turn").alias("key"), F.lit("rasmi").alias("mode"), "input", "output")
    built = corpus.rebuild(rows, modes, "Keep facts.")
    key = F.split("key", r"\|")
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["content"]))
    return built.select(F.get(key, F.lit(0)).cast("long").alias("conv_id"), F.get(key, F.lit(1)).cast("long").alias("turn"), "mode", "system", F.array_join(lines, "\n").alias("messages"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(spark, sf_dir):
    log = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    return matching.not_done(table(spark, sf_dir, "documents").select("doc_id"), log, "doc_id")


@query("SELECT c_custkey, coalesce(e.event_type, c_mktsegment) AS segment, e.event_type IS NOT NULL AS updated FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) e ON e.user_id = c_custkey")
def update_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_id", F.col("event_type").alias("segment"))
    return matching.with_latest(rows, log, "c_custkey", "event_id", "segment")


@query("SELECT doc_id, mode, mode || '|' || doc_id AS key FROM documents CROSS JOIN (VALUES ('rasmi'), ('edari'), ('adabi')) m(mode)")
def cross_mode_source(spark, sf_dir):
    modes = F.explode(F.array(*map(F.lit, ("rasmi", "edari", "adabi")))).alias("mode")
    return table(spark, sf_dir, "documents").select("doc_id", modes).withColumn("key", F.concat_ws("|", "mode", "doc_id"))


NUMBERS = r"regexp_extract_all(input, '[0-9]+(?:[.,][0-9]+)?')"


@query(f"SELECT conv_id, turn, len({NUMBERS})::BIGINT AS n_numbers, len(list_filter({NUMBERS}, lambda n: NOT contains(output, n))) = 0 AS kept FROM {PAIRS}")
def number_preservation(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return rows.select("conv_id", "turn", F.size(g.numbers(F.col("input"))).cast("long").alias("n_numbers"), g.numbers_kept(F.col("input"), F.col("output")).alias("kept"))


def _tokens_sql(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\p{{Latin}}]{{2,}}'), lambda x: x NOT IN ('the', 'and', 'of', 'to')))"


OVERLAP = f"(SELECT conv_id, turn, input, output, a, b, len(list_filter(a, lambda x: len(list_filter(b, lambda y: y = x OR (length(x) >= 4 AND length(y) >= 4 AND (contains(x, y) OR contains(y, x))))) > 0)) AS matched FROM (SELECT *, {_tokens_sql('input')} AS a, {_tokens_sql('output')} AS b FROM {PAIRS}))"
RATIO = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 1.0::DOUBLE ELSE matched::DOUBLE / least(len(a), len(b)) END"


@query(f"SELECT conv_id, turn, round({RATIO}, 6) AS overlap FROM {OVERLAP}")
def token_overlap(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(q.overlap(F.col("input"), F.col("output"), PLAIN), 6).alias("overlap"))


@query(rf"""SELECT conv_id, turn, CASE WHEN NOT regexp_matches(output, '\p{{Latin}}') THEN 'empty-or-no-Persian-output' WHEN regexp_matches(output, '[^\P{{L}}\p{{Latin}}]') THEN 'foreign-script-letter'
    WHEN regexp_matches(output, '[0-9]') THEN 'ASCII-digit' WHEN trim(output) = trim(input) THEN 'unchanged-register' WHEN len(list_filter({NUMBERS}, lambda n: NOT contains(output, n))) > 0 THEN 'lost-number'
    WHEN {RATIO} < 0.14 THEN 'weak-meaning-anchor' WHEN length(output)::DOUBLE / greatest(1, length(input)) < 0.2 OR length(output)::DOUBLE / greatest(1, length(input)) > 4 THEN 'extreme-length-change'
    WHEN {PAIR_KEY} IN {_tripled(PAIRS, PAIR_KEY, 'output', 16)} THEN 'repetition' ELSE '' END AS reason FROM {OVERLAP}""")
def strict_reject_pairs(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("overlap", q.overlap(F.col("input"), F.col("output"), PLAIN))
    reason = g.reject_reason(F.col("output"), F.col("input"), F.lit(False), F.col("overlap"), native=LATIN)
    return rows.select("conv_id", "turn", reason.alias("reason"))


MARKER = {"en": "(?i)the", "fr": "(?i)que", "de": "(?i)und", "es": "(?i)los"}
MARKED = "CASE lang WHEN 'en' THEN regexp_matches(text, '(?i)the') WHEN 'fr' THEN regexp_matches(text, '(?i)que') WHEN 'de' THEN regexp_matches(text, '(?i)und') WHEN 'es' THEN regexp_matches(text, '(?i)los') END"


def _marked(spark, sf_dir):
    marks = spark.createDataFrame(list(MARKER.items()), "mode string, marker string")
    return records(spark, sf_dir).join(F.broadcast(marks), "mode").withColumn("hit", q.marked(F.col("text"), F.col("marker"), F.lit(False)))


@query(f"SELECT m.mode, count(d.lang) AS n, round(avg(hit::INT::DOUBLE), 3) AS coverage FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')) m(mode) LEFT JOIN (SELECT lang, {MARKED} AS hit FROM documents) d ON d.lang = m.mode GROUP BY m.mode")
def marker_coverage(spark, sf_dir):
    every = spark.createDataFrame([(m,) for m in [*MARKER, "xx"]], "mode string")
    return summary.coverage(_marked(spark, sf_dir), "mode", F.col("hit"), every)


@query(f"""WITH d AS (SELECT doc_id, lang, {MARKED} AS hit FROM documents), c AS (SELECT lang, count(*) AS n, round(avg(hit::INT::DOUBLE), 3) AS voice FROM d GROUP BY lang),
    h AS (SELECT count(*) FILTER (quality = 0) AS hard, count(*) FILTER (toxic = 1) AS mean FROM labels JOIN documents USING (doc_id))
    SELECT (SELECT count(*) FROM d) AS records, hard AS hard_issues, mean AS meaning_issues, round(mean / (SELECT count(*) FROM d), 3) AS meaning_rate, hard = 0 AS no_hard_issues, round(mean / (SELECT count(*) FROM d), 3) <= 0.1 AS meaning_ok,
    (SELECT bool_and(voice >= 0.75) AND count(*) = 2 FROM c WHERE lang IN ('en', 'fr')) AS voice_ok, (SELECT count(*) = 4 FROM c WHERE lang IN ('en', 'fr', 'de', 'es')) AS all_modes,
    CASE WHEN hard = 0 AND round(mean / (SELECT count(*) FROM d), 3) <= 0.1 AND (SELECT bool_and(voice >= 0.75) AND count(*) = 2 FROM c WHERE lang IN ('en', 'fr')) AND (SELECT count(*) = 4 FROM c WHERE lang IN ('en', 'fr', 'de', 'es')) THEN 'PASS' ELSE 'FAIL' END AS status FROM h""")
def acceptance_gate(spark, sf_dir):
    docs = _marked(spark, sf_dir)
    modes = spark.createDataFrame([(m,) for m in MARKER], "mode string")
    labelled = records(spark, sf_dir).select("doc_id", "key", "mode").join(table(spark, sf_dir, "labels"), "doc_id")
    issue = lambda rows, category, severity: rows.select("key", "mode", F.lit(category).alias("category"), F.lit(severity).alias("severity"))
    issues = issue(labelled.filter("quality = 0"), "repetition", "hard").unionByName(issue(labelled.filter("toxic = 1"), "meaning-review", "metric")).unionByName(issue(docs.filter("NOT hit"), "register-review", "metric"))
    return summary.gate(docs, issues, modes, ["en", "fr"])


LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 12)"


@query(f"SELECT doc_id, len(list_distinct({LINES})) < len({LINES}) AS repeated FROM documents")
def repeated_lines(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", q.repeated_line(F.col("text")).alias("repeated"))


SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!؟])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 0)"


@query(f"SELECT n_sentences, count(*) AS n FROM (SELECT len({SENTENCES})::BIGINT AS n_sentences FROM documents) GROUP BY 1")
def sentence_histogram(spark, sf_dir):
    return records(spark, sf_dir).select(F.size(q.sentences(F.col("text"))).cast("long").alias("n_sentences")).groupBy("n_sentences").agg(F.count("*").alias("n"))


@query(f"SELECT max(n) AS most, count(*) AS sentences, count(*) FILTER (n > 5) AS over_five FROM (SELECT s, count(*) AS n FROM (SELECT unnest({SENTENCES}) AS s FROM documents) GROUP BY s)")
def max_sentence_repeat(spark, sf_dir):
    rows = summary.sentence_frequency(spread(table(spark, sf_dir, "documents").select("text")), q.sentences(F.col("text")))
    return rows.agg(F.max("n").alias("most"), F.count("*").alias("sentences"), F.count_if(F.col("n") > 5).alias("over_five"))


@query(r"SELECT lang AS mode, count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits, count(*) FILTER (regexp_matches(text, '!!')) AS shouted, count(*) FILTER (regexp_matches(text, '\|')) AS tabular, count(*) FILTER (length(text) < 100) AS short FROM documents GROUP BY lang")
def trap_counts(spark, sf_dir):
    text = F.col("text")
    traps = {"digits": text.rlike("[0-9]"), "shouted": text.rlike("!!"), "tabular": text.rlike(r"\|"), "short": F.length(text) < 100}
    return records(spark, sf_dir).groupBy("mode").agg(*(F.count_if(c).alias(n) for n, c in traps.items()))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<![^>]*>', '', 'g'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '&#[0-9]+;', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages""")
def html_strip(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", g.strip_html(F.col("html")).alias("text"))


STRIPPED = r"""(SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<![^>]*>', '', 'g'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '&#[0-9]+;', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages)"""
_count = lambda x: f"len(string_split_regex({x}, '\\s+'))"
_kept = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!؟…]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: regexp_matches(x, '[A-Za-z]') AND {_count('x')} <= 32)"
_merged = f"list_reduce(list_transform(kept, lambda x: [x]), lambda a, b: CASE WHEN {_count('a[-1]')} + {_count('b[1]')} <= 28 THEN list_concat(a[:-2], [a[-1] || ' ' || b[1]]) ELSE list_concat(a, b) END)"


@query(f"SELECT page_id, unnest(range(0, len(c)))::INTEGER AS chunk, unnest(c) AS text FROM (SELECT page_id, list_filter(CASE WHEN len(kept) = 0 THEN [] ELSE {_merged} END, lambda x: {_count('x')} >= 3) AS c FROM (SELECT page_id, {_kept} AS kept FROM {STRIPPED}))")
def sentencify_chunks(spark, sf_dir):
    pieces = g.chunks(g.strip_html(F.col("html")), native="[A-Za-z]")
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.posexplode(pieces).alias("chunk", "text"))


def _levels(rows: str, levels: int = 4) -> str:
    for _ in range(levels):
        rows = f"(SELECT mode, (n - 1) // 1024 + 1 AS n, sha256(string_agg(d, '' ORDER BY n)) AS d FROM {rows} GROUP BY mode, (n - 1) // 1024 + 1)"
    return rows


DIGESTS = _levels("(SELECT lang AS mode, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, sha256(lang || chr(0) || text || chr(0) || source || chr(0)) AS d FROM documents)")


@query(f"SELECT mode, d AS digest, (SELECT count(*) FROM documents WHERE lang = mode) AS n FROM {DIGESTS}")
def corpus_digest(spark, sf_dir):
    rows = records(spark, sf_dir).select("doc_id", "mode", q.record_digest(F.col("mode"), F.col("text"), F.col("source"), F.lit("")).alias("d"))
    placed = selection.placed_within(rows, "mode", ["doc_id"])
    return summary.order_digests(placed, "mode", "position", "d").join(placed.groupBy("mode").agg(F.count("*").alias("n")), "mode")


VERDICT = "CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'click' THEN 'FAIL' ELSE 'UNCERTAIN' END"
VOTES = f"(SELECT user_id AS key, event_id AS vote, CASE WHEN value < 20 THEN 'skipped' ELSE 'judged' END AS status, {VERDICT} AS verdict, value AS score FROM events)"
FOLDED = f"""(SELECT key, CASE WHEN j = 0 THEN 'SKIP' WHEN len(v) = 1 THEN v[1] ELSE 'UNCERTAIN' END AS verdict, floor(mean + 0.5)::BIGINT AS score, CASE WHEN j = 2 THEN len(v) = 1 END AS agreement FROM (
    SELECT key, count(*) FILTER (status = 'judged') AS j, coalesce(list(DISTINCT verdict) FILTER (status = 'judged'), []) AS v, avg(score) FILTER (status = 'judged') AS mean FROM {VOTES} GROUP BY key))"""


def _folded(spark, sf_dir):
    kind = F.col("event_type")
    votes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("vote"), F.when(F.col("value") < 20, "skipped").otherwise("judged").alias("status"),
        F.when(kind == "purchase", "PASS").when(kind == "click", "FAIL").otherwise("UNCERTAIN").alias("verdict"), F.col("value").alias("score"), kind.alias("reason"), F.lit("unavailable").alias("error"),
    )
    return summary.fold_votes(votes, 2)


@query(f"SELECT * FROM {FOLDED}")
def vote_fold(spark, sf_dir):
    return _folded(spark, sf_dir).select("key", "verdict", "score", "agreement")


@query(f"""SELECT completed, passed, failed, uncertain, skipped, completed - skipped AS judged, round(passed / nullif(completed - skipped, 0), 4) AS pass_rate, CASE WHEN completed = skipped THEN 'UNAVAILABLE' WHEN skipped = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM (
    SELECT count(*) AS completed, count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'FAIL') AS failed, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (verdict = 'SKIP') AS skipped FROM {FOLDED})""")
def judge_report(spark, sf_dir):
    return summary.judge_report(_folded(spark, sf_dir)).drop("requested")


@query(f"SELECT key, verdict, score FROM {FOLDED} WHERE verdict <> 'SKIP' ORDER BY CASE verdict WHEN 'FAIL' THEN 0 WHEN 'UNCERTAIN' THEN 1 ELSE 2 END, coalesce(score, 50), key LIMIT 5")
def worst_five(spark, sf_dir):
    return summary.worst(_folded(spark, sf_dir)).select("key", "verdict", "score")


@query("""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS position, value < 5 AS s FROM events), r AS (SELECT *, s AND lag(s, 1, false) OVER (ORDER BY position) AND lag(s, 2, false) OVER (ORDER BY position) AS three FROM e)
    SELECT event_id, position, coalesce(position > (SELECT min(position) FROM r WHERE three), false) AS circuit_open FROM r""")
def circuit_breaker(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return matching.circuit_breaker(rows, "event_id", F.col("value") < 5).select("event_id", "position", "circuit_open")


@query("SELECT event_id, user_id FROM (SELECT *, coalesce(sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM events) WHERE f < 3")
def failure_budget(spark, sf_dir):
    return matching.failure_budget(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") < 20, 3).select("event_id", "user_id")


@query("SELECT user_id, arg_min(event_type, event_id) FILTER (value >= 50) AS event_type, min(event_id) FILTER (value >= 50) AS event_id FROM events GROUP BY user_id")
def first_success(spark, sf_dir):
    return matching.first_success(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", F.col("value") >= 50)


@query("SELECT event_id, CASE WHEN length(t) = 0 THEN 'بدون عنوان' WHEN length(t) > 32 THEN substring(t, 1, 32) || '…' ELSE t END AS title FROM (SELECT event_id, trim(regexp_replace(event_type || '  ' || props, '\\s+', ' ', 'g')) AS t FROM events ORDER BY event_id DESC LIMIT 40)")
def history_top40(spark, sf_dir):
    rows = matching.newest(table(spark, sf_dir, "events"), "event_id")
    return rows.select("event_id", t.title(F.concat("event_type", F.lit("  "), "props")).alias("title"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'idiot') OR contains(source, 'idiot')")
def history_search(spark, sf_dir):
    return matching.search(table(spark, sf_dir, "documents"), ["text", "source"], "idiot").select("doc_id")


def persian(spark, sf_dir):
    """Sentences by template from each order: Arabic-layout letters, mixed digits, unjoined prefixes, Latin marks."""
    n = F.col("o_orderkey").cast("string")
    arabic = F.translate(n, chars.ASCII_DIGITS, chars.ARABIC_DIGITS)
    text = F.concat(F.lit("من كتاب "), n, F.lit(" را می خواهم,  و شماره "), arabic, F.lit(" يك است...  این قلم ها خوب است ؟ نمي رود"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", text.alias("text"))


PERSIAN = f"(SELECT o_orderkey, 'من كتاب ' || o_orderkey || ' را می خواهم,  و شماره ' || translate(o_orderkey::VARCHAR, '0123456789', '{chars.ARABIC_DIGITS}') || ' يك است...  این قلم ها خوب است ؟ نمي رود' AS text FROM orders)"
FOLD = f"translate(text, 'أإيكة{chars.ARABIC_DIGITS}', 'اایکه{chars.PERSIAN_DIGITS}')"


@query(f"SELECT o_orderkey, {FOLD} AS folded, translate({FOLD}, '{chars.PERSIAN_DIGITS}', '0123456789') AS ascii FROM {PERSIAN}")
def char_fold(spark, sf_dir):
    folded = t.fold_chars(F.col("text"))
    return persian(spark, sf_dir).select("o_orderkey", folded.alias("folded"), t.ascii_digits(folded).alias("ascii"))


@query(f"SELECT o_orderkey, 'من کتاب ' || o_orderkey || ' را می' || chr(8204) || 'خواهم، و شماره ' || translate(o_orderkey::VARCHAR, '0123456789', '{chars.PERSIAN_DIGITS}') || ' یک است… این قلم' || chr(8204) || 'ها خوب است؟ نمی' || chr(8204) || 'رود' AS text FROM orders")
def punctuation_and_spacing(spark, sf_dir):
    text = t.fix_spacing(t.fix_punctuation(t.join_half_spaces(t.fold_chars(F.col("text")))))
    return persian(spark, sf_dir).select("o_orderkey", text.alias("text"))


@query(f"SELECT o_orderkey, 'من کتاب ' || o_orderkey || ' را می' || chr(8204) || 'خواهم، و شماره ' || translate(o_orderkey::VARCHAR, '0123456789', '{chars.PERSIAN_DIGITS}') || ' یک است… این قلم' || chr(8204) || 'ها خوب است؟ نمی' || chr(8204) || 'رود.' AS output, 3::BIGINT AS n_notes FROM orders")
def offline_edit(spark, sf_dir):
    rows = edits.edit_table(persian(spark, sf_dir).withColumn("mode", F.lit("tashih")), modes=["tashih"])
    return rows.select("o_orderkey", F.col("edited.output").alias("output"), F.size("edited.notes").cast("long").alias("n_notes"))


WORDS = r"string_split_regex({}, '\s+')"


@query(f"SELECT conv_id, turn, len(list_filter(list_zip(a, b), lambda z: z[1] IS DISTINCT FROM z[2]))::BIGINT AS changed FROM (SELECT conv_id, turn, {WORDS.format('input')} AS a, {WORDS.format('output')} AS b FROM {PAIRS})")
def word_diff(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", t.word_changes(F.col("input"), F.col("output")).cast("long").alias("changed"))


@query("SELECT conv_id AS session, string_agg(trim(text), ' ' ORDER BY turn) AS text FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations) GROUP BY conv_id")
def dictation_merge(spark, sf_dir):
    events = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("result_index"), F.lit(True).alias("is_final"), F.col("text").alias("transcript"))
    return deltas.merged_dictation(events)


@query("SELECT conv_id::VARCHAR AS request_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations c WHERE turn <= coalesce((SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND role = 'assistant'), 1000000) GROUP BY conv_id")
def delta_collect(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("seq"), "text", (F.col("role") == "assistant").alias("done"), F.lit(None).cast("string").alias("error"))
    return deltas.collected(rows).select("request_id", "text")


@query("SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY page_id) AS n FROM pages) WHERE n <= 8")
def limit_per_feed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/]+)", 1))
    return selection.limit_per_group(pages, "host", ["page_id"], 8).select("page_id")


@query("SELECT doc_id, 'codexv3' || lpad(n, greatest(3, length(n))::INTEGER, '0') || '|' || lang AS expected_key FROM (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id))::VARCHAR AS n FROM documents)")
def expected_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return selection.expected_keys(rows, "lang", "doc_id", "codexv3").select("doc_id", "expected_key")


@query("SELECT lang || '|' || d.doc_id || CASE WHEN i = 1 THEN '' ELSE '-v' || (i - 1) END AS key FROM documents d JOIN labels l ON d.doc_id = l.doc_id, LATERAL (SELECT unnest(range(1, 3 + quality)) AS i)")
def boost_copies(spark, sf_dir):
    rows = records(spark, sf_dir).select("doc_id", "key").join(table(spark, sf_dir, "labels"), "doc_id")
    return selection.boost(rows, "key", F.col("quality") + 2).select("key")


@query(f"SELECT p_partkey, t::INTEGER AS template, replace(replace(x, '{{a}}', translate(p_size::VARCHAR, '0123456789', '{chars.PERSIAN_DIGITS}')), '{{b}}', translate(p_partkey::VARCHAR, '0123456789', '{chars.PERSIAN_DIGITS}')) AS input FROM part CROSS JOIN (VALUES (0, 'از {{a}} تا {{b}}'), (1, 'کد {{b}} با اندازه {{a}}')) v(t, x)")
def number_lessons(spark, sf_dir):
    from quernstone.plans import lessons

    templates = [("از {a} تا {b}", "از {a} تا {b}."), ("کد {b} با اندازه {a}", "کد {b}، اندازه {a}.")]
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return lessons.number_lessons(rows, "p_size", "p_partkey", templates).select("p_partkey", "template", "input")


@query("SELECT user_id AS key, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS categories FROM events GROUP BY user_id")
def categories_by_key(spark, sf_dir):
    flags = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("category"))
    return summary.categories_by_key(flags).select("key", F.array_join("categories", ",").alias("categories"))


@query("SELECT mode, coalesce(n, 0) AS n, expected::BIGINT AS expected FROM (VALUES ('en', 100), ('fr', 100), ('de', 100), ('xx', 0), ('yy', 5)) e(mode, expected) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d ON d.lang = e.mode WHERE coalesce(n, 0) <> expected")
def expected_counts(spark, sf_dir):
    expected = spark.createDataFrame([("en", 100), ("fr", 100), ("de", 100), ("xx", 0), ("yy", 5)], "mode string, expected long")
    return summary.expectation_flags(summary.count_by(records(spark, sf_dir), "mode"), expected)


@query("SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS accepted FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def source_acceptance(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("accepted"))


@query("SELECT least(99, floor(sum(l_discount) / sum(greatest(l_tax, l_discount)) * 100))::BIGINT AS percent FROM lineitem")
def load_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("loaded"), F.col("l_tax").alias("total"))
    return summary.progress(rows).select(F.col("percent").cast("long").alias("percent"))


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN 'method' WHEN user_id % 10 = 3 THEN 'origin' WHEN NOT contains(coalesce(props, ''), '{') THEN 'content-type' WHEN length(trim(coalesce(event_type, ''))) = 0 THEN 'empty' ELSE '' END AS reason FROM events")
def request_admission(spark, sf_dir):
    method = F.when(F.col("event_type") == "click", "POST").otherwise("GET")
    kind = F.when(F.contains(F.coalesce("props", F.lit("")), F.lit("{")), "application/json").otherwise("text/plain")
    origin = F.when(F.col("user_id") % 10 == 3, "https://elsewhere.example")
    return table(spark, sf_dir, "events").select("event_id", g.admission(method, kind, F.col("event_type"), origin, ["https://here.example"]).alias("reason"))


@query(f"SELECT conv_id, turn, list_distinct({_tokens_sql('output')}) = [] AS empty, len(list_filter({WORDS.format('output')}, lambda w: NOT list_contains(list_transform({WORDS.format('input')}, lambda x: regexp_replace(x, '[.,!؟،؛]', '', 'g')), regexp_replace(w, '[.,!؟،؛]', '', 'g'))))::BIGINT AS n_new FROM {PAIRS}")
def new_word_marks(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    marked = t.new_words(F.col("input"), F.col("output"))
    return rows.select("conv_id", "turn", (F.size(q.tokens(F.col("output"), PLAIN)) == 0).alias("empty"), F.size(F.filter(marked, lambda w: w["is_new"])).cast("long").alias("n_new"))


#: Pairs of our own (mode, input, output), each to trip some rule or none; {n} is a number in Persian digits.
PAIR_CASES = [
    ("rasmi", "سلام رفیق. شماره {n} رو بفرست.", "احتراماً درخواست می‌شود شماره {n} ارسال گردد."),
    ("rasmi", "نمیتونم بیام. کد {n} رو لغو کن.", "اگه ممکن است کد {n} را بررسی کنید."),
    ("edari", "این کار انجام نشد و نامه {n} گم شد.", "نامه شماره {n} پیدا شد و کار پایان یافت."),
    ("edari", "نامه {n} را بفرستید.", "خونه را ببینید."),
    ("khodmani", "لطفاً گزارش {n} را بررسی کنید.", "یه نگاه به گزارش {n} بنداز، دیگه."),
    ("khodmani", "متن {n}", "متن {n}"),
    ("adabi", "شب آرام بود.", "شب آرام بود و سایه روی دیوار نشست. از نو بساز."),
    ("adabi", "این متن بلند است و هیچ کس آن را نخواند و شماره {n} هم در آن نیست.", "کوتاه."),
    ("lati", "این چند جمله رو درست کن. همون قبلی بهتر بود.", "داداش جمعش کن. همون بهتر بود."),
    ("lati", "من نمی‌تونم مسئولیت این کار را قبول کنم.", "رفیق این کار با من نیست hello."),
    ("tashih", "می‌خوام اول بیام بعد برم؛ اگر شد.", "می‌خواهم اول بیایم بعد بروم؛ اگر شد."),
    ("tashih", "version {n} آمد.", "نسخه {n} آمد [نام کارفرما]."),
    ("tashih", "سلام", "متن خود را ارسال کنید. لطفاً متن خود را بفرستید."),
    ("tashih", "خوب", "**خوب**\n- یک\n- دو"),
]
VOICES = {"rasmi": "لطفاً|درخواست|ارسال", "edari": "نامه|بررسی|اقدام", "khodmani": "یه|دیگه", "adabi": "سایه|شب", "lati": "داداش|رفیق", "tashih": "."}


def persian_pairs(spark, sf_dir):
    """(o_orderkey, mode, input, output): a pair of the list for each order, with its number."""
    cases = spark.createDataFrame([(i, *c) for i, c in enumerate(PAIR_CASES)], "case int, mode string, before string, after string")
    fill = lambda c: F.replace(c, F.lit("{n}"), t.persian_digits(F.col("o_orderkey").cast("string")))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey")).withColumn("case", (F.col("o_orderkey") % len(PAIR_CASES)).cast("int")).join(F.broadcast(cases), "case")
    return rows.select("o_orderkey", "mode", fill(F.col("before")).alias("input"), fill(F.col("after")).alias("output"))


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_filled = lambda c: f"replace({c}, '{{n}}', translate(o_orderkey::VARCHAR, '0123456789', '{chars.PERSIAN_DIGITS}'))"
PERSIAN_PAIRS = f"(SELECT o_orderkey, mode, {_filled('a')} AS input, {_filled('b')} AS output FROM orders JOIN (VALUES " + ", ".join(f"({i}, {_quoted(m)}, {_quoted(a)}, {_quoted(b)})" for i, (m, a, b) in enumerate(PAIR_CASES)) + f") c(i, mode, a, b) ON i = o_orderkey % {len(PAIR_CASES)})"
VOICED = "CASE mode " + " ".join(f"WHEN '{m}' THEN regexp_matches(output, '{p}')" for m, p in VOICES.items()) + " END"
LATIN_DIGITS = f"translate({{}}, '{chars.PERSIAN_DIGITS}', '0123456789')"
KEPT = f"len(list_filter(regexp_extract_all({LATIN_DIGITS.format('input')}, '[0-9]+(?:[.,][0-9]+)?'), lambda n: NOT contains({LATIN_DIGITS.format('output')}, n))) = 0"
UNCLEAN = "[A-Za-z\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{0E00}-\\x{0E7F}\\x{0900}-\\x{097F}\\x{0400}-\\x{04FF}]"
CLEAN = f"(NOT regexp_matches(input, '{UNCLEAN}') AND NOT regexp_matches(output, '{UNCLEAN}'))"


def _voiced():
    chain = F.lit(None).cast("boolean")
    for m, p in VOICES.items():
        chain = F.when(F.col("mode") == m, F.col("output").rlike(p)).otherwise(chain)
    return chain


@query(f"SELECT o_orderkey, {CLEAN} AS clean, {CLEAN} AND {VOICED} AND {KEPT} AS positive, mode IN ('rasmi', 'edari') AND NOT {VOICED} AS again FROM {PERSIAN_PAIRS}")
def voice_filters(spark, sf_dir):
    before, output = F.col("input"), F.col("output")
    return persian_pairs(spark, sf_dir).select("o_orderkey", g.clean_pair(before, output).alias("clean"), g.voice_positive(before, output, _voiced()).alias("positive"), g.needs_regeneration(F.col("mode"), _voiced(), ["rasmi", "edari"]).alias("again"))


NORMAL = "trim(regexp_replace(regexp_replace(translate({}, 'يىكۀ', 'ییکه'), '[\\x{{200C}}\\x{{200D}}]', '', 'g'), '[^\\p{{Arabic}}\\p{{N}}،؛؟ـ\\x{{064B}}-\\x{{0655}}\\x{{0670}}]+', ' ', 'g'))"
COLLOQUIAL = "regexp_matches(output, 'می‌خوام|نمی‌خوام|می‌تون|نمی‌تون|اگه|واسه|(^|\\s)یه\\s|خونه|بگید|کنسل|اوکی|(^|\\s)رو(\\s|$)')"
FIRST_ECHO = "regexp_matches(output, 'از نو بساز|بازسازی کن|توضیح نده|فقط متن (بازنویسی|ویرایش|اصلاح)[‌\\- ]?شده|متن را به زبان .* بازنویسی کن|یک ویراستار حرفه‌ای باش|متن (اصلی|موردنظر|ارسالی) را .* (بفرست|ارسال)|برای (ویرایش|بازنویسی) به من|\\[[^\\]\\n]{2,}\\]|【[^】\\n]{2,}】')"


@query(f"""SELECT o_orderkey, mode IN ('rasmi', 'daneshgahi', 'edari') AND {COLLOQUIAL} AS colloquial, {FIRST_ECHO} OR contains(output, substring(input, 1, 24)) AS echo,
    regexp_matches({NORMAL.format('input')}, {_quoted(q.NEGATION)}) AND NOT regexp_matches({NORMAL.format('output')}, {_quoted(q.NEGATION)}) AS negation_lost,
    CASE WHEN length(output) < length(input) * 0.45::DOUBLE THEN 'short' WHEN length(output) > length(input) * 2.4::DOUBLE THEN 'long' ELSE '' END AS coverage FROM {PERSIAN_PAIRS}""")
def audit_rules(spark, sf_dir):
    before, output = F.col("input"), F.col("output")
    return persian_pairs(spark, sf_dir).select(
        "o_orderkey", q.colloquial_in_formal(F.col("mode"), output).alias("colloquial"), g.echoes(output, "v1", before).alias("echo"), q.negation_lost(before, output).alias("negation_lost"), q.coverage(before, output).alias("coverage")
    )


COUNTED = r"len(list_filter(list_transform(string_split_regex(regexp_replace({}, '([.!؟])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 0))"


@query(f"SELECT o_orderkey, CASE WHEN {COUNTED.format('input')} NOT BETWEEN 3 AND 8 THEN 'long-input' ELSE '' END || CASE WHEN {COUNTED.format('output')} < 3 THEN ',coverage' ELSE '' END AS flags FROM {PERSIAN_PAIRS}")
def sentence_bounds(spark, sf_dir):
    found = q.sentence_bounds(F.col("input"), F.col("output"))
    text = F.concat(F.when(F.array_contains(found, "long-input"), "long-input").otherwise(""), F.when(F.array_contains(found, "coverage"), ",coverage").otherwise(""))
    return persian_pairs(spark, sf_dir).select("o_orderkey", text.alias("flags"))


@query(f"SELECT mode, k AS trap, count(*) FILTER (regexp_matches(input, p)) AS n, count(*) FILTER (regexp_matches(input, p)) < 20 AS too_few FROM {PERSIAN_PAIRS} CROSS JOIN (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(p)})" for k, p in q.TRAPS.items()) + ") r(k, p) GROUP BY mode, k")
def trap_coverage(spark, sf_dir):
    return q.trap_counts(persian_pairs(spark, sf_dir), "mode", F.col("input"))


@query(f"""SELECT 'unique_mode' AS name, count(DISTINCT mode) AS n FROM {PERSIAN_PAIRS} UNION ALL SELECT 'unique_input', count(DISTINCT input) FROM {PERSIAN_PAIRS} UNION ALL SELECT 'unique_output', count(DISTINCT output) FROM {PERSIAN_PAIRS}
    UNION ALL SELECT 'unique_sentences', count(*) FROM (SELECT DISTINCT unnest({SENTENCES}) FROM documents) UNION ALL SELECT 'max_sentences', max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest({SENTENCES}) AS s FROM documents) GROUP BY s)""")
def distinct_counts(spark, sf_dir):
    said = summary.distinct_counts(records(spark, sf_dir), [], {"sentences": q.sentences(F.col("text"))})
    return summary.distinct_counts(persian_pairs(spark, sf_dir), ["mode", "input", "output"]).unionByName(said)


#: An order-dependent cleanup of a seed, then its length's bounds.
SEED = "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\s*\\n\\s*', ' ', 'g'), '[«\"“'']+|[»\"”'']+$', '', 'g'), '\\s{{2,}}', ' ', 'g'))"


@query(f"SELECT conv_id, turn, length({SEED.format('text')}) BETWEEN 8 AND 400 AS fits FROM conversations")
def seed_bounds(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", g.seed_fits(F.col("text")).alias("fits"))


@query(f"SELECT conv_id, turn, '<start_of_turn>user' || chr(10) || 'Rewrite.' || chr(10) || chr(10) || input || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS prompt FROM {PAIRS}")
def prompt_fold(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", g.fold_prompt(F.lit("Rewrite."), F.col("input")).alias("prompt"))


@query(f"SELECT conv_id || '/' || turn AS key, CASE WHEN conv_id % 3 = 0 THEN 'rasmi' ELSE 'unknown' END AS mode, input, input AS reference, CASE WHEN turn % 4 = 0 THEN output ELSE 'other' END AS candidate FROM {PAIRS} WHERE length(input) > 0 AND length(output) > 0")
def field_fallback(spark, sf_dir):
    rows = pairs(spark, sf_dir).filter("length(input) > 0 AND length(output) > 0").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    left = rows.select("key", F.when(F.col("conv_id") % 3 == 0, "rasmi").alias("mode"), "input", F.col("input").alias("output"))
    right = rows.select("key", F.lit(None).cast("string").alias("input"), F.when(F.col("turn") % 4 == 0, F.col("output")).alias("candidate"), F.lit("other").alias("output"))
    return matching.with_fallbacks(left, right)


@query(f"SELECT r.doc_id, CASE WHEN r.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'test' WHEN r.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'valid' ELSE 'train' END AS split FROM {RECORDS} r")
def holdout_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("id", F.col("doc_id").cast("string"))
    return selection.holdout(records(spark, sf_dir).select("doc_id", "key"), "key", labels.filter("toxic = 1"), labels.filter("quality = 0")).select("doc_id", "split")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE user_id % 5 = 0)")
def delete_entries(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return matching.without_ids(events, events.filter("user_id % 5 = 0"), "event_id").select("event_id")


@query("SELECT doc_id, category FROM documents JOIN (VALUES ('germanic', 'en'), ('germanic', 'de'), ('romance', 'fr'), ('romance', 'es'), ('read', 'en')) c(category, mode) ON mode = lang")
def modes_by_category(spark, sf_dir):
    categories = spark.createDataFrame([("germanic", "en"), ("germanic", "de"), ("romance", "fr"), ("romance", "es"), ("read", "en")], "category string, mode string")
    return matching.in_categories(records(spark, sf_dir), categories).select("doc_id", "category")


@query(f"""SELECT o_orderkey, CASE WHEN NOT regexp_matches(output, '\\p{{Arabic}}') THEN 'no Persian output' WHEN regexp_matches(output, '[^\\P{{L}}\\p{{Arabic}}]') THEN 'foreign-script letter' WHEN regexp_matches(output, '[0-9]') THEN 'ASCII digit'
    WHEN regexp_matches(output, 'از نو بساز|بازسازی کن|توضیح نده|یک ویراستار حرفه‌ای باش|متن را به زبان .* بازنویسی کن') THEN 'prompt echo' WHEN regexp_matches(output, '\\[[^\\]\\n]{{2,}}\\]|【[^】\\n]{{2,}}】') THEN 'placeholder'
    WHEN length(output) > greatest(600, 6 * length(input)) THEN 'extreme expansion' ELSE '' END AS reason FROM {PERSIAN_PAIRS}""")
def poison_v3(spark, sf_dir):
    """None of the pairs repeats a fragment; repeated_fragments covers that rule."""
    return persian_pairs(spark, sf_dir).select("o_orderkey", g.poison_reason(F.col("output"), F.col("input"), version="v3").alias("reason"))


@query(f"""SELECT p.conv_id, p.turn, coalesce(e.text, output) AS output, 'user: Rewrite.' || chr(10) || chr(10) || input || chr(10) || 'assistant: ' || coalesce(e.text, output) AS messages, e.text IS NOT NULL AS updated FROM {PAIRS} p
    LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS text FROM events WHERE event_type <> 'view' GROUP BY user_id) e ON e.user_id = p.conv_id""")
def update_messages(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumns({"key": F.col("conv_id"), "messages": corpus.messages(F.lit("Rewrite."), F.col("input"), F.col("output"))})
    status = F.when(F.col("event_type") == "view", "failed").otherwise("ok").alias("status")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.col("event_type").alias("output"), status)
    new = matching.update_outputs(rows, log, "event_id")
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return new.select("conv_id", "turn", "output", said.alias("messages"), "updated")


DODGED = "regexp_matches(output, 'متن (اصلی|کامل|مورد نظر|خود) را (برای من |جهت )?(ارسال|بفرستید)|برای (ویرایش|بازنویسی) به من ارسال|متنی برای (ویرایش|بازنویسی) ارائه نشده|لطفاً متن (خود|مورد نظر) را|\\[(نام|عنوان|موضوع|تاریخ|نام کارفرما|محل امضا|نام استاد)[^\\]\\n]*\\]|【[^】\\n]{2,}】')"


@query(f"""SELECT o_orderkey, list_filter([CASE WHEN regexp_matches(input, '[\\x{{0600}}-\\x{{06FF}}\\x{{200C}}]') AND NOT regexp_matches(output, '[\\x{{0600}}-\\x{{06FF}}\\x{{200C}}]') THEN 'no-persian' END,
    CASE WHEN NOT regexp_matches(input, '[a-zA-Z]') AND length(regexp_replace(output, '[^a-zA-Z]', '', 'g')) > 25 THEN 'foreign-letter' END, CASE WHEN NOT {KEPT} THEN 'numbers' END, CASE WHEN mode <> 'tashih' AND trim(output) = trim(input) THEN 'unchanged' END,
    CASE WHEN {DODGED} THEN 'broken-pattern' END], lambda x: x IS NOT NULL)::VARCHAR AS reasons, regexp_matches(output, '(?m)\\*\\*|^#{{1,6}}\\s|\\n\\s*[-*]\\s+') AS markdown FROM {PERSIAN_PAIRS}""")
def broken_outputs(spark, sf_dir):
    reasons = g.broken_reasons(F.col("output"), F.col("input"), F.col("mode") == "tashih")
    named = F.transform(reasons, lambda r: F.substring_index(r, ":", 1))
    return persian_pairs(spark, sf_dir).select("o_orderkey", F.concat(F.lit("["), F.array_join(named, ", "), F.lit("]")).alias("reasons"), g.has_markdown(F.col("output")).alias("markdown"))


@query(f"SELECT o_orderkey, least(8192, greatest(2048, len(string_split_regex(trim(input), '\\s+')) * 8 + 512))::INTEGER AS online, least(4096, greatest(256, len(string_split_regex(trim(input), '\\s+')) * 4 + 120))::INTEGER AS hosted, least(420, greatest(240, len(string_split_regex(trim(input), '\\s+')) * 3 + 60))::INTEGER AS browser FROM {PERSIAN_PAIRS}")
def token_budgets(spark, sf_dir):
    return persian_pairs(spark, sf_dir).select("o_orderkey", *(g.token_budget(F.col("input"), k).alias(k) for k in ("online", "hosted", "browser")))


#: Words of several registers' lexicons, some whose replacement is replaced again, between words that stay.
SENTENCE = "امروز آخه یه خونه واسه دوست خوب شما دیدم و شب ماه جالب بود چون برای اینکه بیا گفت اگه دل ما خیلی ممنون است نظر داد کمک خواست دادگاه رفت و نوشتم یک خانه شماره {n} رسید."


def _replaced(register: str, text: str) -> str:
    """The lexicon's words between single spaces, longest key first."""
    for k, v in sorted(lexicon.REGISTERS[register], key=lambda e: -len(e[0])):
        text = f"replace({text}, ' {k} ', ' {v} ')"
    return f"trim({text})"


SAID = f"' ' || replace({_quoted(SENTENCE)}, '{{n}}', translate(o_orderkey::VARCHAR, '0123456789', '{chars.PERSIAN_DIGITS}')) || ' '"


@query("SELECT o_orderkey, CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN {_replaced(register, SAID)}" for i, (_, register, _, _) in enumerate(modes.MODES)) + " END AS output FROM orders")
def offline_edit_registers(spark, sf_dir):
    names = F.array(*(F.lit(m) for m, *_ in modes.MODES))
    text = F.replace(F.lit(SENTENCE), F.lit("{n}"), t.persian_digits(F.col("o_orderkey").cast("string")))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", text.alias("text"), F.get(names, (F.col("o_orderkey") % 13).cast("int")).alias("mode"))
    return edits.edit_table(rows).select("o_orderkey", F.col("edited.output").alias("output"))


@query("SELECT o_orderkey, " + _replaced("formal", SAID) + " AS output FROM orders")
def lexicon_table(spark, sf_dir):
    """A lexicon that comes from a table (register, pos, k, v)."""
    entries = [("formal", i, k, v) for i, (k, v) in enumerate(lexicon.REGISTERS["formal"])]
    own = lexicon.from_table(spark.createDataFrame(entries, "register string, pos int, k string, v string"))
    text = F.replace(F.lit(SENTENCE), F.lit("{n}"), t.persian_digits(F.col("o_orderkey").cast("string")))
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", t.replace_words(text, own["formal"]).alias("output"))


@query(f"SELECT conv_id, turn, array_to_string(list_concat(list_concat(w[1:len(w) // 2], ['MARK']), w[len(w) // 2 + 1:]), ' ') AS mixed FROM (SELECT conv_id, turn, string_split(input, ' ') AS w FROM {PAIRS})")
def token_injection(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", g.inject(F.col("input"), F.lit("MARK"), 0.5).alias("mixed"))


@query("SELECT p_partkey, times::INTEGER AS times, array_to_string(list_transform(range(times), lambda i: p_brand), ' ') AS input FROM part CROSS JOIN (VALUES (1), (2), (3)) v(times)")
def repetition_lessons(spark, sf_dir):
    from quernstone.plans import lessons

    return lessons.repetition_lessons(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 3).select("p_partkey", "times", "input")


@query("SELECT page_id, position FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS position FROM pages) WHERE position BETWEEN 21 AND 60")
def start_limit_window(spark, sf_dir):
    return selection.window_of(table(spark, sf_dir, "pages").select("page_id"), "page_id", 20, 40).select("page_id", "position")


@query("SELECT source, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_value_per_group(spark, sf_dir):
    return matching.first_value_by(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id")


@query(f"SELECT o_orderkey, length(regexp_replace(text, '[^ ]*[\\x{{0600}}-\\x{{06FF}}][^ ]*', chr(1), 'g')) - length(replace(regexp_replace(text, '[^ ]*[\\x{{0600}}-\\x{{06FF}}][^ ]*', chr(1), 'g'), chr(1), '')) AS words FROM (SELECT o_orderkey, output AS text FROM {PERSIAN_PAIRS})")
def persian_word_count(spark, sf_dir):
    return persian_pairs(spark, sf_dir).select("o_orderkey", t.count_persian_words(F.col("output")).cast("long").alias("words"))


@query(f"SELECT o_orderkey, {NORMAL.format('input')} AS normal FROM {PERSIAN_PAIRS}")
def audit_normal(spark, sf_dir):
    return persian_pairs(spark, sf_dir).select("o_orderkey", q.audit_normal(F.col("input")).alias("normal"))


def _folded_stem(x: str) -> str:
    """The first audit's stem of a token as SQL."""
    cases = " ".join(f"WHEN {x}.ends_with('{s}') AND length({x}) > {len(s) + 3} THEN {x}[:length({x}) - {len(s)}]" for s in q.STEM_SUFFIXES)
    return f"CASE {cases} ELSE {x} END"


_stops = "[" + ", ".join(_quoted(w) for w in q.STOP_FIRST) + "]"
FIRST_TOKENS = "list_sort(list_distinct(list_filter(list_transform(list_transform(list_filter(string_split(" + NORMAL + ", ' '), lambda x: length(x) >= 3 AND NOT list_contains(" + _stops + ", x)), lambda x: regexp_replace(x, '^(ن?می)', '')), lambda y: " + _folded_stem("y") + "), lambda z: length(z) >= 3)))"


@query(f"SELECT o_orderkey, array_to_string({FIRST_TOKENS.format('output')}, ' ') AS tokens FROM {PERSIAN_PAIRS}")
def first_audit_tokens(spark, sf_dir):
    return persian_pairs(spark, sf_dir).select("o_orderkey", F.array_join(F.array_sort(q.audit_tokens(F.col("output"))), " ").alias("tokens"))


FIRST_MATCHED = "len(list_filter(a, lambda x: len(list_filter(b, lambda y: y = x OR (length(x) >= 5 AND length(y) >= 5 AND (contains(x, y) OR contains(y, x))))) > 0))"


@query(f"SELECT o_orderkey, round(CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE {FIRST_MATCHED}::DOUBLE / len(a) END, 6) AS overlap FROM (SELECT o_orderkey, {FIRST_TOKENS.format('input')} AS a, {FIRST_TOKENS.format('output')} AS b FROM {PERSIAN_PAIRS})")
def first_audit_overlap(spark, sf_dir):
    found = q.with_audit_overlap(persian_pairs(spark, sf_dir), "input", "output")
    return found.select("o_orderkey", F.round("overlap", 6).alias("overlap"))


@query(f"SELECT o_orderkey, length(trim(input)) > 0 AND length(trim(output)) > 0 AND trim(input) <> trim(output) AND regexp_matches(input, '[\\x{{0600}}-\\x{{06FF}}]') AND regexp_matches(output, '[\\x{{0600}}-\\x{{06FF}}]') AND length(trim(input)) BETWEEN 10 AND 300 AS sound FROM {PERSIAN_PAIRS}")
def correction_pairs(spark, sf_dir):
    return persian_pairs(spark, sf_dir).select("o_orderkey", g.is_correction_pair(F.col("input"), F.col("output")).alias("sound"))


@query(f"""SELECT o_orderkey, CASE WHEN length(trim(output)) = 0 THEN 'empty' WHEN NOT regexp_matches(output, '[\\x{{0600}}-\\x{{06FF}}\\x{{200C}}]') THEN 'no-persian' WHEN regexp_matches(output, '[^\\P{{L}}\\p{{Arabic}}]') THEN 'foreign' WHEN NOT {VOICED} THEN 'no-marker'
    WHEN trim(output) = trim(input) THEN 'unchanged' WHEN NOT {KEPT} THEN 'lost-number' ELSE '' END AS reason FROM {PERSIAN_PAIRS}""")
def candidate_reasons(spark, sf_dir):
    return persian_pairs(spark, sf_dir).select("o_orderkey", g.candidate_reason(F.col("output"), F.col("input"), _voiced()).alias("reason"))


#: A judge's replies, from each event's type, value and properties.
REPLY_WORDS = ["PASS", "رد", "uncertain", "maybe", "درست", "نامشخص", "FAIL"]
REPLY_MEANS = "CASE event_id % 7 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'UNCERTAIN' WHEN 4 THEN 'PASS' WHEN 5 THEN 'UNCERTAIN' WHEN 6 THEN 'FAIL' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 11 <> 3 THEN {REPLY_MEANS} END AS verdict,
    CASE WHEN event_id % 11 = 3 OR event_id % 7 = 3 THEN NULL WHEN event_id % 5 = 0 THEN CASE {REPLY_MEANS} WHEN 'PASS' THEN 100.0 WHEN 'FAIL' THEN 0.0 ELSE 50.0 END ELSE greatest(0.0, least(100.0, value * 2 - 20)) END::DOUBLE AS score,
    CASE WHEN event_id % 11 = 3 OR event_id % 7 = 3 THEN NULL WHEN event_id % 3 = 0 THEN 'no reason given' ELSE event_type || ' "' || user_id || '"' END AS reason FROM events""")
def judge_replies(spark, sf_dir):
    e = F.col("event_id")
    word = F.get(F.array(*map(F.lit, REPLY_WORDS)), (e % 7).cast("int"))
    score = F.when(e % 5 != 0, (F.col("value") * 2 - 20).cast("string")).when(e % 2 == 0, "x")
    reason = F.when(e % 3 == 0, "  ").otherwise(F.concat("event_type", F.lit(' "'), F.col("user_id").cast("string"), F.lit('"')))
    said = F.to_json(F.struct(word.alias("verdict"), score.alias("score"), reason.alias("reason")))
    reply = F.when(e % 11 == 3, F.col("event_type")).when(e % 2 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(F.concat(F.lit("It says: "), said))
    rows = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return rows.select("event_id", g.parse_verdict(F.col("reply")).alias("v")).select("event_id", "v.verdict", "v.score", "v.reason")


#: Turns as raw model outputs: fenced, quoted, bold, as a heading with a list, as one of two options, or begun again.
PLAIN_TURN = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[«»\"“”''*#>`-]', ' ', 'g'), '\\s+', ' ', 'g'))"
RAW = f"""(SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN '```text' || chr(10) || x || chr(10) || '```' WHEN 1 THEN '«' || x || '»' WHEN 2 THEN '**' || x || '** and *' || x || '*' WHEN 3 THEN '## ' || x || chr(10) || '- ' || x || chr(10) || '> ' || x
    WHEN 4 THEN 'نسخه ۱: ' || x || chr(10) || 'نسخه ۲: other' WHEN 5 THEN x || ' ' || x ELSE x END AS raw FROM (SELECT conv_id, turn, {PLAIN_TURN} AS x FROM conversations))"""
_stripped = "trim(raw)"
for _pattern, _by in ((r"(?s)\A```[a-z]*\n(.*?)\n```\z", r"\1"), (r"\*\*(.*?)\*\*", r"\1"), (r"\*(.*?)\*", r"\1"), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*[-*]\s+", ""), (r"(?m)^\s*>\s?", "")):
    _stripped = f"regexp_replace({_stripped}, '{_pattern}', '{_by}', 'g')"
CLEANED = rf"""WITH a AS (SELECT conv_id, turn, trim({_stripped}) AS t FROM {RAW}),
    b AS (SELECT conv_id, turn, CASE WHEN t LIKE 'نسخه ۱: %' THEN trim(regexp_extract(t, '(?s)\Aنسخه ۱: (.+?)\n*(نسخه ۲|\z)', 1)) ELSE t END AS t FROM a),
    c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '\A[«"“''»\s]+', ''), '[«"”''»\s]+\z', '')) AS t FROM b),
    d AS (SELECT *, string_split_regex(t, '\s+') AS w FROM c),
    e AS (SELECT *, w[1] AS b0, coalesce(w[2], '') AS b1, coalesce(w[3], '') AS b2 FROM d),
    f AS (SELECT *, list_min(list_filter(range(3, len(w)), lambda i: instr(w[i + 1], b0) > 1 OR (instr(w[i + 1], b0) = 1 AND b1 <> '' AND coalesce(w[i + 2] = b1, false) AND (b2 = '' OR coalesce(w[i + 3] = b2, false))))) AS k FROM e),
    h AS (SELECT *, trim(array_to_string(list_concat(w[:k], CASE WHEN instr(w[k + 1], b0) > 1 THEN [substring(w[k + 1], 1, instr(w[k + 1], b0) - 1)] ELSE [] END), ' ')) AS cut FROM f)
    SELECT conv_id, turn, CASE WHEN len(w) >= 8 AND length(b0) > 0 AND k IS NOT NULL THEN CASE WHEN regexp_matches(cut, '[.!?؟،؛]\z') THEN cut ELSE cut || '.' END ELSE t END AS output FROM h"""


@query(CLEANED)
def cleaned_outputs(spark, sf_dir):
    x = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[«»\"“”'*#>`-]", " "), r"\s+", " "))
    rows = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", x.alias("x")))
    kind, c = (F.col("conv_id") + F.col("turn")) % 7, lambda *p: F.concat(*(F.col("x") if i is None else F.lit(i) for i in p))
    raw = F.when(kind == 0, c("```text\n", None, "\n```")).when(kind == 1, c("«", None, "»")).when(kind == 2, c("**", None, "** and *", None, "*")).when(kind == 3, c("## ", None, "\n- ", None, "\n> ", None))
    raw = raw.when(kind == 4, c("نسخه ۱: ", None, "\nنسخه ۲: other")).when(kind == 5, c(None, " ", None)).otherwise(F.col("x"))
    return rows.select("conv_id", "turn", g.clean_output(raw).alias("output"))


#: Versions of two to four parts from an event's numbers, some with a v, a letter in a part or nothing before a dot.
VERSION_A = "CASE WHEN event_id % 4 = 0 THEN 'v' ELSE '' END || (event_id % 3) || '.' || (user_id % 12) || CASE WHEN event_id % 5 = 0 THEN '' ELSE '.' || (event_id % 7) || CASE WHEN event_id % 9 = 0 THEN 'rc1' ELSE '' END END"
VERSION_B = "(user_id % 3) || '.' || (event_id % 12) || CASE WHEN user_id % 2 = 0 THEN '.x' ELSE '.' || (user_id % 7) || '.1' END"
_parts = lambda v: rf"list_resize(list_transform(string_split(regexp_replace({v}, '^[vV]', ''), '.'), lambda p: coalesce(try_cast(regexp_extract(p, '^(\d+)', 1) AS INTEGER), 0)), 4, 0)"


@query(f"SELECT event_id, {_parts(VERSION_A)} > {_parts(VERSION_B)} AS newer FROM events")
def newer_versions(spark, sf_dir):
    e, u, s = F.col("event_id"), F.col("user_id"), lambda c: c.cast("string")
    a = F.concat(F.when(e % 4 == 0, "v").otherwise(""), s(e % 3), F.lit("."), s(u % 12), F.when(e % 5 == 0, "").otherwise(F.concat(F.lit("."), s(e % 7), F.when(e % 9 == 0, "rc1").otherwise(""))))
    b = F.concat(s(u % 3), F.lit("."), s(e % 12), F.when(u % 2 == 0, ".x").otherwise(F.concat(F.lit("."), s(u % 7), F.lit(".1"))))
    return table(spark, sf_dir, "events").select("event_id", t.is_newer(a, b).alias("newer"))


@query(f"SELECT o_orderkey, 'با سلام؛ ' || CASE WHEN regexp_matches(output, '[.!؟…»\"'']$') THEN output ELSE output || '.' END || ' با احترام.' AS wrapped FROM {PERSIAN_PAIRS} WHERE output = trim(output)")
def opener_and_closer(spark, sf_dir):
    return persian_pairs(spark, sf_dir).filter(F.col("output") == F.trim("output")).select("o_orderkey", t.wrap(F.col("output"), "با سلام", "با احترام").alias("wrapped"))


_plain = "regexp_replace(s[i + 1], '^\\s+|\\s+$', '', 'g')"
PLAIN_AT = rf"list_filter(range(1, len(s)), lambda i: length({_plain}) > 0 AND NOT regexp_matches({_plain}, '^({t.CONNECTED})([^\x{{0600}}-\x{{06FF}}\x{{200C}}]|$)') AND NOT regexp_matches({_plain}, '[؟!…]$') AND len(string_split_regex({_plain}, '\s+')) >= 3)"


@query(rf"""WITH a AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!؟…]) +', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
    b AS (SELECT *, CASE WHEN len(s) > 2 THEN ({PLAIN_AT})[:least(2, len(s) - 2)] END AS chosen FROM a)
    SELECT doc_id, sha256(CASE WHEN len(s) < 3 THEN text ELSE array_to_string(list_transform(s, lambda x, i: CASE WHEN list_contains(chosen, i - 1) THEN ' ' || (['همچنین', 'سپس'])[list_position(chosen, i - 1)] || '، ' || regexp_replace(x, '^\s+|\s+$', '', 'g') ELSE x END), ' ') END) AS woven_sha256 FROM b""")
def woven_connectors(spark, sf_dir):
    """Connectors in every document: never in the first sentence, in none that opens with one, is short, asks or shouts, two at most."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.sha2(t.weave_connectors(F.col("text"), ["همچنین", "سپس"]), 256).alias("woven_sha256"))


@query("SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Rows written as JSON lines in order, as many parts as tasks, read back with the numbers of their lines over all parts."""
    from quernstone.sources import readers, writers

    placed = selection.with_positions(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    path = new_path(spark, "jsonl")
    writers.write_jsonl_parts(placed, path, "position", ["doc_id", "lang", "source"])
    return readers.read_jsonl_parts(spark, path, "doc_id long, lang string, source string").select("doc_id", "lang", "source", "line_no")


@query(f"SELECT conv_id || '/' || turn AS key, input AS reference, output AS candidate FROM {PAIRS}")
def checked_pair_join(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    joined = matching.pair_up(rows.select("key", "input"), rows.select("key", "input", "output"))
    return joined.select("key", F.col("input").alias("reference"), F.col("candidate_output").alias("candidate"))


@query("SELECT doc_id, coalesce(r, 'other') AS register FROM documents LEFT JOIN (VALUES ('en', 'plain'), ('fr', 'soft')) d(l, r) ON l = lang")
def dimension_default(spark, sf_dir):
    dimension = spark.createDataFrame([("en", "plain"), ("fr", "soft"), ("none", "other")], "mode string, register string")
    return matching.with_dimension(records(spark, sf_dir).select("doc_id", "mode"), dimension, "mode", "none").select("doc_id", "register")


_word = r"\p{L}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
_polished = "replace(translate(text, 'يك', 'یک'), 'ۀ', 'ه' || chr(8204) || 'ی')"
for _pattern, _by in ((rf"(^|[^{_word}])(می|نمی) ", "'\\1\\2' || chr(8204)"), (rf" (ها|های|تر|ترین)([^{_word}]|$)", "chr(8204) || '\\1\\2'"), (r" +([،؛:!؟.])", "'\\1'"), (r"([،؛:!؟])([^ \n])", "'\\1 \\2'")):
    _polished = f"regexp_replace({_polished}, '{_pattern}', {_by}, 'g')"


@query(f"SELECT o_orderkey, part, CASE WHEN regexp_matches(trim(p), '[^.!؟:]$') THEN trim(p) || '.' ELSE p END AS polished FROM (SELECT o_orderkey, part, {_polished} AS p FROM (SELECT o_orderkey, 'a' AS part, text FROM {PERSIAN} UNION ALL SELECT o_orderkey, 'b', input FROM {PERSIAN_PAIRS} UNION ALL SELECT o_orderkey, 'c', output || ' ، می ' || input || ' ها:خوب ' FROM {PERSIAN_PAIRS}))")
def keyboard_polish(spark, sf_dir):
    pairs_ = persian_pairs(spark, sf_dir)
    rows = persian(spark, sf_dir).select("o_orderkey", F.lit("a").alias("part"), "text").unionByName(pairs_.select("o_orderkey", F.lit("b").alias("part"), F.col("input").alias("text")))
    rows = rows.unionByName(pairs_.select("o_orderkey", F.lit("c").alias("part"), F.concat("output", F.lit(" ، می "), "input", F.lit(" ها:خوب ")).alias("text")))
    return rows.select("o_orderkey", "part", t.polish_quick(F.col("text")).alias("polished"))


from quernstone import queries_tables  # noqa: E402, F401  adds its queries
