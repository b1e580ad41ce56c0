"""Mixing sources to target weights: pivotal dependent rounding, with DataFrame operations only.

A source's target divided by its size says how many copies of its documents the mix takes on average: a whole number for
all, and a fraction that each document gets as a probability of one copy more. Rounding each for itself would miss the
target by chance; here the documents of a source are rounded against each other:

1. Two documents meet, and words move from one's fraction to the other's until one fraction is 0 or 1. Which way is drawn
   so that the expectation of both stays; the sum of words stays exactly. The other goes on to meet the next.
2. Blocks of ``BLOCK`` documents of a source do so in tasks, in one fold each, and leave one document with a fraction; the
   blocks' residuals meet in blocks again: a reduction tree of log(documents) rounds, each a shuffle of what is left.
3. The last residual of a source is drawn by its own probability. So the words taken miss the target by less than one
   document, however many there are.

Coins are digests of seed, round, source and place; places follow a digest of id and size, so reruns agree, on any number
of tasks, and rows that differ in nothing that counts here may change places without a difference in the result.

Targets: a source's weight times a level that is the same for all, but at most ``most`` times its size; the level rises
until the targets add up to the share of all sizes (a loop of aggregations over the sources; only sums come to the driver).

Defined results: a null text has size 0; null is a source of its own, the last; a source of size 0 has target 0; rows of
size 0 draw a coin of their own; ids may repeat or be null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.operators.selection import placed_within, with_positions

from .common import ship, stored, table

#: Documents that a fold takes, at most.
BLOCK = 64
#: Sources that are broadcast, at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def coin(*parts: Column) -> Column:
    """A number from 0 to under 1 that only the parts decide."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def with_targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """sources (.., size, weight) with target: weight times a common level, at most ``most`` times the size, adding up to share of all sizes."""
    sources = stored(sources, "mix-sources")
    cap = F.col("size") * most
    total, level, before = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], 0.0, -1
    while True:
        # Sources that the level lifts above their cap are held there; the rest share what is left, so the level only rises.
        above = F.col("weight") * F.lit(level) > cap
        held, n, weights = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.count_if(above), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == before or not weights:
            break
        level, before = (share * total - held) / weights, n
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) > cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def folded(level: DataFrame, round_no: int, seed: int) -> DataFrame:
    """(tree, n, done, left) for each block of rows (tree, n, id, size, p): those whose fraction became whole, and the one left."""
    item = F.struct("n", "id", "size", "p", coin(F.lit(seed), F.lit(round_no), F.col("tree"), F.col("n")).alias("u"))
    blocks = level.groupBy("tree", F.floor(F.col("n") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def meet(acc: Column, b: Column) -> Column:
        a = acc["left"]
        a_up, a_down, b_up, b_down = a["size"] * (1 - a["p"]), a["size"] * a["p"], b["size"] * (1 - b["p"]), b["size"] * b["p"]
        rise, fall = F.least(a_up, b_down), F.least(a_down, b_up)
        rises = b["u"] * (rise + fall) < fall
        a_ends = F.when(rises, a_up <= b_down).otherwise(a_down <= b_up)
        pick = lambda c: F.when(a_ends, b[c]).otherwise(a[c])
        moved = F.when(rises, rise).otherwise(fall) / pick("size")
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(rises == a_ends, pick("p") - moved).otherwise(pick("p") + moved)))
        ended = F.struct(F.when(a_ends, a["id"]).otherwise(b["id"]).alias("id"), F.when(a_ends, a["size"]).otherwise(b["size"]).alias("size"), (rises == a_ends).alias("up"))
        return F.struct(F.struct(pick("id").alias("id"), pick("size").alias("size"), p.alias("p")).alias("left"), F.concat(acc["done"], F.array(ended)).alias("done"))

    first = F.col("items")[0]
    start = F.struct(F.struct(first["id"].alias("id"), first["size"].alias("size"), first["p"].alias("p")).alias("left"), F.array().cast("array<struct<id: bigint, size: bigint, up: boolean>>").alias("done"))
    return blocks.select("tree", F.col("block").alias("n"), F.aggregate(F.slice("items", F.lit(2), F.size("items")), start, meet).alias("r")).select("tree", "n", "r.done", "r.left")


def pivotal(rows: DataFrame, most_rows: int, seed: int) -> DataFrame:
    """(tree, id, size, up) for rows (tree, n from 0 gapless in the tree, id, size > 0, p): p rounded so that each tree's sum of size * p stays, up to one row."""
    out, level, round_no = None, rows.select("tree", "n", "id", "size", "p"), 0
    while round_no == 0 or most_rows > 1:
        met = stored(folded(level, round_no, seed), "mix-level")
        done = met.select("tree", F.explode("done").alias("d")).select("tree", "d.id", "d.size", "d.up")
        out = done if out is None else out.unionByName(done)
        level, round_no, most_rows = met.select("tree", "n", "left.id", "left.size", "left.p"), round_no + 1, -(-most_rows // BLOCK)
    last = level.select("tree", "id", "size", (coin(F.lit(seed), F.lit("last"), F.col("tree")) < F.col("p")).alias("up"))
    return out.unionByName(last)


def mix(docs: DataFrame, weights: list[int] = (5, 2, 1), share: float = 1.5, most: int = 2, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11) -> DataFrame:
    """(id, size, source_size, target, copies) for each row: how often the mix takes it. Weights repeat over the sources in order of their code points."""
    spark = docs.sparkSession
    ship(spark)
    words = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) if size is None else size
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(words.cast("long"), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.count_if(F.col("size") > 0).alias("full"))
    ordered = with_positions(sums.withColumn("o", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))), "o")
    sources = ordered.select("source", "size", "rows", "full", F.col("position").alias("tree"), F.get(F.array(*map(F.lit, weights)), ((F.col("position") - 1) % len(weights)).cast("int")).alias("weight"))
    sources = stored(with_targets(sources, share, most), "mix-targets")
    n, most_rows = sources.agg(F.count("*"), F.coalesce(F.max("full"), F.lit(0))).first()
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    by = sources.select(F.col("source").alias("_s"), F.col("size").alias("source_size"), "target", "tree").withColumns({"whole": F.floor(ratio), "p": ratio - F.floor(ratio)})
    side = F.broadcast(by) if n <= BROADCAST_SOURCES else by
    known = rows.join(side, F.col("source").eqNullSafe(F.col("_s"))).select("tree", "id", "size", "row", "p", F.conv(F.substring(F.md5(F.concat_ws("|", "id", "size")), 1, 15), 16, 10).cast("long").alias("h"))
    placed = placed_within(known.filter("size > 0"), "tree", ["h", "id", "size", "row"], "n").withColumn("n", F.col("n") - 1)
    drawn = pivotal(placed, most_rows, seed).unionByName(known.filter("size = 0").select("tree", "id", "size", (coin(F.lit(seed), F.lit("none"), F.col("tree"), F.coalesce(F.col("id").cast("string"), F.lit("-"))) < F.col("p")).alias("up")))
    side = by.drop("_s", "p")
    return drawn.join(F.broadcast(side) if n <= BROADCAST_SOURCES else side, "tree").select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") + F.col("up").cast("long")).alias("copies"))


def mixture(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of the mix itself: each of docs, whose ids are unique, as often as it is taken, with its copy number from 1."""
    taken = mixed.filter("copies > 0").select(id_col, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return docs.join(taken, id_col)


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _coin_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE / {1 << 52}.0)"


def _rounds_sql(rounds: int, seed: int = 11) -> str:
    """CTEs l0 (rows) to l{rounds}: each folds blocks of 64 rows of the one before; three rounds hold 262,144 rows of a source."""
    out = []
    for k in range(rounds):
        rise, fall = "least(a.size * (1 - a.p), b.size * b.p)", "least(a.size * a.p, b.size * (1 - b.p))"
        rises = f"(b.u * ({rise} + {fall}) < {fall})"
        ends = f"(CASE WHEN {rises} THEN a.size * (1 - a.p) <= b.size * b.p ELSE a.size * a.p <= b.size * (1 - b.p) END)"
        pick = lambda c: f"(CASE WHEN {ends} THEN b.{c} ELSE a.{c} END)"  # noqa: B023, E731
        moved = f"((CASE WHEN {rises} THEN {rise} ELSE {fall} END) / {pick('size')})"
        p = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {rises} = {ends} THEN {pick('p')} - {moved} ELSE {pick('p')} + {moved} END))"
        ended = f"{{'id': CASE WHEN {ends} THEN a.id ELSE b.id END, 'size': CASE WHEN {ends} THEN a.size ELSE b.size END, 'up': {rises} = {ends}}}"
        step = f"lambda a, b: {{'id': {pick('id')}, 'size': {pick('size')}, 'p': {p}, 'u': b.u, 'done': list_append(a.done, {ended})}}"
        item = f"{{'id': id, 'size': size, 'p': p, 'u': {_coin_sql(str(seed), str(k), 'tree', 'n')}, 'done': []::STRUCT(id BIGINT, size BIGINT, up BOOLEAN)[]}}"
        out.append(f"m{k} AS MATERIALIZED (SELECT tree, n // {BLOCK} AS n, list_reduce(list({item} ORDER BY n), {step}) AS r FROM l{k} GROUP BY tree, n // {BLOCK})")
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT tree, n, r.id AS id, r.size AS size, r.p AS p FROM m{k})")
    return ",\n".join(out)


SQL = {
    "op11_mixing": rf"""
    WITH d AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    s AS (SELECT *, [5, 2, 1][(tree - 1) % 3 + 1] AS weight FROM (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) AS tree FROM d GROUP BY source)),
    r AS (SELECT *, row_number() OVER (ORDER BY 2 * size / weight, tree) AS k FROM s),
    f AS (SELECT a.k, ((SELECT 1.5::DOUBLE * sum(size) FROM s) - coalesce(sum(2 * b.size) FILTER (b.k < a.k), 0)::DOUBLE) / (sum(b.weight) FILTER (b.k >= a.k))::DOUBLE AS level, max(2 * b.size / b.weight) FILTER (b.k = a.k) AS own FROM r a CROSS JOIN r b GROUP BY a.k),
    v AS (SELECT level FROM f WHERE own >= level ORDER BY k LIMIT 1),
    t AS (SELECT source, tree, size AS source_size, CASE WHEN weight * level > 2 * size THEN (2 * size)::DOUBLE ELSE weight * level END AS target FROM s CROSS JOIN v),
    q AS (SELECT d.id, d.size, t.*, floor(coalesce(target / nullif(source_size, 0), 0)) AS whole, coalesce(target / nullif(source_size, 0), 0) - floor(coalesce(target / nullif(source_size, 0), 0)) AS p FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    l0 AS MATERIALIZED (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY ('0x' || substr(md5(concat_ws('|', id, size)), 1, 15))::BIGINT, id NULLS FIRST, size) - 1 AS n, id, size, p FROM q WHERE size > 0),
    {_rounds_sql(3)},
    e AS (SELECT tree, unnest(r.done, recursive := true) FROM m0 UNION ALL SELECT tree, unnest(r.done, recursive := true) FROM m1 UNION ALL SELECT tree, unnest(r.done, recursive := true) FROM m2
        UNION ALL SELECT tree, id, size, {_coin_sql('11', "'last'", 'tree')} < p FROM l3
        UNION ALL SELECT tree, id, size, {_coin_sql('11', "'none'", 'tree', "coalesce(id::VARCHAR, '-')")} < p FROM q WHERE size = 0)
    SELECT e.id AS doc_id, e.size, w.source_size, w.target, (e.size * (w.whole + e.up::INT))::BIGINT AS taken, (w.whole + e.up::INT)::BIGINT AS copies
    FROM e JOIN (SELECT DISTINCT tree, source_size, target, whole FROM q) w USING (tree)
    """
}
QUERIES = {"op11_mixing": op11_mixing}
