"""Approximate nearest neighbours: balanced posting lists behind an in-memory graph of centroids.

1. Centroids are fitted on a bounded sample; a cluster that holds more than its share is split in two until none does.
   Their number follows the number of vectors up to ``MAX_LISTS``.
2. Every vector goes to the list of its nearest centroid; one near a boundary is replicated to up to ``REPLICAS`` lists
   in all, whose centroids are at most ``1 + SPREAD`` times as far.
3. A query walks the graph of centroids (each linked to near ones in different directions) best first, and visits the lists whose
   distance is at most ``1 + ratio`` times the nearest's, at least until they hold several times as many vectors as asked.
   ``TRIED`` queries are first compared with every vector; ratio, number of lists and beam grow from ``RATIO``, ``PROBES``
   and ``BEAM`` until the lists visited hold ``TARGET`` of these queries' true neighbours, whatever the number of vectors.
4. Lists meet their queries in a join; a long list and many queries of one list are dealt to several tasks. Each task
   multiplies its block of queries by its vectors in double precision and keeps the best of each query.

Largest inner product becomes least distance by one more component, sqrt(max norm^2 - norm^2), that is 0 in queries.

Defined results: vectors that are null, zero, of another length than the most frequent (of several the longest), or hold null or non-finite
components take no part, neither as query nor as candidate; equal scores go to the smaller id; rows of one id are one
candidate (the best score counts), and query rows of one id are one query, that of the vectors which any of them is near
to; an empty table gives an empty result; with few vectors all are in one list.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import ship, stored, table

LIST_SIZE, MAX_LISTS = 160, 4096
#: Vectors that the centroids are fitted on, at most.
SAMPLE = 40_000
ROUNDS = 6
SPREAD, REPLICAS = 0.12, 4
RATIO, PROBES = 0.25, 64
LINKS, BEAM = 24, 128
#: Recall that the visits are widened to, and queries that it is measured on, at most.
TARGET, TRIED = 0.97, 256
CHUNK = 8192
#: Rows that are compared with all centroids at once: 32 MB a product with 8,192 centroids.
BLOCK = 1024


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each row's nearest centroid, by blocks of rows: all products at once would take gigabytes of the driver."""
    norms, out = (c * c).sum(1)[None, :], np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), BLOCK):
        out[at : at + BLOCK] = (2 * (x[at : at + BLOCK] @ c.T) - norms).argmax(axis=1)
    return out


def fit_centroids(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """About k balanced centroids: Lloyd's rounds, then clusters over twice their share are split."""
    rng = np.random.default_rng(8)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    share = max(2.0 * len(x) / k, 2)
    for _ in range(8):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        large = np.flatnonzero(n > share)
        if not len(large) or len(c) >= 2 * k:
            break
        halves = []
        for i in large:
            own = x[at == i]
            d = own - own.mean(axis=0)
            if not d.any():
                continue  # equal vectors can't be split; their list is dealt to several tasks
            axis = d[np.argmax((d * d).sum(1))]
            side = d @ axis > 0
            c[i] = own[~side].mean(axis=0)
            halves.append(own[side].mean(axis=0))
        if not halves:
            break
        c = np.vstack([c, halves])
    return c[np.bincount(_nearest(x, c), minlength=len(c)) > 0].astype(np.float32)


def link(c: np.ndarray, links: int = LINKS, near: int = 192, far: int = 64) -> list[np.ndarray]:
    """Neighbours of each centroid: of its nearest and some random ones, those to which no kept one lies closer; and back.

    So a tight cluster of centroids keeps links to the outside, and the outside to it.
    """
    n, rng = len(c), np.random.default_rng(24)
    norms = (c * c).sum(1)
    out: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        d = norms - 2 * (c @ c[i]) + norms[i]
        d[i] = np.inf
        some = np.argpartition(d, min(near, n - 1) - 1)[: min(near, n - 1)] if n > 1 else np.zeros(0, dtype=np.int64)
        some = np.setdiff1d(np.r_[some, rng.integers(0, n, far)], [i])
        some = some[np.argsort(d[some], kind="stable")]
        x, alive = c[some], np.ones(len(some), dtype=bool)
        for _ in range(links):
            if not alive.any():
                break
            j = int(alive.argmax())
            out[i].append(int(some[j]))
            out[int(some[j])].append(i)
            alive &= ((x - x[j]) ** 2).sum(1) > d[some]
            alive[j] = False
    return [np.unique(np.array(o, dtype=np.int32)) for o in out]


def walk(q: np.ndarray, c: np.ndarray, norms: np.ndarray, graph: list[np.ndarray], beam: int = BEAM) -> list[tuple[float, int]]:
    """(squared distance, centroid) of the nearest centroids found, nearest first."""
    offset = float(q @ q)
    far = lambda i: norms[i] - 2 * (c[i] @ q) + offset
    start = np.unique(np.linspace(0, len(c) - 1, 8).astype(np.int64))
    seen = np.zeros(len(c), dtype=bool)
    seen[start] = True
    open_ = [(float(d), int(i)) for d, i in zip(far(start), start)]
    heapq.heapify(open_)
    best = [(-d, i) for d, i in open_]
    heapq.heapify(best)
    while open_:
        d, i = heapq.heappop(open_)
        if len(best) >= beam and d > -best[0][0]:
            break
        new = graph[i][~seen[graph[i]]]
        seen[new] = True
        for d, j in zip(far(new).tolist(), new.tolist()):
            if len(best) < beam:
                heapq.heappush(best, (-d, j))
            elif d < -best[0][0]:
                heapq.heapreplace(best, (-d, j))
            else:
                continue
            heapq.heappush(open_, (d, j))
    return sorted((max(-d, 0.0), i) for d, i in best)


def scan(q: np.ndarray, c: np.ndarray, norms: np.ndarray) -> list[tuple[float, int]]:
    """What a walk over the whole graph finds: every centroid, nearest first."""
    d = np.maximum(norms - 2 * (c @ q) + q @ q, 0)
    order = np.argsort(d, kind="stable")
    return list(zip(d[order].tolist(), order.tolist()))


def find(q: np.ndarray, c: np.ndarray, norms: np.ndarray, graph: list[np.ndarray], beam: int) -> list[tuple[float, int]]:
    return scan(q, c, norms) if 2 * beam >= len(c) else walk(q, c, norms, graph, beam)


def visited(found: list[tuple[float, int]], held: np.ndarray, k: int, ratio: float, probes: int) -> list[int]:
    """The lists to visit: those near enough, and in any case until they hold several times as many vectors as asked."""
    reach, got, out = max(found[0][0], 1e-30) * (1 + ratio) ** 2, 0, []
    for n, (d, i) in enumerate(found):
        if got >= 8 * k and (d > reach or n >= probes):
            break
        got += int(held[i])
        out.append(i)
    return out


def assign(x: np.ndarray, c: np.ndarray, norms: np.ndarray) -> tuple[list[int], list[int]]:
    """Rows and lists: each row's nearest centroid and those about as near."""
    near = min(REPLICAS, len(c))
    out_row, out_list = [], []
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        d = np.maximum(norms[None, :] - 2 * (part @ c.T) + (part * part).sum(1)[:, None], 0)
        some = np.argpartition(d, near - 1, axis=1)[:, :near]
        some = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1), 1)
        for r, near_lists in enumerate(some):
            kept = [near_lists[0]]
            reach = d[r, near_lists[0]] * (1 + SPREAD) ** 2
            for j in near_lists[1:]:
                if d[r, j] > reach or len(kept) == REPLICAS:
                    break
                kept.append(j)
            out_row += [at + r] * len(kept)
            out_list += kept
    return out_row, out_list


def nearest(ids: np.ndarray, x: np.ndarray, names: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, the best rows of the k best other ids, best first, and their scores."""
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    for at in range(0, len(q), 512):
        s = q[at : at + 512] @ x.T
        for r in range(len(s)):
            s[r, np.searchsorted(ids, names[at + r]) : np.searchsorted(ids, names[at + r], "right")] = -np.inf
        top = s if len(start) == len(ids) else np.maximum.reduceat(s, start, axis=1)
        for r in range(len(s)):
            least = np.partition(top[r], len(start) - k)[len(start) - k] if len(start) > k else -np.inf
            some = np.flatnonzero((s[r] >= least - 1e-9 * (1 + abs(least))) & (s[r] > -np.inf))
            exact = (x[some] * q[at + r]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
            order = np.lexsort((ids[some], -exact))
            order = order[np.sort(np.unique(ids[some][order], return_index=True)[1])[:k]]
            yield at + r, by_id[some[order]], exact[order]


def widen(truth: list[tuple[np.ndarray, list[set[int]]]], c: np.ndarray, norms: np.ndarray, graph: list[np.ndarray], held: np.ndarray, k: int, ratio: float, probes: int, target: float) -> tuple[float, int, int]:
    """Ratio, probes and beam with which queries visit ``target`` of their true neighbours, from the lists of each neighbour."""
    beam = max(BEAM, 2 * probes)
    truth = [(q, near) for q, near in truth if near]
    if not truth:
        return ratio, probes, beam
    weight, forced, far, place = [], [], [], []
    for q, near in truth:
        d, order = (np.array(a) for a in zip(*scan(q, c, norms)))
        at = np.empty(len(c), dtype=np.int64)
        at[order] = np.arange(len(c))
        before = np.cumsum(held[order]) - held[order]
        first = np.array([min(at[i] for i in lists) for lists in near])
        weight.append(np.full(len(near), 1 / len(near) / len(truth)))
        forced.append(before[first] < 8 * k)
        far.append(np.sqrt(d[first] / max(d[0], 1e-30)) - 1)
        place.append(first + 1)
    weight, forced, far, place = (np.concatenate(a) for a in (weight, forced, far, place))

    def least(need: np.ndarray, start: float, goal: float) -> float:
        order = np.argsort(need, kind="stable")
        total = np.cumsum(weight[order])
        at = int(np.searchsorted(total, goal - 1e-9))
        return max(start, need[order][min(at, len(order) - 1)])

    # Half of what may be missed is left to each of the two bounds.
    ratio = float(least(np.where(forced, 0, far * (1 + 1e-6)), ratio, (1 + target) / 2))
    probes = int(least(np.where(forced, 0, np.where(far <= ratio, place, len(c))), probes, target))
    beam = max(BEAM, 2 * probes)
    while 2 * beam < len(c):
        seen = [(set(visited(walk(q, c, norms, graph, beam), held, k, ratio, probes)), near) for q, near in truth]
        if np.mean([np.mean([bool(own & lists) for lists in near]) for own, near in seen]) >= target - 0.002:
            break
        beam *= 2
    return ratio, probes, beam


def sound(v: Column, size: int | Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) == size) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.maximum(largest**2 - (x * x).sum(axis=1), 0)
    return np.c_[x, np.sqrt(rest)].astype(np.float32)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", list_size: int = LIST_SIZE, ratio: float = RATIO, probes: int = PROBES, target: float = TARGET, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other vectors; ``exact`` visits every list.

    ``ratio`` and ``probes`` are where widening starts, so that ``target`` of the true neighbours are found.
    """
    spark = vectors.sparkSession
    ship(spark)
    length = F.size(F.col(vec_col))
    lengths = vectors.filter(F.col(id_col).isNotNull() & sound(F.col(vec_col).cast("array<double>"), length)).groupBy(length.alias("size")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    size = usual["size"] if usual else 0
    rows = vectors.filter(F.col(id_col).isNotNull() & sound(F.col(vec_col).cast("array<double>"), size)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = stored(rows, "ann-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, largest = rows.agg(F.count("*"), F.max(norm)).first()
    largest = largest or 0.0
    if n:
        h = F.xxhash64("id", F.lit(8))
        bound = rows.select(h.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
        x = np.array([r["v"] for r in rows.filter(h <= bound).orderBy(h, "id").limit(SAMPLE).collect()])
        c = fit_centroids(_lift(x, largest), int(min(MAX_LISTS, max(1, n // list_size))))
    else:
        c = np.zeros((1, size + 1), dtype=np.float32)
    norms, graph = (c * c).sum(1), link(c)
    shared = spark.sparkContext.broadcast((c, norms, graph))  # at most 2 * MAX_LISTS centroids
    h = F.xxhash64("id", F.lit(20))
    tried = [(r["id"], r["v"]) for r in rows.filter("asks").orderBy(h, "id").limit(TRIED).select("id", "v").collect()]
    tried_names, tried_vectors = np.array([i for i, _ in tried], dtype=np.int64), np.array([v for _, v in tried])

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, norms, _ = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = _lift(np.array(pdf["v"].to_list()), largest)
            out_row, out_list = assign(x, c, norms)
            yield pd.DataFrame({"list": np.array(out_list, dtype=np.int32), "id": pdf["id"].to_numpy()[out_row], "v": pdf["v"].to_numpy()[out_row]})

    posts = stored(rows.select("id", "v").mapInPandas(post, "list int, id long, v array<double>"), "ann-lists")
    held = np.zeros(len(c), dtype=np.int64)
    for r in posts.groupBy("list").agg(F.countDistinct("id").alias("ids")).collect():  # one row for each centroid
        held[r["list"]] = r["ids"]

    def ideal(v: list[float]) -> np.ndarray:
        q = np.r_[v, 0.0].astype(np.float32)
        return q * np.float32(largest / max(np.linalg.norm(q), 1e-30))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = np.zeros(0, dtype=np.int64), np.zeros((0, size))
        for pdf in batches:
            if len(pdf):
                ids, x = np.r_[ids, pdf["id"].to_numpy()], np.r_[x, np.array(pdf["v"].to_list())]
                some = np.unique(np.concatenate([rows for _, rows, _ in nearest(ids, x, tried_names, tried_vectors, k)]))
                ids, x = ids[some], x[some]  # TRIED * k at most
        for r, some, exact in nearest(ids, x, tried_names, tried_vectors, k) if len(ids) else ():
            yield pd.DataFrame({"query": np.int32(r), "id": ids[some], "score": exact, "v": list(x[some])})

    truth = []
    if tried and not exact:
        every = rows.select("id", "v").mapInPandas(compare, "query int, id long, score double, v array<double>")
        every = every.groupBy("query", "id").agg(F.max("score").alias("score"), F.max_by("v", "score").alias("v"))
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        near = [[] for _ in tried]
        for r in every.withColumn("n", best).filter(F.col("n") <= k).select("query", "v").collect():  # TRIED * k at most
            near[r["query"]].append(r["v"])
        for v, own in zip(tried_vectors, near):
            lists = [set() for _ in own]
            for r, i in zip(*assign(_lift(np.array(own), largest), c, norms)) if own else ():
                lists[r].add(int(i))
            truth.append((ideal(v), lists))
    ratio, probes, beam = (float("inf"), len(c), len(c)) if exact else widen(truth, c, norms, graph, held, k, ratio, probes, target)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, norms, graph = shared.value
        for pdf in batches:
            out_row, out_list = [], []
            for r, v in enumerate(pdf["v"]):
                lists = visited(find(ideal(v), c, norms, graph, beam), held, k, ratio, probes)
                out_row += [r] * len(lists)
                out_list += lists
            yield pd.DataFrame({"list": np.array(out_list, dtype=np.int32), "id": pdf["id"].to_numpy()[out_row], "v": pdf["v"].to_numpy()[out_row]})

    asked = stored(rows.filter("asks").select("id", "v").repartition(max(2, spark.sparkContext.defaultParallelism), "id").mapInPandas(ask, "list int, id long, v array<double>"), "ann-asked")
    def meet(lists: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(lists) or not len(asks):
            return none
        names = asks["id"].to_numpy()
        out = [none]
        ids = lists["id"].to_numpy()
        for r, some, exact in nearest(ids, np.array(lists["v"].to_list()), names, np.array(asks["v"].to_list()), k):
            out.append(pd.DataFrame({"query_id": names[r], "vec_id": ids[some], "score": exact}))
        return pd.concat(out, ignore_index=True)

    def answers(asked: DataFrame) -> DataFrame:
        parts = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
        sizes = posts.groupBy("list").agg(parts(F.count("*")).alias("lists")).join(asked.groupBy("list").agg(parts(F.count("*")).alias("asks")), "list")
        sizes = F.broadcast(sizes)  # a row for each centroid
        part = lambda side, n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(side)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = posts.join(sizes, "list").select("list", part("a", "lists"), each("asks").alias("b"), "id", "v")
        right = asked.join(sizes, "list").select("list", each("lists").alias("a"), part("b", "asks"), "id", "v")
        met = left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInPandas(meet, "query_id long, vec_id long, score double")
        return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = stored(answers(asked).withColumn("rank", rank).filter(F.col("rank") <= k), "ann-best")
    # Copies and replicas can leave a query with too few other ids; it then asks every list.
    wanted = min(k, rows.select("id").distinct().count() - 1)
    short = rows.filter("asks").select("id", "v").join(best.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) < wanted).drop("n")
    short = stored(short, "ann-short")
    if short.take(1):
        lists = F.sequence(F.lit(0), F.lit(len(c) - 1))
        again = answers(short.select(F.explode(lists).alias("list"), "id", "v")).withColumn("rank", rank)
        best = best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return best.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op8_nearest_neighbours": op8_nearest_neighbours}
