"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Every document becomes a set of 64-bit shingle hashes and 512 MinHash values. Documents of one word sequence are
   one text; only one of each goes on, with its number of copies.
2. Candidates share all 8 MinHash values of one of 64 bands (a pair at 0.8 is missed with probability 8e-6). Each text
   is linked to the least text of its bands' buckets, so links are linear in the texts; groups are what the links
   connect, found by contracting the link graph in joins.
3. A group goes to a task with its texts. There MinHash values (8 bits of each) are compared in steps of 32, and a pair
   is dropped when the posterior probability that its similarity reaches the threshold falls below ``tolerance``. The
   rest are verified on their whole shingle sets. A task returns counts of links and a spanning forest of them, never
   the pairs.
4. A large group is dealt in parts, each with the text of the group's leader. Its texts move once; what goes on is how a
   text differs from the leader, the shingles that it lost and those that are new, from which the exact similarity of
   any two follows. Jaccard distance is a metric: by their distances from the leader texts fall into a few classes, and
   for some pairs of classes every pair of texts is a link, or none is. Only for the others are blocks of differences
   compared, one task for each pair of blocks, with the same pruning.
5. Classes of near copies are the components of the verified links.

Words are lower-cased runs of characters between white space, without punctuation at their ends. Defined results: a
text of fewer than five words has its whole word sequence as its one shingle; a text without words links with nothing
and is a class of its own; each row is a document, also when its id repeats or is null (null comes before all others);
an empty table gives an empty result. Words and shingles are told apart by 64-bit hashes, word sequences by 128 bits of
their words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, stored, table

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 64, 8
COMPARED, STEP = 128, 32  # MinHash values compared, and at a time
TOLERANCE = 1e-6
#: Texts of a part of a group, at most (give or take), and differences of a block.
PART_ROWS, PART_CHARS = 128, 16 << 20
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
#: A side of up to so many bytes (8 for each value) is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20
#: Punctuation that isn't part of a word at its ends.
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\~`"

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hash of each word, kept for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        bare = word.strip(EDGES)
        h = self[word] = int.from_bytes(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") if bare else 0
        return h


_words = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_sequence(text: str) -> np.ndarray:
    words = text.lower().split()
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    return h[h != 0]


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a word sequence."""
    n = min(WORDS, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = _mix(out + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return np.unique(out)


def min_hashes(s: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    low = s.astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(best, (_A[:n] * low[None, at : at + 512] + _B[:n]).min(axis=1), out=best)
    return best


def bytes_of(m: np.ndarray) -> np.ndarray:
    """8 bits of each value, mixed: a minimum's own high bits are nearly always 0."""
    return _mix(m[:COMPARED].astype(np.uint64)).astype(np.uint8)


def band_keys(m: np.ndarray) -> np.ndarray:
    return _mix((m.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
            v, w, bands, chars = [], [], [], []
            for text in batch.column("text").to_pylist():
                h = word_sequence(text)
                digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                v.append(int.from_bytes(digest[:8], "little", signed=True) if len(h) else None)
                w.append(int.from_bytes(digest[8:], "little", signed=True) if len(h) else None)
                bands.append(band_keys(min_hashes(shingles(h))) if len(h) else None)
                chars.append(len(text))
            columns = {"id": batch.column("id"), "t": batch.column("t"), "v": pa.array(v, pa.int64()), "w": pa.array(w, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "chars": pa.array(chars, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values, the fewest matches with which a pair stays.

    With a uniform prior, the posterior of the match probability is Beta(1 + m, 1 + n - m); 8-bit values of sets of
    similarity s match with probability s + (1 - s) / 256.
    """
    p = threshold + (1 - threshold) / 256
    reach = lambda m, n: sum(comb(n + 1, i) * p**i * (1 - p) ** (n + 1 - i) for i in range(m + 1))  # noqa: E731  P(Beta(m+1, n-m+1) >= p)
    return {n: next(m for m in range(n + 1) if reach(m, n) >= tolerance) for n in range(STEP, COMPARED + 1, STEP)}


def roots(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def common_of(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) of sorted sets."""
    n = len(sets)
    if len(i) <= 4 * n:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], dtype=np.int64)
    # Columns of values that two sets or more hold: only they can be common.
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.r_[start, len(every)])
    column = np.repeat(np.cumsum(count > 1) - 1, count)[np.repeat(count > 1, count)]
    owner = owner[np.repeat(count > 1, count)]
    width = int(column[-1]) + 1 if len(column) else 0
    both = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, width, 4096):
        a, z = np.searchsorted(column, (lo, lo + 4096))
        part = np.zeros((n, min(4096, width - lo)), dtype=np.float32)
        part[owner[a:z], column[a:z] - lo] = 1
        both += part @ part.T
    return both[i, j].astype(np.int64)


def candidates(near: np.ndarray, mins: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of near that no step of the comparison drops."""
    i, j = np.nonzero(near)
    same = np.zeros(len(i), dtype=np.int64)
    for at in range(0, COMPARED, STEP):
        same = same + (mins[i, at : at + STEP] == mins[j, at : at + STEP]).sum(axis=1)
        stay = same >= least[at + STEP]
        i, j, same = i[stay], j[stay], same[stay]
    return i, j


def counted(v: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the texts v its number of links, given the links (i, j), and the least text that they connect it with."""
    n = len(v)
    links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
    order = np.argsort(v, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    parent = list(range(n))
    for x, y in zip(place[i].tolist(), place[j].tolist()):
        x, y = roots(parent, x), roots(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([roots(parent, x) for x in range(n)], dtype=np.int64)
    return links.astype(np.int64), v[order][root[place]]


def class_bounds(threshold: float) -> list[float]:
    """Upper bounds of the classes of distances from the leader; the last class has none."""
    return [k * (1 - threshold) for k in (0.25, 0.5, 0.75, 1, 1.5, 2.5)] + [float("inf")]


def class_pairs(threshold: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of classes (a <= b) whose texts are all links, and those of which some may be; of the other pairs none is."""
    up, limit = class_bounds(threshold), 1 - threshold
    low = [0.0, *up[:-1]]
    every = [(a, b) for b in range(len(up)) for a in range(b + 1)]
    sure = [(a, b) for a, b in every if up[a] + up[b] <= limit + 1e-12]
    return sure, [(a, b) for a, b in every if (a, b) not in sure and low[b] - up[a] < limit - 1e-12]


FIRST = "v long, grp long, copies long, links long, root long, whole boolean, cls int, lead_size int, mins binary, lost binary, new binary"


def _first(threshold: float, tolerance: float):
    """A part of a group: all links of a group of one part; else each text's differences from the leader."""
    least, up = least_matches(threshold, tolerance), class_bounds(threshold)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        grp = int(pdf["grp"].iloc[0])
        own = pdf[~pdf["lead"]].drop_duplicates("v")
        v, copies, n = own["v"].to_numpy(), own["copies"].to_numpy(), len(own)
        sets = [shingles(word_sequence(t)) for t in own["text"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        mins = np.stack([bytes_of(min_hashes(s, COMPARED)) for s in sets]) if n else np.zeros((0, COMPARED), dtype=np.uint8)
        if not pdf["lead"].any():
            i, j = candidates(np.triu(np.ones((n, n), dtype=bool), 1), mins, least)
            common = common_of(sets, i, j)
            linked = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
            links, root = counted(v, copies, i[linked], j[linked])
            return pd.DataFrame({"v": v, "grp": grp, "copies": copies, "links": links, "root": root, "whole": True, "cls": 0, "lead_size": 0, "mins": None, "lost": None, "new": None})
        lead = shingles(word_sequence(pdf.loc[pdf["lead"], "text"].iloc[0]))
        out = []
        for k, s in enumerate(sets):
            at = np.minimum(np.searchsorted(lead, s), len(lead) - 1)
            held = lead[at] == s
            there = np.zeros(len(lead), dtype=bool)
            there[at[held]] = True
            lost, new = np.flatnonzero(~there).astype("<u4"), s[~held]
            union = len(lead) + len(new)
            away = (len(lost) + len(new)) / union
            linked = union - len(lost) - len(new) >= threshold * union - 1e-9
            out.append((int(v[k]), grp, int(copies[k]), 0, grp if linked else int(v[k]), False, next(c for c, most in enumerate(up) if away < most), len(lead), mins[k].tobytes(), lost.tobytes(), new.tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FIRST.split(", ")])

    return first


def _second(threshold: float, tolerance: float):
    """A pair of blocks of a large group, by their differences from its leader."""
    least = least_matches(threshold, tolerance)

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        v, copies, side = pdf["v"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
        alone = (pdf["one"].iloc[0], pdf["a"].iloc[0]) == (pdf["two"].iloc[0], pdf["b"].iloc[0])
        mins = np.stack([np.frombuffer(x, dtype=np.uint8) for x in pdf["mins"]])
        lost = [np.frombuffer(x, dtype="<u4").astype(np.uint64) for x in pdf["lost"]]
        new = [np.frombuffer(x, dtype=np.uint64) for x in pdf["new"]]
        gone, come = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (lost, new))
        size = int(pdf["lead_size"].iloc[0])
        near = np.triu(np.ones((len(v), len(v)), dtype=bool), 1)
        if not alone:  # two blocks: pairs across them
            near &= side[:, None] != side[None, :]
        i, j = candidates(near, mins, least)
        common = size - gone[i] - gone[j] + common_of(lost, i, j) + common_of(new, i, j)
        sizes = size - gone + come
        linked = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
        links, root = counted(v, copies, i[linked], j[linked])
        return pd.DataFrame({"v": v, "links": links, "root": root})

    return second


def components(links: DataFrame) -> DataFrame:
    """(v, c): for each vertex of links (a, b) the least vertex of its component.

    Each round every vertex points at its least neighbour, pointers are followed twice, and the links are drawn between
    what the vertices point at; links within one vertex go. The graph shrinks by half or more a round.
    """
    ends = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    label = None
    while ends.take(1):
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")), "points")
        for _ in range(2):
            point = point.join(point.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p"))
        point = stored(point, "points")
        label = stored(point.select("v", F.col("p").alias("c")) if label is None else label.join(point.select(F.col("v").alias("c"), "p"), "c", "left").select("v", F.coalesce("p", "c").alias("c")), "labels")
        moved = ends.join(point.select(F.col("v").alias("a"), F.col("p").alias("x")), "a").join(point.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
        ends = stored(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return label if label is not None else ends.select(F.col("a").alias("v"), F.col("b").alias("c"))


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if its values take no more than BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * 8 * len(df.columns) <= BROADCAST_BYTES else df


def large_groups(parts: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(v, links, root) of the texts of large groups, a row for each task that found some, from their differences (columns of FIRST)."""
    sure, open_ = class_pairs(threshold)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("lost") + F.octet_length("new") + COMPARED) / BLOCK_BYTES)).cast("int")
    classes = stored(parts.groupBy("grp", "cls").agg(blocks.alias("blocks"), F.sum("copies").alias("held")), "classes")  # a few rows for each large group
    spark = parts.sparkSession
    pairs = lambda some: F.broadcast(spark.createDataFrame(some, "one int, two int"))  # noqa: E731  a fixed number
    # Links that the classes are sure of: with all texts of the other class, but not of a text with itself.
    both_ways = sorted({(a, b) for a, b in sure} | {(b, a) for a, b in sure})
    others = classes.select("grp", F.col("cls").alias("two"), "held").join(pairs(both_ways), "two").groupBy("grp", F.col("one").alias("cls")).agg(F.sum("held").alias("held"))
    twin = F.col("cls").isin([a for a, b in sure if a == b])
    certain = parts.join(small(others), ["grp", "cls"]).select("v", (F.col("held") - F.when(twin, F.col("copies")).otherwise(0)).cast("long").alias("links"), F.col("v").alias("root"))
    left, right = (classes.select("grp", F.col("cls").alias(c), F.col("blocks").alias(f"{c}_blocks")) for c in ("one", "two"))
    dealt = left.join(pairs(open_), "one").join(right, ["grp", "two"])
    own = parts.join(small(classes.drop("held")), ["grp", "cls"]).withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int")).select("grp", "cls", "block", "v", "copies", "lead_size", "mins", "lost", "new")

    def meetings(side: int, cls: str, other: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias("to")
        rows = own.join(small(dealt.withColumnRenamed(cls, "cls")), ["grp", "cls"]).select(own.columns + [F.col(other).alias("other"), each])
        return rows.select("grp", *(F.col(c).alias(n) for n, c in zip(("one", "a", "two", "b"), ("cls", "block", "other", "to") if side == 0 else ("other", "to", "cls", "block"))), F.lit(side).alias("side"), "v", "copies", "lead_size", "mins", "lost", "new")

    first = meetings(0, "one", "two")
    # Within one class block a meets block b once, as the first where a <= b; alone, where a = b.
    rows = first.filter("one <> two OR a <= b").unionByName(meetings(1, "two", "one").filter("one <> two OR a < b"))
    found = rows.groupBy("grp", "one", "a", "two", "b").applyInPandas(_second(threshold, tolerance), "v long, links long, root long")
    return found.unionByName(certain)


def told_apart(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sketches with a v of its own for each digest of 128 bits (v, w), and the distinct texts (v, id, t, copies).

    Texts of one v and different w get a new v from both, again until no two share one.
    """
    while True:
        found = sketches.filter("v IS NOT NULL").groupBy("v").agg(F.min(F.struct("id", "t")).alias("rep"), F.count("*").alias("copies"), (F.min("w") != F.max("w")).alias("mixed"))
        found = stored(found.select("v", "rep.*", "copies", "mixed"), "texts")
        if not found.filter("mixed").take(1):
            return sketches, found.drop("mixed")
        mixed = found.filter("mixed").select("v", "mixed")
        new = F.when(F.col("mixed"), F.xxhash64("v", "w")).otherwise(F.col("v"))
        sketches = stored(sketches.join(small(mixed), "v", "left").withColumn("v", new).select(sketches.columns), "sketches")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (least id of the class), n_links (documents at or over the threshold), class_size,
    text_hash (xxhash64 of the text) and kept (of each class the row of least id, then hash)."""
    ship(docs.sparkSession)
    alike = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["t"] == b["t"])
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    sketches, texts = told_apart(stored(own.mapInArrow(_sketch, "id long, t long, v long, w long, bands array<long>, chars long"), "sketches"))
    reps = stored(sketches.drop("v", "w").join(texts, alike(sketches, texts)).select("v", "bands", "chars"), "reps")
    repeated = reps.count() > texts.count()  # rows of one id and one text
    reps = stored(reps.dropDuplicates(["v"]), "reps") if repeated else reps
    keys = reps.select("v", F.explode("bands").alias("key"))
    buckets = stored(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("head")).filter("n > 1").select("key", "head"), "buckets")
    links = keys.join(small(buckets), "key").filter("v <> head").select(F.col("head").alias("a"), F.col("v").alias("b"))
    groups = stored(components(links), "groups")
    sizes = groups.join(reps.select("v", "chars"), "v").groupBy("c").agg(F.count("*").alias("m"), F.sum("chars").alias("chars"))
    sizes = sizes.select("c", F.greatest(F.ceil(F.col("m") / PART_ROWS), F.ceil(F.col("chars") / PART_CHARS)).cast("int").alias("parts"))
    members = groups.join(small(sizes), "c").join(texts, "v").select("id", "t", "v", F.col("c").alias("grp"), "copies", "parts")
    members = stored(members, "members")
    # Only the texts of members move: once, and a leader's (the least text of its group) to every part of a large group.
    part = F.struct(F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), F.lit(False).alias("lead"))
    led = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("lead")))
    places = F.explode(F.when((F.col("v") == F.col("grp")) & (F.col("parts") > 1), F.concat(F.array(part), led)).otherwise(F.array(part)))
    dealt = own.join(small(members), alike(own, members)).select("v", "grp", "copies", "text", places.alias("p")).select("v", "grp", "copies", "text", "p.part", "p.lead")
    dealt = dealt.dropDuplicates(["v", "part", "lead"]) if repeated else dealt
    checked = stored(dealt.groupBy("grp", "part").applyInPandas(_first(threshold, tolerance), FIRST), "checked")
    found = checked.select("v", "links", "root", "whole")
    parts = checked.filter("NOT whole")
    if parts.take(1):
        found = stored(found.unionByName(large_groups(parts, threshold, tolerance).withColumn("whole", F.lit(False))), "found")
    counts = found.groupBy("v").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.min("whole").alias("whole"))
    rest = components(found.filter("NOT whole AND root <> v").select(F.col("root").alias("a"), F.col("v").alias("b")))
    classes = counts.join(rest, "v", "left").select("v", "links", F.when(F.col("whole"), F.col("root")).otherwise(F.coalesce("c", "v")).alias("c"))
    classes = stored(texts.join(classes, "v", "left").select("v", "id", "t", "copies", F.coalesce("c", "v").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    sizes = classes.groupBy("c").agg(F.min(F.struct("id", "t")).alias("first"), F.sum("copies").alias("class_size"))
    rows = sketches.select("id", "t", "v").join(classes.join(sizes, "c").select("v", "first", "n_links", "class_size"), "v", "left")
    alone = F.col("first").isNull()
    return rows.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.col("t").alias("text_hash"), (alone | F.col("first").eqNullSafe(F.struct("id", "t"))).alias("kept"),
    )


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size")


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
