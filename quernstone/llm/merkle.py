"""Merkle manifest of a dataset: trees of digests in van Emde Boas layout, with a proof for every row.

Rows of a group are the leaves of a tree, in order; every ``ARITY`` nodes in a row become one node above, until one is
left; the groups' roots are the leaves of one more tree. A tree of so many levels is split at half its height: the top
half first, then every subtree under it, each laid out in the same way. ``address`` is that layout as arithmetic: the
place of a node follows from its depth and index, whatever the block size of the storage.

1. The recursion is followed down to subtrees of ``BLOCK_LEVELS`` levels at most. Such a subtree is aligned, contiguous in
   the layout, and one row of the stored table: address of its root, and its digests in the order of their addresses.
2. Construction goes up band by band: a task gets the nodes under one subtree (512 leaves, or the 4,096 roots of the
   blocks below it), computes its nodes and stores them at their addresses; block roots are the next band's input. So a
   band is one shuffle of 1/512 of the band below it, and no group, however large, is one task's.
3. Retrieval goes down the same way: a block reads the siblings on the paths to its bottom nodes from their addresses, and
   hands each block below, found by its address, the siblings above it. At the bottom a leaf's proof is its siblings in
   its block and what the block was given.

A proof is a list of levels, each with the siblings to the left and to the right; folding a leaf's digest with it gives
the root again, if the leaf is what it was.

Defined results: null fields are told apart from empty ones; rows with a null group are a group of their own, the first;
null ids come first; rows of one id are in order of their digests, so rows alike in all fields may change places; an empty
table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.operators.selection import placed_within, with_positions

from .common import ship, stored, table

ARITY, BITS = 8, 3
#: Levels of a stored block: 512 nodes at its bottom, 585 in all.
BLOCK_LEVELS = 4
#: Levels of a tree at most: 8 ** 20 leaves, whose addresses fit 64 bits.
MOST_LEVELS = 21
#: Groups that are broadcast, at most; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def full(levels: int) -> int:
    """Nodes of a full tree."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: int) -> int:
    """The place of a node in the layout of a tree: the top half of its levels first, then the subtrees under it in order."""
    at = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = BITS * (depth - top)
        at += full(top) + (index >> below) * full(levels - top)
        levels, depth, index = levels - top, depth - top, index & ((1 << below) - 1)
    return at


def bands(levels: int) -> list[int]:
    """Heights of the stored subtrees on a path, from the bottom up: the layout's own halves."""
    return [levels] if levels <= BLOCK_LEVELS else bands(levels - levels // 2) + bands(levels // 2)


def levels_of(n: int) -> int:
    return 1 + next(k for k in range(MOST_LEVELS) if ARITY**k >= n)


@cache
def places(height: int) -> list[np.ndarray]:
    """For each depth of a block the addresses of its nodes by index."""
    return [np.array([address(height, d, i) for i in range(ARITY**d)]) for d in range(height)]


def hashed(runs: str, n: int) -> bytes:
    """Digests of every ARITY of n digests in a row, given as hexadecimal text."""
    return b"".join(hashlib.sha256(runs[64 * i : 64 * min(i + ARITY, n)].encode()).digest() for i in range(0, n, ARITY))


def build_block(below: bytes, height: int, leaves: bool) -> tuple[bytes, bytes]:
    """Nodes of a block in the order of their addresses (zeros where the tree has none), and its root, from its leaves or the roots of the blocks under it."""
    out = np.zeros((full(height), 32), dtype=np.uint8)
    level = below if leaves else hashed(below.hex(), len(below) // 32)
    for depth in reversed(range(height)):
        n = len(level) // 32
        out[places(height)[depth][:n]] = np.frombuffer(level, dtype=np.uint8).reshape(n, 32)
        root, level = level, hashed(level.hex(), n) if depth else b""
    return out.tobytes(), root


def level_texts(nodes: bytes, height: int, bottom: int) -> list[str]:
    """The nodes of each depth of a block as hexadecimal text, read from their addresses."""
    all_nodes, out, n = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 32), [], bottom
    for depth in reversed(range(height)):
        out.append(all_nodes[places(height)[depth][:n]].tobytes().hex())
        n = -(-n // ARITY)
    return out[::-1]


def siblings(level: str, index: int) -> tuple[str, str]:
    """The other nodes of an index's run, left and right of it."""
    start = index // ARITY * ARITY * 64
    at = index * 64
    return level[start:at], level[at + 64 : start + ARITY * 64]


def path_up(texts: list[str], index: int) -> list[tuple[str, str]]:
    """Siblings of a bottom node of a block and of its ancestors under the block's root."""
    out = []
    for level in reversed(texts[1:]):
        out.append(siblings(level, index))
        index //= ARITY
    return out


def packed(levels: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in levels)


def unpacked(text: str, n: int) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in text.split(";")] if n else []


def fold(digest: str, proof: list[tuple[str, str]]) -> str:
    for left, right in proof:
        digest = hashlib.sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


@dataclass
class Trees:
    """Stored trees: blocks of each band from the bottom up, and the root of each tree."""

    blocks: list[DataFrame]
    roots: DataFrame  # tree, levels, root


def _maker(band: int):
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first = pdf.iloc[0]
        own, levels, block = bands(int(first["levels"])), int(first["levels"]), int(first["block"])
        below = b"".join(pdf["digest"])
        nodes, root = build_block(below, own[band], band == 0)
        at = address(levels, sum(own[band + 1 :]), block)
        return pd.DataFrame([{"tree": first["tree"], "levels": levels, "block": block, "address": at, "nodes": nodes, "below": b"" if band == 0 else below, "n_below": len(pdf), "root": root}])

    return make


def build(leaves: DataFrame, sizes: DataFrame) -> Trees:
    """Trees of leaves (tree, pos from 0, digest); sizes has (tree, n) of each, at most BROADCAST_GROUPS of them broadcast."""
    level_col = F.lit(1)
    for k in range(MOST_LEVELS - 1):
        level_col = F.when(F.col("n") > ARITY**k, k + 2).otherwise(level_col)
    sized = stored(sizes.select("tree", level_col.alias("levels")), "merkle-sizes")
    side = F.broadcast(sized) if sized.count() <= BROADCAST_GROUPS else sized
    heights = F.array(*(F.array(*map(F.lit, bands(n))) for n in range(1, MOST_LEVELS + 1)))
    level, blocks, roots, band = leaves.select("tree", "pos", "digest").join(side, "tree"), [], None, 0
    most = sized.agg(F.coalesce(F.max("levels"), F.lit(1))).first()[0]
    while not blocks or band < max(len(bands(n)) for n in range(1, most + 1)):
        height = F.get(heights[F.col("levels") - 1], F.lit(band))

        # A bottom block takes its own bottom level, one further up the roots of the blocks under its bottom level.
        kept = level.withColumn("h", height).filter("h IS NOT NULL").withColumn("block", F.expr(f"shiftright(pos, {BITS} * (h - {int(band == 0)}))"))
        done = kept.select("tree", "levels", "block", "pos", "digest").groupBy("tree", "levels", "block").applyInPandas(_maker(band), "tree string, levels int, block long, address long, nodes binary, below binary, n_below int, root binary")
        blocks.append(stored(done, "merkle-blocks"))
        level = blocks[-1].select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"), "levels")
        ended = blocks[-1].filter(F.col("address") == 0).select("tree", "levels", "root")
        roots = ended if roots is None else roots.unionByName(ended)
        band += 1
    return Trees(blocks, roots)


def bottom_proofs(trees: Trees, above: DataFrame) -> DataFrame:
    """(tree, block, levels, nodes, n_below, above): the bottom blocks with the siblings above their roots; ``above`` (tree, above, n_above) holds those above each tree's root."""
    given = above.select("tree", F.lit(0).cast("long").alias("address"), "above", "n_above")
    for band in reversed(range(1, len(trees.blocks))):

        def hand_down(batches: Iterator[pd.DataFrame], band: int = band) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    own = bands(r.levels)
                    depth = sum(own[band:])  # of the block roots below
                    below, bottom = r.below.hex(), -(-r.n_below // ARITY)
                    texts, up = level_texts(r.nodes, own[band], bottom), unpacked(r.above, r.n_above)
                    index = [(r.block << BITS * own[band]) + k for k in range(r.n_below)]
                    paths = [[siblings(below, k), *path_up(texts, k // ARITY), *up] for k in range(r.n_below)]
                    yield pd.DataFrame({"tree": r.tree, "address": [address(r.levels, depth, i) for i in index], "above": [packed(p) for p in paths], "n_above": [len(p) for p in paths]})

        here = trees.blocks[band].join(given, ["tree", "address"])
        handed = stored(here.select("tree", "levels", "block", "nodes", "below", "n_below", "above", "n_above").mapInPandas(hand_down, "tree string, address long, above string, n_above int"), "merkle-above")
        given = given.join(trees.blocks[band].select("tree", "address"), ["tree", "address"], "left_anti").unionByName(handed)  # trees without this band keep what they were given
    return trees.blocks[0].join(given, ["tree", "address"]).select("tree", "block", "levels", "nodes", "n_below", "above", "n_above")


def proofs(trees: Trees, above: DataFrame, rows: DataFrame, kept: dict[str, str]) -> DataFrame:
    """For each of rows (tree, pos, leaf, other) beside the columns ``kept`` (name to type): proof_sha256, n_proof, folded, the root folded from ``other`` where it is not null and else from the leaf."""
    first = F.element_at(F.array(*(F.lit(ARITY ** (bands(n)[0] - 1)) for n in range(1, MOST_LEVELS + 1))), F.col("levels"))
    bottom = stored(bottom_proofs(trees, above), "merkle-bottom")
    sized = stored(trees.roots.select("tree", "levels"), "merkle-levels")
    side = F.broadcast(sized) if sized.count() <= BROADCAST_GROUPS else sized
    placed = rows.join(side, "tree").withColumn("block", F.floor(F.col("pos") / first).cast("long")).withColumn("at", (F.col("pos") - F.col("block") * first).cast("int"))
    names = list(kept)

    def prove(own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        texts, up = level_texts(b["nodes"], bands(int(b["levels"]))[0], int(b["n_below"])), unpacked(b["above"], int(b["n_above"]))
        rest = "".join(left + right for left, right in up)
        out = []
        for at, leaf, other in zip(own["at"], own["leaf"], own["other"]):
            path = path_up(texts, at)
            said = "".join(left + right for left, right in path) + rest
            out.append((hashlib.sha256(said.encode()).hexdigest(), len(path) + len(up), fold((leaf if other is None else other).hex(), [*path, *up])))
        found = own[names].copy()
        found[["proof_sha256", "n_proof", "folded"]] = pd.DataFrame(out, index=own.index, columns=["proof_sha256", "n_proof", "folded"])
        return found

    schema = ", ".join(f"{n} {t}" for n, t in kept.items()) + ", proof_sha256 string, n_proof int, folded string"
    return placed.select("tree", "block", "at", "leaf", "other", *(n for n in names if n not in ("tree", "leaf"))).groupBy("tree", "block").cogroup(bottom.groupBy("tree", "block")).applyInPandas(prove, schema)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, other: Column | None = None) -> tuple[DataFrame, Trees, Trees]:
    """The rows' digests in their places (tree, pos, id, leaf, other), the trees of the groups, and the tree over their roots.

    ``other`` is a digest that a row is to be verified with instead of its own, or null.
    """
    ship(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("!"))  # null before all
    digests = stored(
        docs.select(tree.alias("tree"), F.col(order).cast("long").alias("id"), record_digest(*map(F.col, columns)).alias("leaf"), (F.lit(None).cast("binary") if other is None else other).alias("other"), F.monotonically_increasing_id().alias("row")), "merkle-leaves"
    )
    placed = placed_within(digests, "tree", ["id", "leaf", "row"], "pos").withColumn("pos", F.col("pos") - 1)
    groups = build(placed.select("tree", "pos", F.col("leaf").alias("digest")), digests.groupBy("tree").agg(F.count("*").alias("n")))
    ordered = with_positions(groups.roots, "tree").select(F.lit("*").alias("tree"), (F.col("position") - 1).alias("pos"), F.col("root").alias("digest"), F.col("tree").alias("own"))
    ordered = stored(ordered, "merkle-roots")
    return placed, groups, build(ordered, ordered.groupBy("tree").agg(F.count("*").alias("n")))


def verified(docs: DataFrame, columns: list[str], group: str, order: str, other: Column | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs."""
    spark = docs.sparkSession
    placed, groups, top = manifest(docs, columns, group, order, other)
    none = spark.range(1).select(F.lit("*").alias("tree"), F.lit("").alias("above"), F.lit(0).alias("n_above"))
    # The proofs of the groups' roots in the tree over them are what each group's tree is given from above.
    given = stored(root_paths(top, none, groups), "merkle-given")
    found = proofs(groups, given.select("tree", "above", "n_above"), placed, {"tree": "string", "id": "long", "leaf": "binary"})
    side = given.select("tree", "subroot").crossJoin(top.roots.select(F.lower(F.hex("root")).alias("root")))  # one row, the root
    joined = found.join(F.broadcast(side) if given.count() <= BROADCAST_GROUPS else side, "tree")
    return joined.select(F.col("id").alias(order), F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def root_paths(top: Trees, none: DataFrame, groups: Trees) -> DataFrame:
    """(tree, subroot, above, n_above): the proof of each group's root in the tree over them."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                height = bands(r.levels)[0]
                texts, up = level_texts(r.nodes, height, r.n_below), unpacked(r.above, r.n_above)
                paths = [[*path_up(texts, k), *up] for k in range(r.n_below)]
                yield pd.DataFrame({"pos": [(r.block << BITS * (height - 1)) + k for k in range(r.n_below)], "above": [packed(p) for p in paths], "n_above": [len(p) for p in paths]})

    paths = bottom_proofs(top, none).mapInPandas(each, "pos long, above string, n_above int")
    named = with_positions(groups.roots, "tree").select("tree", (F.col("position") - 1).alias("pos"), F.lower(F.hex("root")).alias("subroot"))
    return named.join(paths, "pos").select("tree", "subroot", "above", "n_above")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    changed = [F.col(c) for c in FIELDS[:-1]] + [F.translate("text", UPPER, LOWER)]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, record_digest(*changed))
    return verified(table(spark, sf_dir, "documents"), FIELDS, "lang", "doc_id", tampered)


#: CRC-32 of a text of ASCII characters: eight shifts for each.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT)"


def _tree_sql(name: str, levels: int, by: str) -> str:
    """CTEs {name}0 (by, i, h) to {name}{levels}, with the neighbours of each node in its run; {name}_root (by, h)."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k}s AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n, coalesce(string_agg(h, '') OVER (PARTITION BY {by}, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY {by}, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT {by}, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k}s WHERE n > 1 GROUP BY {by}, i // 8)")
    roots = " UNION ALL ".join(f"SELECT {by}, h FROM {name}{k}s WHERE n = 1" for k in range(levels))
    return ",\n".join([*out, f"{name}_root AS ({roots})"])


def _folds_sql(name: str, levels: int, by: str, start: str, index: str) -> str:
    """CTEs {name}f0 to {name}f{levels}: the columns of ``start`` with proof and fold carried up through the levels."""
    out = [f"{name}f0 AS (SELECT * FROM {start})"]
    for k in range(levels):
        out.append(f"{name}f{k + 1} AS (SELECT f.* REPLACE (proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.h IS NULL THEN fold ELSE sha256(s.l || fold || s.r) END AS fold) FROM {name}f{k} f LEFT JOIN {name}{k}s s ON s.{by} = f.{by} AND s.i = f.{index} // {8**k} AND s.n > 1)")
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    return f"sha256({' || '.join(map(part, [*FIELDS[:-1], text]))})"


SQL = {
    "op12_merkle_manifest": f"""
    WITH d AS (SELECT doc_id, coalesce('+' || lang, '!') AS tree, {_leaf_sql('text')} AS leaf, CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
    g0 AS (SELECT tree, i, leaf AS h FROM p),
    {_tree_sql('g', 7, 'tree')},
    t0 AS (SELECT 1 AS one, row_number() OVER (ORDER BY tree) - 1 AS i, h, tree FROM g_root),
    {_tree_sql('t', 4, 'one').replace('SELECT *, count(*)', 'SELECT one, i, h, count(*)')},
    gs AS (SELECT doc_id, tree, i, leaf, coalesce(other, leaf) AS fold, '' AS proof FROM p),
    {_folds_sql('g', 7, 'tree', 'gs', 'i')},
    ts AS (SELECT g.*, 1 AS one, t0.i AS j, t0.h AS subroot FROM gf7 g JOIN t0 USING (tree)),
    {_folds_sql('t', 4, 'one', 'ts', 'j')}
    SELECT doc_id, leaf, subroot, t_root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t_root.h AS verified FROM tf4 CROSS JOIN t_root
    """
}
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
