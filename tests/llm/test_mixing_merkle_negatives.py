"""Mixing, Merkle manifest and hard negatives: against SQL, plain loops and by their laws."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyspark.sql.functions as F
import pytest

from quernstone.llm import merkle, mixing, negatives

TABLES = ("documents", "embeddings")


@pytest.mark.parametrize("module", [mixing, merkle, negatives])
def test_queries_match_sql(spark, sf_dir, module):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, run in module.QUERIES.items():
        got, want = run(spark, sf_dir).toPandas(), con.execute(module.SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and len(got)
        plain = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).astype(str).values.tolist()))  # noqa: B023, E731
        assert plain(got) == plain(want)


# mixing


def targets_by_hand(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight; what lies above a cap is shared again among the others, until none does."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in held)
        free = [s for s in names if s not in held]
        got = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free} | {s: float(most * sizes[s]) for s in held}
        above = {s for s in free if got[s] > most * sizes[s]}
        if not above:
            return got
        held |= above


def check_mix(rows, found):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most = {}, {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
        most[source] = max(most.get(source, 0), words(text))
    target = targets_by_hand(sizes)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in found) == sorted((i is None, i or 0, words(t)) for i, _, t in rows)
    taken = {}
    for r in found:
        assert 0 <= r["copies"] <= 2
        key = (round(r["target"], 6), r["source_size"])
        taken[key] = taken.get(key, 0) + r["size"] * r["copies"]
    for s, t in target.items():
        if list(target.values()).count(t) == 1:
            assert abs(taken.get((round(t, 6), sizes[s]), 0) - t) <= most[s] + 1e-6


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "𐍈", None]), "w " * rng.choice([0, 1, 5, 40, 900 if i % 97 == 0 else 3])) for i in range(3000)] + [(9000, "tiny", "one two"), (9001, "empty", ""), (9002, "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"tree": F.lit(1), "p": F.lit("x"), "n": F.lit(2), "target": F.lit(0)})
    found = mixing.mix(df.repartition(7), id_col="doc_id").collect()
    check_mix(rows, found)
    again = mixing.mix(df.repartition(3).orderBy("text"), id_col="doc_id").collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    copies = {r["doc_id"]: r["copies"] for r in found}
    assert {r["doc_id"]: r["n"] for r in mixing.mixture(df.drop("n"), mixing.mix(df)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {i: n for i, n in copies.items() if n}


def test_fraction_is_each_documents_chance(spark):
    """Over seeds a document is taken as often as its fraction says, whatever its size."""
    rows = spark.createDataFrame([(1, i, i, 1 + i * i, 0.3) for i in range(40)], "tree long, n long, id long, size long, p double")
    taken = np.zeros(40)
    for seed in range(60):
        got = mixing.folded(rows, 0, seed).select(F.explode("done").alias("d"), F.col("left")).collect()
        for r in got:
            taken[r["d"]["id"]] += r["d"]["up"]
        left = got[0]["left"]
        taken[left["id"]] += left["p"]
        whole = sum(r["d"]["size"] * r["d"]["up"] for r in got) + left["size"] * left["p"]
        assert abs(whole - 0.3 * sum(1 + i * i for i in range(40))) < 1e-6
    assert abs(taken.mean() / 60 - 0.3) < 0.05 and (taken > 0).all() and (taken < 60 * 0.8).all()


def test_mix_of_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in odd_docs.collect()]
    check_mix(rows, mixing.mix(odd_docs).collect())
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "a", " "), (2, None, None)], "doc_id long, source string, text string")
    assert [(r["target"], r["size"] * r["copies"]) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2


# Merkle manifest


def merkle_by_hand(rows):
    """rows (doc_id, source, lang, n_chars, text): per row the contract's columns, by plain lists."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(part, r)))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def walk(levels, i, digest):
        said = ""
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            left, right = "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
            said, digest, i = said + left + right, sha(left + digest + right), i // 8
        return said, digest

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: tree([leaf(r) for r in by[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if r[4] is not None else None
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            said, digest = walk(trees[x], i, leaf((*r[:4], low)) if tampered else leaf(r))
            more, digest = walk(top, j, digest)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha(said + more), digest, digest == top[-1][0]))
    return out


def checked(docs):
    changed = [F.col(c) for c in merkle.FIELDS[:-1]] + [F.translate("text", merkle.UPPER, merkle.LOWER)]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.record_digest(*changed))
    return merkle.verified(docs, merkle.FIELDS, "lang", "doc_id", tampered)


def same_rows(got, want):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(str(tuple(r[n] for n in names)) for r in got) == sorted(map(str, want))


def test_layout_is_a_bijection_by_halves():
    for levels in range(1, 6):
        at = [merkle.address(levels, d, i) for d in range(levels) for i in range(8**d)]
        assert sorted(at) == list(range(merkle.full(levels)))
    for levels in range(1, merkle.MOST_LEVELS + 1):
        own = merkle.bands(levels)
        assert sum(own) == levels and max(own) <= merkle.BLOCK_LEVELS
        depth = sum(own[1:])
        last = 8**depth - 1  # a stored block lies at its root's address in one piece
        inner = [merkle.address(levels, depth + d, (last << 3 * d) + i) - merkle.address(levels, depth, last) for d in range(own[0]) for i in range(8**d)]
        assert inner == [merkle.address(own[0], d, i) for d in range(own[0]) for i in range(8**d)]
    assert merkle.address(21, 20, 8**20 - 1) == merkle.full(21) - 1 < 2**63


def test_trees_of_one_and_of_many_bands(spark):
    rng = random.Random(5)
    langs = ["hot"] * 5000 + ["b"] * 600 + ["é"] * 65 + ["z"] + [None] * 9
    rows = [(i if i % 50 else 7, f"s{i % 3}" if i % 4 else None, x, i % 11 or None, None if i % 41 == 0 else "".join(rng.choice("aBcD é|:") for _ in range(i % 13))) for i, x in enumerate(langs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"tree": F.lit(1), "pos": F.lit("x"), "leaf": F.lit(0)})
    same_rows(checked(df.repartition(5)).collect(), merkle_by_hand(rows))


def test_manifest_of_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd_docs.collect()]
    same_rows(checked(odd_docs).collect(), merkle_by_hand(rows))
    assert checked(odd_docs.limit(0)).count() == 0
    one = odd_docs.limit(1)
    same_rows(checked(one).collect(), merkle_by_hand([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in one.collect()]))


# hard negatives


def mined_by_hand(rows):
    """rows (vec_id, embedding, label) as the operator's docstring has them."""
    own = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((k, i, [int(np.floor(256 * x)) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    last = lambda c: (-c[0], c[1] is None, c[1] or 0)
    for k, i, v, label in own:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m == label) for n, j, w, m in own if n != k]
        for p, j, _ in sorted((c for c in scored if c[2]), key=last)[:5]:
            hard = sorted((c for c in scored if not c[2] and 30 * p <= 100 * c[0] <= 90 * p), key=last)[:10]
            out += [(i, j, n + 1, c[1], p, c[0]) for n, c in enumerate(hard)]
    return out


def mined(spark, rows, kind="array<double>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").withColumns({"anchor": F.lit(1), "id": F.lit("x"), "x": F.lit(2), "slot": F.lit(0)})
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, label=changed).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return [tuple(r[n] for n in names) for r in got]


def test_mined_like_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for n, dim, labels in ((900, 6, 10), (700, 2, 3), (400, 5, 1)):
        x = rng.normal(size=(n, dim)).round(2 if dim > 2 else 1)  # many ties with two components
        rows = [(int(i), [float(c) for c in x[i]], int(rng.integers(labels))) for i in range(n)]
        assert sorted(mined(spark, rows)) == sorted(mined_by_hand(rows))
    monkeypatch.setattr(negatives, "ANCHORS", 2)  # several batches of anchors
    assert sorted(mined(spark, rows)) == sorted(mined_by_hand(rows))


def test_mined_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [0.5, 1.0], 1), (1, [1.0], 1), (2, [0.9, 0.4], 2), (2, [0.9, 0.4], 2), (None, [0.9, 0.4], 2), (None, [0.9, 0.4], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [1.0, -inf], 2), (6, [None, 1.0], 2), (8, [0.7, 0.3], None), (9, [0.5, 0.5], 3), (200, [-1.0, 0.1], 2), (300, [], 2), (400, [1e7, 1.0], 4), (401, [9e6, 1.0], 4), (402, [5e6, 1.0], 5)]
    key = lambda t: tuple((c is None, c or 0) for c in t)
    got = sorted(mined(spark, rows), key=key)
    assert got == sorted(mined_by_hand(rows), key=key) and any(r[0] == 400 for r in got)
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0


def test_exact_beyond_doubles():
    big = np.array([[2.0**31, 3.0], [2.0**30, -1.0]])
    assert negatives.products(big, big)[0, 0] == 2**62 + 9
    with pytest.raises(OverflowError):
        negatives.products(big * 2**10, big)
