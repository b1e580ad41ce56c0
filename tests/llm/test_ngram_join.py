import random
from collections import defaultdict

import numpy as np

from quernstone.llm import ngram_join as m


def brute(rows):
    sets = [m.shingles(m.word_sequence(t or "")) for _, t in rows]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if len(sets[i]) and len(sets[j]):
                c = len(np.intersect1d(sets[i], sets[j]))
                if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    parent[root(j)] = root(i)
    members = defaultdict(list)
    for i in range(n):
        members[root(i)].append(rows[i][0])
    least = {k: min(v, key=lambda x: (x is not None, x or 0)) for k, v in members.items()}
    return sorted(((rows[i][0], least[root(i)], links[i], len(members[root(i)])) for i in range(n)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["class_size"]) for r in df.collect()), key=str)


def test_odd_rows(spark, odd_docs):
    found = m.near_duplicates(odd_docs)
    assert got(found) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert found.filter("kept").count() <= found.count()


def test_near_copies_and_blocks(spark, make_text, monkeypatch):
    rng, rows = random.Random(5), []
    for g in range(12):
        base = make_text(100 + g, 80).split()
        for k in range(rng.randint(1, 9) if g else 60):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"new{g}x{k}"
            rows.append((len(rows), " ".join(words) + rng.choice(["", ".", " "])))
    shared = make_text(999, 40)
    rows += [(1000 + i, make_text(2000 + i, 60) + " " + shared) for i in range(30)]  # a passage in common isn't a copy
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert got(m.near_duplicates(df)) == want
    monkeypatch.setattr(m, "BLOCK_ROWS", 16)
    monkeypatch.setattr(m, "PART_ROWS", 16)
    monkeypatch.setattr(m, "BROADCAST_BYTES", 0)
    assert got(m.near_duplicates(df)) == want
    kept = m.near_duplicates(df).filter("kept").count()
    assert kept == len({w[1] for w in want})


def test_large_group_at_all_distances(spark, make_text, monkeypatch):
    """Copies whose distances from the leader fall into every class, repeated rows and a chain to texts far from it."""
    monkeypatch.setattr(m, "PART_ROWS", 32)
    monkeypatch.setattr(m, "BLOCK_ROWS", 20)
    rng, base, rows = random.Random(7), make_text(7, 150).split(), []
    for k in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 7])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    for k in range(60):  # each a step further
        base[rng.randrange(len(base))] = f"step{k}"
        rows.append((1000 + k, " ".join(base)))
    rows += rows[:20] + [(5000, rows[3][1] + "."), (None, rows[4][1]), (None, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(m.near_duplicates(df)) == brute(rows)


def test_classes_of_distances():
    sure, open_ = m.class_pairs(0.8)
    assert (0, 0) in sure and (1, 1) in sure and (0, 2) in sure and (1, 2) not in sure
    assert (0, 3) in open_ and (0, 6) not in open_ and (6, 6) in open_ and not set(sure) & set(open_)


def test_long_unrelated_texts_are_pruned():
    rng = np.random.default_rng(11)
    some = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    least = m.least_matches(0.8, 1e-6)
    for n in (100, 1_000, 10_000):
        common = some(n)
        near = [np.concatenate([common, some(n // 20)]) for _ in range(2)]
        mins = np.stack([m.bytes_of(m.min_hashes(s)) for s in (some(n), some(n), *near)])
        i, j = m.candidates(np.triu(np.ones((4, 4), dtype=bool), 1), mins, least)
        assert list(zip(i, j)) == [(2, 3)]


def test_pruning_is_rare_above_the_threshold():
    least = m.least_matches(0.8, 1e-6)
    assert list(least) == [32, 64, 96, 128] and least[128] > 0.6 * 128


def test_empty(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["v"]: r["c"] for r in m.components(links).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_texts_of_one_hash_are_told_apart(spark):
    """Six texts with two values of the first 64 bits, some repeated, and one without words."""
    rows = [(i, i, i % 2, i % 6, None, 1) for i in range(18)] + [(99, 99, None, None, None, 0)]
    df = spark.createDataFrame(rows, "id long, t long, v long, w long, bands array<long>, chars long")
    sketches, texts = m.told_apart(df)
    by = {}
    for r in sketches.collect():
        by.setdefault(r["w"], set()).add(r["v"])
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == 7 and by[None] == {None}
    assert sorted(r["copies"] for r in texts.collect()) == [3] * 6 and sketches.columns == df.columns
