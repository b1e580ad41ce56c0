import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import packing as p, sharding as s


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(p.byte_bpe())


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a \n b  c\n\n d ", "x<|endoftext|> y<|endoftext|>", "it's 'tis don't", "  x", "日本語 é\r\n z ", "a\x1c b \x85 c", "word " * 50 + "\n \n"])
def test_ids_are_the_librarys(text):
    assert np.frombuffer(p.encoder(p.byte_bpe()).ids(text), dtype="<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def check_packing(rows, found, sequence):
    own = {}
    for r in found:
        own.setdefault((r["doc_id"], r["piece"], r["start"]), []).append(r)
    tk = tokenizer()
    want = []
    for i, t in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % sequence or sequence
        cuts = [0, *range(first, len(ids) + 1, sequence)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str)
    spans = {}
    for r in found:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= sequence
    return len(spans)


def test_packing(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_packing(rows, p.pack(odd_docs, p.byte_bpe(), sequence=512).collect(), 512)


def test_packing_in_rounds(spark, make_text):
    rows = [(i, make_text(i, 1 + i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = check_packing(rows, p.pack(df, p.byte_bpe(), sequence=128).collect(), 128)
    more = check_packing(rows, p.pack(df, p.byte_bpe(), sequence=128, items_per_task=100).collect(), 128)
    assert more <= few * 1.05 + 2
    assert p.pack(df.limit(0), p.byte_bpe()).count() == 0


def test_sum_of_squares_is_near_the_bound():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 1500) for _ in range(3000)), reverse=True)
    bins, offsets, fill = p.sum_of_squares(sizes, 2048)
    assert max(fill) <= 2048 and sum(fill) == sum(sizes)
    assert len(fill) <= max(s.best_fit(sizes, 2048)) + 1 + 3
    assert len(fill) <= -(-sum(sizes) // 2048) * 1.02


def test_sum_of_squares_like_a_scan():
    """Every open sequence that holds the piece is tried; the sum of squares decides, then the tightest."""
    rng = random.Random(3)
    for _ in range(20):
        capacity = rng.choice([20, 64])
        sizes = sorted((rng.randint(1, capacity) for _ in range(120)), reverse=True)
        gaps, want = [], []
        squares = lambda g: sum(c * c for v, c in Counter(g).items() if v)
        for x in sizes:
            tried = [(squares([*gaps[:i], g - x, *gaps[i + 1 :]]), g) for i, g in enumerate(gaps) if g >= x]
            if tried:
                i = next(i for i, g in enumerate(gaps) if g == min(tried)[1])
                gaps[i] -= x
            else:
                gaps.append(capacity - x)
            want.append(sorted(gaps))
        bins, _, _ = p.sum_of_squares(sizes, capacity)
        left = Counter()
        for x, b, gaps in zip(sizes, bins, want):
            left[b] += x
            assert sorted(capacity - f for f in left.values()) == gaps


def test_pieces_over_half_a_sequence_end_the_rounds(spark):
    items = spark.createDataFrame([(i, 70 + i % 50) for i in range(300)], "item long, length long")
    found = p.pack_items(items, 128, items_per_task=50).collect()
    assert len({r["bin"] for r in found}) == len(found) == 300


def test_capacity_is_near_the_least():
    rng = random.Random(4)
    sizes = sorted((rng.randint(1, 10_000) for _ in range(300)), reverse=True)
    at, bins = s.least_capacity(sizes, 12)
    assert max(bins) < 12 and at <= -(-sum(sizes) // 12) * (1 + 3 / 4096) + 1
    assert s.least_capacity([7, 5, 5], 2)[0] == 10


def test_sharding_of_rows_alike(spark):
    """A third of the rows have no id and one text; columns have names that are used inside."""
    rows = [(None, "same text", 1)] * 700 + [(i, f"text {i} " * (i % 9), 2) for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumns({"g": F.lit("x"), "size": F.lit(0), "chunk": F.lit(1)}).repartition(6)
    found = s.shard(df, 6).collect()
    sizes = check_shards(rows, found, 6)
    assert max(sizes.values()) / min(sizes.values()) < 1.05


def test_best_fit_like_a_scan():
    rng = random.Random(2)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 60) for _ in range(80)), reverse=True)
        left, want = [], []
        for x in sizes:
            fits = [(r, i) for i, r in enumerate(left) if r >= x]
            if fits:
                i = min(fits)[1]
                left[i] -= x
            else:
                i = len(left)
                left.append(100 - x)
            want.append(i)
        assert s.best_fit(sizes, 100) == want


def check_shards(rows, found, shards):
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by) <= set(range(shards))
    return {k: sum(r["size"] for r in own) for k, own in by.items()}


def test_sharding(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_shards(rows, s.shard(odd_docs, 4).collect(), 4)
    assert s.shard(odd_docs.limit(0), 4).count() == 0


def test_sharding_even_with_a_hot_group(spark, make_text):
    rows = [(i, make_text(i, 10 + i % 50)) for i in range(1500)] + [(5000 + i, make_text(7777, 30)) for i in range(700)] + [(9000 + i, make_text(8000 + i // 4, 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = s.shard(df, 8).collect()
    sizes = check_shards(rows, found, 8)
    assert max(sizes.values()) / min(sizes.values()) < 1.02 and len(sizes) == 8
    where = {r["doc_id"]: r["shard"] for r in found}
    for g in range(50):
        assert len({where[9000 + 4 * g + k] for k in range(4)}) == 1
    assert all(r["size"] == len((dict(rows)[r["doc_id"]]).encode()) + 16 for r in found[:50])


@pytest.mark.parametrize(("sizes", "shards", "crates"), [([3] * 1700, 40, 512), ([5] * 1700, 40, 512), ([1, 2, 3, 4, 5] * 400, 40, 512), ([3] * 400, 4, 120), ([2] * 900 + [900] * 2 + [30] * 40, 7, 64)])
def test_groups_that_fit_a_shard_stay_whole(spark, sizes, shards, crates):
    """Thousands of groups around a crate's capacity, above and below it: each in one shard, and shards of nearly one size."""
    rows = [(n * 1000 + k, f"group {n:06d} " + "x" * 147) for n, c in enumerate(sizes) for k in range(c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = s.shard(df, shards, crates_per_shard=crates).collect()
    filled = check_shards(rows, found, shards)
    where = {}
    for r in found:
        where.setdefault(r["doc_id"] // 1000, set()).add(r["shard"])
    row = len(rows[0][1]) + 16
    fits = [g for g, c in enumerate(sizes) if c * row <= -(-len(rows) * row // shards)]
    assert len(fits) > 300 and all(len(where[g]) == 1 for g in fits)
    mean = len(rows) * row / shards
    assert len(filled) == shards and max(filled.values()) - mean <= max(0.01 * mean, max(sizes[g] for g in fits) * row)


def test_sharding_query(spark, sf_dir):
    """The registered query on its table: sizes, digests, gapless slots, groups whole, sizes near equal."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = s.op10_sharding(spark, sf_dir).collect()
    check_shards(docs, found, 40)
    where = {}
    for r in found:
        text = docs[r["doc_id"]].encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and r["grown_shard"] is None
        where.setdefault(text, []).append((r["shard"], r["size"]))
    full = -(-sum(r["size"] for r in found) // 40)
    assert all(len({x for x, _ in own}) == 1 for own in where.values() if sum(n for _, n in own) <= full)
