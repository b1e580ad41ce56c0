import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quernstone.llm import exact_dedup as m


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = Counter()
    for own in groups.values():
        keep = min(own, key=lambda r: (-len(r[1]), (r[0] is not None, r[0] or 0)))[0]
        for i, _ in own:
            out[i, keep, len(own), i == keep] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def test_odd_rows(spark, odd_docs):
    assert got(m.exact_dedup(odd_docs)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


@pytest.mark.parametrize("bits", [2, 4, 63])
def test_collisions_chain_and_bytes_decide(spark, bits):
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(m.exact_dedup(df, capacity=4, bits=bits)) == brute(rows)


@pytest.mark.parametrize("broadcast, hot", [(500_000, 20_000), (0, 20_000), (0, 3)])
def test_hot_group(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(m, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(m, "HOT_GROUPS", hot)
    rows = [(i, "same" if i % 3 else f"t{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(m.exact_dedup(df)) == brute(rows)


def test_extreme_and_null_ids(spark):
    rows = [(-(1 << 63), "a"), (1, "a"), (None, "b"), (2, "b "), (None, "c"), (None, "c"), ((1 << 63) - 1, "a b"), (3, "d")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, sha string")
    assert got(m.exact_dedup(df)) == brute(rows)


def test_directory_doubles_only_where_overfull():
    buckets = m.grow_directory({0: 9, 1: 1, 2: 1, 3: 1}, 2, 4)
    assert buckets == [(0, 2), (1, 2), (1, 1)]
    assert m.grow_directory({}, 3, 4) == [(0, 0)]


def test_empty(spark):
    assert m.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(m.SQL["op1_exact_dedup"]).df()
    have = m.op1_exact_dedup(spark, sf_dir).toPandas()[want.columns]
    assert sorted(map(tuple, want.values.tolist())) == sorted(map(tuple, have.values.tolist()))
