"""Registered queries on their whole tables, against plain loops."""

import numpy as np

from quernstone.llm import ngram_join, packing, quality

from test_models import posteriors
from test_ngram_join import brute, got
from test_packing_sharding import check_packing


def documents(spark, sf_dir, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns).collect()]


def test_near_duplicates(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "text")
    want = brute(rows)
    assert got(ngram_join.op5_ngram_jaccard_join(spark, sf_dir)) == want and any(w[2] for w in want)


def test_packing(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "text")
    found = packing.op7_best_fit_packing(spark, sf_dir).collect()
    used = check_packing(rows, found, 2048)
    assert used <= -(-sum(r["length"] for r in found) // 2048) + 1  # so many tokens need as many sequences at least


def test_quality(spark, sf_dir):
    """Site evidence and posteriors of the query from its own document evidence, by hand."""
    found = {r["doc_id"]: r for r in quality.op4_quality_classifier(spark, sf_dir).collect()}
    rows = documents(spark, sf_dir, "doc_id", "source", "lang", "text")
    assert len(found) == len(rows)
    said = [(i, s, f"{s or ''}/{x or ''}") for i, s, x, t in rows if t and t.strip()]
    docs = spark.createDataFrame([(s, p, found[i]["document_p"]) for i, s, p in said], "host string, path string, p double")
    one = quality.sites_of(docs).first()
    by_hand = posteriors([(s, p, found[i]["document_p"]) for i, s, p in said], (one["mean"], one["host_k"], one["path_k"]))
    for (i, *_), (site, posterior) in zip(said, by_hand):
        assert np.isclose(found[i]["site_p"], site, atol=1e-6) and np.isclose(found[i]["posterior"], posterior, atol=1e-6)
        assert found[i]["accepted"] == (found[i]["posterior"] >= quality.THRESHOLD)
    assert all(not found[i]["accepted"] for i, _, _, t in rows if not (t and t.strip()))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(found[i]["accepted"], labels[i]) for i in found if i in labels]
    assert np.mean([a == bool(q) for a, q in judged]) > 0.95
