import re
from collections import Counter

import corpus_pipeline as m
from quernstone import tables
from quernstone.llm import common
from quernstone.llm.ngram_join import shingles, word_sequence


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for name, stage in m.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"test-{name}")
        kept.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in docs.collect()]
            assert len(set(texts)) == len(texts)
        if name == "near_dedup":
            sets = [set(shingles(word_sequence(r["text"])).tolist()) for r in docs.collect()]
            assert not [1 for i, a in enumerate(sets) for b in sets[:i] if a and b and len(a & b) >= 0.8 * len(a | b)]
    assert kept[:4] == sorted(kept[:4], reverse=True)


def test_odd_rows(spark, odd_docs, sf_dir):
    """Each stage drops what its rule names and nothing else."""
    docs, rows, previous = odd_docs, {}, odd_docs.collect()
    for name, stage in m.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"odd-{name}")
        assert name == "packing" or docs.columns == odd_docs.columns
        now = rows[name] = docs.collect()
        left = Counter(map(tuple, previous))
        if name == "packing":
            assert sorted({str(r["doc_id"]) for r in now}) == sorted({str(r["doc_id"]) for r in previous}) and sum(r["piece"] == 0 for r in now) == len(previous)
            break
        gone = left - Counter(map(tuple, now))
        assert not Counter(map(tuple, now)) - left
        bare = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        if name == "quality":
            assert all((r["text"] or "").strip() for r in now)
            assert {1, 2, 3} <= {r[0] for r in gone}
        if name == "exact_dedup":
            want = {}
            for r in previous:
                key = (-len(r["text"]), r["doc_id"] is not None, r["doc_id"] or 0)
                want[bare(r)] = min(want.get(bare(r), key), key)
            assert sorted((bare(r), (-len(r["text"]), r["doc_id"] is not None, r["doc_id"] or 0)) for r in now) == sorted(want.items())
        if name == "near_dedup":
            sets = [set(shingles(word_sequence(r["text"])).tolist()) for r in now]
            for r in gone:  # what went is near what stayed
                own = set(shingles(word_sequence(r[1])).tolist())
                assert any(own and len(own & s) >= 0.8 * len(own | s) for s in sets)
        previous = now
    empty = odd_docs.limit(0)
    for name, stage in m.STAGES:
        empty = common.stored(stage(spark, empty, sf_dir), f"none-{name}")
    assert empty.count() == 0


def test_many_ids_to_drop(spark, odd_docs, sf_dir, monkeypatch):
    """Ids to drop that are too many to broadcast are joined by a shuffle."""
    want = Counter(tuple(r) for r in m.drop_exact(spark, odd_docs, sf_dir).collect())
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    assert Counter(tuple(r) for r in m.drop_exact(spark, odd_docs, sf_dir).collect()) == want


def test_run(spark, sf_dir):
    at = tables.made()
    rows = m.run(spark, sf_dir)
    assert rows.count() > 0 and tables.made() == at + 1  # what the stages stored on their way is gone
