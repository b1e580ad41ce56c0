"""Classifiers, licences, BPE and neighbours."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import ann, bpe, language_id, licences, quality
from quernstone.llm.common import table


def test_language_held_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = language_id.op9_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, odd_docs):
    got = language_id.identify(odd_docs, keep=["n_chars"]).collect()
    assert len(got) == odd_docs.count()
    assert sum(r["lang_pred"] == "und" for r in got) == 3
    none = language_id.identify(odd_docs, F.lit(False)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language_id.identify(odd_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        language_id.identify(odd_docs, keep=["score"])


def test_language_of_long_texts(spark):
    """Held-out texts of over 100,000 characters, of words rich enough to hold nearly every folded n-gram."""
    letters = {"de": "abcdefghijklmnopqrstuvwxyzäöüß", "en": "abcdefghijklmnopqrstuvwxyz", "fr": "abcdefghijklmnopqrstuvwxyzéèçàê", "tr": "abcdefghijklmnopqrstuvwxyzığşçö"}
    rng = np.random.default_rng(13)
    words = {}
    for lang, own in letters.items():  # letters follow each other by each language's own habit
        habit = rng.dirichlet(np.full(len(own), 0.3), size=len(own)) * 0.9 + 0.1 / len(own)
        words[lang] = []
        for _ in range(20_000):
            at = [int(rng.integers(len(own)))]
            for _ in range(int(rng.integers(2, 9))):
                at.append(int(np.searchsorted(np.cumsum(habit[at[-1]]), rng.random() * 0.999)))
            words[lang].append("".join(own[min(i, len(own) - 1)] for i in at))
    some = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, some(lang, 40), lang) for i, lang in enumerate(["en"] * 120 + ["de"] * 30 + ["fr"] * 30 + ["tr"] * 30)]
    rows += [(1000 + i, some(lang, 150_000), lang) for i, lang in enumerate(letters)]
    assert all(len(t) > 100_000 for i, t, _ in rows if i >= 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, F.col("doc_id") < 1000, keep=["lang"]).filter("doc_id >= 1000").collect()
    assert [(r["lang_pred"], r["score"] > 0.9) for r in got] == [(r["lang"], True) for r in got]


def test_presence_kernel_like_sets():
    a, b = "the cat sat", "the dog sat"
    grams = lambda t: {t[i : i + n] for n in language_id.ORDERS for i in range(len(t) - n + 1)}
    want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    x = np.stack([language_id.presence(a), language_id.presence(b)])
    assert abs(float(language_id.kernel(x, x)[0, 1]) - want) < 0.05


def test_quality_held_out(spark):
    """Fitted on half of the labels, judged by the other half."""
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    rows = quality.judge(docs, labels.filter(~odd), F.col("source"), quality.section()).join(labels.filter(odd), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    good = [r["accepted"] for r in rows if r["quality"] == 1]
    bad = [r["accepted"] for r in rows if r["quality"] == 0]
    assert len(good) > 50 and len(bad) > 20
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


def posteriors(rows, mean_k):
    """By hand: rows (host, path, p), the parameters of a site table; the site's p of each row without the row itself, and the posterior."""
    mean, host_k, path_k = mean_k
    logit = lambda p: np.log(p / (1 - p))
    out = []
    for k, (h, s, p) in enumerate(rows):
        host = [q for i, (a, _, q) in enumerate(rows) if i != k and a == h]
        path = [q for i, (a, b, q) in enumerate(rows) if i != k and (a, b) == (h, s)]
        of_host = (sum(host) + host_k * mean) / (len(host) + host_k)
        of_path = (sum(path) + path_k * of_host) / (len(path) + path_k)
        out.append((of_path, 1 / (1 + np.exp(-(logit(p) + logit(of_path) - logit(mean))))))
    return out


@pytest.mark.parametrize("broadcast", [100_000, 2, 0])
def test_site_evidence_decides(spark, monkeypatch, broadcast):
    """Documents that say little by themselves are accepted on good sites and paths and rejected on bad ones, as by hand."""
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast)
    odds = {"yes": 3.0, "no": -3.0, "maybe": 0.0}
    monkeypatch.setattr(quality, "train", lambda *a, **k: None)

    def evidence(docs, weights, text_col="_text"):
        value = F.coalesce(*(F.when(F.col(text_col) == t, F.lit(o)) for t, o in odds.items()))
        return docs.withColumn("_odds", value).drop(text_col)

    monkeypatch.setattr(quality, "evidence", evidence)
    texts = [("fine", "a", "yes")] * 60 + [("fine", "b", "no")] * 60 + [("poor", "a", "no")] * 60 + [("fine", "a", "maybe"), ("fine", "b", "maybe"), ("poor", "a", "maybe"), ("poor", "new", "maybe"), ("new", None, "maybe"), (None, None, "yes")]
    df = spark.createDataFrame([(i, h, s, t, "x") for i, (h, s, t) in enumerate(texts)], "doc_id long, host string, path string, text string, mean string")
    got = sorted(quality.judge(df, df, F.col("host"), F.col("path"), keep=["doc_id", "host", "path", "mean"]).collect(), key=lambda r: r["doc_id"])
    assert [(r["host"], r["path"], r["mean"]) for r in got] == [(h, s, "x") for h, s, _ in texts]
    rows = [(h, s, 1 / (1 + np.exp(-odds[t]))) for h, s, t in texts]
    site = quality.sites_of(spark.createDataFrame([(h, s, float(p)) for h, s, p in rows], "host string, path string, p double")).first()
    want = posteriors(rows, (site["mean"], site["host_k"], site["path_k"]))
    assert np.allclose([(r["site_p"], r["posterior"]) for r in got], want)
    assert [r["accepted"] for r in got[180:184]] == [True, False, False, False]


def test_quality_odd_rows(spark, odd_docs, sf_dir):
    got = quality.judge(odd_docs, table(spark, sf_dir, "labels"), F.col("source"), quality.section()).collect()
    assert len(got) == odd_docs.count()
    assert sorted(str(r["doc_id"]) for r in got if r["posterior"] == 0) == ["1", "2", "3"]
    nothing = table(spark, sf_dir, "labels").limit(0)
    assert quality.judge(odd_docs, nothing, F.col("source"), F.col("lang")).filter("accepted").count() == odd_docs.count() - 3
    assert quality.judge(odd_docs.limit(0), nothing, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [("big", "a", 0.9)] * 200 + [("bad", "a", 0.1)] * 200 + [("tiny", "a", 0.1)]
    sites = {r["host"]: r for r in quality.sites_of(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    mean = lambda s: (s["host_total"] + s["host_k"] * s["mean"]) / (s["host_n"] + s["host_k"])
    assert abs(mean(sites["bad"]) - 0.1) < 0.05
    assert mean(sites["tiny"]) > mean(sites["bad"])


@pytest.mark.parametrize("name", list(licences.TEMPLATES))
def test_licence_inside_a_text(name, make_text):
    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    text = make_text(1, 40) + ".\n" + licences.TEMPLATES[name][0].upper().replace(" ", "\n ", 3) + "\n" + make_text(2, 40)
    found = scanner.scan(text)
    assert name in {p["licence"] for p in found} or (name == "BSD-2-Clause" and "BSD-3-Clause" in {p["licence"] for p in found})
    assert not scanner.scan(make_text(3, 500))


def brute_licences(text, templates, threshold=0.8):
    """Every passage from one template bigram to another, tried one by one; of those that overlap the best stays."""
    w, found = licences.words_of(text), []
    for name, texts in templates.items():
        for t in texts:
            t = licences.words_of(t)
            mine = set(zip(t, t[1:]))
            at = [i for i in range(len(w) - 1) if (w[i], w[i + 1]) in mine]
            for i in at:
                best, own, upto = None, set(), i
                for j in (j for j in at if j >= i):
                    own.update(zip(w[upto : j + 1], w[upto + 1 : j + 2]))
                    upto = j + 1
                    score = 2 * len(own & mine) / (len(own) + len(mine))
                    if score >= threshold and (best is None or score > best[0]):
                        best = (score, len(mine), i, j + 2, name)
                if best:
                    found.append(best)
    out = []
    for p in sorted(found, key=lambda p: (-p[0], -p[1], p[2], p[4])):
        if all(p[3] <= o[2] or p[2] >= o[3] for o in out):
            out.append(p)
    return sorted((p[2], p[3], p[4], p[0]) for p in out)


def test_licence_like_brute_force():
    templates = {"x": ["alpha beta gamma delta epsilon zeta"], "y": ["one two three four"], "z": ["alpha beta one two"]}
    scanner = licences.Scanner(templates, 0.8)
    rng = np.random.default_rng(2)
    texts = ["alpha beta gamma delta epsilon", "q alpha beta gamma w delta epsilon zeta q", "one two three four one two three four", "alpha beta x gamma delta epsilon zeta one two three", ""]
    parts = ["alpha beta gamma delta epsilon zeta", "one two three four", "alpha beta", "one two", "gamma delta epsilon", "q", "four"]
    texts += [" ".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(300)]
    for text in texts:
        assert [(p["start"], p["end"], p["licence"], p["dice"]) for p in scanner.scan(text)] == brute_licences(text, templates)


def test_repeated_notice_is_linear():
    import time

    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    notice = licences.TEMPLATES["MIT notice"][0] + " "
    began = time.process_time()
    assert len(scanner.scan(notice * 4000)) == 4000
    short = " ".join(notice.split()[:4]) + " "  # never the whole notice, but for the end
    assert scanner.scan(short * 5000 + notice)
    assert time.process_time() - began < 4
    assert [(p["start"], p["end"], p["licence"], p["dice"]) for p in scanner.scan(notice * 20)] == brute_licences(notice * 20, licences.TEMPLATES)


def test_licence_query_like_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = licences.op2_licence_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r["n_passages"] for r in rows) > 0
    for r in rows:
        want = brute_licences(texts[r["doc_id"]], licences.TEMPLATES)
        assert [(p["start"], p["end"], p["licence"], p["dice"]) for p in json.loads(r["passages"])] == want
        assert (r["n_passages"], r["licences"], r["best_dice"]) == (len(want), ",".join(sorted({x[2] for x in want})), max((x[3] for x in want), default=0.0))


def test_licences_odd_rows(spark, odd_docs):
    assert licences.scan_licences(odd_docs).filter("size(passages) > 0").count() == 0
    assert licences.scan_licences(odd_docs).count() == odd_docs.count()
    assert licences.scan_licences(odd_docs.limit(0)).count() == 0


def expected_digests(text):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.word_bpe())
    ids = tk.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("head", [3, 200_000])
def test_bpe_round_trip(spark, odd_docs, head):
    docs = odd_docs.unionByName(odd_docs.limit(1).withColumn("doc_id", F.lit(99).cast("long")).withColumn("text", F.lit("Hello  WORLD's 12 don't <|endoftext|>x <|ENDOFTEXT|> İstanbul ΣΑΣ ﬁ ''s #'s 'sa a\x1cb")))
    got = bpe.decode(bpe.encode(docs, bpe.word_bpe(), head=head).withColumn("sha", F.sha2("ids", 256)).withColumn("n", F.octet_length("ids") / 4), bpe.word_bpe()).collect()
    have = sorted((str(r["doc_id"]), int(r["n"]), r["sha"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got)
    assert have == sorted((str(r["doc_id"]), *expected_digests(r["text"])) for r in docs.collect())
    assert bpe.encode(docs.limit(0), bpe.word_bpe()).count() == 0


def test_bpe_after_a_shuffle(spark, sf_dir):
    """Rows whose order is another one at each reading are stored first."""
    docs = table(spark, sf_dir, "documents")
    got = bpe.encode(docs.select("doc_id", "text").orderBy(F.rand()), bpe.word_bpe(), head=50).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert hashlib.sha256(bytes(r["ids"])).hexdigest() == expected_digests(r["text"])[1]


def test_bpe_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = bpe.op3_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected_digests(texts[r["doc_id"]]) for r in rows)


def test_bpe_refuses_other_files():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.tokens(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("top", [1, 200, 16_000, 342_976])
def test_packed_numbers(top):
    x = np.random.default_rng(top).integers(0, top, 5000).astype("u4")
    assert (bpe.unpack_numbers(bpe.pack_numbers(x)) == x).all()
    assert not len(bpe.unpack_numbers(bpe.pack_numbers(x[:0])))


def test_centroids_in_bounded_memory():
    """As many rows and centroids as a table of 600,000 vectors has: the fit's arrays stay far under a product of both."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(20_000, 8)).astype(np.float32), rng.normal(size=(4000, 8)).astype(np.float32)
    tracemalloc.start()
    at = ann._nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all products at once: 320 MB and more
    some = rng.integers(0, len(x), 200)
    d = ((x[some, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert np.allclose(d[np.arange(200), at[some]], d.min(axis=1), rtol=1e-3, atol=1e-4)


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[:300] = x[0] + 0.01 * rng.normal(size=(300, 16))  # a tight cluster
    x[300:340] = x[300]  # equal vectors
    rows = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)] + [(9001, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0] * 15), (9080, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20))
    hits = []
    for i, own in got.items():
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert np.allclose([c for _, _, c in own], s[[v for _, v, _ in own]])
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(own, own[1:]))
        hits.append(len({v for _, v, _ in own} & set(best.tolist())) / 20)
    assert np.mean(hits) >= 0.9 and min(hits) > 0.3


def test_visits_follow_the_lists(spark):
    """Far more lists than are visited at first; the target is reached all the same."""
    x = np.random.default_rng(5).normal(size=(3000, 24))
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, list_size=10, probes=4).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(range(0, 3000, 20))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert np.mean([len(own & set(np.argsort(-s[i])[:20].tolist())) / 20 for i, own in got.items()]) >= 0.95


def test_copies_take_one_place(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(1, (x[0] * 3 + 0.01 * rng.normal(size=8)).tolist()) for _ in range(200)] + [(777, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.search(df, F.col("vec_id") == 0, list_size=20).orderBy("rank").collect()]
    others = sorted(range(2, 60), key=lambda i: -float(x[i] @ x[0]))[:19]
    assert len(got) == 20 and got[0] == 1 and len(set(got[1:]) & set(others)) >= 17


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, f"/root/testdata/sf{sf}", "embeddings").collect() if r["embedding"] is not None]
    size = max(len(v) for _, v in rows)
    rows = [(i, v) for i, v in rows if len(v) == size and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    got = {}
    for r in ann.op8_nearest_neighbours(spark, f"/root/testdata/sf{sf}").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        hits.append(len(got[int(ids[k])] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_exact_search(spark):
    x = np.random.default_rng(9).normal(size=(900, 12))
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, list_size=10, exact=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert all([v for _, v in sorted(own)] == np.argsort(-s[i], kind="stable")[:20].tolist() for i, own in got.items()) and len(got) == 45


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
