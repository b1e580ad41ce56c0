"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

1. Document evidence: a logistic model on counts of characters, words and lines and on hashed words, fitted on a bounded
   sample of labelled rows (the ``sample`` ids of least hash), gives each document a probability of being good.
2. Grouped aggregation of these probabilities gives every path and host its total and its number of documents. The
   spread between hosts (and between paths of a host) beyond sampling noise sets, by the method of moments, how many
   documents the prior counts for.
3. A host's posterior mean is shrunk toward the global mean, a path's toward its host's; a document is left out of its
   own path and host, so a sparse site says little. The path's odds against the global odds, times the document's own
   odds, are the posterior odds.
4. Documents whose posterior probability is under ``threshold`` are rejected.

Each text is looked at once; what is found is stored, then meets its site. Sites of many documents are broadcast, a
bounded number; rows of all others, a few for each site, meet theirs in a shuffle where the sites are too many.

Defined results: a text that is null or has no character but white space has posterior 0 and is rejected; a null host
or path is a site of its own; without labels every other document has posterior 1; rows with repeated or null ids are
judged one by one, a repeated label counts as its mean, and of the rows of a labelled id one is learned from; columns
to keep may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ship, stored, table

#: Labelled rows that the document model is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Penalties of the weights of counts and of hashed words, and the number of hashed words.
RIDGE, WORD_RIDGE, BUCKETS = 1.0, 4.0, 1024
#: Sites that are broadcast, at most: all, or those of the most documents.
BROADCAST_ROWS = 100_000

SYMBOLS, DIGITS = b"#$%&*|!@^=<>{}[]_~\\", b"0123456789"
RUNS = re.compile(r"[!#$%&*]{2,}")
LETTER = re.compile(r"[^\W\d_]")
_latin = [chr(i) for i in range(256)]
LETTERS, UPPER = ("".join(filter(f, _latin)).encode("latin-1") for f in (str.isalpha, str.isupper))
COUNTS = 11


def counts(text: str, words: list[str]) -> list[float]:
    """Numbers between 0 and about 3 that say what a text is made of."""
    n, k, lines = max(len(text), 1), max(len(words), 1), text.split("\n")
    raw = text.encode("utf-8", "surrogatepass")
    among = lambda raw, some: len(raw) - len(raw.translate(None, some))
    try:
        latin = raw if len(raw) == len(text) else text.encode("latin-1")
        letters, upper = among(latin, LETTERS), among(latin, UPPER)
    except UnicodeEncodeError:
        letters, upper = len(LETTER.findall(text)), sum(map(str.isupper, text))
    return [
        among(raw, SYMBOLS) / n,
        len(RUNS.findall(text)) / k,
        raw.count(b"|") / k,
        upper / max(letters, 1),
        among(raw, DIGITS) / n,
        1 - letters / n,
        1 - len(set(words)) / k,
        1 - len(set(lines)) / len(lines),
        min(n / k, 30.0) / 10,
        float(np.log10(n + 1)) / 2,
        len(lines) / k,
    ]


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        i = self[word] = crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return i


_buckets = Buckets()


def features(text: str) -> np.ndarray:
    """Counts, then the square roots of the hashed words' frequencies (of length 1 in all)."""
    words = text.lower().split()
    hashed = np.sqrt(np.bincount(np.fromiter(map(_buckets.__getitem__, words), dtype=np.int64, count=len(words)), minlength=BUCKETS) / max(len(words), 1))
    return np.r_[counts(text, words), hashed].astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray | None:
    """Weights (the last is the constant) of a logistic model: Newton's steps on standardised counts and hashed words, each solved by conjugate gradients. x is standardised in place."""
    if not len(x):
        return None
    mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    mean[:COUNTS], scale[:COUNTS] = x[:, :COUNTS].mean(axis=0), np.maximum(x[:, :COUNTS].std(axis=0), 1e-9)
    x[:, :COUNTS] = (x[:, :COUNTS] - mean[:COUNTS]) / scale[:COUNTS]
    penalty = np.r_[np.full(COUNTS, RIDGE), np.full(x.shape[1] - COUNTS, WORD_RIDGE), 1e-3]
    times = lambda v: (x @ v[:-1].astype(np.float32)).astype(np.float64) + v[-1]
    back = lambda v: np.r_[(v.astype(np.float32) @ x).astype(np.float64), v.sum()]
    w = np.zeros(len(penalty))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        rest = back(y - p) - penalty * w
        step, way, left = np.zeros_like(w), rest.copy(), float(rest @ rest)
        for _ in range(60):
            if left < 1e-8:
                break
            curve = back(p * (1 - p) * times(way)) + penalty * way
            far = left / float(way @ curve)
            step, rest = step + far * way, rest - far * curve
            now = float(rest @ rest)
            way, left = rest + now / left * way, now
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray | None:
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(sample)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))  # the sample's bound

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                x = features(text)
                at = np.flatnonzero(x)
                found.append(at.astype("<u2").tobytes() + x[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(found, pa.binary())], ["h", "y", "x"])

    got = rows.select(F.xxhash64("id").alias("h"), "y", "m.text").mapInArrow(look, "h long, y double, x binary").collect()
    got.sort(key=lambda r: r["h"])
    x, y = np.zeros((len(got), COUNTS + BUCKETS), dtype=np.float32), np.array([r["y"] for r in got])
    for k, r in enumerate(got):
        n = len(r["x"]) // 6
        x[k, np.frombuffer(r["x"], "<u2", n)] = np.frombuffer(r["x"], "<f4", n, 2 * n)
    got.clear()
    return fit(x, y)


def evidence(docs: DataFrame, weights: np.ndarray | None, text_col: str = "_text") -> DataFrame:
    """docs with its text replaced by _odds, the document's own log odds of being good."""
    rest = docs.drop(text_col)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                odds = [30.0 if weights is None else float(np.clip(features(t or "") @ weights[:-1] + weights[-1], -30, 30)) for t in batch.column(text_col).to_pylist()]
                own = batch.drop_columns([text_col])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(odds, pa.float64())], [*own.schema.names, "_odds"])

    return docs.mapInArrow(look, T.StructType([*rest.schema.fields, T.StructField("_odds", T.DoubleType())]))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(sites: DataFrame, total: str, n: str, mean: Column) -> float:
    """Documents that the prior of these sites counts for: mean * (1 - mean) over the variance between sites."""
    noise = mean * (1 - mean)
    got = sites.filter(F.col(n) > 0).agg(F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - mean, F.lit(2)) - noise).alias("between"), F.sum(n).alias("docs"), F.avg(noise).alias("noise")).first()
    if not got["docs"] or not got["noise"]:
        return 1.0
    between = max(got["between"] / got["docs"], 1e-6)
    return float(min(max(got["noise"] / between, 1.0), 1e6))


def sites_of(judged: DataFrame) -> DataFrame:
    """(host, path, path_total, path_n, host_total, host_n, mean, host_k, path_k) from documents (host, path, p)."""
    paths = stored(judged.groupBy("host", "path").agg(F.sum("p").alias("path_total"), F.count("*").alias("path_n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("path_total").alias("host_total"), F.sum("path_n").alias("host_n"))
    whole = hosts.agg(F.sum("host_total").alias("t"), F.sum("host_n").alias("n")).first()
    mean = (whole["t"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    host_k = _strength(hosts, "host_total", "host_n", F.lit(mean))
    both = paths.withColumnRenamed("host", "h").join(hosts, F.col("h").eqNullSafe(F.col("host"))).drop("h")
    of_host = (F.col("host_total") + host_k * mean) / (F.col("host_n") + host_k)
    path_k = _strength(both, "path_total", "path_n", of_host)
    return both.select("host", "path", "path_total", "path_n", "host_total", "host_n", F.lit(mean).alias("mean"), F.lit(host_k).alias("host_k"), F.lit(path_k).alias("path_k"))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id alone by default) of each row of docs, with document_p, site_p, posterior and accepted."""
    ship(docs.sparkSession)
    weights = train(docs, labels, sample, id_col, text_col)
    keep = keep or [id_col]
    said = F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False))
    own = docs.select(F.struct(*(F.col(c) for c in keep)).alias("_kept"), host.cast("string").alias("_host"), path.cast("string").alias("_path"), said.alias("_said"), F.col(text_col).alias("_text"))
    own = stored(evidence(own, weights), "quality-odds")
    p = 1 / (1 + F.exp(-F.col("_odds")))
    sites = stored(sites_of(own.filter("_said").select(F.col("_host").alias("host"), F.col("_path").alias("path"), p.alias("p"))), "quality-sites")
    here = F.col("_host").eqNullSafe(F.col("host")) & F.col("_path").eqNullSafe(F.col("path"))
    if sites.count() <= BROADCAST_ROWS:
        rows = own.join(F.broadcast(sites), here, "left")
    else:
        order = [F.desc("path_n"), "host", "path"]
        hot = stored(sites.orderBy(*order).limit(BROADCAST_ROWS), "quality-hot")
        cold = sites.join(F.broadcast(hot.select(F.col("host").alias("_host"), F.col("path").alias("_path"))), here, "left_anti")
        rows = own.join(F.broadcast(hot), here).unionByName(own.join(F.broadcast(hot), here, "left_anti").join(cold, here, "left"))
    rest = lambda total, n, mean, k: (F.col(total) - p + k * mean) / (F.col(n) - 1 + k)  # noqa: E731  without the document itself
    of_host = rest("host_total", "host_n", F.col("mean"), F.col("host_k"))
    of_path = rest("path_total", "path_n", of_host, F.col("path_k"))
    odds = F.col("_odds") + _logit(of_path) - _logit(F.col("mean"))
    posterior = F.when(F.col("_said"), 1 / (1 + F.exp(-odds))).otherwise(0.0)
    return rows.select(*(F.col("_kept")[c].alias(c) for c in keep), p.alias("document_p"), F.coalesce(of_path, F.lit(0.0)).alias("site_p"), posterior.alias("posterior"), (posterior >= threshold).alias("accepted"))


def section(host: str = "source", lang: str = "lang") -> Column:
    """documents has no address; a host's documents of one language stand for a path."""
    return F.concat_ws("/", F.coalesce(host, F.lit("")), F.coalesce(lang, F.lit("")))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), section())


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
