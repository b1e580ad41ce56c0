"""Language identification: string-kernel classification.

The kernel of two texts is the blended-spectrum presence kernel: the number of n-grams (1 to 4 bytes of the lower-cased
text, folded into ``2 ** BITS`` features) that both hold, divided by the geometric mean of their own numbers. A long text
would fill the features, so it is taken in equal pieces of at most ``PIECE`` bytes, and its kernel is the mean of theirs;
every piece counts. Nystroem landmarks, pieces of some texts of each language, map a text to its kernels with them,
whitened by the landmarks' own kernel matrix; one-versus-rest kernel ridge regression is fitted on these. Whitening and
weights fold into one matrix, so a batch of pieces is scored by two matrix products: presence by landmarks, kernels by
weights.

The model is fitted on a bounded sample, the ``sample`` training rows of least hash (of rows alike in id and text each
takes a place, but one is learned from); scoring covers every whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no training row every text is
``und``; ties go to the language first in order; rows with repeated or null ids are scored like any other; columns to
keep may have any name but those of the result (ValueError).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import ship, stored, table

ORDERS, BITS = (1, 2, 3, 4), 15
#: Rows that the model is fitted on, and landmarks for each language, at most.
SAMPLE, LANDMARKS = 3000, 48
RIDGE = 1e-3
#: Scores are the softmax of the ridge outputs times this.
SHARPNESS = 6.0
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of a piece, at most; pieces overlap, so no n-gram is lost.
PIECE = 1 << 12
#: Pieces of a matrix product.
BLOCK = 256


def pieces(text: str) -> list[bytes]:
    """The text's bytes in pieces of equal length that overlap by an n-gram less one byte."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // PIECE))
    return [raw[len(raw) * i // n : len(raw) * (i + 1) // n + (max(ORDERS) - 1 if i + 1 < n else 0)] for i in range(n)]


def presence(text: str | bytes) -> np.ndarray:
    """Which features the text or piece holds, as a boolean vector."""
    raw = text.lower().encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(1 << BITS, dtype=bool)
    gram = np.zeros(len(b), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        gram = (gram[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        if n in ORDERS:
            out[((gram + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435769)) >> np.uint32(32 - BITS)] = True
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float32, copy=False), b.astype(np.float32, copy=False)
    return (a @ b.T) / np.sqrt(np.maximum(a.sum(1), 1)[:, None] * np.maximum(b.sum(1), 1)[None, :])


def kernels(texts: list[str], marks: np.ndarray) -> np.ndarray:
    """Each text's kernels with the landmarks: the mean over all of its pieces."""
    out = np.zeros((len(texts), len(marks)))
    each = ((i, piece, len(all_)) for i, t in enumerate(texts) for all_ in [pieces(t)] for piece in all_)
    while part := list(islice(each, BLOCK)):
        i, raw, n = zip(*part)
        np.add.at(out, list(i), kernel(np.stack([presence(p) for p in raw]), marks) / np.array(n)[:, None])
    return out


def fit(marks: np.ndarray, k: np.ndarray, lang: list[str], ridge: float = RIDGE) -> dict:
    """Landmarks, weights and languages, from the landmarks, the kernels of texts with them and the texts' languages."""
    langs = sorted(set(lang))
    y = np.array([[1.0 if a == b else -1.0 for b in langs] for a in lang])
    own = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    white = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = np.c_[k @ white, np.ones(len(k))]
    w = np.linalg.solve(z.T @ z + ridge * len(k) * np.eye(z.shape[1]), z.T @ y)
    return {"marks": np.packbits(marks, axis=1), "weights": white @ w[:-1], "bias": w[-1], "langs": langs}


def scores(model: dict, texts: list[str], marks: np.ndarray) -> np.ndarray:
    z = SHARPNESS * (kernels(texts, marks) @ model["weights"] + model["bias"])
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def model_of(docs: DataFrame, sample: int, landmarks: int, id_col: str, text_col: str, lang_col: str) -> dict | None:
    """The model of at most ``sample`` rows, those of least hash (a few KB of each go to the driver)."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.xxhash64(F.col(id_col), F.lit(9)).alias("h"), F.xxhash64(text_col).alias("t"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    key = F.struct("h", "t")
    bound = rows.select(key.alias("key")).orderBy("key").limit(sample).agg(F.max("key").alias("key")).first()["key"]
    if bound is None:
        return None
    # Texts stay where they are read; rows of one id and one text count once.
    some = rows.filter((F.col("h") < bound["h"]) | ((F.col("h") == bound["h"]) & (F.col("t") <= bound["t"])))
    rows = stored(some.groupBy("h", "t").agg(F.min("lang").alias("lang"), F.first("text").alias("text")), "language-sample")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = [(p := pieces(text))[i % len(p)] for i, text in zip(pdf["h"], pdf["text"])]
            yield pd.DataFrame({"h": pdf["h"], "t": pdf["t"], "lang": pdf["lang"], "x": [np.packbits(presence(p)).tobytes() for p in some]})

    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    first = rows.select("h", "t", "lang", "text").withColumn("n", place).filter(F.col("n") <= landmarks).drop("n")
    got = first.mapInPandas(own, "h long, t long, lang string, x binary").orderBy("lang", "h", "t").collect()
    marks = np.unpackbits(np.array([np.frombuffer(r["x"], dtype=np.uint8) for r in got]), axis=1).astype(bool)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "t": pdf["t"], "lang": pdf["lang"], "k": [k.tobytes() for k in kernels(list(pdf["text"]), marks.astype(np.float32))]})

    spread = rows.repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism), "h")
    got = spread.mapInPandas(meet, "h long, t long, lang string, k binary").orderBy("h", "t", "lang").collect()
    return fit(marks, np.array([np.frombuffer(r["k"]) for r in got]), [r["lang"] for r in got])


def identify(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS, keep: list[str] = ()) -> DataFrame:
    """id, lang_pred, score of every row (and the columns ``keep``); learns from the rows that ``train`` admits."""
    spark = docs.sparkSession
    ship(spark)
    if {"lang_pred", "score", id_col} & {*keep}:
        raise ValueError(f"keep: {id_col}, lang_pred and score are columns of the result")
    model = model_of(docs if train is None else docs.filter(train), sample, landmarks, id_col, text_col, lang_col)
    shared = spark.sparkContext.broadcast(model)  # landmarks of 4 KB each and their weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        marks = model and np.unpackbits(model["marks"], axis=1).astype(np.float32)
        for batch in batches:
            text = batch.column("_text").to_pylist()
            names, best = [UNKNOWN] * len(text), np.zeros(len(text))
            rows = [i for i, t in enumerate(text) if model and t and LETTER.search(t)]
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                p = scores(model, [text[i] for i in part], marks)
                best[part] = p.max(axis=1)
                for i, k in zip(part, p.argmax(axis=1)):
                    names[i] = model["langs"][k]
            own = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.string()), pa.array(best)], [*own.schema.names, "lang_pred", "score"])

    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    kind = T.StructType([*rows.drop("_text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(score, kind)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
