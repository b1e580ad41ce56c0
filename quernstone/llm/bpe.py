"""BPE encoding and decoding over a table of distinct words.

1. Tasks split their texts into words as the tokenizer does and count them; grouped aggregation gives the table of
   distinct words, and each distinct word is encoded once.
2. Ids come back by position. The words of the highest counts, at most ``HEAD`` of them, are numbered in a broadcast
   table, and a text becomes its words' numbers. Every other word of a text leaves a hole: its place among the text's
   holes and the word are joined with the table of the remaining words by a shuffle, and the ids found are grouped by
   text, meet the text's numbers and are set in.
3. Decoding joins ids with the vocabulary's pieces. The vocabulary has a fixed size, so this is a map-side join: each
   task looks its ids up in the broadcast table, in place. (A row for each id, joined and gathered again, would move
   several times the input through a shuffle for the same text.)

So texts are not shuffled, only their words' numbers (one to three bytes each, compressed) and words outside the
broadcast table. Rows without a hole, an eighth of those bytes, move along: to leave them out, texts would be looked up
a third time.

Defined results: a null text is empty and has no tokens; special strings in a text are special ids; rows of one id are
encoded one by one; an empty table gives an empty result. A tokenizer file that splits, marks or decodes words in
another way than this module knows is refused (ValueError).
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, stored, table

#: Words of the broadcast table, at most; numbers of three bytes allow for 342,975.
HEAD = 200_000
#: Distinct words, or runs between white space, that a task counts before it hands on what it has combined.
COMBINE_WORDS = 400_000
#: Runs between white space whose numbers a task keeps.
KEPT_RUNS = 250_000
#: Rows that a task holds as Python objects at a time.
SLICE = 512
#: Texts of these bytes in Latin-1 are split here; all others by the library itself.
PLAIN = bytes([*range(0x1C), *range(0x20, 0x80), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or (0xC0 <= b <= 0xDE and b != 0xD7) else b for b in range(256))
#: Fixed value: how the tokenizer with word ends splits a normalised text, for ASCII and Latin-1 letters.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Fixed value: the same in the tokenizer file.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Tokens:
    """What a task needs of one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(self.tokenizer.to_str())
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        splits = [p.get("pattern", {}).get("Regex") for p in (file["pre_tokenizer"] or {}).get("pretokenizers", [])]
        normal = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        if file["decoder"] is not None or SPLITS not in splits or normal != ["NFC", "Replace", "Lowercase"] or self.size > 1 << 16:
            raise ValueError(f"{path}: not a tokenizer of lower-cased words without a decoder and of up to 65,536 ids")
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def runs(self, text: str) -> list[bytes] | None:
        """The lower-cased runs between white space, across which no word reaches; None for a text that only the library can split."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if raw.translate(None, PLAIN) or (b"<|" in raw and self.cut and self.cut.search(text)):
            return None
        return raw.translate(LOWER).split()

    @staticmethod
    def words_of(run: bytes) -> list[str]:
        return WORDS.findall(run.decode("latin-1"))

    def words(self, text: str) -> list[str]:
        """The words in order; a special string stays as it is and is told apart by its case-sensitive form."""
        parts = self.cut.split(text) if self.cut else [text]
        return [w for part in parts for w in ([part] if part in self.special else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if (runs := self.runs(text)) is not None:
            return [w for run in runs for w in self.words_of(run)]
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 4096):
            for e in self.tokenizer.encode_batch(words[at : at + 4096], add_special_tokens=False):
                out.append(np.array(e.ids, dtype="<u2").tobytes())
        return out


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class Kept(dict):
    """Values of a function, kept for the first so many keys: frequent ones come early."""

    def __init__(self, f: Callable) -> None:
        self.f = f

    def __missing__(self, key):
        value = self.f(key)
        if len(self) < KEPT_RUNS:
            self[key] = value
        return value


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def word_table(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n, ids): the distinct words of texts (text), how often each occurs, and its ids (little-endian unsigned 16-bit)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, runs, seen = tokens(tokenizer), Counter(), Counter()

        def settle() -> None:
            for run, n in runs.items():
                for w in own.words_of(run):
                    seen[w] += n
            runs.clear()

        def out() -> pa.RecordBatch:
            found = _batch({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return found

        for batch in _slices(batches):
            for text in batch.column("text").to_pylist():
                some = own.runs(text)
                if some is None:
                    seen.update(own.words(text))
                else:
                    runs.update(some)
            if len(runs) > COMBINE_WORDS:
                settle()
            if len(seen) > COMBINE_WORDS:
                yield out()
        settle()
        if seen:
            yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(tokenizer)
        for batch in batches:
            yield _batch({"word": batch.column("word"), "n": batch.column("n"), "ids": pa.array(own.encode(batch.column("word").to_pylist()), pa.binary())})

    counted = texts.mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.mapInArrow(encode, "word string, n long, ids binary"), "bpe-words")


def frequent(words: DataFrame, head: int) -> tuple[list[str], list[bytes], int]:
    """The words that occur most, at most ``head``, most frequent first, their ids, and the least count among them."""
    levels = words.groupBy(F.floor(F.log2("n") * 16).alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()  # at most 16 * 63
    least, total = (1 << 62), 0
    for r in levels:
        total += r["words"]
        if total > head:
            break
        least = r["least"]
    rows = sorted(words.filter(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))
    return [r["word"] for r in rows], [bytes(r["ids"]) for r in rows], least


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers up to 342,975 in one to three bytes each, the first bytes of all before the second ones; compressed."""
    import zstandard

    first = np.where(x < 192, x, np.where(x < 15296, 192 + ((x - 192) >> 8), 251 + ((x - 15296) >> 16))).astype("u1")
    two = x[x >= 192]
    second = np.where(two < 15296, two - 192, two - 15296).astype("u1")
    third = ((x[x >= 15296] - 15296) >> 8).astype("u1")
    return np.uint32(len(x)).tobytes() + zstandard.ZstdCompressor(level=3).compress(first.tobytes() + second.tobytes() + third.tobytes())


def unpack_numbers(raw: bytes) -> np.ndarray:
    import zstandard

    n = int(np.frombuffer(raw, "u4", 1)[0])
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4:]), dtype="u1").astype("u4")
    x = flat[:n].copy()
    two, three = x >= 192, x >= 251
    second = np.zeros(n, dtype="u4")
    second[two] = flat[n : n + int(two.sum())]
    third = flat[n + int(two.sum()) :]
    middle = two & ~three
    out = x
    out[middle] = 192 + ((x[middle] - 192) << 8) + second[middle]
    out[three] = 15296 + ((x[three] - 251) << 16) + (third << 8) + second[three]
    return out


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, settled: bool = False) -> DataFrame:
    """id and ids (binary: little-endian unsigned 32-bit) of each row of docs.

    ``settled``: docs gives the same rows in the same order whenever it is read, as files do; other inputs are stored first,
    since a row is known by its place.
    """
    spark = docs.sparkSession
    ship(spark)
    if head > 342_975:
        raise ValueError("head: at most 342,975")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = own if settled else stored(own, "bpe-texts")
    kind = own.schema["id"].dataType
    words = word_table(own.select("text"), tokenizer)
    names, ids, least = frequent(words, head)
    shared_names, shared_ids = spark.sparkContext.broadcast(names), spark.sparkContext.broadcast([b"", *ids])
    own = own.withColumn("row", F.monotonically_increasing_id())

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = tokens(tokenizer), set(shared_names.value)
        lost = Kept(lambda run: tuple(w for w in own.words_of(run) if w not in known))
        for batch in _slices(batches):
            row, hole, word = [], [], []
            for r, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                runs = own.runs(text)
                some = list(chain.from_iterable(map(lost.__getitem__, runs))) if runs is not None else [w for w in own.words(text) if w not in known]
                row += [r] * len(some)
                hole += range(len(some))
                word += some
            yield _batch({"row": pa.array(row, pa.int64()), "hole": pa.array(hole, pa.int32()), "word": pa.array(word, pa.string())})

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = tokens(tokenizer), {w: i for i, w in enumerate(shared_names.value, 1)}
        as_bytes = lambda words: np.array([number.get(w, 0) for w in words], dtype="<u4").tobytes()  # noqa: E731  0 is a hole
        of = Kept(lambda run: as_bytes(own.words_of(run)))
        for batch in _slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                runs = own.runs(text)
                raw = b"".join(map(of.__getitem__, runs)) if runs is not None else as_bytes(own.words(text))
                out.append(pack_numbers(np.frombuffer(raw, dtype="<u4")))
            yield _batch({"row": batch.column("row"), "id": batch.column("id"), "numbers": pa.array(out, pa.binary())})

    holes = own.select("row", "text").mapInArrow(missing, "row long, hole int, word string")
    found = holes.join(words.filter(F.col("n") < least).select("word", "ids"), "word")
    found = found.groupBy("row").agg(F.collect_list(F.struct("hole", "ids")).alias("more"))
    numbered = own.mapInArrow(numbers, T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("numbers", T.BinaryType())]))
    both = numbered.join(found, "row", "left").select("id", "numbers", F.col("more.hole").alias("holes"), F.col("more.ids").alias("more"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared_ids.value.__getitem__
        for batch in _slices(batches):
            out = []
            for raw, holes, more in zip(batch.column("numbers").to_pylist(), batch.column("holes").to_pylist(), batch.column("more").to_pylist()):
                x = unpack_numbers(raw)
                parts = list(map(ids_of, x.tolist()))
                at = np.flatnonzero(x == 0).tolist()
                if len(at) != len(holes or ()):
                    raise ValueError("a word of a text is missing from the table of words")
                for h, m in zip(holes or (), more or ()):
                    parts[at[h]] = m
                out.append(np.frombuffer(b"".join(parts), dtype="<u2").astype("<u4").tobytes())
            yield _batch({"id": batch.column("id"), "ids": pa.array(out, pa.binary())})

    return both.mapInArrow(fill, T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType())])).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with its ids (binary: little-endian unsigned 32-bit; null: none) replaced by the text they stand for, special strings included."""
    vocabulary = tokens(tokenizer).tokenizer.get_vocab(with_added_tokens=True)
    pieces = [""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = piece
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)  # of the vocabulary's fixed size
    rest = [c for c in encoded.columns if c != ids_col]
    rows = encoded.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(rest)), F.col(ids_col).alias("ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shared.value.__getitem__
        for batch in _slices(batches):
            # This tokenizer has no decoder: its pieces are joined by spaces.
            text = [" ".join(map(piece, np.frombuffer(ids or b"", dtype="<u4").tolist())) for ids in batch.column("ids").to_pylist()]
            own = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(text, pa.string())], [*own.schema.names, "text"])

    kind = T.StructType([*rows.drop("ids").schema.fields, T.StructField("text", T.StringType())])
    return rows.mapInArrow(join, kind).toDF(*rest, text_col)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), word_bpe(), settled=True)
    told = encoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(told, word_bpe()).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op3_bpe": op3_bpe}
