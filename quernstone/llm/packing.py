"""Best-fit packing of tokenised documents into sequences of a fixed length, by the sum-of-squares rule.

1. Each document becomes its ids plus an end id; one longer than a sequence is cut into full pieces, of which only the
   first may be shorter. Full pieces are sequences of their own.
2. The short pieces are dealt to tasks of at most ``items_per_task`` pieces. A task places each piece, longest first,
   in that open sequence which leaves the sum over residual gaps of the squared number of open sequences smallest; of
   equal choices it takes the tightest, and it opens a new one only where none holds the piece. (Free to open new
   ones for a smaller sum, as for pieces in random order, it needs 1 to 3 % more sequences.)
3. Sequences that a task leaves open are packed again as wholes, across tasks, until one task holds them all or a
   round saves nothing. So few open sequences remain, however many tasks there were.

Tokens are those of a tokenizers file: a text is cut at spaces where no token can cross, and a task keeps the ids of
frequent units (a bounded number), so each is encoded once; other units are encoded where they stand.

Defined results: a null text is empty and gives one piece, the end id alone; repeated ids are packed as separate
documents whose rows have equal doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ship, stored, table

SEQUENCE = 2048
ITEMS_PER_TASK = 200_000
#: Units whose ids a worker keeps.
KEPT_UNITS = 300_000
#: A space next to other white space: there the pre-tokeniser looks beyond the space, so such texts are encoded whole.
CROSSING = re.compile(r"\s (?:\s|\Z)")


#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class UnitIds(dict):
    """Ids (little-endian unsigned 32-bit) of a unit that follows a space."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(" " + unit)
        if len(self) < KEPT_UNITS and len(unit) < 40:
            self[unit] = ids
        return ids


def _bytes_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE of a tokenizers file; special strings in a text are special ids.

    Where the file's ids are in the order of its merges, as is usual, tiktoken runs the merges: it gives the same ids
    with a tenth of the work for each unit. Else the tokenizers library does.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain = self._merges() or (lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.units = UnitIds(lambda text: array("I", self.plain(text)).tobytes())

    def _merges(self):
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = {w: i for w, i in model["vocab"].items() if w not in self.special}
        ordered = [vocab.get(a + b) for a, b in pairs]
        known = _bytes_of()
        if None in ordered or ordered != sorted(ordered) or not all(c in known for w in vocab for c in w):
            return None
        ranks = {bytes(known[c] for c in w): i for w, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(array("I", [self.special[part]]).tobytes() if part in self.special else self._part(part) for part in self.cut.split(text))
        return self._part(text)

    def _part(self, text: str) -> bytes:
        if CROSSING.search(text):
            return array("I", self.plain(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.plain(first)).tobytes() + b"".join(map(self.units.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, sequence: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).ids
        for pdf in batches:
            out = []
            for i, row, text in zip(pdf["id"], pdf["row"], pdf["text"]):
                ids = encode(text) + end
                n = len(ids) // 4
                start, stop, k = 0, n % sequence or sequence, 0
                while start < n:
                    out.append((i, row, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, k = stop, stop + sequence, k + 1
            yield pd.DataFrame(out, columns=["id", "row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "id long, row long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size in turn, and the fill of each bin."""
    n = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; n[0] stays 0
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill, bins, offsets = [], [], []
    for s in sizes:
        gap = 0
        if s < capacity:
            gain = n[: capacity - s] - n[s:capacity]  # half the change, less 1/2 for a gap that closes
            gain = gain * 2 + 2
            gain[0] -= 1
            gain[n[s:capacity] == 0] = 1 << 60
            best = int(gain.argmin())
            if gain[best] < 1 << 59:
                gap = best + s
        if gap:
            b = at[gap].pop()
            n[gap] -= 1
        else:
            b, gap = len(fill), capacity
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += s
        if gap > s:
            n[gap - s] += 1
            at[gap - s].append(b)
    return bins, offsets, fill


def _pack(sequence: int, turn: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        frames = [pdf for pdf in batches if len(pdf)]  # at most items_per_task rows of two numbers, give or take
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True)
        bins, offsets, fill = sum_of_squares(pdf["length"].tolist(), sequence)
        first = (turn << 54) + (TaskContext.get().partitionId() << 32)
        yield pd.DataFrame({"item": pdf["item"], "bin": np.array(bins, dtype=np.int64) + first, "offset": np.array(offsets, dtype=np.int64), "fill": np.array(fill, dtype=np.int64)[bins]})

    return pack


def pack_items(items: DataFrame, sequence: int, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """(item, bin, offset) for items (item, length), both long."""
    rounds, n = [], items.count()
    while True:
        tasks = max(1, -(-n // items_per_task))
        dealt = items.repartition(tasks, F.xxhash64("item")).sortWithinPartitions(F.desc("length"), "item")
        packed = stored(dealt.mapInPandas(_pack(sequence, len(rounds)), "item long, bin long, offset long, fill long"), "pack-round")
        rounds.append(packed)
        if tasks == 1:
            break
        items = packed.select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct().filter(F.col("length") < sequence)
        n, before = items.count(), n
        if n >= before or not n:
            break
    found = rounds[0]
    for later in rounds[1:]:
        again = later.select(F.col("item").alias("bin"), F.col("bin").alias("new_bin"), F.col("offset").alias("base"))
        found = found.join(again, "bin", "left")
        found = found.select("item", F.coalesce("new_bin", "bin").alias("bin"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
    return found.select("item", "bin", "offset")


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    cut = stored(pieces(docs, tokenizer, sequence, end_id, id_col, text_col), "pack-pieces")
    short = (F.col("piece") == 0) & (F.col("length") < sequence)
    packed = pack_items(cut.filter(short).select(F.col("row").alias("item"), "length"), sequence, items_per_task)
    packed = packed.select(F.col("item").alias("row"), (2 * F.col("bin")).alias("sequence_id"), "offset")
    full = cut.filter(~short).select("id", "piece", "start", "length", "ids_crc32", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(short).join(packed, "row").select(full.columns)
    return full.unionByName(rest).withColumnRenamed("id", id_col)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe())


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
