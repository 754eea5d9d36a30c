"""Packing token sequences into windows: repeat counts of length combinations by non-negative least squares.

1. Texts are encoded whole. Each document's ids and a closing id are cut at multiples of the window; what is left over is its last piece.
2. The histogram of piece lengths has at most ``window`` entries. Shallow combinations of lengths that fill a window
   exactly (one full piece, all pairs, triples with one length on a grid) are the columns of a non-negative least
   squares problem with the histogram as its right side; an accelerated projected gradient solves it.
3. The repeat counts are rounded and taken from the histogram, largest first. What is left is packed greedily, the
   longest length first, always adding the longest length that still fits.
4. Pieces are ranked within their length (salted, so a frequent length isn't one task), and an interval of ranks tells
   each piece its sequence and offset.

Nulls: a null text has the closing id alone; null doc_ids are kept. Repeated rows are packed once each. Empty tables
give no rows; other columns of docs are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm import kernel as K
from pricetide.llm.bpe import Vocabulary, as_list, encoder
from pricetide.session import cut

GRID = 32  # one length of a triple is a multiple of this
ROUNDS = 400
CELL_ROWS, LEAST_CELL = 20_000, 50  # pieces ranked together: a thousandth of all within these bounds
RANKS = 1 << 44  # more than there are pieces of a length
#: Fixed value: the vocabulary's way to cut a text into words, written so that the matcher need not step back.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Ids:
    """Token ids of whole texts by merge ranks, for vocabularies whose ids rise with the rank of their merges.

    There, merging the adjacent pair of least id is what the vocabulary's own merges do (tests hold this against the
    tokenizers library). Other vocabularies, and texts on which the splitting pattern gives up (very long runs of white
    space), take the trie of ``bpe``, which has the same ids.
    """

    def __init__(self, path: str):
        self.path, known = path, Vocabulary(path)
        special = set(known.special.values())
        ranks = {b: i for i, b in known.bytes.items() if i not in special}
        merged = [ranks[known.bytes[a] + known.bytes[b]] for a, b in known.rank]
        rising = all(x < y for x, y in zip(merged, merged[1:], strict=False)) and all(bytes([b]) in ranks for b in range(256))
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=known.special) if rising else None

    def __call__(self, text: str | None) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text or "", allowed_special="all")
            except ValueError:
                pass
        return np.array([i for unit in next(encoder(self.path, as_list).batch([text])) for i in unit], np.uint32)


@cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def tokenised_pieces(docs: DataFrame, vocabulary: str, window: int, closing: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) for each piece of docs (doc_id, text)."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.binary())] if with_ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = ids_of(vocabulary), np.array([closing], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = coder(text.as_py()).astype("<u4", copy=False).tobytes() + end
                for at in range(0, len(data), 4 * window):
                    piece = data[at : at + 4 * window]
                    out["doc_id"].append(doc)
                    out["start"].append(at // 4)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(data) // 4)
                    if with_ids:
                        out["ids"].append(piece)
            yield K.table(out, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids)


def combinations(window: int, present: list[int], grid: int = GRID) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the window, all of them in the histogram."""
    there = np.zeros(window + 1, bool)
    there[present] = True
    out = [(window, 0, 0)] if there[window] else []
    out += [(a, window - a, 0) for a in range(1, window // 2 + 1) if there[a] and there[window - a]]
    for a in range(grid, window, grid):
        if there[a]:
            out += [(a, b, window - a - b) for b in range(1, (window - a) // 2 + 1) if there[b] and there[window - a - b]]
    return np.array(out, np.int64).reshape(-1, 3)


def repeat_counts(columns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Counts x >= 0 of the combinations that come nearest to the histogram in the least-squares sense."""
    size = len(histogram)

    def forward(x: np.ndarray) -> np.ndarray:
        total = np.zeros(size)
        for k in range(3):
            total += np.bincount(columns[:, k], x, size)
        total[0] = 0
        return total

    def back(r: np.ndarray) -> np.ndarray:
        return r[columns].sum(axis=1)

    target = histogram.astype(float)
    target[0] = 0
    v = np.ones(len(columns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        w = back(forward(v))
        norm = np.linalg.norm(w)
        v = w / norm
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - back(forward(y) - target) / (1.05 * norm))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / after * (nxt - x)
        x, t = nxt, after
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Compositions of a sequence with how often each is made; together they use up the histogram."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    columns = combinations(window, np.flatnonzero(left).tolist())
    if len(columns):
        counts = repeat_counts(columns, left)
        for i in np.argsort(-counts, kind="stable").tolist():
            use = Counter(x for x in columns[i].tolist() if x)
            n = min(int(round(counts[i])), *(int(left[x]) // k for x, k in use.items()))
            if n > 0:
                out.append((tuple(sorted(use.elements(), reverse=True)), n))
                for x, k in use.items():
                    left[x] -= n * k
    while left.any():
        used: Counter[int] = Counter()
        room = window
        while room:
            fit = np.flatnonzero(left[: room + 1] - np.array([used[k] for k in range(room + 1)]) > 0)
            if not len(fit):
                break
            used[int(fit[-1])] += 1
            room -= int(fit[-1])
        n = min(int(left[x]) // k for x, k in used.items())
        out.append((tuple(sorted(used.elements(), reverse=True)), n))
        for x, k in used.items():
            left[x] -= n * k
    return out


def pack(pieces: DataFrame, window: int) -> DataFrame:
    """pieces (doc_id, start, length, ...) with sequence_id and offset; ``pieces`` must be a written table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    slots, sequence, ranked = [], 0, Counter()
    for lengths, n in plan(histogram, window):
        offset = 0
        for length in lengths:
            slots.append((length, ranked[length], sequence - ranked[length], offset))
            ranked[length] += n
            offset += length
        sequence += n
    place = np.array(sorted(slots), np.int64).reshape(-1, 4)  # as many rows as the plan has lengths
    firsts = place[:, 0] * RANKS + place[:, 1]
    cell = min(CELL_ROWS, max(LEAST_CELL, sum(histogram.values()) // 1000))
    salts = spark.createDataFrame([(k, -(-n // cell)) for k, n in histogram.items()], "length bigint, salts bigint")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), "salts"))
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked_df = salted.withColumn("inner", inner).join(before.select("length", "salt", "before"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inner") - 1)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(firsts, batch.column("length").to_numpy() * RANKS + rank, "right") - 1
            kept = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rank + place[at, 2]), pa.array(place[at, 3])], schema.names)

    return ranked_df.select(*pieces.columns, "rank").mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 1024, closing: int = 0) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(cut(tokenised_pieces(docs, vocabulary, window, closing)), window)
