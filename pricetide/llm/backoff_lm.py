"""Stupid-backoff language-model scores of every document under the n-gram counts of all others.

score(w | context) is count(context w) / count(context) where that n-gram occurs elsewhere, else alpha times the score
under a shorter context; a word that occurs nowhere else counts one half. The counts are those of the whole table less
the document's own, so copies of a document raise its score but its own text doesn't.

All is relational, on packed rows. Documents are dealt into chunks of bounded size by a hash. A chunk's distinct n-grams
(hashed to 64 bits) with their counts go out as one row for each range of hashes; so a frequent n-gram is one entry
of each chunk, never a hot key. The rows of a range make its part of the count table, which is joined to each chunk's
entries and sent back as counts in the entries' order. Chunk by chunk, n-grams look up their counts and are summed by
document. A chunk has at most half of ``MOST_CHUNKS`` ranges, so rows stay packed and grow with the text: beyond that many
chunks, the chunks of a ward are summed first, and wards, whose ranges are cut finer, meet as chunks do.

Nulls: a null text has no words and score 0; null doc_ids are scored like others. Repeated rows are documents of their
own, so each counts as "another" of the others. Extra columns are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import kernel as K
from pricetide.session import cut

CHUNK_BYTES = 8 << 20  # of text
MOST_CHUNKS = 4096  # whose rows meet at once; more chunks meet by wards of so many
ALPHA = 0.4

_ENTRY = pa.schema([("range", pa.int64()), ("order", pa.int32()), ("chunk", pa.int64()), ("ward", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_ENTRY_DDL = "range bigint, order int, chunk bigint, ward bigint, grams binary, counts binary"
_ANSWER = pa.schema([("chunk", pa.int64()), ("order", pa.int32()), ("range", pa.int64()), ("counts", pa.binary())])
_ANSWER_DDL = "chunk bigint, order int, range bigint, counts binary"
_SCORE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("part", pa.float64()), ("n_unigram", pa.int64()), ("n_backoff", pa.int64())])
_SCORE_DDL = "doc_id bigint, n_words bigint, part double, n_unigram bigint, n_backoff bigint"


def planes(x: np.ndarray) -> bytes:
    """Bytes by significance, which a compressor of the shuffle shortens."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def chunk_words(text: pa.ChunkedArray) -> K.Words:
    """Words of a whole chunk; text numbers run over the chunk."""
    parts, at = [], 0
    for array in text.chunks:
        for part in K.slices(array):
            found = K.words(part)
            parts.append(K.Words(found.hashes, found.text + at + part.lo, found.counts))
        at += len(array)
    if not parts:
        return K.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return K.Words(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length of x at the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _rows(out: dict[str, list], order: int, chunk: int, ward: int, gram: np.ndarray, count: np.ndarray, ranges: int) -> None:
    """Add the rows of sorted n-grams, one for each range that has any."""
    place = range_of(gram, ranges)
    cuts = _runs(place)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out["range"].append(int(place[lo]))
        out["order"].append(order)
        out["chunk"].append(chunk)
        out["ward"].append(ward)
        out["grams"].append(planes(np.diff(gram[lo:hi], prepend=np.uint64(0))))
        out["counts"].append(planes(count[lo:hi].astype(np.uint32 if count[lo:hi].max() < 2**32 else np.uint64)))


def _entries(order: int, ranges: int, wards: int):
    def run(table: pa.Table) -> pa.Table:
        chunk, found = table.column("chunk")[0].as_py(), chunk_words(table.column("text"))
        out: dict[str, list] = {f.name: [] for f in _ENTRY}
        for n in range(1, order + 1):
            gram = np.sort(K.grams(found, n)[0])
            first = _runs(gram)
            _rows(out, n, chunk, chunk % wards, gram[first[:-1]], np.diff(first).astype(np.uint64), ranges)
        return pa.table([pa.array(out[f.name], f.type) for f in _ENTRY], schema=_ENTRY)

    return run


def _ward_entries(ranges: int):
    """The entries of a ward as those of one chunk, with finer ranges: from rows of one ward, range and order."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in _ENTRY}
        known, total, *_ = _summed(table)
        ward = table.column("ward")[0].as_py()
        _rows(out, table.column("order")[0].as_py(), ward, ward, known, total, ranges)
        return pa.table([pa.array(out[f.name], f.type) for f in _ENTRY], schema=_ENTRY)

    return run


def range_of(gram: np.ndarray, ranges: int) -> np.ndarray:
    return (((gram >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of rows of one order and range, their counts, the place of each row's entries there, and the rows' ends."""
    grams = [np.cumsum(unplanes(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("grams")]
    counts = [unplanes(data := x.as_py(), np.uint32 if len(data) == 4 * len(g) else np.uint64) for x, g in zip(table.column("counts"), grams, strict=True)]
    known, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(known)).astype(np.uint64)
    return known, total, at, np.cumsum([0, *map(len, grams)])


def _told(table: pa.Table, total: np.ndarray, at: np.ndarray, ends: np.ndarray) -> pa.Table:
    own = [planes(total[at[lo:hi]]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table([table.column("chunk").combine_chunks(), table.column("order").combine_chunks(), table.column("range").combine_chunks(), pa.array(own, pa.binary())], schema=_ANSWER)


def _answers(table: pa.Table) -> pa.Table:
    """Counts of the whole table for each chunk's entries of one range and order."""
    _, total, at, ends = _summed(table)
    return _told(table, total, at, ends)


def _ward_answers(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The same for a ward's chunks, from the answers to the ward's own entries (in the order of their finer ranges)."""
    if not table.num_rows:
        return pa.table([pa.array([], f.type) for f in _ANSWER], schema=_ANSWER)
    _, _, at, ends = _summed(table)
    parts = sorted(zip(answers.column("range").to_pylist(), answers.column("counts").to_pylist(), strict=True))
    return _told(table, np.concatenate([unplanes(x, np.uint64) for _, x in parts]), at, ends)


def _elsewhere(gram: np.ndarray, text: np.ndarray, answers: list[np.ndarray]) -> np.ndarray:
    """For each n-gram occurrence, how often it occurs in other documents."""
    if not len(gram):
        return np.zeros(0)
    order = np.argsort(gram, kind="stable")  # texts stay in order among equal n-grams
    g, t = gram[order], text[order]
    new = np.append(True, g[1:] != g[:-1])
    total = np.concatenate(answers)[np.cumsum(new) - 1]
    first = np.flatnonzero(new | np.append(True, t[1:] != t[:-1]))
    own = np.repeat(np.diff(np.append(first, len(g))), np.diff(np.append(first, len(g))))
    out = np.empty(len(g))
    out[order] = total - own.astype(np.uint64)
    return out


def _scores(order: int, alpha: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = chunk_words(docs.column("text"))
        n_texts, n_words = docs.num_rows, len(found.hashes)
        held: dict[int, list[tuple[int, np.ndarray]]] = {n: [] for n in range(1, order + 1)}
        for row in answers.to_pylist():
            held[row["order"]].append((row["range"], unplanes(row["counts"], np.uint64)))
        part, steps, done, shorter = np.zeros(n_words), np.zeros(n_words, np.int64), np.zeros(n_words, bool), []
        for n in range(1, order + 1):
            gram, at = K.grams(found, n)
            shorter.append((at, _elsewhere(gram, found.text[at], [x for _, x in sorted(held[n], key=lambda p: p[0])])))
        context = np.zeros((order + 1, n_words))  # [n]: count of the n-gram that begins at a word
        for n, (at, count) in enumerate(shorter, 1):
            context[n, at] = count
        position = np.arange(n_words) - np.repeat(np.cumsum(found.counts) - found.counts, found.counts)
        for n in range(order, 1, -1):
            last = np.flatnonzero((position >= n - 1) & ~done)
            start = last - (n - 1)
            seen = context[n, start] > 0
            hit, miss = last[seen], last[~seen]
            part[hit] += np.log(context[n, start[seen]]) - np.log(context[n - 1, start[seen]])
            done[hit] = True
            part[miss] += np.log(alpha)
            steps[miss] += 1
        rest = np.flatnonzero(~done)
        part[rest] += np.log(np.maximum(context[1, rest], 0.5))
        sums = [np.bincount(found.text, w, n_texts) for w in (part, (~done).astype(float), steps.astype(float))]
        ids = docs.column("doc_id").combine_chunks()
        columns = [ids, pa.array(found.counts.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(np.int64))]
        return pa.table(columns, schema=_SCORE)

    return run


def backoff_scores(docs: DataFrame, order: int = 2, alpha: float = ALPHA, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_unigram, n_backoff, log_score, mean_log_score) for docs (doc_id, text).

    n_unigram counts words scored without context, n_backoff the steps to a shorter one; logarithms are natural.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("bigint")))
    wards = -(-chunks // MOST_CHUNKS)
    ranges = -(-min(chunks, MOST_CHUNKS) // 2)
    entries = dealt.groupBy("chunk").applyInArrow(_entries(order, ranges, wards), _ENTRY_DDL)
    if wards == 1:
        answers = entries.groupBy("range", "order").applyInArrow(_answers, _ANSWER_DDL)
    else:
        finer = -(-wards // 2)
        of_wards = entries.groupBy("ward", "range", "order").applyInArrow(_ward_entries(ranges * finer), _ENTRY_DDL)
        told = of_wards.groupBy("range", "order").applyInArrow(_answers, _ANSWER_DDL).withColumnRenamed("chunk", "ward").withColumn("wide", F.expr(f"range div {finer}"))
        answers = entries.groupBy("ward", "range", "order").cogroup(told.groupBy("ward", "wide", "order")).applyInArrow(_ward_answers, _ANSWER_DDL)
    parts = cut(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(order, alpha), _SCORE_DDL))
    words = parts.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(words) - F.col("n_words"), F.lit(1))
    score = F.col("part") - F.col("n_unigram") * F.log(others.cast("double"))
    return parts.select("doc_id", "n_words", "n_unigram", "n_backoff", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log_score"))
