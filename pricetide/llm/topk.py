"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are grouped by length (norm ranges, each cut into blocks of bounded size) and queries into blocks. A first
pass over a block of the longest vectors gives each query a lower bound of its k-th score. Pairs of blocks in which no
query can reach its bound, by the longest norm, are left out before any vector moves. In every other pair that bound, over the query's norm and the block's largest norm, is a local cosine threshold: above 1 the query
passes the block over; if it is high, vectors whose coordinates can't reach it at the query's largest coordinates are
dropped; else only those too short are. What is left is verified by the products themselves.

Scores are integers and exact: products are taken in floating point where they are below 2**53, else with Python's
integers (a score beyond 64 bits becomes the nearest 64-bit number). Ties go to the smaller vec_id.

Nulls: null vectors, vectors with a null, NaN or infinite component, and null ids take no part. Rows that repeat an
id and a vector count once; a row never finds vectors of its own id. Vectors meet queries of their own dimension only.
Other columns are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm import kernel as K
from pricetide.session import cut

NORM_RANGES, RANGE_ROWS = 64, 256  # ranges at most, and vectors of a range at least
BLOCK_ROWS, QUERY_ROWS = 4096, 512
FOCUS = 4  # coordinates that prune
HIGH_COSINE = 0.6  # local thresholds from here on prune by coordinates
_EXACT = 2**53

_PACKED = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>, norm2, dims): floor(scale * x) of every sound vector."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("bigint"))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).distinct()
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return rows.withColumn("norm2", norm2).withColumn("dims", F.size("v"))


def _pack(rows: DataFrame, id_column: str) -> DataFrame:
    """(block, ids, rows): one packed row for each value of ``block``, the longest vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, data = None, [], []

        def done() -> pa.RecordBatch:
            return K.table({"block": [held], "ids": [b"".join(ids)], "rows": [b"".join(data)]}, _PACKED)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            own = batch.column("id").to_numpy()
            values, ends = batch.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column("dims").to_numpy())])
            cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                if held is not None and blocks[lo] != held:
                    yield done()
                    ids, data = [], []
                held = int(blocks[lo])
                ids.append(own[lo:hi].astype(np.int64).tobytes())
                data.append(values[ends[lo] : ends[hi]].astype(np.int64).tobytes())
        if held is not None:
            yield done()

    chosen = rows.select("block", F.col(id_column).alias("id"), "v", "dims", "norm2")
    return chosen.repartition("block").sortWithinPartitions("block", F.desc("norm2")).drop("norm2").mapInArrow(run, "block bigint, ids binary, rows binary")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of q with those of c."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    most = max(abs(int(q.max())), abs(int(q.min()))) * max(abs(int(c.max())), abs(int(c.min()))) * q.shape[1]
    if most < _EXACT:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    whole = q.astype(object) @ c.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of up to k best of a block for each query; only scores of at least its floor."""
    c_norm, q_norm = np.sqrt((c.astype(float) ** 2).sum(axis=1)), np.sqrt((q.astype(float) ** 2).sum(axis=1))
    least = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(least <= 0, -1.0, least / (q_norm * c_norm.max(initial=0)))
    active = np.flatnonzero(~(cosine > 1 + 1e-9))
    steep = active[cosine[active] >= HIGH_COSINE]
    flat = np.setdiff1d(active, steep)

    def best(i: int, ids: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ok = (ids != q_ids[i]) & (score >= least[i])
        ids, score = ids[ok], score[ok]
        if len(score) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[score >= edge], score[score >= edge]
        if len(ids):
            order = np.lexsort((ids, -score))[:k]
            yield i, ids[order], score[order]

    if len(flat):  # by length: rows come longest first
        with np.errstate(divide="ignore", invalid="ignore"):
            short = np.where(least[flat] <= 0, -np.inf, least[flat] / q_norm[flat])
        ends = len(c) - np.searchsorted(c_norm[::-1], short * (1 - 1e-9), "left")
        for at in range(0, len(flat), 128):
            part = flat[at : at + 128]
            most = int(ends[at : at + 128].max())
            score = products(q[part], c[:most])
            for row, i in enumerate(part):
                n = int(ends[at + row])
                yield from best(i, c_ids[:n], score[row, :n])
    unit = c / np.where(c_norm > 0, c_norm, 1)[:, None] if len(steep) else None
    for i in steep:  # by coordinate: the angle to a coordinate's axis bounds the cosine
        direction = q[i] / q_norm[i]
        near = np.ones(len(c), bool)
        spread = np.arccos(min(1.0, cosine[i]))
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            angle = np.arccos(np.clip(direction[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + spread)) - 1e-9, np.cos(max(0.0, angle - spread)) + 1e-9
            near &= (unit[:, f] >= low) & (unit[:, f] <= high)
        if near.any():
            yield from best(i, c_ids[near], products(q[i : i + 1], c[near])[0])


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) from packed pairs: q_ids, q_rows, floors (binary or null), c_ids, c_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("q_ids", "q_rows", "floors", "c_ids", "c_rows")}
                q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
                q, c = np.frombuffer(row["q_rows"], np.int64).reshape(len(q_ids), -1), np.frombuffer(row["c_rows"], np.int64).reshape(len(c_ids), -1)
                floor = None if row["floors"] is None else np.frombuffer(row["floors"], np.int64)
                found = list(search_block(q_ids, q, c_ids, c, k, floor))
                if found:
                    yield K.table({"query_id": np.repeat(q_ids[[i for i, _, _ in found]], [len(x) for _, x, _ in found]), "vec_id": np.concatenate([x for _, x, _ in found]), "score": np.concatenate([s for _, _, s in found])}, _FOUND)

    return pairs.select("q_ids", "q_rows", "floors", "c_ids", "c_rows").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, size: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """rows with ``block``, and a small table of the blocks: dims, level (of norms, from 0), salt, block and its longest norm."""
    cuts = [i / ranges for i in range(1, ranges)]
    edges = cut(rows.groupBy("dims").agg((F.percentile_approx("norm2", cuts) if cuts else F.array().cast("array<double>")).alias("edges")))
    levelled = rows.join(edges, "dims").withColumn("level", F.size(F.filter("edges", lambda x: F.col("norm2") > x))).drop("edges")
    counts = cut(levelled.groupBy("dims", "level").agg(F.ceil(F.count("*") / size).cast("bigint").alias("salts"), F.sqrt(F.max("norm2")).alias("longest")))
    salted = levelled.join(counts.select("dims", "level", "salts"), ["dims", "level"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(7)), "salts"))
    block = F.xxhash64("dims", "level", "salt").alias("block")
    listed = counts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")).select("dims", "level", "salt", block, "longest")
    return salted.select("vec_id", "v", "norm2", "dims", block), listed


def _wanted(asked: DataFrame, asked_blocks: DataFrame, blocks: DataFrame, firsts: DataFrame, floors: DataFrame) -> DataFrame:
    """(q_block, block): the pairs of blocks, beyond the first ones, in which some query's floor can be reached.

    By the norms alone: a block of which the longest vector is shorter than the least floor / norm of the queries is out.
    """
    known = asked.select(F.col("block").alias("q_block"), F.col("vec_id").alias("query_id"), "norm2").join(floors, "query_id", "left")
    need = F.when(F.col("least") > 0, F.col("least") / F.sqrt("norm2")).otherwise(-1.0)  # null: the query has no floor yet
    reach = known.groupBy("q_block").agg((F.min(need) * (1 - 1e-9)).alias("reach"))
    ours = asked_blocks.select("dims", F.col("block").alias("q_block")).join(reach, "q_block").join(firsts.withColumnRenamed("block", "first"), "dims")
    return ours.join(blocks.select("dims", "block", "longest"), "dims").where((F.col("block") != F.col("first")) & ((F.col("longest") >= F.col("reach")) | (F.col("reach") < 0))).select("q_block", "block")


def exact_topk(vectors: DataFrame, is_query: Column, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors (vec_id, embedding) where ``is_query`` (of vec_id) holds."""
    rows = cut(integer_vectors(vectors, scale))
    total = rows.count()
    placed, blocks = _blocks(rows, BLOCK_ROWS, max(1, min(NORM_RANGES, total // RANGE_ROWS)))
    asked, asked_blocks = _blocks(rows.where(is_query), QUERY_ROWS, 1)
    c = cut(_pack(placed, "vec_id").select("block", F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows")))
    q = cut(_pack(asked, "vec_id").select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")))
    firsts = blocks.groupBy("dims").agg(F.min_by("block", F.struct(-F.col("level"), F.col("salt"))).alias("block"))
    opening = asked_blocks.select("dims", F.col("block").alias("q_block")).join(firsts, "dims").select("q_block", "block")
    opened = cut(_search(q.withColumn("floors", F.lit(None).cast("binary")).join(opening, "q_block").join(c, "block"), k))
    floors = cut(_best(opened, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("query_id", "least"))
    wanted = _wanted(asked, asked_blocks, blocks, firsts, floors)
    pairs = q.join(_floors_by_block(q, floors), "q_block").join(wanted, "q_block").join(c, "block")
    found = opened.unionByName(_search(pairs, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floors_by_block(q: DataFrame, floors: DataFrame) -> DataFrame:
    """(q_block, floors): the lower bounds of a block's queries, in its order."""
    low = -(2**63)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column("q_block").to_pylist(), batch.column("q_ids").to_pylist(), strict=True):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_pydict({"q_block": np.full(len(own), block), "at": np.arange(len(own)), "query_id": own})

    listed = q.select("q_block", "q_ids").mapInArrow(spread, "q_block bigint, at bigint, query_id bigint")
    known = listed.join(floors, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(low)))
    by_block = known.groupBy("q_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "least"))), lambda s: s["least"]).alias("least"))

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"q_block": batch.column("q_block"), "floors": pa.array([np.array(x, np.int64).tobytes() for x in batch.column("least").to_pylist()], pa.binary())})

    return by_block.mapInArrow(pressed, "q_block bigint, floors binary")
