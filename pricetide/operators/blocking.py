"""Candidate pairs from several blocks at once: tokens, wards, distance and similar vectors; and what they add to a score.

Every block is an equality join. A block of one kind can be so large that its pairs alone (rows of one side times rows of the
other) are more than ``most``: such a block makes no pairs of its own, and those of its pairs that another block holds stay.
Sizes are counted by key before any pair exists, so an oversized block costs its rows and nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import text as T
from pricetide.operators import resolve as R
from pricetide.operators.dedup import first_by
from pricetide.operators.geo import EARTH_KM, haversine_km, within
from pricetide.operators.kinds import expanded, kinds
from pricetide.operators.resolve import candidates, canonical, cosine
from pricetide.session import cut, wide

MOST_PAIRS = 1_000_000  # of one block
BITS, TABLES, SEED = 8, 16, 11  # vectors of cosine 0.8 meet in some table with 0.94; bits should grow with the logarithm of the rows
TILE = 2048  # vectors of a side of a tile, about
ASKERS, LEAST_ASKERS, HOLDERS = 2048, 64, 16_384  # extractions and entities of a block, about
BASES = 1_000_000  # pairs of kinds beside a block of extractions, about
AT_ONCE = 8  # blocks of entities that a task reads beside one of extractions
REACH_KM = 2.0
NEAR_WEIGHT, ALIKE_WEIGHT = 0.1, 0.1


def planes(dims: int, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """Hyperplanes (tables, bits, dims) of entries 1 and -1, made from a seed."""
    return np.random.default_rng(seed).integers(0, 2, (tables, bits, dims)) * 2 - 1


def sound(vector: str, dims: int) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")), F.lit(False)))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in vectors]).reshape(len(vectors), dims)


def _sides(x: np.ndarray, flat: np.ndarray, bits: int) -> np.ndarray:
    """(rows, tables): the sides of each table's hyperplanes as a number."""
    return ((x @ flat >= 0).reshape(len(x), -1, bits) * (1 << np.arange(bits))).sum(axis=2)


def vector_blocks(rows: DataFrame, key: str, vector: str, dims: int, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """(key, kind, block): a block for each table, named by the sides of its hyperplanes that a vector is on.

    Vectors that are null, of another length, or that hold null or no number are in no block.
    """

    def sides(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flat = planes(dims, bits, tables, seed).reshape(-1, dims).astype(float).T
        for vectors in batches:
            yield pd.Series(list(_sides(_matrix(vectors, dims), flat, bits)), dtype=object)

    found = rows.where(sound(vector, dims)).select(key, F.posexplode(F.pandas_udf(sides, "array<bigint>")(vector)).alias("table", "side"))
    return found.select(key, F.concat(F.lit("vector"), "table").alias("kind"), F.col("side").cast("string").alias("block"))


def similar_pairs(rows: DataFrame, key: str, vector: str, dims: int, least: float, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """(id, other, cosine), id < other: rows that share a block of ``vector_blocks``, of a cosine of ``least`` or more.

    Equal vectors are compared once. A block is cut into tiles, and a pair is made in its first table alone, if its vectors
    of bytes come near enough by their own errors; so pairs that aren't alike are no rows. Cosines are then exact.
    """
    members, once = kinds(rows.where(sound(vector, dims)), key, (vector,))
    kind = np.dtype("u1") if bits <= 8 else np.dtype("u4")

    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """The sides, and length of a byte, error, bytes and sides as they travel."""
        flat = planes(dims, bits, tables, seed).reshape(-1, dims).astype(float).T
        for vectors in batches:
            x = _matrix(vectors, dims)
            found = _sides(x, flat, bits)
            top = np.abs(x).max(axis=1, initial=0, keepdims=True)
            unit = x / np.where(top > 0, top, 1)
            unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
            step = np.abs(unit).max(axis=1, initial=1e-300, keepdims=True) / 127
            q = np.rint(unit / step).astype(np.int8)
            step = step.astype("f4")
            off = np.linalg.norm(unit - q * step.astype(float), axis=1, keepdims=True).astype("f4")
            parts = [a.view(np.uint8).reshape(len(x), -1) for a in (np.hstack([step, off]), q, found.astype(kind))]
            yield pd.DataFrame({"sides": list(found), "packed": [r.tobytes() for r in np.hstack(parts)]})

    def near(of: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table, _, i, j = of
        raw = np.frombuffer(b"".join(pdf["packed"]), np.uint8).reshape(len(pdf), -1)
        step, off = np.ascontiguousarray(raw[:, :8]).view("f4").T
        x = np.ascontiguousarray(raw[:, 8 : 8 + dims]).view(np.int8).astype("f4") * step[:, None]
        earlier = np.ascontiguousarray(raw[:, 8 + dims :]).view(kind)[:, :table]
        part, ids, found = pdf["part"].to_numpy(), pdf[key].to_numpy(object), []
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        for begin in range(0, len(left), 512):
            own = left[begin : begin + 512]
            reach = least - 1e-5 - off[own][:, None] - off[right][None] - off[own][:, None] * off[right][None]
            a, b = np.nonzero(x[own] @ x[right].T >= reach)
            a, b = own[a], right[b]
            first = (a < b) if i == j else np.ones(len(a), bool)
            for t in range(table):
                first &= earlier[a, t] != earlier[b, t]
            found.append((a[first], b[first]))
        a, b = (np.concatenate(side) for side in zip(*found, strict=True)) if found else (np.array([], int),) * 2
        return pd.DataFrame({"id": ids[a], "other": ids[b]})

    bytes_of = F.pandas_udf(packed, "sides array<bigint>, packed binary")(vector)
    dealt = cut(once.select(key, bytes_of.alias("p")).select(key, "p.*"))
    blocks = dealt.select(key, "packed", F.posexplode("sides").alias("table", "side"))
    parts = blocks.groupBy("table", "side").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))  # bounded by tables and bits
    own = blocks.join(F.broadcast(parts), ["table", "side"]).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    with_each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    tiles = own.select(key, "packed", "table", "side", "part", F.explode(with_each).alias("tile")).select(key, "packed", "table", "side", "part", "tile.*")
    shape = dealt.schema[key].dataType.simpleString()
    pairs = tiles.groupBy("table", "side", "i", "j").applyInPandas(near, f"id {shape}, other {shape}")
    again = members.groupBy("kind").agg(F.count("*").alias("n")).where("n > 1").select(F.col("kind").alias("id"), F.col("kind").alias("other"))
    a, b = (once.select(F.col(key).alias(name), F.col(vector).alias(f"_{name}")) for name in ("id", "other"))
    scored = pairs.unionByName(again).join(a, "id").join(b, "other").select("id", "other", cosine(F.col("_id"), F.col("_other")).alias("cosine"))
    one, two = (members.withColumnRenamed(key, name) for name in ("id", "other"))
    every = expanded(scored.where(F.col("cosine") >= least).withColumn("same", F.col("id") == F.col("other")), one, two, "id", "other")
    return every.where("id < other OR (NOT same AND id > other)").select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), "cosine")


def block_pairs(left: DataFrame, right: DataFrame, a: str, b: str, most: int = MOST_PAIRS) -> DataFrame:
    """(a, b): pairs of rows (a or b, kind, block) that share a block of at most ``most`` pairs."""
    keys = ["kind", "block"]
    left, right = left.distinct(), right.distinct()
    sizes = left.groupBy(*keys).agg(F.count("*").alias("n")).join(right.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    sound = sizes.where(F.col("n") * F.col("m") <= most).select(*keys)
    return left.join(sound, keys, "left_semi").join(right.join(sound, keys, "left_semi"), keys).select(a, b).distinct()


def ward_blocks(rows: DataFrame, key: str, ward: str) -> DataFrame:
    name = T.normalize_name(ward)
    return rows.where(F.coalesce(name, F.lit("")) != "").select(key, F.lit("ward").alias("kind"), name.alias("block"))


def composite_candidates(extractions: DataFrame, entities: DataFrame, km: float = REACH_KM, dims: int | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """(ext_id, property_id, km, cosine) of pairs that share a token, a ward, a distance of at most ``km`` or a vector block.

    Both sides may have ward, lat, lng and (with ``dims``) vector; km and cosine are null where a side lacks them.
    """
    entities = canonical(entities)
    found = candidates(extractions, entities)
    where = lambda df, key: df.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.col(key).alias("id"), "lat", "lng")
    near = within(where(extractions, "ext_id"), where(entities, "property_id"), km).select(F.col("left_id").alias("ext_id"), F.col("right_id").alias("property_id"))
    pairs = found.unionByName(near).unionByName(_blocked(extractions, entities, dims, most)).distinct()
    return _beside_each_other(pairs, extractions, entities, dims)


def _blocked(extractions: DataFrame, entities: DataFrame, dims: int | None, most: int) -> DataFrame:
    """(ext_id, property_id) of wards and vector blocks."""
    sides = (extractions, "ext_id"), (entities, "property_id")
    blocks = [ward_blocks(df, key, "ward") for df, key in sides]
    if dims:
        blocks = [b.unionByName(vector_blocks(df, key, "vector", dims)) for b, (df, key) in zip(blocks, sides, strict=True)]
    return block_pairs(*blocks, "ext_id", "property_id", most)


def _beside_each_other(pairs: DataFrame, extractions: DataFrame, entities: DataFrame, dims: int | None) -> DataFrame:
    """pairs with km and cosine."""
    more = ["lat", "lng", *(["vector"] if dims else [])]
    e = extractions.select("ext_id", *(F.col(c).alias(f"e_{c}") for c in more))
    c = entities.select("property_id", *(F.col(c).alias(f"c_{c}") for c in more))
    far = haversine_km(F.col("e_lat"), F.col("e_lng"), F.col("c_lat"), F.col("c_lng"))
    alike = cosine(F.col("e_vector"), F.col("c_vector")) if dims else F.lit(None).cast("double")
    return pairs.join(e, "ext_id").join(c, "property_id").select(*pairs.columns, far.alias("km"), alike.alias("cosine"))


def extra_score(km: Column, alike: Column, reach: float = REACH_KM) -> Column:
    """What distance and vectors add: a tenth each at best, nothing beyond the reach, at a right angle or where a side lacks them."""
    near = F.coalesce(F.greatest(1 - km / reach, F.lit(0.0)), F.lit(0.0))
    return NEAR_WEIGHT * near + ALIKE_WEIGHT * F.coalesce(F.greatest(alike, F.lit(0.0)), F.lit(0.0))


def ranked_composite(extractions: DataFrame, entities: DataFrame, km: float = REACH_KM, dims: int | None = None, most: int = MOST_PAIRS, keep: int = R.KEEP) -> DataFrame:
    """(ext_id, property_id, score, rank): the best of ``composite_candidates`` by the score with distance and vectors.

    Pairs of tokens and distance are no rows: names and types are matched once a kind, and blocks of extractions and
    entities are scored as matrices, of which the best of an extraction leave. These and the pairs of wards and vector
    blocks are then scored as rows. Of entities equal in all that is scored, the ``keep`` least ids can be among the best.
    """
    entities = canonical(entities)
    own = ["area_m2", "lat", "lng", *(["vector"] if dims else [])]
    askers, asking = kinds(extractions, "ext_id", (*R.NAMES, "type", *own))
    same = F.md5(F.to_json(F.struct(*R.TEXTS, "type", *own)))
    holding = first_by(entities.withColumn("_same", same), ["_same"], "property_id", k=keep).drop("_same")
    of_ext, asked = kinds(asking, "ext_id", (*R.NAMES, "type"))
    of_ent, held = kinds(holding, "property_id", (*R.TEXTS, "type"))
    left, right = cut(asking.select("ext_id", *own).join(of_ext, "ext_id")), cut(holding.select("property_id", *own).join(of_ent, "property_id"))
    place = lambda df: df.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.col("kind").alias("id"), "lat", "lng").distinct()
    near = within(place(left), place(right), km).select(F.col("left_id").alias("ext_id"), F.col("right_id").alias("property_id"))
    told = candidates(asked, held).withColumn("told", F.lit(True))
    met = told.unionByName(near.withColumn("told", F.lit(False))).groupBy("ext_id", "property_id").agg(F.max("told").alias("told"))
    none = F.lit(None).cast("double")
    texts = R.keyed_extractions(asked.withColumn("area_m2", none)), R.keyed_entities(held.withColumn("area_m2", none))
    base = met.join(texts[0], "ext_id").join(texts[1], "property_id").select("ext_id", F.col("property_id").alias("kind"), R.score().alias("base"), "told")
    best = first_by(_best_in_blocks(left, right, base, km, keep), ["ext_id"], F.desc("score"), "property_id", k=keep)
    rows = R.to_members(best.select("ext_id", "property_id"), askers).select("ext_id", "property_id")
    pairs = _beside_each_other(rows.unionByName(_blocked(extractions, entities, dims, most)).distinct(), extractions, entities, dims)
    return R.ranked_candidates(extractions, entities, keep, pairs, extra_score(F.col("km"), F.col("cosine"), km))


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _best_in_blocks(left: DataFrame, right: DataFrame, base: DataFrame, km: float, keep: int) -> DataFrame:
    """(ext_id, property_id, score): the best entities of an extraction within some blocks of entities.

    left and right have ext_id or property_id, kind, area_m2, lat, lng and maybe vector; base (ext_id, kind, base, told) has
    the score of two kinds without areas, and whether it needs no distance. Rows become packed blocks, those of extractions
    with the base of their kinds; a task reads a block of the left and some of the right from where they are kept, so no
    row is moved for each of the blocks that it meets.
    """
    vector = F.col("vector") if "vector" in left.columns else F.lit(None).cast("array<double>")
    whole = F.when(F.forall(vector, lambda x: x.isNotNull()), vector).alias("vector")
    spots = [F.col(c).cast("double").alias(c) for c in ("area_m2", "lat", "lng")]
    shape = {key: df.schema[key].dataType.simpleString() for df, key in ((left, "ext_id"), (right, "property_id"))}
    base = cut(base.withColumnRenamed("ext_id", "of"))
    n, m, all_cores = left.count(), right.count(), wide(left.sparkSession)
    each = min(max(n // all_cores, LEAST_ASKERS), ASKERS)
    asking, holding = max(-(-n // each), -(-base.count() // BASES), 1), max(-(-m // HOLDERS), 1)
    e = left.select("ext_id", F.col("kind").alias("of"), *spots, whole)
    parts = e.groupBy("of").agg(F.ceil(F.count("*") / each).cast("int").alias("parts"))
    bucket = F.pmod(F.xxhash64("of"), F.lit(asking)).cast("int").alias("bucket")
    asks = e.join(parts, "of").select(bucket, F.pmod(F.xxhash64("ext_id"), F.col("parts")).cast("int").alias("part"), *e.columns)
    wanted = base.join(parts, "of").select(bucket, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "of", "kind", "base", "told")
    c = right.select("property_id", "kind", *spots, whole, F.pmod(F.xxhash64("property_id"), F.lit(holding)).cast("int").alias("block"))

    def ask(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = a.num_rows and b.num_rows
        return pa.table({"asks": pa.array([_packed(a.drop_columns(["bucket", "part"]))] if rows else [], pa.binary()), "bases": pa.array([_packed(b.drop_columns(["bucket", "part"]))] if rows else [], pa.binary())})

    def hold(b: pa.Table) -> pa.Table:
        return pa.table({"holds": pa.array([_packed(b.drop_columns(["block"]).sort_by("property_id"))], pa.binary())})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [pd.DataFrame({"ext_id": [], "property_id": [], "score": []}, dtype=object)]
        for batch in batches:
            for asks, bases, holds in zip(*batch.columns, strict=True):
                found += _scored(_unpacked(asks.as_py()), _unpacked(bases.as_py()), _unpacked(holds.as_py()), km, keep)
        top = pd.concat(found).sort_values(["score", "property_id"], ascending=[False, True]).groupby("ext_id").head(keep)
        if len(top):
            yield pa.RecordBatch.from_pandas(top.astype({"score": float}), preserve_index=False)

    block = ["bucket", "part"]
    some = cut(asks.groupBy(*block).cogroup(wanted.groupBy(*block)).applyInArrow(ask, "asks binary, bases binary").repartition(asking))
    others = cut(c.repartition(holding, "block").groupBy("block").applyInArrow(hold, "holds binary")).coalesce(-(-holding // AT_ONCE))
    pairs = some.hint("shuffle_replicate_nl").crossJoin(others)  # a batch is a task's rows: one block, or a few, beside AT_ONCE
    return pairs.mapInArrow(best, f"ext_id {shape['ext_id']}, property_id {shape['property_id']}, score double")


def _scored(a: pa.Table, base: pa.Table, b: pa.Table, km: float, keep: int) -> Iterator[pd.DataFrame]:
    """The best entities (b, by property_id) of the extractions of a block (a), kind by kind."""
    values = lambda t, name: t[name].to_numpy().astype(float)
    asked, kinds_of = (t[name].combine_chunks().dictionary_encode() for t, name in ((a, "of"), (b, "kind")))
    at = [pc.fill_null(pc.index_in(base[name], value_set=x.dictionary), -1).to_numpy() for name, x in (("of", asked), ("kind", kinds_of))]
    of, kind, own_base, own_told = asked.indices.to_numpy(), kinds_of.indices.to_numpy(), values(base, "base"), base["told"].to_numpy().astype(bool)
    lists = [t["vector"].to_pylist() if pa.types.is_null(t["vector"].type) else t["vector"].to_pandas() for t in (a, b)]
    lengths = [np.array([-1 if v is None else len(v) for v in x], int) for x in lists]
    matrix = {k: [_matrix([x[i] for i in np.flatnonzero(size == k)], k) for x, size in zip(lists, lengths, strict=True)] for k in np.unique(lengths[0]) if k > 0 and (lengths[1] == k).any()}
    place = [np.zeros(len(size), int) for size in lengths]
    for k in matrix:
        for p, size in zip(place, lengths, strict=True):
            p[size == k] = np.arange((size == k).sum())
    numbers_a, numbers_b = ([values(t, name) for name in ("area_m2", "lat", "lng")] for t in (a, b))
    for o in range(len(asked.dictionary)):
        use = (at[0] == o) & (at[1] >= 0)
        scores, says, met = np.zeros(len(kinds_of.dictionary)), np.zeros(len(kinds_of.dictionary), bool), np.zeros(len(kinds_of.dictionary), bool)
        scores[at[1][use]], says[at[1][use]], met[at[1][use]] = own_base[use], own_told[use], True
        others = np.flatnonzero(met[kind])
        if not len(others):
            continue
        scored, told = scores[kind[others]], says[kind[others]]
        held, lat, lng = (x[others] for x in numbers_b)
        members = np.flatnonzero(of == o)
        step = max((1 << 21) // len(others), 1)
        for own in (members[begin : begin + step] for begin in range(0, len(members), step)):
            area_of, lat_of, lng_of = (x[own] for x in numbers_a)
            with np.errstate(all="ignore"):
                area = (held > 0) & (np.abs(area_of[:, None] - held) / held <= 0.1)
                up = lat_of[:, None] - lat
                i, j = np.nonzero(np.abs(up) <= km / 110)
                half = np.sin(np.radians(up[i, j]) / 2) ** 2 + np.cos(np.radians(lat_of[i])) * np.cos(np.radians(lat[j])) * np.sin(np.radians(lng[j] - lng_of[i]) / 2) ** 2
                far = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(half, 1)))
                close = far <= km
                i, j, far = i[close], j[close], far[close]
                alike = np.zeros(up.shape)
                for k, (left, right) in matrix.items():
                    rows, columns = np.flatnonzero(lengths[0][own] == k), np.flatnonzero(lengths[1][others] == k)
                    x, y = left[place[0][own[rows]]], right[place[1][others[columns]]]
                    size = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))
                    alike[np.ix_(rows, columns)] = np.where(size == 0, 0, np.maximum(x @ y.T / size, 0))
            near, reached = np.zeros(up.shape), np.broadcast_to(told, up.shape).copy()
            near[i, j] = 1 - far / km
            reached[i, j] = True
            score = np.round(scored + 0.1 * area + (NEAR_WEIGHT * near + ALIKE_WEIGHT * alike), 12)
            score = np.where(reached, np.where(np.isnan(score), np.inf, score), -1)  # no number is first in Spark's order
            if score.shape[1] > keep:
                least = np.partition(score, -keep, axis=1)[:, -keep, None]
                over, equal = score > least, score == least
                chosen = over | (equal & (np.cumsum(equal, axis=1) <= keep - over.sum(axis=1, keepdims=True)))
            else:
                chosen = np.ones(score.shape, bool)
            i, j = np.nonzero(chosen & (score > 0))
            yield pd.DataFrame({"ext_id": a["ext_id"].take(own[i]).to_pandas().to_numpy(object), "property_id": b["property_id"].take(others[j]).to_pandas().to_numpy(object), "score": score[i, j]})
