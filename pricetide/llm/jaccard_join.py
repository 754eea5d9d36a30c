"""Exact n-gram Jaccard self-join with connected components.

1. A document's set is its distinct word shingles (hashed to 64 bits); equal sets collapse into one node.
2. Candidates. Sets of a size band differ in at most k hashes if they reach the threshold. Each set is cut by hash
   range into k + 1 parts and some spare ones, and each leaves out as many parts as are spare: empty ones, then those
   with the fewest hashes that aren't frequent in the table (a passage that many texts share leads nowhere). The order
   depends on a part's contents alone, so two such sets still agree in a part that both keep. Sets
   that agree in a part of a band they both can join in are connected; the connected groups are the only places
   where links can be. A task connects what agrees within it by itself, so it sends a key once a chunk at most. Keys
   travel packed, a row for each chunk and range of keys, and name sets by 32 bits: sets of equal names or equal packed
   keys are only looked at in vain.
3. Tiles. A group is cut into size bands and blocks of bounded size; a tile is a pair of blocks of one band or of
   neighbouring bands. In a tile, parity bitmaps of the hashes bound the overlap of two sets from above
   (bits that differ are at most the hashes that differ), and sorted arrays of those left are intersected.
4. Pairs already connected within a tile are passed over, so a tile emits a spanning forest of its links, and
   components over all tiles are those of all links: no link between different sets is lost.

Texts are moved only where they may be needed: a bitmap of bounded size tells which tags surely aren't among the wanted ones.

Nulls: a null text has an empty set and no links; a null doc_id takes part but never names a component unless all
are null. Repeated rows are nodes with the same set. Extra columns are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm import kernel as K
from pricetide.llm.graph import connected_components
from pricetide.session import cut, wide

BLOCK_ROWS, BLOCK_HASHES = 4096, 1_600_000  # of a tile's side; 64 bits a hash
SEEN = 1_000_000  # sets that a task remembers, to send equal ones once
GROWTH = 1.5  # of the size bands of step 2
SPARE = 3  # one spare part for so many hashes that may differ
CHUNK_KEYS = 2_000_000  # keys or hashes that a task holds at a time
KEY_BITS, SHORT = 46, 0xFFFFFFFF  # of a key as it travels, and of a set's name beside it
RANGE_HASHES, MOST_RANGES = 2_000_000, 4096  # hashes of the table for a range of keys, which is joined at once; and how many ranges there are at most
MARKS, LEAST_MARKS, MOST_MARKS = 32, 1 << 16, 1 << 27  # bits of a bitmap for each tag, and of all
#: Hashes that a task reports as frequent, the least count there, and how many of the whole table count as frequent. These
#: choose which parts are left out, and so how much work there is; the links found are the same with any others.
FREQUENT, LEAST_FREQUENT, HOT = 5_000, 8, 20_000


def band_tops(most: int) -> np.ndarray:
    """Largest sizes of the bands up to the one that holds ``most``."""
    tops, low = [], 1
    while not tops or tops[-1] < most:
        nxt = max(low + 1, int(low * GROWTH))
        tops.append(nxt - 1)
        low = nxt
    return np.array(tops)


def node_ids(sets: K.Sets) -> np.ndarray:
    """One 64-bit id for each distinct set."""
    size = np.diff(sets.bounds).astype(np.uint64)
    return K.mix(K.sum_ranges(K.mix(sets.hashes ^ K.PLACE[40]), sets.bounds) + size * K.PLACE[41]).view(np.int64)


def part_keys(hashes: np.ndarray, cold: np.ndarray, tops: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of step 2 for one set: for its own band and those above it that it can reach. cold: which hashes are rare."""
    size = len(hashes)
    own, reach = np.searchsorted(tops, [size, size * den // num])
    out = []
    for band in range(own, min(reach, len(tops) - 1) + 1):
        differ = 2 * int(tops[band]) * (den - num) // (den + num)
        if not differ:
            continue  # only equal sets link
        spare = 1 + differ // SPARE
        parts = np.uint64(differ + 1 + spare)
        part = ((hashes >> np.uint64(32)) * parts) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums = np.add.reduceat(K.mix(hashes ^ K.PLACE[42]), first)
        place, empty = part[first], int(parts) - len(first)
        if empty > spare:  # too many empty parts to rule out that they are all two sets agree in
            none = np.setdiff1d(np.arange(parts, dtype=np.uint64), place)
            place, sums = np.concatenate([place, none]), np.concatenate([sums, np.zeros(len(none), np.uint64)])
        keys = K.mix(sums + K.mix(place * K.PLACE[43] + np.uint64(band * int(K.PLACE[44]) % 2**64)))
        if empty < spare:  # the parts that tell least are left out, by an order that depends on their contents alone
            order = np.lexsort((keys, np.diff(first, append=size), np.add.reduceat(cold.astype(np.int64), first)))
            keys = keys[order[spare - empty :]]
        out.append(keys)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


class Frequent:
    """The hashes met most, of a stream of hashes, in bounded memory; counts are lower bounds."""

    def __init__(self):
        self.waiting, self.n, self.hashes, self.counts = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.n += len(hashes)
        if self.n > CHUNK_KEYS:
            self._fold()

    def _fold(self) -> None:
        new, count = np.unique(np.concatenate(self.waiting), return_counts=True)
        known, at = np.unique(np.concatenate([self.hashes, new[count > 1]]), return_inverse=True)
        total = np.bincount(at, np.concatenate([self.counts, count[count > 1]]), len(known)).astype(np.int64)
        top = np.argsort(-total, kind="stable")[:FREQUENT]
        self.waiting, self.n, self.hashes, self.counts = [], 0, known[top], total[top]

    def most(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            self._fold()
        top = self.counts >= LEAST_FREQUENT
        return self.hashes[top].view(np.int64), self.counts[top]


def _describe(n: int):
    """A row for each row of docs; at the end, rows with a null node, a frequent hash as their tag and minus its count."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = Frequent(), set()
        for batch in batches:
            size, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in K.slices(batch.column("text")):
                sets = K.shingle_sets(part, n)
                own = node_ids(sets)
                size.append(np.diff(sets.bounds))
                node.append(own)
                new = np.array([x not in seen and not seen.add(x) for x in own.tolist()], bool)  # equal sets count once
                frequent.add(sets.hashes[np.repeat(new, size[-1])])
                if len(seen) > SEEN:
                    seen = set()
            yield K.table({"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "n_shingles": np.concatenate(size), "node": np.concatenate(node)}, schema)
        hashes, counts = frequent.most()
        none = pa.nulls(len(hashes), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(hashes), pa.array(-counts), none], schema=schema)

    return run


def combined(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, node) that connect the same nodes as the given ones, with one row for each of the given keys.

    Of the nodes of a key the least stays with it; each other one is connected with that by a key of the least node's own.
    """
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    least = nodes[first][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([least, nodes])[:, least != nodes], axis=1)
    heads = np.unique(pairs[0])
    own = lambda x: K.mix(x.view(np.uint64) ^ K.PLACE[45]).view(np.int64)
    return np.concatenate([keys[first], own(pairs[0]), own(heads)]), np.concatenate([nodes[first], pairs[1], heads])


def packed(keys: np.ndarray, nodes: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, bytes): the keys' upper KEY_BITS by range, in order as steps of as few bytes as the longest takes; then the nodes' names."""
    keys = keys.view(np.uint64) >> np.uint64(64 - KEY_BITS)
    order = np.argsort(keys, kind="stable")
    keys, names = keys[order], nodes.view(np.uint64)[order].astype(np.uint32)
    width = -(-(1 << KEY_BITS) // ranges)
    of = (keys // np.uint64(width)).astype(np.int64)
    ends = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    for lo, hi in zip(ends, ends[1:] if len(of) else [], strict=False):
        steps = np.diff(keys[lo:hi], prepend=np.uint64(int(of[lo]) * width))
        size = max((int(steps.max()).bit_length() + 7) // 8, 1)
        yield int(of[lo]), bytes([size]) + steps.view(np.uint8).reshape(-1, 8)[:, :size].tobytes() + names[lo:hi].tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys, counted from the begin of their range, and names of the nodes."""
    size, rest = data[0], np.frombuffer(data, np.uint8, offset=1)
    n = len(rest) // (size + 4)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :size] = rest[: n * size].reshape(n, size)
    return np.cumsum(steps.view(np.uint64)[:, 0]), np.frombuffer(rest[n * size :].tobytes(), np.uint32)


def _keys(n: int, num: int, den: int, hot: np.ndarray, ranges: int):
    schema = pa.schema([("range", pa.int32()), ("packed", pa.binary())])
    hot = np.sort(hot)

    def cold(hashes: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.ones(len(hashes), bool)
        return hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] != hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tops, keys, owner, waiting = band_tops(1 << 10), [], [], 0

        def done() -> pa.RecordBatch:
            rows = [*packed(*combined(np.concatenate(keys), np.concatenate(owner)), ranges)]
            return K.table({"range": [r for r, _ in rows], "packed": [x for _, x in rows]}, schema)

        for batch in batches:
            for part in K.slices(batch.column("text")):
                sets = K.shingle_sets(part, n)
                sizes, rare = np.diff(sets.bounds), cold(sets.hashes)
                if len(sizes) and tops[-1] < (most := int(sizes.max()) * den // num):
                    tops = band_tops(most)
                for i, node in enumerate(node_ids(sets).tolist()):
                    if sizes[i] and node not in seen:
                        seen.add(node)
                        own = slice(sets.bounds[i], sets.bounds[i + 1])
                        keys.append(part_keys(sets.hashes[own], rare[own], tops, num, den))
                        owner.append(np.full(len(keys[-1]), node))
                        waiting += len(keys[-1])
                if len(seen) > SEEN:
                    seen = set()
                if waiting > CHUNK_KEYS:
                    yield done()
                    keys, owner, waiting = [], [], 0
        if keys:
            yield done()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least): names of sets that share a key, each beside the least of them. Rows of a range come together."""
    schema = pa.schema([("node", pa.int64()), ("least", pa.int64())])

    def solve(held: list[bytes]) -> pa.RecordBatch:
        keys, names = (np.concatenate(x) for x in zip(*map(unpacked, held), strict=True))
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order].astype(np.int64)
        first = np.append(True, keys[1:] != keys[:-1])
        least = names[first][np.cumsum(first) - 1]
        pairs = np.unique(np.stack([names, least])[:, names != least], axis=1)
        return K.table({"node": pairs[0], "least": pairs[1]}, schema)

    at, held = None, []
    for batch in batches:
        for r, data in zip(batch.column("range").to_pylist(), batch.column("packed"), strict=True):
            if r != at and held:
                yield solve(held)
                held = []
            at = r
            held.append(data.as_py())
    if held:
        yield solve(held)


def marked(tags: DataFrame) -> np.ndarray:
    """A bitmap of the tags of a table, by their lowest bits; about MARKS bits a tag, MOST_MARKS at most."""
    bits = 1 << min(max(MARKS * tags.count(), LEAST_MARKS) - 1, MOST_MARKS - 1).bit_length()
    at = F.col("tag").bitwiseAND(bits - 1)
    words = tags.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def maybe(marks: np.ndarray) -> Column:
    """Whether a row's tag may be among the marked ones: always so if it is."""

    def look(tags: pd.Series) -> pd.Series:
        at = tags.to_numpy(np.int64) & (64 * len(marks) - 1)
        return pd.Series((marks[at >> 6] >> (at & 63) & 1).astype(bool))

    return F.pandas_udf(look, "boolean")("tag")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps: a bit tells whether an odd number of a set's hashes fall on it. One width for all."""
    most = max(len(s) for s in sets)
    log = min(15, max(6, int(8 * most - 1).bit_length()))
    out = np.empty((len(sets), (1 << log) // 64), np.uint64)
    for i, s in enumerate(sets):
        odd = np.bincount((s >> np.uint64(64 - log)).astype(np.int64), minlength=1 << log) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def tile_links(nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a tile. Pairs of unlike sides count, or all if there is one side."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, sides, sets = nodes[order], sides[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    both = sides.min() != sides.max()
    bits, label, out = bitmaps(sets), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(size, size[i] * den // num, "right"))
        other = np.arange(i + 1, end)
        other = other[(label[other] != label[i]) & ((sides[other] != sides[i]) | (not both))]
        if not len(other):
            continue
        differ = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
        total = size[other] + size[i]
        near = (total - differ) * (den + num) >= 2 * num * total
        for j in other[near][np.argsort(differ[near], kind="stable")].tolist():
            if label[j] == label[i]:
                continue
            at = np.searchsorted(sets[j], sets[i])
            at[at == len(sets[j])] = 0
            common = int(np.count_nonzero(sets[j][at] == sets[i]))
            if den * common >= num * (int(size[i] + size[j]) - common):
                out.append((int(nodes[j]), int(nodes[i])))
                label[label == label[j]] = label[i]
    return out


def _tiles(n: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(held: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        links = tile_links(np.array(list(held)), np.array([x[0] for x in held.values()]), [x[1] for x in held.values()], num, den)
        return K.table({"a": [x for x, _ in links], "b": [x for _, x in links]}, schema) if links else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            tiles, nodes, sides = (batch.column(c).to_numpy() for c in ("tile", "node", "side"))
            for part in K.slices(batch.column("text")):
                sets = K.shingle_sets(part, n)
                for i in range(part.hi - part.lo):
                    at = part.lo + i
                    if tiles[at] != tile:
                        if (out := solve(held)) is not None:
                            yield out
                        tile, held = tiles[at], {}
                    if int(nodes[at]) not in held:
                        held[int(nodes[at])] = (int(sides[at]), sets.hashes[sets.bounds[i] : sets.bounds[i + 1]].copy())
        if (out := solve(held)) is not None:
            yield out

    return run


def _id():
    return F.col("doc_id").cast("bigint")


def _text():
    return F.col("text").cast("string")


def _assign(members: DataFrame, num: int, den: int) -> DataFrame:
    """Tiles of each member (node, tag, n, root): one for a small group, else pairs of blocks of like or neighbouring bands."""
    step = float(np.log(den / num * 1.02))
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    bands = banded.groupBy("root", "band").agg(F.count("*").alias("rows"), F.sum("n").alias("hashes"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("int")
    groups = bands.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", blocks))).alias("blocks"), F.sum("rows").alias("rows"), F.sum("hashes").alias("hashes"))
    whole = (F.col("rows") <= BLOCK_ROWS) & (F.col("hashes") <= BLOCK_HASHES)
    size = lambda band: F.coalesce(F.try_element_at("blocks", band), F.lit(0))
    steps = lambda band: F.when(size(band) > 0, F.sequence(F.lit(0), size(band) - 1)).otherwise(F.array().cast("array<int>"))
    band, block = F.col("band"), F.col("block")
    key = lambda *of: F.xxhash64("root", *of)
    cell = lambda tile, side: F.struct(tile.alias("tile"), side.alias("side"))
    own = F.transform(steps(band), lambda j: cell(key(band, F.least(block, j), band, F.greatest(block, j)), (block > j).cast("int")))
    above = F.transform(steps(band + 1), lambda j: cell(key(band, block, band + 1, j), F.lit(0)))
    below = F.transform(steps(band - 1), lambda j: cell(key(band - 1, j, band, block), F.lit(1)))
    tiles = F.when(whole, F.array(cell(F.col("root"), F.lit(0)))).otherwise(F.concat(own, above, below))
    return (
        banded.join(groups, "root")
        .withColumn("block", F.pmod(F.xxhash64("node"), size(band).cast("bigint")).cast("int"))
        .select("node", "tag", F.explode(tiles).alias("t"))
        .select("node", "tag", "t.tile", "t.side")
    )


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, tag, n_shingles, node, root, component_id) for each row of docs (doc_id, text).

    Sets of lower-case n-word shingles link when den * intersection >= num * union. component_id is the least doc_id
    that links reach, root names the component itself; documents of equal ``node`` have the same set, and rows of equal
    ``tag`` the same id and text.
    """
    rows = docs.select(_id().alias("doc_id"), _text().alias("text")).withColumn("tag", F.xxhash64("doc_id", "text"))
    described = cut(rows.mapInArrow(_describe(n), "doc_id bigint, tag bigint, n_shingles bigint, node bigint"))
    sets = described.where("node is not null")
    often = described.where("node is null").groupBy("tag").agg(F.sum("n_shingles").alias("n")).orderBy("n", "tag").limit(HOT).collect()
    hot = np.array([r["tag"] for r in often], np.int64).view(np.uint64)
    hashes = sets.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = min(max(hashes // RANGE_HASHES, wide(docs.sparkSession)), MOST_RANGES)
    keys = rows.select("text").mapInArrow(_keys(n, num, den, hot, ranges), "range int, packed binary")
    met = keys.repartition("range").sortWithinPartitions("range").mapInArrow(_met, "node bigint, least bigint")
    groups = connected_components(met, "node", "least").withColumnRenamed("node", "short")
    nodes = sets.where("n_shingles > 0").groupBy("node").agg(F.min("tag").alias("tag"), F.max("n_shingles").alias("n"))
    short = F.col("node").bitwiseAND(F.lit(SHORT))
    tiles = cut(_assign(nodes.withColumn("short", short).join(groups, "short").drop("short"), num, den))
    placed = rows.where(maybe(marked(tiles.select("tag")))).join(tiles, "tag").select("tile", "node", "side", "text")
    links = placed.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(n, num, den), "a bigint, b bigint")
    linked = connected_components(links)
    least_id = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = least_id.join(least_id.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "root", "component_id")
    return (
        sets.join(named, "node", "left")
        .select("doc_id", "tag", "n_shingles", "node", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near-duplicates: of each component the row of least doc_id stays (null ids come last), and all rows
    without shingles. Rows that repeat an id and a text count as copies, one stays.
    """
    found = cut(jaccard_components(docs, n, num, den).select("doc_id", "tag", "n_shingles", "root"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tag"))
    chosen = found.where("n_shingles > 0").groupBy("root").agg(F.min_by("tag", order).alias("tag")).select("tag")
    kept = chosen.unionByName(found.where("n_shingles = 0").select("tag").distinct())
    times = found.groupBy("tag").agg(F.count("*").alias("times")).join(kept.withColumn("kept", F.lit(True)), "tag", "left")
    doubtful = maybe(marked(times.where("kept IS NULL OR times > 1").select("tag")))  # all others stay, and needn't move
    held = docs.select(F.xxhash64(_id(), _text()).alias("tag"), F.struct(*docs.columns).alias("row"))  # no name of docs clashes in here
    moved = held.where(doubtful).join(kept, "tag", "left_semi").dropDuplicates(["tag"])
    return held.where(~doubtful).unionByName(moved).select("row.*")
