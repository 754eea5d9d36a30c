"""The trie of conversations by their turns, found by blocks of turns.

A turn is the hash of role and text with its position; a prefix is named by the exclusive or of its turns' hashes (128
bits), so a window over a conversation's blocks names all its block ends. Conversations are grouped by successive blocks of
``BLOCK`` turns first, and only distinct blocks remain. Where a group goes on with one block alone, the turns inside it are
nodes as they are; only where siblings diverge are the distinct blocks cut into turns and grouped again.

Sums over a subtree need no walk. Every node belongs to its smallest member, and a conversation owns what is below the
point where it leaves all smaller ones. So the nodes below x are those that x's members own, but for the path down to x:
totals over members, added up by blocks as the counts are, give leaves and words of any subtree at once.

Nulls: null role or text is empty, null turn comes first, rows of null conv_id belong to no conversation and take no part.
Rows of equal turn are taken by role, then hash of the text; repeated rows are turns of their own. Texts of any length
count whole, but only hashes and counts are moved. Many children of one node (the root), or copies of one conversation, are
added up before any shuffle; a node's ending members are joined in pieces and hashed as a stream. A conversation's blocks
meet in one task's window. Tables without rows give no nodes. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import stash

BLOCK = 4  # turns
WORD = r"[^\x20\x09-\x0D]+"
HOT_PARENTS = 1000  # nodes of more than this part of all children are broadcast, fewer than so many
PIECE = 4096  # ids that are joined into one string
NODE, UP, START, END = ["node1", "node2"], ["up1", "up2"], ["start1", "start2"], ["end1", "end2"]


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv, place (from 1), hash1, hash2, words of conversations (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("hash1"), F.xxhash64(F.lit(1), role, text).alias("hash2"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "hash1", "hash2")
    return rows.select("conv", F.row_number().over(order).alias("place"), "hash1", "hash2", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where each conversation begins with the first turns of its group's head.

    A conversation c takes crc32(c) modulo ``most`` turns of conversation c - c % every in place of as many of its own.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("own")).select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int").alias("h"), (F.col("conv") - F.col("conv") % every).alias("head"))
    heads = turns.where((F.col("conv") % every == 0) & (F.col("place") < most)).groupBy(F.col("conv").alias("head")).agg(F.sort_array(F.collect_list(F.struct("place", "hash1", "hash2", "words"))).alias("lead"))
    led = convs.join(heads, "head", "left").select("conv", "h", F.filter("lead", lambda x: x["place"] <= F.col("h")).alias("lead"))
    before = led.select("conv", F.explode("lead").alias("x")).select("conv", "x.*")
    shift = led.select("conv", "h", F.coalesce(F.array_size("lead"), F.lit(0)).alias("n"))
    after = turns.join(shift, "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("n")).alias("place"), "hash1", "hash2", "words")
    return before.unionByName(after), convs.select("conv")


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row for each block of a conversation: names of its start and end, its turns, the words before it and in all."""
    name = [F.xxhash64("place", "hash1", "hash2").alias("t1"), F.xxhash64(F.lit(2), "place", "hash1", "hash2").alias("t2")]
    rows = turns.select("conv", "place", *name, "words", F.expr(f"(place - 1) div {BLOCK}").cast("int").alias("block"))
    blocks = rows.groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "words"))).alias("turns"), F.bit_xor("t1").alias("own1"), F.bit_xor("t2").alias("own2"), F.sum("words").alias("own_words"),
    )
    upto = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [F.bit_xor(f"own{i}").over(upto).alias(f"end{i}") for i in (1, 2)]
    placed = blocks.select("conv", "block", "turns", "own1", "own2", *ends, (F.sum("own_words").over(upto) - F.col("own_words")).alias("above"), F.sum("own_words").over(whole).alias("total"), F.max("block").over(whole).alias("last"))
    return placed.select("conv", "block", "turns", *(F.col(f"end{i}").bitwiseXOR(F.col(f"own{i}")).alias(f"start{i}") for i in (1, 2)), *END, "above", "total", (F.col("block") == F.col("last")).alias("last"))


def _nodes(groups: DataFrame, sums: dict[str, str], facts: list[str]) -> DataFrame:
    """The nodes inside distinct blocks, with ``sums`` (column: SQL aggregate) over the blocks that share one.

    Blocks without siblings are only unfolded; turns of the others are grouped.
    """
    xor = lambda i, n: f"aggregate(slice(turns, 1, {n}), start{i}, (s, y) -> s ^ y.t{i})"
    node = f"struct({BLOCK} * block + i + 1 AS depth, {xor(1, 'i + 1')} AS node1, {xor(2, 'i + 1')} AS node2, {xor(1, 'i')} AS up1, {xor(2, 'i')} AS up2, x.words AS words, above + aggregate(slice(turns, 1, i), 0L, (s, y) -> s + y.words) AS above)"
    unfolded = groups.select("alone", F.explode(F.expr(f"transform(turns, (x, i) -> {node})")).alias("n"), *sums).select("alone", *(f"n.{c}" for c in [*NODE, *facts]), *sums)
    split = unfolded.where("NOT alone").groupBy(*NODE).agg(*(F.first(c).alias(c) for c in facts), *(F.expr(f"{f}({c})").alias(c) for c, f in sums.items()))
    return unfolded.where("alone").drop("alone").unionByName(split)


def _ending(ends: DataFrame) -> DataFrame:
    """node1, node2, ends_sha256 of the conversations (conv, node1, node2): decimal ids in ascending order, joined by commas.

    Ids are sorted over ranges of node and id and joined in pieces there; each node's pieces are then hashed in order.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("node1", "node2", "conv")), strict=True):
                if (a, b) != node or len(ids) == PIECE:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (a, b), []
                ids.append(c)
            yield _batch(out, piece)
        if ids:
            yield _batch([(*node, ids[0], ",".join(map(str, ids)))], piece)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(x).to_pylist() for x in ("node1", "node2", "ids")), strict=True):
                if (a, b) == node:
                    state.update(b",")
                else:
                    if state:
                        out.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                state.update(text.encode())
            yield _batch(out, digest)
        if state:
            yield _batch([(*node, state.hexdigest())], digest)

    piece = pa.schema([("node1", pa.int64()), ("node2", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
    digest = pa.schema([("node1", pa.int64()), ("node2", pa.int64()), ("ends_sha256", pa.string())])
    joined = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(pieces, "node1 bigint, node2 bigint, least bigint, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "least").mapInArrow(digests, "node1 bigint, node2 bigint, ends_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie over turns (conv, place from 1, hash1, hash2, words) and all conversations (conv).

    node1, node2, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. ``convs`` has each conversation once, those without turns too.
    """
    blocks = stash(blocks_of(turns), "blocks")
    key = [*START, *END]
    groups = stash(blocks.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), *(F.first(c).alias(c) for c in ("turns", "block", "above"))), "groups")
    single = groups.groupBy(*START).agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in END)).where("n = 1").select(*END, F.lit(True).alias("alone"))
    marked = groups.join(single, END, "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    facts = ["depth", *UP, "words", "above"]
    no = F.lit(None).cast("bigint")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(*(F.lit(0).cast("bigint").alias(c) for c in NODE), F.lit(0).alias("depth"), *(no.alias(c) for c in UP), *(F.lit(0).cast("bigint").alias(c) for c in ("words", "above")), "n_convs", "conv_id")
    inner = _nodes(marked, {"n_convs": "sum", "conv_id": "min"}, facts)
    nodes = stash(inner.unionByName(root), "nodes")
    children = nodes.where("up1 IS NOT NULL").groupBy(*(F.col(u).alias(n) for u, n in zip(UP, NODE, strict=True))).agg(F.count("*").alias("n_children"))
    known = stash(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "known")

    owned = known.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("words").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    valued = blocks.select("conv", *END, "total").join(owned, "conv", "left").na.fill(0, ["owned", "leaves"])
    sums = {"total": "sum", "owned": "sum", "leaves": "sum", "top": "min"}
    own = F.struct("conv", "owned", "total").alias("top")
    by_block = valued.select(*END, "total", "owned", "leaves", own).groupBy(*END).agg(*(F.expr(f"{f}({c})").alias(c) for c, f in sums.items()))
    below = _nodes(marked.join(by_block, END), sums, [])
    every = convs.join(blocks.where("last").select("conv", "total"), "conv", "left").join(owned, "conv", "left").na.fill(0)
    at_root = every.select("total", "owned", "leaves", own).agg(*(F.expr(f"{f}({c})").alias(c) for c, f in sums.items())).where("top IS NOT NULL")
    below = below.unionByName(at_root.select(*(F.lit(0).cast("bigint").alias(c) for c in NODE), *sums))

    total = known.count()
    parents = known.where("n_children > 0").select(*(F.col(n).alias(u) for u, n in zip(UP, NODE, strict=True)), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") * HOT_PARENTS > total).drop("n_children"))  # fewer than HOT_PARENTS rows
    kids = known.where("up1 IS NOT NULL")
    apart = kids.join(hot, UP, "left_anti").join(parents.where(F.col("n_children") * HOT_PARENTS <= total).drop("n_children"), UP)
    placed = kids.join(hot, UP).unionByName(apart).unionByName(known.where("up1 IS NULL").withColumn("parent_conv_id", no))

    last = blocks.where("last").select("conv", F.col("end1").alias("node1"), F.col("end2").alias("node2"))
    without = convs.join(last, "conv", "left_anti").select("conv", *(F.lit(0).cast("bigint").alias(c) for c in NODE))
    ends = _ending(last.unionByName(without))
    distinct = F.col("owned") - F.col("top.owned") + F.col("top.total") - F.col("above")
    saved = F.col("total") - F.col("n_convs") * F.col("above") - distinct
    return placed.join(below, NODE).join(ends, NODE, "left").select(
        *NODE, "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").cast("bigint").alias("n_leaves"), saved.cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The nodes of the trie over conversations (conv_id, turn, role, text), rebuilt from their groups' heads."""
    turns, convs = rebuilt(stash(hashed_turns(conversations), "turns"), every, most)
    return prefix_trie(turns, convs).drop(*NODE)
