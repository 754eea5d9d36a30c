"""Lines that many documents share, found over sorted hashes; the answer is a compressed keep bitmap for each document.

A line's key is the line without white space at its ends and with A-Z in lower case. Hashes of keys are partitioned by
range together with their document, so even a line of a third of all documents is spread over partitions; within one they
are sorted by hash, document and position, and a window over each hash and document streams the first occurrences. Their
number is the number of documents of the key. Keys of enough documents come back to the sorted rows: the most frequent
ones, at most ``BROADCAST_KEYS``, beside them; the others, none of which has more than that part of all lines, by a join.
Positions that lose their line become words of 64 bits; a bitmap is the list of words that lose any, each with the number
of full words before it. Texts aren't moved until a bitmap meets its document.

Nulls: a null text is one empty line; a null doc_id is an id like others. Every row is a document: rows that repeat an id
and a text count once each and share a bitmap. A key repeated within a document counts once there. Empty keys are never
dropped. Texts of any length are split whole. A table without rows gives none. Other columns of docs pass through
``deduplicated``, whatever their names; its own columns replace those of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import stash

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_KEYS = 200_000  # rows of two hashes; keys beyond are joined by a shuffle
KEY, OWN = ["key1", "key2"], ["own1", "own2"]


def _names() -> list[Column]:
    """A document's name: 128 bits of its id and text."""
    own = [F.col("doc_id").cast("bigint"), F.col("text").cast("string")]
    return [F.xxhash64(*own).alias("own1"), F.xxhash64(F.lit(1), *own).alias("own2")]


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def sorted_lines(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """key1, key2, own1, own2, place (from 0) and ``first`` (in its document) of every line whose key is long enough."""
    split = docs.select(*_names(), _lines().alias("lines"))  # a name is made once a document, before its lines part
    lines = split.select(*OWN, F.posexplode("lines").alias("place", "line")).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= max(least_chars, 1))
    rows = lines.select(F.xxhash64("key").alias("key1"), F.xxhash64(F.lit(1), "key").alias("key2"), *OWN, "place")
    ranged = rows.repartitionByRange(*KEY, *OWN).sortWithinPartitions(*KEY, *OWN, "place")
    return ranged.withColumn("first", F.rank().over(Window.partitionBy(*KEY, *OWN).orderBy("place")) == 1)


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """own1, own2 and ``keep`` of each document that loses a line.

    keep is an array of (full, word): ``full`` words of 64 kept lines, then a word whose bit i tells whether line i of it
    is kept. Lines beyond the last word are kept.
    """
    rows = stash(sorted_lines(docs, least_chars), "lines")
    total = rows.count()
    common = stash(rows.groupBy(*KEY).agg(F.count_if("first").alias("docs"), F.count("*").alias("lines")).where(F.col("docs") >= least_docs), "keys")
    frequent = F.col("lines") * BROADCAST_KEYS > total
    near = F.broadcast(common.where(frequent).select(*KEY))  # fewer than BROADCAST_KEYS rows
    places = [*OWN, "place"]
    dropped = rows.join(near, KEY, "left_semi").select(*places)
    rest = common.where(~frequent).select(*KEY)
    if not rest.isEmpty():
        dropped = dropped.unionByName(rows.join(near, KEY, "left_anti").join(rest, KEY, "left_semi").select(*places))
    words = dropped.groupBy(*OWN, F.expr("place div 64").cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("bits"))
    held = words.groupBy(*OWN).agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("words"))
    return held.select(*OWN, F.expr("transform(words, (x, i) -> struct(x.at - coalesce(get(words, i - 1).at, -1) - 1 AS full, ~x.bits AS word))").alias("keep"))


def kept_text(lines: Column, keep: Column) -> Column:
    """The kept lines of a text, joined again."""
    words = F.flatten(F.transform(keep, lambda x: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), x["full"]), F.array(x["word"]))))
    flags = F.flatten(F.transform(words, lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(x, i))))
    marked = F.zip_with(lines, flags, lambda line, flag: F.when(F.coalesce(flag, F.lit(1).cast("tinyint")) == 1, line))
    return F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n")


def deduplicated(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """docs with ``n_lines``, ``n_dropped``, the bitmap ``keep`` (null where nothing is dropped) and ``kept_text``."""
    bitmaps = keep_bitmaps(docs, least_docs, least_chars)
    rows = docs.select(*_names(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    text, keep = F.col("text"), F.col("keep")
    added = {
        "n_lines": (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1).cast("bigint"),
        "n_dropped": F.coalesce(F.aggregate(keep, F.lit(0).cast("bigint"), lambda n, x: n + F.bit_count(F.bitwise_not(x["word"]))), F.lit(0)).cast("bigint"),
        "keep": keep,
        "kept_text": F.when(keep.isNull(), text).otherwise(kept_text(_lines(), keep)),
    }
    return rows.join(bitmaps, OWN, "left").select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in added), *(x.alias(c) for c, x in added.items()))


def line_digest(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for docs (doc_id, text)."""
    found = deduplicated(docs.select("doc_id", "text"), least_docs, least_chars)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
