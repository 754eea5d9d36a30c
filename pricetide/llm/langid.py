"""Language identification by compression with per-language zstandard raw-content dictionaries.

A text in lower case, its letters' words parted by single spaces, is compressed whole, in blocks of ``BLOCK`` bytes, with
each language's zstandard dictionary; the language of the smallest sum is predicted, and the prediction is rejected
where the second smallest is nearly as small. The dictionaries are raw content: the whole texts of at most ``SAMPLED``
labelled rows a language, those of the least hash of the text in each of as many cells of hashes. Every labelled
language is learned, however many there are; time a text grows with their number.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and is rejected; null labels aren't learned from.
Equal texts of a language are learned once. Ties go to the language with more labelled rows, then to the lesser name.
With no labelled row every text is ``und``, and ``keep_identified`` keeps all rows, since nothing speaks against any.
Texts of any length are taken whole. Repeated rows get the same prediction; other columns are not looked at, and pass
through ``keep_identified``. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm import kernel as K

SAMPLED = 64  # labelled texts a language at most
LEVEL, BLOCK = 12, 4096
MARGIN = 0.002
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")
_between = regex.compile(r"[^\p{L}\p{M}']+")


def plain(text: str) -> bytes:
    return f" {_between.sub(' ', text).lower()} ".encode()


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, train: Column) -> dict[str, bytes]:
    """A dictionary for each language of docs (doc_id, text, lang), from rows where ``train`` holds."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    known = docs.where(train & lang.isNotNull() & (F.length(text) > 0)).select(lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("h"))
    least = known.groupBy("lang", F.pmod("h", F.lit(SAMPLED)).alias("cell")).agg(F.min("h").alias("h"), F.count("*").alias("n")).collect()  # at most SAMPLED a language
    if not least:
        return {}
    chosen = known.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in least], "lang string, h bigint")
    texts = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    rows: Counter[str] = Counter()
    for r in least:
        rows[r["lang"]] += r["n"]
    out = {x: b"" for x in sorted(rows, key=lambda x: (-rows[x], x))}  # those with most rows first
    for r in sorted(texts, key=lambda r: (r["lang"], r["h"])):
        out[r["lang"]] += plain(r["text"])
    return out


class Judge:
    """Predictions of texts with given dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float):
        self.names, self.margin, self.presses = list(dictionaries), margin, []
        for content in dictionaries.values():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.presses.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Label, score and whether the label is rejected."""
        if not self.names or text is None or not _letter.search(text):
            return UNKNOWN, 0.0, True
        data = plain(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        size = [sum(len(p.compress(x)) for x in blocks) for p in self.presses]
        best = min(range(len(size)), key=size.__getitem__)
        second = min((x for i, x in enumerate(size) if i != best), default=2 * size[best])
        gap = (second - size[best]) / second
        return self.names[best], min(1.0, max(0.0, gap)), gap < self.margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries, margin)
        for batch in batches:
            label, score, rejected = zip(*found, strict=True) if (found := [judge(t) for t in batch.column("text").to_pylist()]) else ([], [], [])
            yield K.table({"doc_id": batch.column("doc_id"), "lang_pred": label, "score": score, "rejected": rejected}, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learned from rows that aren't held out."""
    found = predict(docs, fit(docs, ~is_held_out(F.col("doc_id"))))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of docs (text, lang and others) whose language isn't rejected, with all their columns; no shuffle of texts."""
    dictionaries = fit(docs, F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries, margin)
        for batch in batches:
            yield batch.filter(pa.array([not judge(t)[2] for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if dictionaries else docs
