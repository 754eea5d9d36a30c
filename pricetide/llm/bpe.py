"""Byte-level BPE by prefix-sharing trie traversal.

Two facts about BPE carry the method. The encoding of a word without its last token is the encoding of the remaining
prefix; so the last token of every prefix of a word gives the word's encoding, read backwards. And a row of tokens
is an encoding exactly if each neighbouring pair is one. So the last token of a prefix is the one vocabulary token
that ends it and fits the last token of what stands before.

The distinct words of a batch are the leaves of a trie. In sorted order they come as a depth-first walk meets them,
with the path from the root as a stack of last tokens: a prefix that words share is worked out once. Texts are taken
apart into units (a space and what follows up to the next space); bounded caches keep the units and words met so far.

Nulls: a null text is an empty one, with no ids. Texts are encoded whole. Rows are independent, so repeated rows,
ties and extra columns need nothing more; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import kernel as K

CACHED_UNITS, CACHED_WORDS, CACHED_FITS = 150_000, 150_000, 250_000  # of units and words twice as many, in two generations
PLAIN_MARKS = frozenset(".,;:!?)\"")
PIECE_CHARS = 1 << 20  # of texts whose units are held at a time
LONG_UNIT = 200  # characters; longer units aren't kept
# The vocabulary's way to cut a text into words, and to spell bytes as characters.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

SHIFT = 32
_NEVER = 1 << 60
_word = regex.compile(WORD)
_unsafe = regex.compile(r"\s \s|\s \Z")


class Vocabulary:
    """A byte-level BPE vocabulary file and the fit of token pairs."""

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())
        byte = {chr(b): b for b in PRINTABLE}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
        ids = model["model"]["vocab"]
        self.bytes = {i: bytes(byte[c] for c in s) for s, i in ids.items()}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.special = {x["content"]: x["id"] for x in model["added_tokens"] if x["special"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.rank, self.parts = {}, {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = ids[a], ids[b]
            self.rank[left, right] = rank
            self.parts[ids[a + b]] = (left, right, rank)
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._fit: dict[int, bool] = {}  # by the left token, shifted, and the right one
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.single = [self.ids.get(bytes([b])) for b in range(256)]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens along one side of a token's merge tree, bottom up, with the rank of the merge that takes each in."""
        key = (token, side)
        if key not in self._edges:
            out, taken = [(token, _NEVER)], token
            while taken in self.parts:
                *halves, rank = self.parts[taken]
                taken = halves[side]
                out.append((taken, rank))
            self._edges[key] = out[::-1]
        return self._edges[key]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both are encoded as these two: no merge across the border comes before their own.

        Merges run by rank and from the left; so on equal rank the left token's own merge is first, and the one
        across the border comes before the right token's.
        """
        key = left << SHIFT | right
        if (known := self._fit.get(key)) is None:
            if len(self._fit) > CACHED_FITS:
                self._fit.clear()
            a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
            known = True
            while True:
                (x, x_taken), (y, y_taken) = a[i], b[j]
                rank = self.rank.get((x, y), _NEVER)
                if rank < x_taken and rank <= y_taken and rank < _NEVER:
                    known = False
                    break
                if x_taken == y_taken == _NEVER:
                    break
                if x_taken <= y_taken:
                    i += 1
                else:
                    j += 1
            self._fit[key] = known
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words, by a depth-first walk over their trie."""
        ids, fit, fits, size, single = self.ids, self._fit, self.fits, self.size, self.single
        out: dict[bytes, list[int]] = {}
        last, before = [-1], b""  # last[k]: last token of the first k bytes on the current path, shifted by SHIFT
        for word in sorted(words):
            n = shared = min(len(word), len(before))
            if word[:n] != before[:n]:
                shared = next(k for k in range(n) if word[k] != before[k])
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start, token = end - 1, single[word[end - 1]]
                while start:
                    known = fit.get(last[start] | token)
                    if known or known is None and fits(last[start] >> SHIFT, token):
                        break
                    start -= 1
                    while (token := ids.get(word[start:end])) is None:
                        start -= 1
                last.append(token << SHIFT)
            tokens, end = [], len(word)
            while end:
                token = last[end] >> SHIFT
                tokens.append(token)
                end -= size[token]
            out[word] = tokens[::-1]
            before = word
        return out


def words(unit: str) -> list[str]:
    """The words of a unit. Letters of the Latin script, and one mark after them, are told without the pattern."""
    bare = unit[1:] if unit[:1] == " " else unit
    if bare.isalpha() and max(bare) < "\u0250":
        return [unit]
    if bare[-1:] in PLAIN_MARKS and (head := bare[:-1]).isalpha() and max(head) < "\u0250":
        return [unit[:-1], unit[-1]]
    return _word.findall(unit)


def units(text: str) -> list[str]:
    """Cut a text where no word crosses: before each single space; a text with runs of spaces stays in one piece."""
    if " " not in text or _unsafe.search(text):
        return [text] if text else []
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


class Kept:
    """A bounded cache in two generations: what is asked for again outlives a full one."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> set:
        """The keys that aren't held; those that are held are in ``new`` afterwards."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        lacking = keys.difference(self.new)
        again = lacking.intersection(self.old)
        self.new.update((k, self.old[k]) for k in again)
        return lacking - again


class Form(NamedTuple):
    """What is kept of a word, made from its ids, and of several words, made from theirs."""

    of: Callable
    joined: Callable


class Encoder:
    """Encodes texts unit by unit; ``form`` makes what is kept of a unit from the ids of its words."""

    def __init__(self, path: str, form: Form):
        self.vocabulary, self.form, self.units, self.words = Vocabulary(path), form, Kept(CACHED_UNITS), Kept(CACHED_WORDS)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self._special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def batch(self, texts: list[str | None]) -> Iterator[Iterator]:
        """For each text the forms of its units, in order; to be used up before the next."""
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo] or "")
            while hi < len(texts) and size + len(texts[hi] or "") <= PIECE_CHARS:
                size += len(texts[hi] or "")
                hi += 1
            yield from self._piece(texts[lo:hi])
            lo = hi

    def _piece(self, texts: list[str | None]) -> Iterator[Iterator]:
        cut = [self._cut(t or "") for t in texts]
        vocabulary, special = self.vocabulary, self.vocabulary.special
        new = self.units.missing(set().union(*cut))
        split = {u: words(u) for u in new if u not in special}
        lacking = self.words.missing({w for found in split.values() for w in found})
        coded, known, made, joined = vocabulary.encode_words(w.encode() for w in lacking), self.words.new, self.form.of, self.form.joined
        known.update((w, made(vocabulary, coded[w.encode()])) for w in lacking)
        held = self.units.new
        held.update((u, known[found[0]] if len(found) == 1 else joined([known[w] for w in found])) for u, found in split.items())
        held.update((u, made(vocabulary, [special[u]])) for u in new if u in special)
        for us in cut:
            yield map(held.__getitem__, us)
        for kept, keys in ((held, new), (known, lacking)):
            for k in [k for k in keys if len(k) > LONG_UNIT]:
                del kept[k]

    def _cut(self, text: str) -> list[str]:
        if self._special is None or not any(s in text for s in self.vocabulary.special):
            return units(text)
        return [u for piece in self._special.split(text) for u in ([piece] if piece in self.vocabulary.special else units(piece))]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, form: Form) -> Encoder:
    """One encoder for each vocabulary and form in a worker."""
    key = (path, form.of.__name__)
    if key not in _encoders:
        _encoders[key] = Encoder(path, form)
    return _encoders[key]


def _spelled(vocabulary: Vocabulary, ids: list[int]) -> tuple[bytes, bytes]:
    return b"".join([b"%d," % i for i in ids]), b"".join([vocabulary.bytes[i] for i in ids])


def _listed(vocabulary: Vocabulary, ids: list[int]) -> list[int]:
    return ids


def _sides(forms: Iterable[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    ids, text = zip(*forms, strict=True)
    return b"".join(ids), b"".join(text)


as_text = Form(_spelled, _sides)  #: decimal ids, a comma after each, and the decoded bytes
as_list = Form(_listed, lambda forms: [i for x in forms for i in x])


def bpe_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for docs (doc_id, text); both hashes are those of whole results."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, as_text)
        for batch in batches:
            count, ids_hash, text_hash = [], [], []
            for found in coder.batch(batch.column("text").to_pylist()):
                ids, text = _sides(chain([(b"", b"")], found))
                count.append(ids.count(b","))
                ids_hash.append(hashlib.sha256(ids[:-1]).hexdigest())
                text_hash.append(hashlib.sha256(text).hexdigest())
            yield K.table({"doc_id": batch.column("doc_id"), "n_tokens": count, "ids_sha256": ids_hash, "decoded_sha256": text_hash}, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) with the ids as an array."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, as_list)
        for batch in batches:
            ids = [[i for x in found for i in x] for found in coder.batch(batch.column("text").to_pylist())]
            yield K.table({"doc_id": batch.column("doc_id"), "ids": ids}, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def bpe_decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that aren't UTF-8 become the replacement character, null ids null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(vocabulary, as_list).vocabulary.bytes
        for batch in batches:
            text = [None if ids is None else b"".join(table[i] for i in ids if i is not None).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield K.table({"doc_id": batch.column("doc_id"), "text": text}, schema)

    return coded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
