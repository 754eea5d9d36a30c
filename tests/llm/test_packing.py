import random
import zlib
from array import array
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from pricetide.llm import packing as P  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, got, window):
    t = Tokenizer.from_file(PATH)
    ids = Counter()
    for doc, text in rows:
        own = t.encode(text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(own), window):
            part = own[at : at + window]
            ids[doc, at, len(part), zlib.crc32(array("I", part).tobytes()), len(own)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == ids
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(r.length for r in got) / (window * max(1, len(by)))


@pytest.mark.parametrize("cell", [5, 20_000])
def test_pieces_and_fill(docs, words, monkeypatch, cell):
    monkeypatch.setattr(P, "CELL_ROWS", cell)
    rows = [(i, " ".join(words(3 + (i * 37) % 200, seed=i))) for i in range(300)] + [(900, None), (901, ""), (None, "a b"), (902, "copy"), (902, "copy"), (903, "x" * 20_000)]
    got = P.pack_documents(docs(rows, extra=True), PATH, window=128).collect()
    assert check(rows, got, 128) > 0.97


def test_empty(docs):
    assert P.pack_documents(docs([]), PATH).count() == 0


def test_plan_uses_up_the_histogram():
    r = random.Random(1)
    for n in (0, 1, 10, 5000):
        histogram = dict(Counter(min(256, 1 + int(r.expovariate(1 / 70))) for _ in range(n)))
        made = P.plan(histogram, 256)
        assert all(sum(lengths) <= 256 and k > 0 for lengths, k in made)
        used = Counter()
        for lengths, k in made:
            for x in lengths:
                used[x] += k
        assert dict(used) == histogram
        if n == 5000:
            assert sum(x * k for x, k in histogram.items()) > 0.99 * 256 * sum(k for _, k in made)


def test_least_squares_meets_a_solvable_histogram():
    import numpy as np

    columns = P.combinations(64, list(range(1, 65)), grid=8)
    counts = np.random.default_rng(3).integers(0, 50, len(columns)).astype(float)
    histogram = np.zeros(65)
    for row, n in zip(columns, counts):
        for x in row:
            histogram[x] += n
    histogram[0] = 0
    x = P.repeat_counts(columns, histogram, 2000)
    again = np.zeros(65)
    for row, n in zip(columns, x):
        for k in row:
            again[k] += n
    again[0] = 0
    assert (x >= 0).all() and np.abs(again - histogram).max() < 0.02 * histogram.max()


def test_rank_ids_are_those_of_the_library_and_of_the_trie():
    from pricetide.llm import bpe

    r, library, ranks = random.Random(4), Tokenizer.from_file(PATH), P.ids_of(PATH)
    assert ranks.fast
    parts = [b.decode("utf-8", "ignore") for b in list(bpe.Vocabulary(PATH).bytes.values())[::7]] + ["a" * 9, "=" * 5, "aaaa", " ", "\n", "\t\t", "　", "\x85", "'s", "<|endoftext|>", "0" * 7, "é", "\U0001f600"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [c * n for c in ("a", "A", "=", "-", "0", "ab", " ", "\n") for n in range(1, 60)] + [None, ""]
    trie = bpe.encoder(PATH, bpe.as_list)
    for text, units in zip(texts, trie.batch(texts), strict=True):
        assert ranks(text).tolist() == library.encode(text or "", add_special_tokens=False).ids == [i for u in units for i in u]


def test_every_token_is_its_own_encoding():
    from pricetide.llm import bpe

    known = bpe.Vocabulary(PATH)
    whole = {i: b for i, b in known.bytes.items() if i not in known.special.values()}
    coded = known.encode_words(set(whole.values()))
    assert all(coded[b] == [i] for i, b in whole.items())


def test_pattern_that_gives_up_falls_back():
    text = " " * 1_000_000 + "x"
    ranks = P.ids_of(PATH)
    with pytest.raises(ValueError):
        ranks.fast.encode_to_numpy(text, allowed_special="all")
    assert ranks(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
