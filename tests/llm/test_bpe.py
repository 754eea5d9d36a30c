import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from pricetide.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \n b", "a\n  b", " \n", "a \t", "it's we'll I'D 's", "x 's", "\r\n\r\n x", "a  b", "a  b", "\x1c \x1d a", "a\x85 b",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext|> <|endoft", "日本語 テスト", "😀👍🏽 é é", "١٢٣ 456", "x" * 3000, "ab" * 2000, " " * 500, "a" + " " * 77 + "b", "=" * 400, "�\u0000", "don't  can't   won't",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa aaa aaaa", "1234567890" * 30, "----------------\n\n\n\n   \n", "Q̣̇ Ḍ̇",
]


def random_texts(n):
    r = random.Random(11)
    alphabets = ["abcdefgh  \n", "aA1 .'", " \t\n a", "éèüß ñ,", "日本 語a", "<|endoftx>", "".join(map(chr, range(32, 127))), "".join(map(chr, range(0x250))) + "😀"]
    return ["".join(r.choice(a) for _ in range(r.randint(1, 60))) for _ in range(n) for a in [r.choice(alphabets)]]


def test_ids_equal_those_of_the_library():
    t = Tokenizer.from_file(PATH)
    coder = bpe.Encoder(PATH, bpe.as_list)
    texts = EDGES + random_texts(4000)
    got = [[i for x in found for i in x] for found in coder.batch(texts)]
    for text, ids in zip(texts, got):
        assert ids == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_digest(docs, words):
    t = Tokenizer.from_file(PATH)
    rows = [(i, x) for i, x in enumerate(EDGES)] + [(100, None), (None, "a b"), (101, " ".join(words(40_000)))]
    got = {r.doc_id: r for r in bpe.bpe_digest(docs(rows, extra=True), PATH).collect()}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip(docs):
    rows = [(i, x) for i, x in enumerate(EDGES)]
    coded = bpe.bpe_encode(docs(rows), PATH)
    assert {r.doc_id: r.text for r in bpe.bpe_decode(coded, PATH).collect()} == dict(rows)


def test_empty(docs):
    assert bpe.bpe_digest(docs([]), PATH).count() == 0
