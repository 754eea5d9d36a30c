import os
import random
import zlib

import pytest
import xxhash
import zstandard

from pricetide.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def corpus(words, n=60):
    return [(i, " ".join(words(30 + i % 50, lang, seed=i)), lang, "s") for i in range(n) for lang in [("en", "de", "fr")[i % 3]]]


def test_predictions(docs, words):
    rows = corpus(words) + [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 456 !!", "de", "s"), (None, "the and ing ion the and", None, "s")]
    got = {r.doc_id: r for r in langid.identify(docs(rows, extra=True)).collect()}
    for i, text, lang, _ in rows:
        r = got[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if not text or i == 902:
            assert r.lang_pred == "und" and r.rejected
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in corpus(words)) >= 57
    assert got[None].lang_pred == "en"


def test_no_labels(docs):
    got = langid.identify(docs([(1, "the and", None, "s")])).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_keep_identified(docs, words):
    rows = corpus(words) + [(900, None, "en", "s"), (901, "...", "en", "s")]
    assert sorted(r.doc_id for r in langid.keep_identified(docs(rows)).collect()) == list(range(60))


def test_empty(docs):
    assert langid.identify(docs([])).count() == 0


def test_long_text(docs, words):
    rows = corpus(words, 30) + [(500, " ".join(words(100_000, "de", seed=1)), None, "s")]
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs(rows)).collect()}[500] == "de"


def test_every_labelled_language_is_learned(docs):
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    parts = {f"l{k:02d}": ["".join(r.choice(letters) for _ in range(3)) for _ in range(12)] for k in range(70)}
    text = lambda lang: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(60))
    rows = [(k * 100 + i, text(lang), lang, "s") for k, lang in enumerate(parts) for i in range(9 if k < 64 else 6)]
    df = docs(rows)
    assert set(langid.fit(df, langid.F.lit(True))) == set(parts)
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    rare = [(i, lang) for i, _, lang, _ in rows if i >= 6400 and got[i].held_out]
    assert rare and all(got[i].lang_pred == lang and not got[i].rejected for i, lang in rare)


def brute(rows):
    """(lang_pred, score) by id: dictionaries and one-shot compressions worked out row by row."""
    learned, count = {}, {}
    for i, text, lang, _ in rows:
        if not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and lang is not None and text:
            h = xxhash.xxh64(text.encode(), seed=42).intdigest()
            h -= (h >> 63) << 64
            learned.setdefault(lang, {}).setdefault(h % langid.SAMPLED, {})[h] = text
            count[lang] = count.get(lang, 0) + 1
    names = sorted(count, key=lambda x: (-count[x], x))
    books = {x: b"".join(langid.plain(t) for _, t in sorted((min(cell), cell[min(cell)]) for cell in learned[x].values())) for x in names}
    out = {}
    for i, text, *_ in rows:
        if not any(c.isalpha() for c in text or ""):
            out[i] = ("und", 0.0)
            continue
        data = langid.plain(text)
        size = {}
        for x in names:
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(books[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            size[x] = sum(len(c.compress(data[k : k + langid.BLOCK])) for k in range(0, len(data), langid.BLOCK))
        best = min(names, key=size.get)
        second = min(size[x] for x in names if x != best)
        out[i] = (best, (second - size[best]) / second)
    return out


def test_predictions_against_plain_compressions(docs, words):
    rows = [(i, " ".join(words(20 + i * 7 % 150, lang, seed=i)), lang, "s") for i in range(240) for lang in [("en", "de", "fr", "de")[i % 4]]]
    rows += [(500, None, "en", "s"), (501, "12 !", None, "s"), (502, " ".join(words(3000, "fr", seed=1)), None, "s"), (503, rows[0][1], "en", "s"), (504, "é", None, None)]
    want = brute(rows)
    for n in (1, 5):
        got = {r.doc_id: r for r in langid.identify(docs(rows).repartition(n)).collect()}
        right = sum(got[i].lang_pred == x and abs(got[i].score - max(0.0, s)) < 0.02 for i, (x, s) in want.items())
        assert right >= len(want) - 2, [(i, got[i], want[i]) for i in want if got[i].lang_pred != want[i][0]]
    again = {r.doc_id: r for r in langid.identify(docs(rows).repartition(3)).collect()}
    assert again == got


def test_keep_identified_without_labels(docs):
    assert langid.keep_identified(docs([(1, "the and", None, "s"), (2, None, None, "s")])).count() == 2


def test_language_without_letters(docs, words):
    rows = [*corpus(words), (700, "12 34", "xx", "s"), (701, "5", "xx", "s")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(rows)).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in corpus(words)) >= 57


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    df = spark.read.parquet(SF)
    both = langid.identify(df).where("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.97 * len(both)
