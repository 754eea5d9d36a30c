import math
from collections import Counter

import pytest

from pricetide.llm.backoff_lm import backoff_scores


def brute(rows, order, alpha=0.4):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    own = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)] for _, w in texts]
    total = [sum((o[n] for o in own), Counter()) for n in range(order)]
    words, out = sum(len(w) for _, w in texts), []
    for (d, w), o in zip(texts, own):
        left = lambda g: total[len(g) - 1][g] - o[len(g) - 1][g]
        s = uni = steps = 0
        for i in range(len(w)):
            n = min(order, i + 1)
            while n > 1 and not left(tuple(w[i - n + 1 : i + 1])):
                s += math.log(alpha)
                steps += 1
                n -= 1
            g = tuple(w[i - n + 1 : i + 1])
            if n > 1:
                s += math.log(left(g) / left(g[:-1]))
            else:
                uni += 1
                s += math.log(max(left(g), 0.5) / max(words - len(w), 1))
        out.append((d, len(w), uni, steps, round(s, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_same_as_brute_force(docs, words, order, chunk):
    rows = [(i, " ".join(words(5 + i * 3, seed=i % 9))) for i in range(40)] + [(90, None), (91, ""), (92, "one"), (None, "the and the"), (93, "the and the"), (93, "the and the")]
    got = sorted(((r.doc_id, r.n_words, r.n_unigram, r.n_backoff, round(r.log_score, 6)) for r in backoff_scores(docs(rows, extra=True), order, chunk_bytes=chunk).collect()), key=repr)
    want = brute(rows, order)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want], abs=1e-5)


def test_empty_and_alone(docs):
    assert backoff_scores(docs([])).count() == 0
    assert backoff_scores(docs([(1, "a b a b")])).first().n_unigram == 4


def test_long_text(docs, words):
    rows = [(1, " ".join(words(120_000))), (2, "x" * 500_000)]
    assert {r.doc_id: r.n_words for r in backoff_scores(docs(rows)).collect()} == {1: 120_000, 2: 1}


@pytest.mark.parametrize("most", [2, 5])
def test_wards_of_chunks(docs, words, monkeypatch, most):
    """Many chunks meet by wards; the rows of a chunk stay as many as its ranges."""
    from pricetide.llm import backoff_lm as B

    monkeypatch.setattr(B, "MOST_CHUNKS", most)
    rows = [(i, " ".join(words(5 + i * 3, seed=i % 9))) for i in range(40)] + [(90, None), (93, "the and the"), (93, "the and the")]
    got = sorted(((r.doc_id, r.n_words, r.n_unigram, r.n_backoff, round(r.log_score, 6)) for r in backoff_scores(docs(rows), 2, chunk_bytes=1000).collect()), key=repr)
    want = brute(rows, 2)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want], abs=1e-5)


def test_rows_grow_with_the_chunks(docs, words, spark, monkeypatch):
    from pricetide.llm import backoff_lm as B

    monkeypatch.setattr(B, "MOST_CHUNKS", 4)
    texts = docs([(i, " ".join(words(200, seed=i))) for i in range(64)])
    n = {}
    for chunks in (8, 16, 32):
        dealt = texts.selectExpr("doc_id", "text", f"doc_id % {chunks} AS chunk")
        n[chunks] = dealt.groupBy("chunk").applyInArrow(B._entries(2, 2, chunks // 4), B._ENTRY_DDL).count()
    assert n[16] == 2 * n[8] and n[32] == 4 * n[8]
