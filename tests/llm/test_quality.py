import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import quality as Q

WHITE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    for c in WHITE[1:]:
        spaced = text if c == "\t" else spaced
        spaced = spaced.replace(c, " ")
    w = [x for x in spaced.split(" ") if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts(docs, words):
    r = random.Random(2)
    rows = [(0, None), (1, ""), (2, " \n\n "), (3, "a b c a b c"), (4, "é😀 ## é😀\né😀 ## é😀\n\nx"), (5, "a\x0bb\x0cc\rd e"), (6, "x " * 200), (7, "z" * 100_000)]
    rows += [(10 + i, "".join(r.choice(["the", "and", "x", " ", " ", "\n", "*", "é"]) for _ in range(150))) for i in range(60)]
    got = {x.doc_id: x for x in Q.quality_verdicts(docs(rows, extra=True)).collect()}
    for i, text in rows:
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(text), i
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert not (x.base_failed and x.kept)


def test_outliers_go_and_clean_texts_stay(docs, words):
    rows = [(i, " ".join(words(60 + i % 300, seed=i)), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join(x + "#$%" for x in words(100, seed=i)), "en", "s0") for i in range(40)]
    got = {x.doc_id: x.kept for x in Q.quality_verdicts(docs(rows)).collect()}
    assert sum(got[i] for i in range(300)) >= 298
    assert not any(got[1000 + i] for i in range(40))
    assert {r.doc_id for r in Q.keep_good(docs(rows, extra=True)).collect()} == {i for i, kept in got.items() if kept}


def brute_fit(v, base, floors, share, prior, seen):
    """The estimate of some rows in numpy, over all of them at once; ``seen`` gets the determinants of each start."""
    dims, unit, n = v.shape[1], Q.UNIT, len(v)
    scale = share / Q._chi2_below(Q.chi2_quantile(share, dims), dims + 2)
    wide = lambda s: s + np.diag(np.square(floors))

    def lean(n, centre, cov):
        off, w = centre - base[0], n / (n + prior)
        return w * centre + (1 - w) * base[0], w * cov + (1 - w) * base[1] + w * (1 - w) * np.outer(off, off)

    def closer(c, s):
        off = v / unit - c
        d2 = np.einsum("ij,jk,ik->i", off, np.linalg.inv(wide(s)), off)
        cell = np.floor(np.log2(np.clip(d2, 2.0**-20, 2.0**40)) * Q.BINS)
        near = v[cell <= np.sort(cell)[int(np.ceil(share * n)) - 1]]
        return lean(len(near), near.mean(axis=0) / unit, scale * np.cov(near.T, bias=True) / unit**2)

    m, r = box(v)
    ends = []
    for k, (c, s) in enumerate((lean(n, m, np.diag(r)), base, lean(n, v.mean(axis=0) / unit, np.cov(v.T, bias=True) / unit**2))):
        path = []
        for _ in range(40):
            c, s = closer(c, s)
            path.append((round(float(np.linalg.slogdet(wide(s))[1]), 9), k, c, s))
        sizes = [x[0] for x in path]
        seen.append(sizes)
        fallen = next(i for i in range(39) if sizes[i + 1] >= sizes[i])
        ends.append(path[fallen])
    *_, c, s = min(ends, key=lambda e: e[:2])
    return c, s


def box(v):
    q = np.percentile(v, [25, 50, 75], axis=0) / Q.UNIT
    return q[1], ((q[2] - q[0]) / 1.349) ** 2


def brute_distances(x, group, parent, floors, share=Q.SHARE, prior=Q.PRIOR_ROWS, seen=None):
    seen = [] if seen is None else seen
    out, (m, r) = np.zeros(len(x)), box(x)
    for p in np.unique(parent):
        language = brute_fit(x[parent == p], (m, np.diag(r)), floors, share, prior, seen)
        for g in np.unique(group[parent == p]):
            c, s = brute_fit(x[group == g], language, floors, share, prior, seen)
            off = x[group == g] / Q.UNIT - c
            out[group == g] = np.einsum("ij,jk,ik->i", off, np.linalg.inv(s + np.diag(np.square(floors))), off)
    return out


def test_groups_that_swing_have_one_estimate(spark):
    """Steps of some small groups never settle; the least determinant before the first rise counts, wherever one stops."""
    r = np.random.default_rng(120)
    x = np.round(np.concatenate([r.standard_t(1.5, size=(n, 2)) * r.uniform(0.2, 3) for n in range(5, 25)]) * Q.UNIT).astype(np.int64)
    group = np.repeat(np.arange(20), range(5, 25))
    seen = []
    want = brute_distances(x, group, group % 2, [0.05, 0.05], seen=seen)
    assert any(len(set(sizes[-6:])) > 1 for sizes in seen)
    df = spark.createDataFrame([(i, int(g), int(g % 2), int(a), int(b)) for i, (g, (a, b)) in enumerate(zip(group, x))], "i int, g bigint, p bigint, x0 bigint, x1 bigint")
    got = {q.i: q.d2 for q in Q.mcd_distances(df, "g", "p", 2, [0.05, 0.05]).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(want, rel=1e-6)


def test_distances_against_numpy(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(300, 2)) @ np.array([[1.0, 0.4], [0, 0.5]]), 8 + r.normal(size=(60, 2)), r.normal(3, 2, size=(200, 2)), r.normal(1, 1, size=(9, 2))])
    x = np.round(x * Q.UNIT).astype(np.int64)
    group, parent = np.repeat([1, 1, 2, 3], [300, 60, 200, 9]), np.repeat([7, 8], [560, 9])
    rows = [(i, int(g), int(p), int(a), int(b)) for i, (g, p, (a, b)) in enumerate(zip(group, parent, x))]
    df = spark.createDataFrame(rows, "i int, g bigint, p bigint, x0 bigint, x1 bigint")
    want = brute_distances(x, group, parent, [0.05, 0.05])
    runs = [{q.i: q.d2 for q in Q.mcd_distances(df.repartition(n, "i"), "g", "p", 2, [0.05, 0.05]).collect()} for n in (1, 7)]
    assert runs[0] == runs[1]
    assert [runs[0][i] for i in range(len(rows))] == pytest.approx(want, rel=1e-6)
    assert all(want[300:360] > Q.chi2_quantile(1 - Q.TAIL, 2)) and sum(want[:300] > Q.chi2_quantile(1 - Q.TAIL, 2)) == 0


def test_small_groups_and_equal_rows(spark):
    """A group of one row leans on its language's estimate; rows that are all equal are no outliers."""
    rows = [(i, 1, 7, 1000 + 10 * (i % 9), 50) for i in range(200)] + [(900, 2, 7, 1030, 50), (901, 3, 7, 90_000, 50)] + [(950 + i, 4, 9, 5, 5) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, g bigint, p bigint, x0 bigint, x1 bigint")
    got = {q.i: q.d2 for q in Q.mcd_distances(df, "g", "p", 2, [0.05, 0.05]).collect()}
    assert got[900] < 5 and got[901] > Q.chi2_quantile(1 - Q.TAIL, 2) and got[950] < 5


def test_quantile():
    assert Q.chi2_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert Q.chi2_quantile(0.99, 4) == pytest.approx(13.277, abs=1e-3)


def test_empty_and_nulls(docs):
    assert Q.quality_verdicts(docs([])).count() == 0
    assert Q.keep_good(docs([(1, None, None, None), (None, None, None, None)])).count() == 0


def test_null_language_and_id_are_values(docs, words):
    rows = [(None if i == 0 else i, " ".join(words(80, seed=i)), None, None) for i in range(80)]
    assert Q.keep_good(docs(rows)).where(F.col("doc_id").isNull()).count() == 1
