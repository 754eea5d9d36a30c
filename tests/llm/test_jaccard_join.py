import os
import random

import numpy as np
import pytest

from pricetide.llm import jaccard_join as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root)), key=repr)


def corpus(words, seed, families=12, members=12):
    r, rows = random.Random(seed), []
    for f in range(families):
        base = words(r.choice([3, 5, 9, 30, 120, 400]), seed=f)
        for _ in range(members):
            copy = list(base)
            for _ in range(int(len(copy) * r.choice([0, 0, 0.005, 0.01, 0.02, 0.04]))):
                copy[r.randrange(len(copy))] = "edit%d" % r.randrange(10**6)
            if r.random() < 0.3:
                copy += words(r.randint(1, max(1, len(copy) // 10)), seed=r.random())
            rows.append((len(rows), " ".join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_same_as_brute_force(docs, words, n, num, den):
    rows = corpus(words, n)
    got = J.jaccard_components(docs(rows), n, num, den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, n, num, den)


def test_blocks_and_bands(docs, words, monkeypatch):
    rows = corpus(words, 7, families=2, members=60)
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    got = J.jaccard_components(docs(rows), 4, 85, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 4, 85, 100)


def test_edge_cases(docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "a"), (6, "a"), (None, "x y z w v"), (7, "x y z w v"), (8, "É a b c"), (9, "é a b c")]
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in J.jaccard_components(docs(rows, extra=True), 4, 85, 100).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 1), (None, 7, 2), (7, 7, 2), (8, 8, 1), (9, 9, 1)}


def test_empty_table(docs):
    assert J.jaccard_components(docs([])).count() == 0
    assert J.keep_one(docs([])).count() == 0


def test_long_text(docs, words):
    long = " ".join(words(60_000))
    got = J.jaccard_components(docs([(2, long), (1, long + " more"), (3, "x" * 300_000)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_keep_one(docs, words):
    a, b = " ".join(words(200, seed=1)), " ".join(words(200, seed=2))
    rows = [(5, a), (3, a), (9, a + " tail"), (4, b), (4, b), (6, None), (7, ""), (None, "alone in the world of words"), (None, b)]
    assert sorted((r.doc_id for r in J.keep_one(docs(rows, extra=True)).collect()), key=str) == [3, 4, 6, 7, None]


def test_bitmap_bound_is_an_upper_bound():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**64, 500, np.uint64)
    sets = [np.sort(r.choice(pool, r.integers(1, 300), replace=False)) for _ in range(40)]
    bits = J.bitmaps(sets)
    for i in range(40):
        for j in range(40):
            differ = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert len(np.intersect1d(sets[i], sets[j])) <= (len(sets[i]) + len(sets[j]) - differ) / 2


def test_texts_without_copies_are_not_moved(spark, docs):
    """What shuffles leave on disk, beside the texts: keys of some bytes, and the texts of the few that may be copies."""
    r = random.Random(6)
    rows = [(i, " ".join("%07x" % r.randrange(1 << 28) for _ in range(300))) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " tail") for i in range(20)] + rows[:5]
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for top in manager.localDirsString() for d, _, names in os.walk(top) for f in names if f.startswith("shuffle"))
    table = docs(rows).repartition(4).cache()
    assert table.count() == 2025
    before = held()
    assert {x.doc_id for x in J.keep_one(table).collect()} == set(range(2000))
    moved = held() - before
    assert moved < 0.75 * sum(len(t) for _, t in rows)


def test_packed_keys():
    r = np.random.default_rng(3)
    for n, ranges in ((0, 4), (1, 1), (3, 4096), (5000, 7)):
        keys, nodes = r.integers(-(2**63), 2**63 - 1, n), r.integers(-(2**63), 2**63 - 1, n)
        keys[: n // 2] = keys[n // 2 : n // 2 * 2]
        width, got = -(-(1 << J.KEY_BITS) // ranges), []
        for of, data in J.packed(keys, nodes, ranges):
            assert 0 <= of < ranges
            a, b = J.unpacked(data)
            got += zip((a.astype(int) + of * width).tolist(), b.tolist(), strict=True)
        assert sorted(got) == sorted((int(k) % 2**64 >> 64 - J.KEY_BITS, int(x) & J.SHORT) for k, x in zip(keys, nodes, strict=True))


def test_marked_tags_are_always_found(spark, monkeypatch):
    rows = spark.range(-3000, 3000).selectExpr("xxhash64(id) AS tag", "id")
    some = rows.where("id % 50 = 0").select("tag")
    for most, others in ((J.MOST_MARKS, 400), (J.LEAST_MARKS, 400), (256, 5880)):
        monkeypatch.setattr(J, "MOST_MARKS", most)
        found = {x.id for x in rows.where(J.maybe(J.marked(some))).collect()}
        assert found >= set(range(-3000, 3000, 50)) and len(found) - 120 <= others
