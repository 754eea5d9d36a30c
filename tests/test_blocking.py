"""Composite blocks: recall of vectors, oversized wards, what distance and vectors add to a score."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.operators import blocking as B
from pricetide.operators import resolve as R

RECORD = "name string, project_name string, building_name string, house_number string, location_text string, aliases array<string>, wiki_notes string, type string, area_m2 double, ward string, lat double, lng double, vector array<float>"


def record(spark, key, rows):
    """rows: (id, name, ward, lat, lng, vector)."""
    return spark.createDataFrame([(i, name, None, None, None, None, [], None, "house", 50.0, *rest) for i, name, *rest in rows], f"{key} bigint, {RECORD}")


def test_recall_of_similar_vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 32))
    x = np.repeat(centres, 12, axis=0) + 0.4 * r.normal(size=(480, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = {(i, j) for i, j in zip(*np.where(np.triu(unit @ unit.T, 1) >= 0.8), strict=True)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    blocks = B.vector_blocks(df, "id", "v", 32)
    got = {(p.id, p.other) for p in B.block_pairs(blocks, blocks.withColumnRenamed("id", "other"), "id", "other", 1 << 40).where("id < other").collect()}
    assert len(close) > 1000 and len(close & got) >= 0.9 * len(close)
    assert len(got) < 0.6 * 480 * 479 / 2


def test_vectors_that_are_none(spark):
    odd = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [0.0, 0.0])]
    assert {r.id for r in B.vector_blocks(spark.createDataFrame(odd, "id int, v array<double>"), "id", "v", 2).collect()} == {5}


def test_an_oversized_ward_loses_no_pair_of_another_block(spark):
    ents = [(i, f"Name{i} Park", "Hot ward", 10.0 + i, 100.0, None) for i in range(40)] + [(900, "Quiet House", "  quiet WARD", None, None, None)]
    exts = [(1, "Name7 Park", "hot ward", 17.001, 100.0, None), (2, "Other", "Quiet ward", None, None, None), (3, "Else", None, 20.0, 100.0, None)]
    e, c = record(spark, "ext_id", exts), record(spark, "property_id", ents)
    pairs = lambda most: {(p.ext_id, p.property_id) for p in B.composite_candidates(e, c, 2.0, None, most).collect()}
    tokens = {(p.ext_id, p.property_id) for p in R.candidates(e, c).collect()}
    assert pairs(39) == tokens | {(2, 900), (1, 7), (3, 10)}
    assert pairs(40) == tokens | {(2, 900), (3, 10)} | {(1, i) for i in range(40)}


def test_distance_and_vectors_in_the_score(spark):
    ents = [(1, "Sky Tower", "w", 10.0, 100.0, [1.0, 0.0]), (2, "Sky Tower", "w", 10.0, 100.009, [0.0, 1.0]), (3, "Sky Tower", "w", None, None, None)]
    e, c = record(spark, "ext_id", [(9, "Sky Tower", "w", 10.0, 100.0, [1.0, 0.0])]), record(spark, "property_id", ents)
    found = B.composite_candidates(e, c, 2.0, 2)
    got = {r.property_id: r.score for r in R.ranked_candidates(e, c, pairs=found, extra=B.extra_score(F.col("km"), F.col("cosine"))).collect()}
    plain = {r.property_id: r.score for r in R.ranked_candidates(e, c).collect()}
    assert got[1] == pytest.approx(plain[1] + 0.2) and got[3] == plain[3]
    assert got[2] == pytest.approx(plain[2] + 0.1 * (1 - 0.986 / 2), abs=1e-3)


@pytest.mark.parametrize("most", [0, 50_000])
def test_tokens_are_found_by_their_rarest_trigram(spark, monkeypatch, most):
    from pricetide.operators import quantiles as Q

    monkeypatch.setattr(Q, "BROADCAST_CELLS", most)
    texts = [(i, f"anna banana {i % 7}" if i % 3 else f"bananas\nana{i}") for i in range(60)]
    tokens = ["banana", "ana", "nas", "xyz", "ananas", "anna", "ana5", "sana"]
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(tokens)], "ext_id int, token string")
    got = {(r.ext_id, r.id) for r in R.token_matches(wanted, spark.createDataFrame(texts, "id int, search_text string"), "id").collect()}
    assert got == {(k, i) for k, t in enumerate(tokens) for i, text in texts if t in text}


@pytest.mark.parametrize("tile", [16, 2048])
def test_similar_pairs_of_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(B, "TILE", tile)
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(30, 24)), 4, axis=0) + 0.3 * r.normal(size=(120, 24))
    x = np.concatenate([x, x[:40], x[:10], np.zeros((2, 24))])
    df = spark.createDataFrame([(i * 7 % 173, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id bigint, v array<float>")
    blocks = B.vector_blocks(df, "id", "v", 24)
    shared = B.block_pairs(blocks, blocks.withColumnRenamed("id", "other"), "id", "other", 1 << 40).where("id < other")
    sides = [df.select(F.col("id").alias(n), F.col("v").alias(v)) for n, v in (("id", "a"), ("other", "b"))]
    want = shared.join(sides[0], "id").join(sides[1], "other").select("id", "other", R.cosine(F.col("a"), F.col("b")).alias("cosine")).where("cosine >= 0.8")
    seen, step = [], B.expanded
    monkeypatch.setattr(B, "expanded", lambda pairs, *rest: seen.append(pairs.count()) or step(pairs, *rest))
    got = sorted((p.id, p.other, p.cosine) for p in B.similar_pairs(df, "id", "v", 24, 0.8).collect())
    assert got == sorted((p.id, p.other, p.cosine) for p in want.collect()) and len(got) > seen[0]


def test_the_best_of_composite_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "ASKERS", 5)
    monkeypatch.setattr(B, "HOLDERS", 80)
    r, names = np.random.default_rng(2), ["Red Ring", "Blue Ring", "Blue Bolt", "Old Nail"]
    vector = lambda i: None if i % 3 == 0 else [1.0, None] if i % 31 == 0 else [float(x) for x in r.normal(size=2 if i % 7 else 3)]
    rows = lambda n, first: [(first + i, names[i % 4], f"w{i % 9}", 10 + i % 5 / 100, 100.0 if i % 6 else None, vector(i % 60)) for i in range(n)]
    e, c = record(spark, "ext_id", rows(30, 1)), record(spark, "property_id", rows(240, 1000))
    old = B.composite_candidates(e, c, 2.0, 2, 150)
    want = R.ranked_candidates(e, c, 6, pairs=old, extra=B.extra_score(F.col("km"), F.col("cosine")))
    seen, step = [], R.scores
    monkeypatch.setattr(R, "scores", lambda pairs, *rest: seen.append(pairs.count()) or step(pairs, *rest))
    ranked = lambda df: sorted((p.ext_id, p["rank"], p.property_id, p.score) for p in df.select("ext_id", "rank", "property_id", "score").collect())
    assert ranked(B.ranked_composite(e, c, 2.0, 2, 150, 6)) == ranked(want)
    assert seen[0] < old.count() / 3


def test_entities_move_once_however_many_kinds_ask(spark):
    """60 kinds of extractions, each of which asks for all 600 entities: a row for each of both would be 18 MB of vectors."""
    r = np.random.default_rng(5)
    rows = lambda n, first: [(first + i, f"ring w{i % 60}", f"w{i}", 10 + i / 10, 100.0, [float(x) for x in r.normal(size=128)]) for i in range(n)]
    e, c = (record(spark, key, rows(n, 1)).cache() for key, n in (("ext_id", 60), ("property_id", 600)))
    assert (e.count(), c.count()) == (60, 600)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for top in manager.localDirsString() for d, _, names in os.walk(top) for f in names if f.startswith("shuffle"))
    before, seen, step = held(), [], B._best_in_blocks

    def spy(left, right, *rest):
        found = step(left, right, *rest)
        seen.append((found.count(), held() - before))
        return found

    B._best_in_blocks = spy
    try:
        B.ranked_composite(e, c, 2.0, 128, 1)
    finally:
        B._best_in_blocks = step
    assert seen[0][0] >= 600 and seen[0][1] < 6_000_000
