"""Rows of equal columns are matched and scored once, and every one of them is in the results."""

import os

import pytest
from pyspark.sql import functions as F

from pricetide.operators import geo as G
from pricetide.operators import kinds as K
from pricetide.operators import resolve as R

RECORD = "name string, project_name string, building_name string, house_number string, location_text string, aliases array<string>, wiki_notes string, type string, area_m2 double"


def record(spark, key, names):
    return spark.createDataFrame([(i, n, None, None, None, None, [], None, "house", 50.0) for i, n in enumerate(names)], f"{key} bigint, {RECORD}")


@pytest.fixture
def copies(spark, monkeypatch):
    """90 extractions and 120 entities of three names, and the texts and tokens that were matched."""
    seen, step = [], R.token_matches

    def spy(wanted, texts, key):
        seen.append((wanted.count(), texts.count()))
        return step(wanted, texts, key)

    monkeypatch.setattr(R, "token_matches", spy)
    names = ["red ring", "blue ring", "blue bolt"]
    return record(spark, "ext_id", names * 30), record(spark, "property_id", names * 40), seen


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_candidates_of_copies(copies, monkeypatch, block):
    ext, ent, seen = copies
    monkeypatch.setattr(K, "BLOCK", block)
    got = [tuple(r) for r in R.candidates(ext, ent).collect()]
    assert len(got) == len(set(got)) and set(got) == {(e, p) for e in range(90) for p in range(120) if {e % 3, p % 3} != {0, 2}}
    assert seen == [(6, 3)]


def test_ranks_of_copies(copies):
    ext, ent, seen = copies
    got = {}
    for r in R.ranked_candidates(ext, ent, 4).collect():
        got.setdefault(r.ext_id, []).append((r["rank"], r.property_id))
    assert got == {e: [(k + 1, e % 3 + 3 * k) for k in range(4)] for e in range(90)}
    assert {r.ext_id: r.property_id for r in R.resolve(ext, ent).where("action = 'link'").collect()} == {e: e % 3 for e in range(90)}
    assert all(texts == 3 for _, texts in seen)


def test_kinds_keep_the_sign_of_zero(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, None), (4, 0.0)], "id int, x double")
    members, kinds = K.kinds(rows, "id", ("x",))
    assert members.join(kinds.withColumnRenamed("id", "kind"), "kind").count() == 4


def test_search_of_copies(spark, copies):
    ext, ent, seen = copies
    wanted = spark.createDataFrame([(e, t) for e in range(30) for t in ("ring", "zzz")], "ext_id bigint, token string")
    names, none = ent.selectExpr("property_id AS id", "name"), ent.selectExpr("property_id AS id", "name").where("false")
    got = {}
    for r in R.search_entities(wanted, none, none, names, 5).collect():
        got.setdefault(r.ext_id, []).append((r.name, r.id))
    blue = sorted(str(p) for p in range(1, 120, 3))[:5]
    assert {e: sorted(rows) for e, rows in got.items()} == {e: sorted(("blue ring", i) for i in blue) for e in range(30)}
    assert seen == [(2, 0), (2, 0), (2, 3)]


def test_places_of_copies(spark, monkeypatch):
    seen, step = [], G.expanded
    monkeypatch.setattr(G, "expanded", lambda pairs, *rest: seen.append(pairs.count()) or step(pairs, *rest))
    rows = spark.createDataFrame([(i, 10.0 + i % 2 / 100, 100.0) for i in range(60)] + [(60, 20.0, 100.0), (61, None, 100.0)], "id int, lat double, lng double")
    got = [(r.left_id, r.right_id) for r in G.within(rows, rows, 2).collect()]
    assert len(got) == len(set(got)) == 60 * 60 + 1 and seen == [5]


def shuffled(spark, run):
    """What run gives, and the bytes of shuffles that it leaves on disk."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for top in manager.localDirsString() for d, _, names in os.walk(top) for f in names if f.startswith("shuffle"))
    before = held()
    return run(), held() - before


@pytest.mark.parametrize("block, least, most", [(64, 64, 400_000), (9, 4, 3_000_000)])
def test_a_kind_has_the_blocks_that_its_rows_need(spark, monkeypatch, block, least, most):
    """40 kinds of 50 rows on each side, all paired: blocks by the whole table's size would be a row each."""
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "LEAST", least, raising=False)
    sides = [spark.range(2000).selectExpr(f"id AS {key}", "id % 40 AS kind") for key in ("l", "r")]
    pairs = spark.range(1600).selectExpr("id div 40 AS l", "id % 40 AS r", "id % 7 AS more")
    every = K.expanded(pairs, *sides, "l", "r")
    checked = F.sum((F.col("more") == (F.col("l") % 40 * 40 + F.col("r") % 40) % 7).cast("int"))
    got, moved = shuffled(spark, lambda: every.agg(F.count("*"), F.count_distinct("l", "r"), checked).first())
    assert tuple(got) == (2000 * 2000,) * 3
    _, alone = shuffled(spark, lambda: every.write.format("noop").mode("overwrite").save())
    assert alone < most


def test_candidates_of_many_copies_move_little(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    monkeypatch.setattr(K, "LEAST", 64, raising=False)
    names = ["red ring", "blue ring", "blue bolt"]
    ext, ent = record(spark, "ext_id", names * 800), record(spark, "property_id", names * 800)
    got, moved = shuffled(spark, lambda: R.candidates(ext, ent).count())
    assert got == 7 * 800 * 800 and moved < 600_000


def test_places_of_many_copies_move_little(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    monkeypatch.setattr(K, "LEAST", 64, raising=False)
    rows = spark.range(3000).selectExpr("id", "10.0D + id % 3 / 100 AS lat", "100.0D AS lng")
    got, moved = shuffled(spark, lambda: G.within(rows, rows, 2).count())
    assert got == 7 * 1000 * 1000 and moved < 600_000
