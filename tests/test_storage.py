"""Stored tables, merge logs and places: what is rewritten, lost jobs, long chains, deep trees, cycles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricetide.operators import dedup as K
from pricetide.operators import entities as E
from pricetide.operators import location_stats as L
from pricetide.sources.versioned import VersionedTable, part_of, upsert_into


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", "id bigint, v string, version bigint", ["id"], 8)


def rows(spark, *data):
    return spark.createDataFrame(list(data), "id bigint, v string, version bigint")


def test_only_touched_parts_are_written(spark, table):
    assert table.read().count() == 0 and table.version() == 0
    assert len(upsert_into(table, spark.range(200).selectExpr("id", "'old' AS v", "5L AS version"), "version")) == 8
    before = table.manifest()
    part = rows(spark, (3, "", 0)).select(part_of(["id"], 8)).first()[0]
    assert upsert_into(table, rows(spark, (3, "stale", 1), (3, "stale", 2)), "version") == [part]
    assert upsert_into(table, rows(spark, (3, "new", 5)), "version") == [part]
    after = table.manifest()
    assert {p for p in after if after[p] != before[p]} == {part}
    assert {r.id: r.v for r in table.read().collect()} == {i: "new" if i == 3 else "old" for i in range(200)}
    assert table.read(1).where("id = 3").first().v == "old"
    assert upsert_into(table, rows(spark), "version") == [] and table.version() == 3


def test_a_lost_job_leaves_the_old_version(spark, table):
    upsert_into(table, rows(spark, (1, "old", 1)), "version")

    def lost():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        upsert_into(table, rows(spark, (1, "new", 2), (2, "new", 2)), "version", before_publishing=lost)
    assert [(r.id, r.v) for r in table.read().collect()] == [(1, "old")]
    upsert_into(table, rows(spark, (1, "again", 2)), "version")
    assert [(r.id, r.v) for r in table.read().collect()] == [(1, "again")]


def test_two_writers_publish_one_version(spark, table):
    def other():
        upsert_into(table, rows(spark, (1, "other", 1)), "version")

    with pytest.raises(RuntimeError, match="another writer"):
        upsert_into(table, rows(spark, (1, "mine", 9)), "version", before_publishing=other)
    assert [r.v for r in table.read().collect()] == ["other"]


LOG = "merge_id bigint, from_id bigint, to_id bigint, undone boolean"


def test_long_chains_and_cycles(spark):
    chain = spark.range(5000).selectExpr("id AS merge_id", "id AS from_id", "id + 1 AS to_id", "false AS undone")
    assert K.resolve_pointers(chain).agg(F.min("canonical"), F.max("canonical"), F.count("*")).first() == (5000, 5000, 5000)
    cycle = spark.createDataFrame([(1, 1, 2, False), (2, 2, 3, False), (3, 3, 1, False), (4, 9, 1, False)], LOG)
    with pytest.raises(ValueError, match="cycle"):
        K.resolve_pointers(cycle)
    assert {r.id: r.canonical for r in K.resolve_pointers(cycle.withColumn("undone", F.col("merge_id") == 3)).collect()} == {1: 3, 2: 3, 9: 3}
    with pytest.raises(ValueError, match="cycle"):
        K.resolve_pointers(spark.createDataFrame([(1, 7, 7, False)], LOG))
    assert K.resolve_pointers(spark.createDataFrame([], LOG)).count() == 0


def test_merges_as_of_a_time(spark):
    day = lambda n: dt.date(2024, 1, n)
    log = spark.createDataFrame([(1, 1, 2, day(2), day(9)), (2, 2, 3, day(5), None)], "merge_id int, from_id int, to_id int, created_at date, undone_at date")
    at = lambda n: {r.id: r.canonical for r in K.resolve_pointers(K.merges_as_of(log, F.lit(day(n)))).collect()}
    assert (at(1), at(3), at(6), at(10)) == ({}, {1: 2}, {1: 3, 2: 3}, {2: 3})
    facts = spark.createDataFrame([(1, 5), (2, 6), (4, 7), (None, 8)], "id_of int, v int")
    for small in (0, 100):
        assert sorted((r.id_of or 0, r.v) for r in K.followed(facts, K.resolve_pointers(K.merges_as_of(log, F.lit(day(6)))), "id_of", small).collect()) == [(0, 8), (3, 5), (3, 6), (4, 7)]


def test_deep_trees_and_cycles(spark):
    places = spark.createDataFrame([(f"p{i}", f"P{i}", f"p{i - 1}" if i else None) for i in range(20)], "id string, name string, parent_id string")
    facts = spark.createDataFrame([("P19", 3.0), ("P10", 5.0)], "area string, ppm2 double")
    got = {r.id: (r.n, r["median"]) for r in E.tree_rollup(places, facts, "area").collect()}
    assert got == {f"p{i}": (2, 4.0) if i <= 10 else (1, 3.0) for i in range(20)}
    around = places.withColumn("parent_id", F.when(F.col("id") == "p3", F.lit("p7")).otherwise(F.col("parent_id")))
    with pytest.raises(ValueError, match="own ancestors"):
        L.ancestors(around)


def test_increments_equal_one_pass(spark, tmp_path):
    facts = spark.range(900).selectExpr("concat('p', id % 3) AS place", "IF(id % 2 = 0, 'house', NULL) AS property_type", "'asking' AS deal_status", "IF(id % 50 = 7, -1.0D, pow(1.01D, id % 300)) AS ppm2", "id")
    table = L.location_table(spark, f"file://{tmp_path}/s", 4)
    for part in range(3):
        L.add_facts(table, facts.where(f"id % 7 % 3 = {part}"), "place")
    whole = L.state_of(facts, "place")
    assert sorted(map(tuple, table.read().fillna("").collect())) == sorted(map(tuple, whole.fillna("").collect()))
    one = spark.createDataFrame([("p0", "r"), ("p1", "r"), ("p2", None), ("r", None)], "id string, parent_id string")
    top = {(r.place, r.property_type): r for r in L.summary(L.rolled_up(table.read(), one)).collect()}
    exact = facts.where("place <> 'p2' AND ppm2 > 0 AND property_type = 'house'").agg(F.count("*"), F.min("ppm2"), F.max("ppm2"), F.percentile("ppm2", 0.5)).first()
    r = top["r", "house"]
    assert (r.n, r.min, r.max) == tuple(exact)[:3] and abs(r["median"] / exact[3] - 1) < 1 / L.PER_E
    assert ("p2", "house") in top and ("r", None) in top
