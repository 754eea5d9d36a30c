"""Work that grew faster than its rows, and pages that Python held all at once."""

import time

import pandas as pd
from pyspark.sql import functions as F

from pricetide.functions import text as T
from pricetide.operators import dedup as K
from pricetide.operators import pages as P


def test_first_names_of_a_large_group(spark):
    """30,000 names of one project: comparing each with all before it takes minutes."""
    names = spark.range(30_000).select("id", F.lit("p").alias("project"), F.concat(F.lit(" Tòa "), (F.col("id") % 15_000).cast("string")).alias("name"))
    odd = spark.createDataFrame([(-2, "p", "  "), (-1, "p", None), (7, "q", "?!"), (8, "r", " Đất 1"), (9, "r", "dat-1")], "id bigint, project string, name string")
    began = time.perf_counter()
    got = {r.project: r.names for r in K.keep_first_names(names.unionByName(odd), "project", "name", "id").collect()}
    assert got == {"p": [f"Tòa {i}" for i in range(15_000)], "q": [], "r": ["Đất 1"]} and time.perf_counter() - began < 60


def test_clean_name_is_the_name_of_the_split(spark):
    names = ["Dự án Sky", "DU AN  villa x", "villa", " villa ", "Căn hộ\tA", "project", "can hox y", "", " ", None, "shop house Mé\nb", "NHÀ PHỐ 1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(T.clean_project_name("n").alias("a"), T.split_name_tags("n")["name"].alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a == "Sky"


def test_hierarchies_take_few_expressions(spark):
    """A part is cut and cleaned once, not once for each use."""
    plan = lambda c: spark.range(1).select(F.lit("a / b / c").alias("n"), F.col("id")).repartition(1).select(c("n").alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(T.hierarchy_from_name).count("split(") <= 3


def test_pages_leave_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "AT_ONCE", 3)
    rows = spark.createDataFrame([(i, "https://h/x", f"<title>t{i}</title><li><a href='/{i}'>word {i}</a></li>" if i else None) for i in range(10)], "page_id bigint, url string, html string").coalesce(1)
    got = {r.page_id: (r.title, r.text, r.links, [tuple(x) for x in r["items"]]) for r in P.parsed(rows, "li").collect()}
    assert got == {0: (None, "", [], [])} | {i: (f"t{i}", f"word {i}", [f"https://h/{i}"], [(f"https://h/{i}", f"word {i}")]) for i in range(1, 10)}


def test_geocoding_is_dealt_out(spark):
    from pricetide.operators.geo import geocode_candidates

    named = {"name": "'A'", "project_name": "'Dự án Sky'", "building_name": "'B1'", "house_number": "'2'", "address": "'Q7'", "building_address": "'q7'", "project_address": "string(null)", "location_texts": "array('P. 3', 'Q7')"}
    rows = spark.range(64).coalesce(1).selectExpr("id", *(f"{v} AS {k}" for k, v in named.items()))
    found = geocode_candidates(rows)
    parts = {r.part for r in found.selectExpr("spark_partition_id() AS part").distinct().collect()}
    assert len(parts) > 4 and found.groupBy("id").count().where("count = 8").count() == 64


def test_cases_are_aligned_side_by_side(spark, monkeypatch):
    import random

    from pricetide.operators import evaluate as V

    r, seen, step = random.Random(4), [], V._near
    monkeypatch.setattr(V, "_near", lambda have, *rest: seen.append(have.shape) or step(have, *rest))
    some = lambda n: [(f"c{r.randrange(40)}" if i % 50 else None, i, r.choice([None, 1, 2, 3]), r.choice([None, 1.0, 1.4, 2.0]), r.choice(["a", "b", None])) for i in range(n)]
    predicted, expected, want = some(200), some(240), []
    for case in {row[0] for row in expected}:
        left = [row for row in predicted if row[0] == case]
        for _, i, price, area, kind in (row for row in expected if row[0] == case):
            if left:
                same = lambda p, e, reach: p is None if e is None else p is not None and abs(p - e) <= reach
                best = max(left, key=lambda row: 2 * same(row[2], price, 0.005 * max(price or 1, 1)) + same(row[3], area, 0.5) + (row[4] == kind))  # noqa: B023
                left.remove(best)
                want.append((case, best[1], i, best[2], price))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        frames = [spark.createDataFrame(rows, "case_id string, id int, price_vnd bigint, area_m2 double, type string") for rows in (predicted, expected)]
        got = [tuple(row) for row in V.aligned(*frames, ("price_vnd",)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted(want, key=repr)
    pdf = [pd.concat([pd.DataFrame(rows, columns=["case", "id", "price", "area", "type"]).assign(side=side) for side, rows in ((0, predicted), (1, expected))]).sort_values(["case", "side", "id"])]
    p, _ = V._matches(*(pdf[0][c] for c in ("case", "price", "area", "type", "side")))
    assert len(p) == len(want) and len(seen) < len(expected) and max(shape[0] for shape in seen) > 5


def test_reliability_reads_its_rows_once(spark, tmp_path):
    from pricetide.operators import market as M

    rows = spark.range(60).selectExpr("id % 4 AS source_id", "'sale' AS listing_type", "'asking' AS deal_status", "'house' AS property_type", "double(id % 7) AS ppm2")
    rows.write.parquet(str(tmp_path / "rows"))
    got = M.source_reliability(spark.read.parquet(str(tmp_path / "rows")))
    assert got.count() == 4 and got.inputFiles() and all("pricetide-priced" in f for f in got.inputFiles())


def test_a_fact_line_is_worked_out_once(spark):
    from pricetide.operators import extract as X

    posts = spark.createDataFrame([(1, "Giá 3 tỷ, LH: 0901 234 567\n\n\n \nxin chào\ngiá  3 TỶ,\nmenu giá 4 tỷ. View sông"), (2, None), (3, "")], "id int, text string").repartition(1)
    found = X.fact_lines(posts, "id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in ("hotline", "breadcrumb", "sổ hồng", "{3,}")] == [1, 1, 1, 1]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, "Giá 3 tỷ,"), (1, 4, "View sông")]


def test_fact_and_junk_patterns_find_what_each_finds(spark):
    import random

    from pricetide.operators import extract as X

    r = random.Random(3)
    bits = [*"0123 ,./|-đĐmMxX_", "m2", "tỷ", "TỶ", "tr", "pn", "Phòng ngủ", "BÁN", "ban", "ſo hong", "tp.", "hcm", "Ðất", "đất", "ĐẤT", "duong", "ĐƯỜNG", "quận", "Sổ đỏ", "can\u212a", "\u212ahu vực", "menu", "ads", "ad ", "HOME", "Lọc", "source :", "é", "huong", "view", "ab"]
    lines = ["".join(r.choice(bits) for _ in range(r.randrange(1, 5))) for _ in range(20_000)]
    of = lambda patterns: F.col("x").rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", of(X.FACTS).alias("f"), X.is_fact(F.col("x")).alias("g"), of(X.JUNK).alias("j"), X.is_junk(F.col("x")).alias("k"))
    got = rows.groupBy("f", "g", "j", "k").count().collect()
    assert all(x.f == x.g and x.j == x.k for x in got) and len(got) == 4
