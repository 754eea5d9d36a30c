"""Expectations of operators on small tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pricetide.operators import dedup as K
from pricetide.operators import entities as E
from pricetide.operators import evaluate as V
from pricetide.operators import extract as X
from pricetide.operators import geo as G
from pricetide.operators import ingest as I
from pricetide.operators import market as M
from pricetide.operators import ops as O
from pricetide.operators import pages as P
from pricetide.operators import resolve as R
from pricetide.operators import stats as S


def test_distribution(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(float("nan"),), (float("inf"),), (None,)], "v double")
    assert tuple(df.agg(*S.distribution(F.col("v"))).first()) == (4, 2.5, 1.75, 3.25, 1.0, 4.0)
    assert tuple(df.where("false").agg(*S.distribution(F.col("v"))).first()) == (0, None, None, None, None, None)


def obs(spark, rows):
    return spark.createDataFrame(rows, "ppm2 double, listing_type string, deal_status string, property_type string, project string, area string, at timestamp")


DAY = dt.datetime


def test_trend_keeps_empty_months(spark):
    rows = [(100.0, "sale", "asking", "a", "p", "x", DAY(2024, 1, 5)), (90.0, "sale", "transacted", "a", "p", "x", DAY(2024, 3, 5)), (None, "sale", "unknown", "a", "p", "x", DAY(2024, 3, 6))]
    got = [tuple(r) for r in M.monthly_trend(obs(spark, rows), 3).orderBy("key").collect()]
    assert got == [("2024-01", "T1", 100.0, None, 1), ("2024-02", "T2", None, None, 0), ("2024-03", "T3", None, 90.0, 2)]
    change = M.trend_change(M.monthly_trend(obs(spark, rows), 3)).first()
    assert (change["first"], change.latest, change.direction) == (100.0, 100.0, "flat")


def test_window_and_filters(spark):
    rows = [(1.0, "sale", "asking", t, "p", "x", DAY(2024, m, 1)) for m in (1, 6, 12) for t in ("a", "b")]
    base = M.filtered(M.in_window(obs(spark, rows), 7), M.Filters.parse({"period": "bad", "type": "a", "deal": "nope"}))
    assert [r["at"].month for r in base.orderBy("at").collect()] == [6, 12]
    assert M.Filters.parse({"period": "24", "deal": "asking"}) == M.Filters(24, "all", "all", "asking")


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 10, 20, 70, 70)], "v double")
    bins = S.histogram(df, "v", 7, 10.0).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in bins] == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 2)]
    assert S.median_bin(S.histogram(df, "v", 7, 10.0)).first()[0] == 2
    assert S.histogram(df.limit(4), "v", 7, 10.0).count() == 0
    assert S.histogram(spark.createDataFrame([(1.0,)] * 6, "v double"), "v").count() == 0


def test_discounts(spark):
    rows = [(100.0, "sale", "asking", "a", "p", "x", DAY(2024, 1, 1)), (80.0, "sale", "transacted", "a", "p", "x", DAY(2024, 1, 1)), (5.0, "sale", "asking", "b", "p", "x", DAY(2024, 1, 1))]
    assert {r.property_type: r.discount_pct for r in M.discounts(obs(spark, rows), "property_type").collect()} == {"a": 20.0, "b": None}
    assert tuple(M.mean_discount(obs(spark, rows)).first()) == (20.0, 1)


def test_weights_and_levels(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None)], "id int, v double")
    assert {r.id: r.weight for r in E.map_weight(df, "v").collect()} == {1: 0.0, 2: 1.0, 3: 0.5}
    assert E.map_weight(df.where("id = 1"), "v").first().weight == 0.5
    assert [r[0] for r in spark.createDataFrame([(n,) for n in (0, 1, 5, 7, 10)], "n int").select(E.reliability_level(F.col("n"))).collect()] == [0, 1, 2, 3, 4]


def test_dedup_and_upserts(spark):
    a = spark.createDataFrame([("x", None, 1), ("x", None, 2), ("y", "r", 3)], "k string, r string, v int")
    known = spark.createDataFrame([("y", "r")], "k string, r string")
    assert [r.v for r in K.new_only(a, known, ["k", "r"], "v").collect()] == [1]
    assert K.new_only(a, known.unionByName(a.select("k", "r")), ["k", "r"], "v").count() == 0
    old = spark.createDataFrame([(1, "old", 5), (2, "keep", 9)], "id int, v string, version int")
    new = spark.createDataFrame([(1, "new", 5), (2, "stale", 1), (3, "in", 1)], "id int, v string, version int")
    assert {r.id: r.v for r in K.upsert(old, new, ["id"], "version").collect()} == {1: "new", 2: "keep", 3: "in"}
    log = spark.createDataFrame([(1, "a", "b", False), (2, "b", "c", False), (3, "a", "z", True), (4, "c", "d", False)], "merge_id int, from_id string, to_id string, undone boolean")
    assert {r.id: r.canonical for r in K.resolve_pointers(log).collect()} == {"a": "d", "b": "d", "c": "d"}
    notes = spark.createDataFrame([(None, "n"), ("old", "n"), ("x\n\nN: n", "n"), ("old", " ")], "o string, n string").select(K.merge_note(F.col("o"), F.col("n"), "N: "))
    assert [r[0] for r in notes.collect()] == ["N: n", "old\n\nN: n", "x\n\nN: n", "old"]


EXT = "ext_id int, name string, project_name string, building_name string, house_number string, location_text string, type string, area_m2 double, aliases array<string>, tags array<string>, wiki_notes string, listing_type string, price_vnd bigint, price_basis string, confidence double"


def extraction(i, **given):
    base = dict(ext_id=i, name=None, project_name=None, building_name=None, house_number=None, location_text=None, type="apartment", area_m2=None, aliases=[], tags=[], wiki_notes=None, listing_type="sale", price_vnd=1, price_basis="total", confidence=0.9)
    return tuple((base | given).values())


def entities(spark, rows):
    return spark.createDataFrame(rows, EXT).withColumnRenamed("ext_id", "property_id")


def scored(spark, ext, ent):
    e, c = spark.createDataFrame([ext], EXT), entities(spark, [ent])
    return R.keyed_extractions(e).join(R.keyed_entities(c)).select(R.score()).first()[0]


def test_scores(spark):
    full = dict(project_name="Vinhomes Grand Park", building_name="S1", house_number="0512", area_m2=60.0)
    assert scored(spark, extraction(1, **full), extraction(1, **(full | {"area_m2": 63.0}))) == pytest.approx(0.42 + 0.22 + 0.18 + 0.08 * 0.75 + 0.2)
    assert scored(spark, extraction(1, name="Ecopark Villa"), extraction(1, name="Ecopark Villa", type="land")) == pytest.approx(0.72)
    assert scored(spark, extraction(1, project_name="Ecopark", name="Ecopark"), extraction(1, name="Ecopark", project_name="Ecopark", type="project")) == pytest.approx(0.76 + 0.14)
    assert scored(spark, extraction(1, name="Nothing"), extraction(1, name="Else")) == pytest.approx(0.1)


def test_resolution(spark):
    ents = entities(spark, [extraction(10, name="Sky Garden", project_name="Sky Garden"), extraction(11, name="Sunrise City", project_name="Sunrise City", building_name="V1", house_number="12"), extraction(12, name="Other")])
    exts = spark.createDataFrame([
        extraction(1, project_name="Sky Garden", name="Sky Garden"), extraction(2, project_name="Sunrise City", building_name="V2"), extraction(3, name="Ab"), extraction(4, project_name="Unknown Place", house_number="3"),
        extraction(5, project_name="Sunrise City", building_name="V1", house_number="12"), extraction(6, name=None),
    ], EXT)
    got = {r.ext_id: (r.action, r.property_id) for r in R.resolve(exts, ents).collect()}
    assert got[1] == ("link", 10) and got[2][0] == "review" and got[3] == ("create", None) and got[4] == ("create", None) and got[5] == ("link", 11)
    parents = spark.createDataFrame([("sky garden",), ("sunrise city",)], "name_normalized string")
    out = {r.ext_id: r.outcome for r in R.persist_decisions(exts, ents, parents).collect()}
    assert out == {1: "review", 2: "review", 3: "created", 4: "review", 5: "linked", 6: "rejected"}


def test_blocking_equals_contains(spark):
    ents = entities(spark, [extraction(i, name=n) for i, n in enumerate(["Skyline Tower", "Blue Sky", "sk", "Garden", "Áo Sky", None])])
    exts = spark.createDataFrame([extraction(1, name="Sky"), extraction(2, name="den"), extraction(3, name="no")], EXT)
    assert {tuple(r) for r in R.candidates(exts, ents).collect()} == {(1, 0), (1, 1), (1, 4), (2, 3)}


def test_hierarchy_choice(spark):
    wanted = spark.createDataFrame([("a", "Grand Park", None), ("b", "Sky", None), ("c", "Zed", None)], "ext_id string, project string, building string")
    matches = spark.createDataFrame([("a", "Vinhomes Grand Park", None), ("a", "Other", None), ("b", "Sky One", None), ("b", "Sky Two", None), ("c", "Far", None)], "ext_id string, project_name string, building_name string")
    assert [tuple(r) for r in R.choose_hierarchy(wanted, matches).select("ext_id", "project_name").collect()] == [("a", "Vinhomes Grand Park")]
    evidence = spark.createDataFrame([("a", "Grand Park apartments", "http://x", "by Vinhomes"), ("a", "Grand Park", "u", "s"), ("c", "none", "u", "s")], "ext_id string, title string, url string, snippet string")
    names = spark.createDataFrame([("a", "Grand Park"), ("c", "Zed"), ("d", None)], "ext_id string, name string")
    assert {r.ext_id: (r.results, r.supported) for r in R.evidence_support(names, evidence, "name", 2).collect()} == {"a": (2, True), "c": (0, False), "d": (0, False)}


def test_created_entities(spark):
    row = R.created_entities(spark.createDataFrame([extraction(1, project_name="dự án Sky", house_number="12", aliases=["sky / 12", "Sky Tower"], tags=["view"])], EXT)).first()
    assert (row["name"], row.project_name, row.aliases, row.tags) == ("Sky / 12", "Sky", ["Sky Tower"], ["dự án", "view"])


GOLDEN = [
    ("FOR SALE: 3BR apartment at Estella Heights, 115 sqm, asking 8.2 billion VND, slightly negotiable.", "apartment", "sale", 8_200_000_000, "total", 115.0, 3, True, "asking"),
    ("Còn duy nhất 1 căn 1PN view sông, diện tích 50m2. Inbox giá nhé!", "apartment", "unknown", None, "unknown", 50.0, 1, False, "asking"),
    ("HOT bán gấp nhà hẻm Bình Thạnh 4x15 = 60m2, 6ty5, shr, hỗ trợ vay 70%.", "house", "sale", 6_500_000_000, "total", 60.0, None, False, "asking"),
    ("Cho thuê phòng trọ Q.Gò Vấp 25m2 giá 4tr5/tháng, có gác.", "apartment", "rent", 4_500_000, "total", 25.0, None, False, "asking"),
    ("Bán căn 2PN Ecopark 58m2 giá 3.6x tỷ, view nội khu.", "apartment", "sale", 3_600_000_000, "total", 58.0, 2, False, "asking"),
    ("Bán đất nền 100m2 giá 80 triệu/m2 TL", "land", "sale", 80_000_000, "per_m2", 100.0, None, True, "asking"),
    ("Đã chốt căn 2PN 70m2 4,1 tỷ, x", "apartment", "sale", 4_100_000_000, "total", 70.0, 2, False, "transacted"),
]
NOISE = ["Chào buổi sáng cả nhà, chúc một ngày hiệu quả!", "Cần mua gấp căn hộ 2PN tài chính 3.5 tỷ đổ lại.", "Khách em tìm thuê căn 1PN tài chính 14tr/tháng.", "Tuyển dụng 5 nhân viên kinh doanh, hoa hồng 60%.", "", None]


def test_listing_extraction(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(GOLDEN)] + [(100 + i, x) for i, x in enumerate(NOISE)], "id int, text string")
    got = {r.id: r for r in X.extract_listings(df).collect()}
    assert set(got) == set(range(len(GOLDEN)))
    for i, (_, *want) in enumerate(GOLDEN):
        r = got[i]
        assert [r.type, r.listing_type, r.price_vnd, r.price_basis, r.area_m2, r.bedrooms, r.is_negotiable, r.deal_status] == want, GOLDEN[i][0]


def test_several_listings_in_a_message(spark):
    df = spark.createDataFrame([(1, "Bán 2 căn:\n- căn 60m2 giá 3 tỷ\n- căn 80m2 giá 4 tỷ\nLH 0909")], "id int, text string")
    assert [(r["item"], r.area_m2, r.price_vnd) for r in X.extract_listings(df).orderBy("item").collect()] == [(0, 60.0, 3_000_000_000), (1, 80.0, 4_000_000_000)]


def test_distillation(spark):
    raw = "Đăng nhập\nBán căn hộ Sky 60m2 giá 3 tỷ. Liên hệ: 0909 123 456\nbán căn hộ sky 60m2 giá 3 tỷ.\nmenu\nTrời đẹp quá\n" + "Giá tốt " * 60
    rows = spark.createDataFrame([(1, raw, "r1", None), (2, "Trời đẹp", "r", "p"), (3, None, "r", None)], "id int, text string, ref string, page string")
    posts = {r["id"]: r.post for r in X.distilled_posts(rows, "id", "text", "ref", "page").collect()}
    lines = posts[1].split("\n")
    assert lines[:3] == ["Distilled public web listing for extraction.", "Source URL: r1", "Key explicit facts:"]
    assert lines[3] == "- Bán căn hộ Sky 60m2 giá 3 tỷ." and len(lines) == 6 and lines[4].endswith("...") and len(lines[4]) <= 2 + X.FACT_CHARS + 3
    assert lines[5] == "Distillation confidence: 0.55"
    assert "No clear listing facts found." in posts[2] and posts[2].endswith("0.30") and "Collected from: p" in posts[2]
    assert posts[3].endswith("0.30")


def test_described_post(spark):
    row = {c: None for c in X.DESCRIBED.values()} | {"title": " T ", "listing_type": "unknown", "property_type": "house", "price_text": "3 tỷ"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    got = df.select(X.described_post(F.lit("u"), F.lit(None).cast("string"), F.array(F.lit(" a "), F.lit("")), F.lit(0.7))).first()[0]
    assert got == "Distilled public web listing for extraction.\nSource URL: u\nTitle: T\nProperty type: house\nPrice: 3 tỷ\nAdditional explicit facts:\n- a\nDistillation confidence: 0.70"


def test_messages_and_backfill(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"raw_text":" a ","source_ref":" "}\n{"raw_text":" "}\n{"raw_text":"b","source_type":"web","source_ref":"r"}\n')
    got = sorted((r.raw_text, r.source_type, r.source_ref) for r in I.read_messages(spark, str(tmp_path / "m.json")).collect())
    assert got == [("a", "broker", None), ("b", "web", "r")]
    projects, buildings = I.backfill(spark.createDataFrame([("Sky ", "S1"), ("sky", " s1"), ("Park", None), (" ", "x"), (None, "y")], "project_name string, building_name string"))
    assert sorted(r.name_normalized for r in projects.collect()) == ["park", "sky"]
    assert [(r.project, r.name_normalized) for r in buildings.collect()] == [("sky", "s1")]


HTML = """<html><head><title> A &amp; B </title><meta property="og:title" content="OG"><script type="application/ld+json">{"a":1}</script></head><body><nav><a href="/n">nav</a></nav>
<div class="card big"><h3>One</h3><a class="go" href="/p/1?b=2&a=1#x">open</a><p>60m2</p></div><div class="card"><a href="/p/1?b=2&a=1#x">dup</a></div><div class="card" data-k="abc">Two<script>x()</script></div>
<a href="mailto:x">m</a><a href="https://other.com/">o</a></body></html>"""


def test_page_parsing(spark):
    df = spark.createDataFrame([(1, "https://site.com/list", HTML), (2, None, None), (3, "https://s.com", "<div class=card><b>open")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in P.parsed(df, "div.card", "a").collect()}
    assert got[1].title == "A & B" and "nav" not in got[1].text and "x()" not in got[1].text
    assert [(i.ref, i.text) for i in got[1]["items"]] == [("https://site.com/p/1?b=2&a=1#x", "One\nopen\n60m2"), (None, "Two")]
    assert got[3]["items"][0].text == "open" and got[2].text == ""
    assert [len(r["items"]) for r in P.parsed(df.where("page_id = 1"), "[data-k*=b], #none").collect()] == [1]
    assert {r.link for r in P.links(P.parsed(df.where("page_id = 1"))).collect()} == {"https://site.com/n", "https://site.com/p/1?a=1&b=2", "https://other.com"}
    meta = df.where("page_id = 1").select(P.metadata("html").alias("m")).first().m
    assert (meta.title, meta.og_title, meta.json_ld) == ("A &amp; B", "OG", ['{"a":1}'])


def test_verdicts(spark):
    rows = [
        ("<p>ok</p>", "fine text", 200, "ok", None), ("", "Please solve the CAPTCHA", 200, "blocked", "bot/auth wall: captcha"), ("<i>cf_chl_opt</i>", "short", 200, "blocked", "anti-bot challenge: cf_chl_opt"),
        ("<i>cf_chl_opt</i>", "Bán căn hộ 60m2 giá 3 tỷ", 200, "ok", None), ("", "x", 403, "blocked", "HTTP 403"), ("", "x", 500, "error", "HTTP 500"), ("", "x", None, "ok", None), ("", "vui lòng xác minh", 500, "blocked", "bot/auth wall: vui lòng xác minh"),
    ]
    got = spark.createDataFrame(rows, "html string, text string, code int, kind string, reason string").select("kind", "reason", P.verdict("html", "text", "code").alias("v")).collect()
    assert [(r.v.kind, r.v.reason) for r in got] == [(r.kind, r.reason) for r in got]


def test_geocoding(spark):
    rows = [(1, None, "dự án Sky", "S1", "12", "Q7", None, "Q7, HCM", ["a", "long place"]), (2, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, name string, project_name string, building_name string, house_number string, address string, building_address string, project_address string, location_texts array<string>")
    found = G.geocode_candidates(df).orderBy("id", "pos").collect()
    assert [r.query for r in found][:4] == ["Sky S1 12, Quận 7, Vietnam", "S1 Sky, Quận 7, Vietnam", "Sky, Quận 7, Vietnam", "S1 Sky, Vietnam"] and len(found) == 8 and {r.id for r in found} == {1}
    cache = spark.createDataFrame([("Sky S1 12, Quận 7, Vietnam", None, None), ("Sky, Quận 7, Vietnam", 10.5, 106.5)], "query string, lat double, lng double")
    row = G.geocoded(G.geocode_candidates(df), cache).first()
    assert (row.id, row.lat, row.lng, row.address, row.misses) == (1, 10.5, 106.5, "Q7", 1)


def test_within_radius(spark):
    import random

    r = random.Random(3)
    pts = [(i, r.uniform(-80, 80) if i % 2 else r.uniform(10, 10.3), r.uniform(106, 106.3)) for i in range(250)]
    df = spark.createDataFrame(pts, "id int, lat double, lng double")
    every = df.select(F.col("id").alias("a"), F.col("lat").alias("y1"), F.col("lng").alias("x1")).join(df)
    want = {(x.a, x.id) for x in every.where(G.haversine_km(F.col("y1"), F.col("x1"), F.col("lat"), F.col("lng")) <= 5).collect()}
    assert {(x.left_id, x.right_id) for x in G.within(df, df, 5).collect()} == want


def test_operations(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    sent = spark.createDataFrame([("d", "n", t(1), t(1)), ("d", "n", t(2), t(3)), ("e", "n", t(1), dt.datetime(2024, 1, 1, 1))], "device_id string, nonce string, sent_at timestamp, received_at timestamp")
    assert sorted(r.verdict for r in O.replay_rejected(sent).collect()) == ["ok", "replay", "stale"]
    config = spark.createDataFrame([('{"max_pages": 99, "max_depth": -1, "include": ["a"]}',), ("broken",), (None,)], "c string").select(*(x.alias(k) for k, x in O.config_columns("c").items())).collect()
    assert [(r.max_pages, r.max_depth, r.max_chars, r["include"]) for r in config] == [(50, 0, 12_000, ["a"]), (10, 1, 12_000, []), (10, 1, 12_000, [])]


def test_frontier_and_changes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r.depth for r in P.frontier(edges, roots, 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    snaps = spark.createDataFrame([("u", 1, "x"), ("u", 2, "x"), ("u", 3, "y")], "url string, v int, t string")
    assert [r.changed for r in P.changes(snaps, "url", "v", "t").orderBy("v").collect()] == [None, False, True]


def test_sessions(spark):
    said = spark.createDataFrame([(1, 2, "user", "two"), (1, 1, "user", " one "), (1, 3, "assistant", "x"), (2, 1, "assistant", "y")], "session_id int, turn int, role string, text string")
    assert {r.session_id: r.transcript for r in I.transcript(said, "session_id", "turn", "role", "text", "|").collect()} == {1: "one|two", 2: ""}
    files = spark.createDataFrame([(1, 2, [("k2", "u2")]), (1, 1, [("k1", "u1"), ("", "u"), (None, "u")])], "session_id int, turn int, a array<struct<key:string,url:string>>")
    assert [x.key for x in I.attachments(files, "session_id", "turn", "a").first().attachments] == ["k1", "k2"]
    outcomes = spark.createDataFrame([(1, "created"), (1, "review"), (2, "rejected"), (3, "linked")], "s int, outcome string")
    assert {r.s: r.status for r in I.signal_status(outcomes, "s").collect()} == {1: "needs_review", 2: "ignored", 3: "extracted"}


def test_commit_and_curation(spark):
    draft = "session_id int, name string, project_name string, building_name string, house_number string, location_text string, type string, listing_type string, price_vnd bigint, price_basis string, area_m2 double, confidence double"
    drafts = spark.createDataFrame([(1, "A", None, None, None, None, "house", "sale", 1, "total", 1.0, 0.9), (2, "A", None, None, None, None, "house", "sale", None, "total", 1.0, 0.9)], draft)
    sessions = spark.createDataFrame([(1, "open"), (2, "open"), (3, "closed")], "session_id int, status string")
    said = spark.createDataFrame([(1, 1, "user", "hello")], "session_id int, turn int, role string, text string")
    got = I.committed(sessions, drafts, said).collect()
    assert [(r.session_id, r.source_ref, r.raw_text) for r in got] == [(1, "session:1", "hello")]
    ents = spark.createDataFrame([(1, ["Sky"], ["new"], "", None), (2, None, None, "kept", "old")], "id int, aliases array<string>, tags array<string>, address string, notes string")
    new = spark.createDataFrame([(1, ["sky", "Sky 2"], [], "addr", "seen"), (2, [], [], "other", None)], "id int, aliases array<string>, tags array<string>, address string, note string")
    out = {r.id: r for r in I.merged_curation(ents, new).collect()}
    assert (out[1].aliases, out[1].address, out[1].notes) == (["Sky", "Sky 2"], "addr", "Note: seen") and (out[2].address, out[2].notes) == ("kept", "old")


def test_facts_are_appended_by_month(spark, tmp_path):
    rows = [(1, "Bán căn 2PN 60m2 giá 3 tỷ", dt.datetime(2024, 5, 2)), (2, "hello", dt.datetime(2024, 5, 3))]
    found = I.facts(spark.createDataFrame(rows, "signal_id int, raw_text string, captured_at timestamp"))
    I.append_facts(found, str(tmp_path / "f"))
    row = spark.read.parquet(str(tmp_path / "f")).first()
    assert (row.price_per_m2, row.month) == (50_000_000, "2024-05")


def test_evaluation(spark):
    cols = "case_id string, id int, type string, listing_type string, price_vnd bigint, price_basis string, area_m2 double, bedrooms int, is_negotiable boolean, deal_status string, location_text string, location_contains string"
    one = lambda i, price, area: ("c", i, "apartment", "sale", price, "total", area, 2, False, "asking", "Quận 7, HCM", "quan 7" if i == 0 else None)
    expected = spark.createDataFrame([one(0, 1000, 50.0), one(1, 2000, 60.0)], cols)
    predicted = spark.createDataFrame([one(0, 2001, 60.4), one(1, 1004, 70.0), one(2, 5, 5.0)], cols)
    matched = V.align(predicted, expected)
    assert {(r.p_id, r.e_id) for r in matched.collect()} == {(1, 0), (0, 1)}
    acc = {r.field: (r.accuracy, r.n) for r in V.field_accuracy(predicted, expected, matched).collect()}
    assert acc["price"] == (1.0, 2) and acc["area"] == (0.5, 2) and acc["location"] == (1.0, 1)
    assert tuple(spark.range(1).select(*V.detection(0, 0, 0)).first()) == (1.0, 1.0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_hierarchy_search_reaches_every_property(spark):
    from pricetide.plans import catalog

    found = catalog.queries["R9_U1_hierarchy_search"](spark, "/root/testdata/sf0.001").collect()
    assert {r.entity_type for r in found} >= {"building", "property"}
    assert max(sum(r.ext_id == x for r in found) for x in {r.ext_id for r in found}) == 8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_frontier_and_pointers_go_over_whole_keys(spark):
    from pricetide.plans import catalog

    folder = "/root/testdata/sf0.001"
    part = {r[0] for r in spark.read.parquet(f"{folder}/lineitem.parquet").where("l_returnflag <> 'R' and l_partkey > 0").select("l_partkey").distinct().collect()}
    assert {r.id for r in catalog.queries["D10_undone_pointer_chase"](spark, folder).select("id").collect()} == part
    assert catalog.queries["E10_whole_link_frontier"](spark, folder).agg(F.max("url")).first()[0] > 997


def test_alignment_is_the_greedy_one(spark):
    import random

    r = random.Random(8)
    cols = "case_id string, id int, price_vnd bigint, area_m2 double, type string"
    side = lambda: [(f"c{c}", i, r.choice([None, 1000, 1004, 1010, 2000]), r.choice([None, 50.0, 50.4, 51.0]), r.choice(["a", "b", None])) for c in range(30) for i in range(r.choice([0, 1, 3, 9]))]
    predicted, expected = side(), side()
    price = lambda p, e: p is None if e is None else p is not None and abs(p - e) <= 0.005 * max(abs(e), 1)
    area = lambda p, e: p is None if e is None else p is not None and abs(p - e) <= 0.5
    want, taken = [], set()
    for c, e_id, *e in expected:
        left = [(-(2 * price(p[0], e[0]) + area(p[1], e[1]) + (p[2] == e[2])), p_id) for k, p_id, *p in predicted if k == c and (c, p_id) not in taken]
        if left:
            want.append((c, min(left)[1], e_id))
            taken.add((c, min(left)[1]))
    got = V.align(spark.createDataFrame(predicted, cols), spark.createDataFrame(expected, cols))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_numbers_of_a_large_group_are_gapless(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, 'hot') AS k", "CAST(id * 7919 % 3000 AS INT) AS v").unionByName(spark.range(5).selectExpr("'few' AS k", "CAST(1 AS INT) AS v"))
    got = K.numbered(rows, ["k"], "v").collect()
    for k, n in (("hot", 2000), (None, 1000), ("few", 5)):
        own = sorted((r.place, r.v) for r in got if r.k == k)
        assert [p for p, _ in own] == list(range(n)) and [v for _, v in own] == sorted(v for _, v in own)
    assert {r.batch for r in K.batches(rows.where("k = 'few'"), "k", 2, "v").collect()} == {0, 1, 2}
