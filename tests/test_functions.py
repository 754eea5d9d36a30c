"""Expectations of text, URL and gate functions on small tables."""

import pytest
from pyspark.sql import functions as F

from pricetide.functions import gate as G
from pricetide.functions import text as T
from pricetide.functions import urls as U


def values(spark, inputs, make):
    """make(column) for each input, in order."""
    rows = [(i, x) for i, x in enumerate(inputs)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, x string").orderBy("i").select(make(F.col("x"))).collect()]


def test_normalized_names(spark):
    given = ["Thủ Thiêm", "Đường Nguyễn Huệ", "  A--B,  c!  ", "THỦ", "", None, "Ư ợ ẫ Ý", "3.2 tỷ/m²", "日本 x"]
    assert values(spark, given, T.normalize_name) == ["thu thiem", "duong nguyen hue", "a b c", "thu", "", None, "u o a y", "3 2 ty m", "x"]


def test_tokens_and_similarity(spark):
    assert values(spark, ["an phu thao dien", ""], T.tokens) == [["phu", "thao", "dien"], []]
    rows = [("Vinhomes Grand Park", "vinhomes grand park", 1.0), ("Masteri Thao Dien", "Masteri An Phu", 0.25), ("", "x", 0.0), (None, "x", 0.0), ("ab", "cd", 0.0)]
    got = spark.createDataFrame(rows, "a string, b string, s double").select("s", T.text_sim("a", "b").alias("t"), T.near_sim("a", "b").alias("n")).collect()
    assert all(r.s == pytest.approx(r.t) for r in got)
    near = spark.createDataFrame([("Grand Park", "Vinhomes Grand Park")], "a string, b string").select(T.near_sim("a", "b"), T.max_near_sim(F.array("a", F.lit("x")), F.array("b"))).first()
    assert tuple(near) == (0.86, 0.86)
    best = spark.range(1).select(T.max_text_sim(F.lit("sky garden"), F.array(F.lit("sky"), F.lit("Sky Garden"), F.lit(None))), T.max_text_sim(F.lit("a"), F.array().cast("array<string>"))).first()
    assert tuple(best) == (1.0, 0.0)


def test_category_prefixes(spark):
    got = values(spark, ["nhà phố ABC", "Nhà Phố ABC", "SHOPHOUSE  Khối đế", "Ecopark", "  ", None, "villa", "dự án du an X"], T.split_name_tags)
    assert [(r["name"], r["tags"]) for r in got] == [("ABC", ["nhà phố"]), ("ABC", ["nhà phố"]), ("Khối đế", ["shophouse"]), ("Ecopark", []), (None, []), (None, []), ("villa", []), ("du an X", ["dự án"])]


def test_keep_first(spark):
    df = spark.range(1).select(T.unique_text(F.array(*map(F.lit, ["Căn A", " can a ", None, "", "B", "b!"]))), T.unique_lower(F.array(*map(F.lit, ["Căn A", "can a", " CĂN A"]))))
    assert tuple(df.first()) == (["Căn A", "B"], ["Căn A", "can a"])


def test_labels(spark):
    none = F.lit(None).cast("string")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.display_name(F.lit("dự án Sky"), F.lit("S1"), F.lit("s1"), none, none)) == "Sky / S1"
    assert one(T.display_name(none, none, none, F.lit("Căn 1"), F.lit(" Q7 "))) == "Q7"
    assert one(T.display_name(none, none, none, F.lit("Căn 1"), none)) == "Căn 1"
    assert one(T.identity_label(F.lit(""), none, F.lit("12"), F.lit("n"), none)) == "12"
    assert one(T.identity_label(none, none, none, none, none)) == "(unnamed)"
    assert one(T.area_label(none, F.lit("12 Street, Ward 3 , District 7, City"))) == "District 7"
    assert one(T.area_label(F.lit(" "), F.lit("City"))) == "City"
    assert one(T.area_label(none, F.lit(" , "))) is None


def test_address_shorthand(spark):
    got = values(spark, ["Q7", "P.3, Q.10", "District 2/abc", "Q9 | x", "Quận 9"], T.expand_address)
    assert got == ["Quận 7", "Phường 3, Quận 10", "Quận 2 abc", "Thành phố Thủ Đức, Thành phố Hồ Chí Minh x", "Thành phố Thủ Đức, Thành phố Hồ Chí Minh"]
    assert values(spark, ["Chung cư Sky", "Sky dự án Park", "dự án ", None], T.strip_category) == ["Sky", "Sky Park", "dự án", None]


def test_names_from_display_names(spark):
    got = values(spark, ["Sky / S1 / 12", "Sky > S1", "Sky", "2 tỷ / S1"], T.hierarchy_from_name)
    assert [tuple(r) for r in got] == [("Sky", "S1"), ("Sky", "S1"), (None, None), (None, "S1")]
    assert values(spark, ["Sky Park", "giá 3 tỷ", "chung cư", "x" * 90, "77", "Tower", "Sky Tower", "for sale", "3,5 tr", "tr 5", "Thuê", " "], T.reasonable_name) == ["Sky Park", None, None, None, "77", None, "Sky Tower", None, "3,5 tr", "tr 5", "Thuê", None]


def test_flat_json_and_field_lines(spark):
    rows = ['{"name":" A  b ","price":12.5,"x":{"name":"no"}}', '{"name":{"name":"in","value":7},"priceCurrency":"VND"}', '["a"]', '"', "plain  text", "{}", "", '{"name":[1],"value":""}', None]
    assert values(spark, rows, lambda x: T.flat_json(F.col(x) if isinstance(x, str) else x)) == ["A b 12.5", "in 7 VND", None, '"', "plain text", None, None, None, None]
    assert values(spark, ["v ", " ", None], lambda x: T.field_lines({"A": F.col(x) if isinstance(x, str) else x, "B": F.lit("b")})) == ["A: v\nB: b", "B: b", "B: b"]


def test_building_inference(spark):
    rows = [
        ("Ecopark", "Title: Bán căn hộ Park Premium Ecopark giá tốt", None, "Park Premium"),
        ("Ecopark", "x", "https://site.vn/ban-can-ho-2-park-premium-ecopark-58m2.htm", "Park Premium"),
        ("Ecopark", "x\nSource URL: https://site.vn/a/sky-oasis-ecopark", None, "Sky Oasis"),
        ("Ecopark", "Title: bán Ecopark", None, None),
        (None, "Title: a b c", None, None),
    ]
    got = spark.createDataFrame(rows, "p string, raw string, ref string, want string").select("want", T.infer_building("p", "raw", "ref").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in rows and got]


def test_urls(spark):
    assert values(spark, ["https://A.com/x/?b=2&a=1#t", "http://a.com", "http://a.com/?z=1", "mailto:x", None], U.canonical_url) == ["https://a.com/x?a=1&b=2", "http://a.com", "http://a.com?z=1", None, None]
    assert values(spark, ["https://www.A.com/x", "nope", None], U.host_label) == ["a.com", None, None]
    assert values(spark, ["https://www.a.com:80/x", "WWW.b.vn/path", " c.d "], U.normalize_host) == ["a.com", "b.vn", "c.d"]
    allowed = lambda x: U.allowed(x, F.array(F.lit("a.com")))
    assert values(spark, ["https://a.com/1", "https://m.a.com", "https://ba.com", None], allowed) == [True, True, False, False]
    assert spark.range(1).select(U.allowed(F.lit("x"), F.array().cast("array<string>"))).first()[0] is True
    kind = lambda x: U.web_ref(F.lit("web"), x)
    assert values(spark, ["https://a.com", "ftp://a.com", "note", None], kind) == ["https://a.com", None, None, None]


def test_signal_refs(spark):
    rows = [("web", "https://a/1", "https://p", "t"), ("web", "card 7", "https://p", "t"), ("chat", "m1", None, "t"), ("web", "card", None, "t")]
    got = spark.createDataFrame(rows, "k string, r string, p string, c string").select(U.signal_ref("k", "r", "p", "c").alias("x")).collect()
    hashed = "e3b98a4da31a127d4bde6e43033f66ba274cab0eb7eb1c70ec41402bf6273dd8"[:12]
    assert [r.x for r in got] == ["https://a/1", f"https://p#item={hashed}", "m1", "card"]


GATE = "name string, project_name string, building_name string, house_number string, location_text string, type string, listing_type string, price_vnd bigint, price_basis string, area_m2 double, confidence double"
FULL = dict(name="A", project_name=None, building_name=None, house_number=None, location_text=None, type="house", listing_type="sale", price_vnd=3_000_000_000, price_basis="total", area_m2=60.0, confidence=0.9)


@pytest.mark.parametrize(
    "change,reason",
    [
        ({}, None),
        ({"confidence": 0.39}, "confidence too low (0.39 < 0.4)"),
        ({"name": ""}, "lacks identity or location"),
        ({"listing_type": "unknown"}, "unknown listing type (neither sale nor rent)"),
        ({"price_vnd": None, "area_m2": None}, "lacks both price and area"),
        ({"price_vnd": None}, "sale listing lacks price"),
        ({"price_vnd": None, "listing_type": "rent"}, None),
        ({"name": None, "house_number": "1"}, "lacks identity or location"),
    ],
)
def test_rejections(spark, change, reason):
    row = FULL | change
    got = spark.createDataFrame([tuple(row.values())], GATE).select(G.rejection_reason().alias("r"), G.is_usable().alias("u")).first()
    assert (got.r, got.u) == (reason, reason is None)


def test_gate_columns(spark):
    rows = [FULL, FULL | {"price_basis": "per_m2"}, FULL | {"area_m2": 0.0}, FULL | {"type": "apartment", "project_name": "Sky"}, FULL | {"confidence": 0.5}, FULL | {"price_vnd": None, "name": None}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], GATE)
    got = df.select(G.price_per_m2().alias("p"), G.should_review().alias("r"), G.missing_fields().alias("m"), G.incomplete_line(F.lit(0)).alias("l"), G.is_complete().alias("c")).collect()
    assert [r.p for r in got] == [50_000_000, 3_000_000_000, None, 50_000_000, 50_000_000, None]
    assert [r.r for r in got] == [False, False, False, True, True, True]
    assert got[0].c and got[5].m == ["price", "project/property identity or location"]
    assert got[5].l == "#1 (unnamed): needs price, project/property identity or location"


def test_flat_json_of_any_depth(spark):
    deep = '{"name":' * 10 + '{"value":7.0,"name":"in"}' + "}" * 10
    very = '{"name":' * 400 + '"x"' + "}" * 400
    rows = [deep, very, '{"name":NaN}', '{"price":1e999}', '{"price":true,"value":1.5}', "{broken"]
    assert values(spark, rows, lambda x: T.flat_json(F.col(x) if isinstance(x, str) else x)) == ["in 7", "x", None, "inf", "1.5", None]
