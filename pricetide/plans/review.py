"""Queries on reviews, names, evidence, posts, messages and backfills."""

from pyspark.sql import functions as F

from pricetide.functions import text as T
from pricetide.operators import extract as X
from pricetide.operators import geo as G
from pricetide.operators import ingest as I
from pricetide.operators import resolve as R
from pricetide.plans.registry import query
from pricetide.plans.streams import _run, in_pieces
from pricetide.plans.text import NORM, RANKED, TOKENS, _resolution
from pricetide.session import stash_path
from pricetide.streaming import streams as S


def _null():
    return F.lit(None).cast("string")


@query("R15_R16_review_queue", f"""WITH {RANKED}, b AS (SELECT ext_id, count(*) AS n, min(property_id) FILTER (WHERE rank = 1) AS best FROM k WHERE rank <= 10 GROUP BY 1)
SELECT s_suppkey AS ext_id, source AS source_ref, sha256('Title: bán sky ' || lower(p_type) || ' ' || p_name || chr(10) || text) AS text_hash, p_name AS project_name,
  p_name || ' / Sky ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS label, coalesce(n, 0) AS candidates, best
FROM supplier JOIN part ON p_partkey = s_suppkey JOIN documents ON doc_id = s_suppkey LEFT JOIN b ON b.ext_id = s_suppkey WHERE s_acctbal < 5000""")  # fmt: skip
def review_queue(d):
    """Suppliers' extractions of small balance wait; the title of their signals names a building before the project."""
    ext, ent = _resolution(d)
    sup = d.table("supplier").join(d.properties(), F.col("s_suppkey") == F.col("property_id"))
    more = sup.select(F.col("s_suppkey").alias("ext_id"), F.col("s_suppkey").alias("signal_id"), (F.col("s_acctbal") < 5000).alias("needs_review"), F.col("s_acctbal").alias("created_at"))
    title = sup.select(F.col("s_suppkey").alias("signal_id"), F.concat(F.lit("Title: bán sky "), F.lower("property_type"), F.lit(" "), "name", F.lit("\n")).alias("title"))
    signals = d.signals().join(title, "signal_id").withColumn("raw_text", F.concat("title", "raw_text"))
    queue = R.review_queue(ext.join(more, "ext_id"), signals, ent)
    first = F.get("candidates", 0)["property_id"]
    return queue.select("ext_id", "source_ref", F.sha2("raw_text", 256).alias("text_hash"), "suggestion.project_name", "suggestion.label", F.size("candidates").cast("bigint").alias("candidates"), first.alias("best"))


@query("R16_F25_create_suggestions", "SELECT p_partkey AS property_id, p_name AS project, 'Sky ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS building, p_size::VARCHAR AS unit, p_name || ' / Sky ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' / ' || p_size AS label FROM part")
def suggestions(d):
    """The building stands before the project in the path of the reference."""
    p = d.properties()
    ref = F.concat(F.lit("https://site/a/ban-can-ho-sky-"), F.lower("property_type"), F.lit("-"), F.element_at(F.split("name", " "), -1), F.lit("-58m2.htm"))
    ext = p.select("property_id", F.concat(F.lit("dự án "), F.col("name")).alias("project_name"), _null().alias("name"), F.lit(" ").alias("building_name"), F.col("size").cast("int").cast("string").alias("house_number"), ref.alias("ref"))
    s = ext.select("property_id", R.create_suggestion(F.lit("no title"), F.col("ref")).alias("s"))
    return s.select("property_id", F.col("s.project_name").alias("project"), F.col("s.building_name").alias("building"), F.col("s.house_number").alias("unit"), "s.label")


@query("P22_canonical_candidates", f"WITH {RANKED} SELECT ext_id, property_id FROM h JOIN part ON p_partkey = property_id WHERE p_size <= 40")
def canonical(d):
    """Parts above a size count as merged into the first part; none of them may be a candidate."""
    ext, ent = _resolution(d)
    merged = ent.withColumn("canonical_id", F.when(F.col("area_m2") > 40, F.lit(0).cast("bigint")))
    return R.candidates(ext, merged)


@query("R7_get_or_create", f"SELECT min(p_name) AS name, {NORM.format('p_name')} AS name_normalized FROM part WHERE {NORM.format('p_name')} NOT IN (SELECT {NORM.format('p_name')} FROM part WHERE p_size < 3) GROUP BY 2")
def get_or_create(d):
    p = d.properties()
    known = p.where("size < 3").select("name", T.normalize_name("name").alias("name_normalized"))
    return R.get_or_create(p.select("name"), known).select("name", "name_normalized")


@query("R14_evidence_support", f"""WITH e AS (SELECT p_partkey AS ext_id, {TOKENS.format(NORM.format('p_name'))} AS t, unnest([p_name || ' ' || p_brand, p_brand || ' ' || p_type, string_split(p_name, ' ')[1] || ' x']) AS hay FROM part),
n AS (SELECT ext_id, count(*) FILTER (WHERE len(t) > 0 AND len(list_filter(t, lambda w: contains({NORM.format('hay')}, w))) >= 0.75 * len(t)) AS results FROM e GROUP BY 1) SELECT ext_id, results, results >= 1 AS supported FROM n""")  # fmt: skip
def evidence_support(d):
    p = d.properties()
    names = p.select(F.col("property_id").alias("ext_id"), "name")
    rows = p.select(F.col("property_id").alias("ext_id"), F.posexplode(F.array(F.struct(F.col("name").alias("a"), F.col("project").alias("b")), F.struct(F.col("project").alias("a"), F.col("property_type").alias("b")), F.struct(F.split("name", " ")[0].alias("a"), F.lit("x").alias("b")))).alias("i", "x"))
    evidence = rows.select("ext_id", F.col("x.a").alias("title"), F.lit("").alias("url"), F.col("x.b").alias("snippet"))
    return R.evidence_support(names, evidence, "name", 1)


@query("G2_geocoded", """WITH c AS (SELECT o_custkey AS id, o_orderkey AS pos, o_orderpriority AS query, o_orderstatus AS address FROM orders),
g AS (SELECT DISTINCT o_orderpriority AS query, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE length(o_orderpriority)::DOUBLE END AS lat FROM orders WHERE o_orderpriority <> '5-LOW'),
j AS (SELECT c.*, g.lat, g.query IS NOT NULL AS known FROM c LEFT JOIN g USING (query))
SELECT id, arg_min(lat, pos) FILTER (WHERE lat IS NOT NULL) AS lat, arg_min(address, pos) FILTER (WHERE lat IS NOT NULL) AS address, count(*) FILTER (WHERE known AND lat IS NULL) AS misses FROM j GROUP BY id""")  # fmt: skip
def geocoded(d):
    """Orders stand in for a place's candidate queries; one priority is a cached miss and one isn't cached."""
    found = d.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("query"), F.col("o_orderstatus").alias("address"))
    lat = F.when(F.col("query") != "1-URGENT", F.length("query").cast("double"))
    cache = found.select("query").distinct().where("query <> '5-LOW'").select("query", lat.alias("lat"), (lat * 2).alias("lng"))
    return G.geocoded(found, cache).select("id", "lat", "address", "misses")


@query("F22_bare_place_names", "SELECT p_partkey AS property_id, p_name || ' ' || p_type AS name FROM part")
def bare_names(d):
    return d.properties().select("property_id", T.strip_category(F.concat(F.lit("Khu Đô Thị "), F.col("name"), F.lit(" chung cu "), F.col("property_type"))).alias("name"))


@query("F23_R10_reasonable_names", """SELECT p_partkey AS property_id, CASE p_type WHEN 'ECONOMY' THEN p_name WHEN 'SMALL' THEN NULL WHEN 'PROMO' THEN NULL WHEN 'LARGE' THEN NULL ELSE p_brand END AS project,
  CASE WHEN p_type = 'ECONOMY' THEN 'block ' || p_size WHEN p_type IN ('SMALL', 'LARGE', 'PROMO') THEN 'S' || p_size ELSE 'T1' END AS building FROM part""")  # fmt: skip
def reasonable(d):
    """Names with an amount, words of an offer or a category alone are none; the display name helps where the fields don't."""
    p, kind = d.properties(), F.col("property_type")
    size = F.col("size").cast("int").cast("string")
    project = F.when(kind == "ECONOMY", F.concat(F.lit("dự án "), "name")).when(kind == "SMALL", F.concat(size, F.lit(" tỷ "), "name")).when(kind == "PROMO", F.concat(F.lit("for rent "), "name")).when(kind == "LARGE", F.lit("Tòa"))
    building = F.when(kind == "ECONOMY", F.concat(F.lit("block "), size)).when(kind.isin("SMALL", "LARGE", "PROMO"), F.concat(F.lit(" S"), size))
    shown = F.when(~kind.isin("ECONOMY", "SMALL", "PROMO", "LARGE"), F.concat("project", F.lit(" > T1")))
    return p.select("property_id", T.hierarchy_of(project, building, shown).alias("h")).select("property_id", "h.project", "h.building")


@query("F26_post_headers", "SELECT p_partkey AS property_id, p_name AS title, 'https://site/' || p_partkey AS url FROM part")
def headers(d):
    raw = F.concat(F.lit("seen today\nTITLE:  "), "name", F.lit("\nSource URL: https://site/"), F.col("property_id").cast("string"), F.lit(" (page)\n"), "project")
    return d.properties().select("property_id", T.title_line(raw).alias("title"), T.source_url_line(raw).alias("url"))


@query("F29_flat_structured_values", "SELECT s_suppkey AS id, s_name || ' ' || n_nationkey || ' ' || n_name || ' ' || s_suppkey || ' VND' AS told FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def structured(d):
    s = d.table("supplier").join(d.table("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    inner = F.struct(F.col("s_name").alias("name"), F.lit("dropped").alias("note"), F.struct(F.col("n_nationkey").alias("value")).alias("streetAddress"))
    value = F.to_json(F.struct(F.lit("VND").alias("priceCurrency"), F.col("s_suppkey").alias("price"), F.concat(F.lit("  "), "n_name").alias("addressRegion"), inner.alias("name"), F.array(F.lit("x")).alias("value")))
    return s.select(F.col("s_suppkey").alias("id"), T.flat_json(value).alias("told"))


@query("F34_described_posts", """SELECT p_partkey AS property_id, concat_ws(chr(10), 'Distilled public web listing for extraction.', 'Source URL: https://site/' || p_partkey, 'Title: ' || p_name, CASE WHEN p_type <> 'SMALL' THEN 'Property type: ' || p_type END,
  'Project: ' || p_brand, CASE WHEN p_size > 25 THEN 'Area: ' || p_size || ' m2' END, 'Additional explicit facts:', '- ' || p_name, 'Distillation confidence: 0.50') AS post FROM part""")  # fmt: skip
def described(d):
    said = {c: _null() for c in X.DESCRIBED.values()} | {"title": F.concat(F.lit(" "), "name"), "property_type": F.when(F.col("property_type") == "SMALL", "unknown").otherwise(F.col("property_type")), "listing_type": F.lit("unknown"), "project_name": F.col("project"), "area_text": F.when(F.col("size") > 25, F.concat(F.col("size").cast("int").cast("string"), F.lit(" m2")))}
    p = d.properties().select("property_id", F.col("name").alias("fact"), *(v.alias(k) for k, v in said.items()))
    ref = F.concat(F.lit("https://site/"), F.col("property_id").cast("string"))
    return p.select("property_id", X.described_post(ref, _null(), F.array("fact", F.lit(" ")), F.lit(0.5)).alias("post"))


def planted_text():
    """The listing of a document (doc_id, lang)."""
    n = F.col("doc_id")
    size = F.concat(F.lit(" "), (50 + n).cast("string"), F.lit("m2 giá "))
    ask = F.concat((1 + n).cast("string"), F.lit(",5 tỷ, thương lượng"))
    rent = F.concat(F.lit("Cho thuê chung cư 2pn"), size, (10 * (1 + n) + 5).cast("string"), F.lit(" triệu"))
    lang = F.col("lang")
    return F.when(lang == "en", F.concat(F.lit("Bán nhà phố"), size, ask)).when(lang == "de", F.concat(F.lit("Bán đất nền"), size, ask)).when(lang == "fr", rent).otherwise(F.concat(F.lit("Bán căn hộ 2 phòng ngủ"), size, ask))


@query("E5_F32_planted_listings", """SELECT doc_id, 0 AS item, CASE WHEN lang = 'en' THEN 'house' WHEN lang = 'de' THEN 'land' ELSE 'apartment' END AS type, CASE WHEN lang = 'fr' THEN 'rent' ELSE 'sale' END AS listing_type,
  (CASE WHEN lang = 'fr' THEN 1000000 ELSE 100000000 END * (10 * (1 + doc_id) + 5))::BIGINT AS price_vnd, 'total' AS price_basis, (50 + doc_id)::DOUBLE AS area_m2, CASE WHEN lang NOT IN ('en', 'de') THEN 2 END AS bedrooms, 0.82::DOUBLE AS confidence FROM documents""")  # fmt: skip
def planted(d):
    """A listing for every document, worded by its language."""
    found = X.extract_listings(d.table("documents").select("doc_id", planted_text().alias("text")))
    return found.select("doc_id", "item", "type", "listing_type", "price_vnd", "price_basis", "area_m2", "bedrooms", "confidence")


@query("E6_F18_F19_planted_facts", "SELECT doc_id, 'Distilled public web listing for extraction.' || chr(10) || 'Source URL: ' || source || chr(10) || 'Key explicit facts:' || chr(10) || '- bán ' || doc_id || ' căn' || chr(10) || '- pháp lý sổ hồng ' || source || chr(10) || 'Distillation confidence: 0.55' AS post FROM documents")
def planted_facts(d):
    """Fact lines with contacts, junk and repeats around them."""
    text = F.concat(F.lit("Trang chủ | menu\nbán "), F.col("doc_id").cast("string"), F.lit(" căn 0901 234 567\nLọc giá theo khu vực\nBÁN "), F.col("doc_id").cast("string"), F.lit(" CĂN\nhello there\npháp lý  sổ hồng "), "source", F.lit(" LH: mr. x\nabc"))
    return X.distilled_posts(d.table("documents").select("doc_id", text.alias("text"), "source"), "doc_id", "text", "source")


@query("U2_curation_drafts", "SELECT 'session' AS origin, n_name AS project_name, NULL AS building_name FROM nation UNION ALL SELECT 'hierarchy', n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def drafts(d):
    n = d.table("nation")
    session = n.select(F.col("n_name").alias("project_name"))
    derived = n.join(d.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("project_name"), F.col("r_name").alias("building_name"))
    return I.curation_drafts(session, derived).select("origin", "project_name", "building_name")


@query("S4_read_messages", "SELECT sha256(trim(text)) AS text_hash, 'broker' AS source_type, source AS source_ref, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY 1, 3")
def messages(d):
    """The documents written as JSON lines and read as messages."""
    path = stash_path(d.spark, "messages")
    d.table("documents").select(F.col("text").alias("raw_text"), F.concat(F.lit(" "), "source").alias("source_ref")).write.json(path)
    return I.read_messages(d.spark, path).groupBy(F.sha2("raw_text", 256).alias("text_hash"), "source_type", "source_ref").agg(F.count("*").alias("n"))


@query("S8_backfilled_buildings", "SELECT lower(p_brand) AS project, lower(p_name) AS name_normalized, min(p_name) AS name FROM part GROUP BY 1, 2")
def backfilled(d):
    old = d.properties().select(F.concat(F.col("project"), F.lit(" ")).alias("project_name"), F.col("name").alias("building_name"))
    return I.backfill(old)[1].select("project", "name_normalized", "name")


@query("T10_stream_new_signals", "SELECT DISTINCT source AS source_ref, sha256(trim(text)) AS content_hash FROM documents")
def stream_signals(d):
    """Documents in several micro-batches at one capture time: the state lets each key through once."""
    rows = d.table("documents").select(F.lit("web").alias("source_type"), F.col("source").alias("source_ref"), F.col("text").alias("raw_text"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("captured_at"))
    return _run(d, S.new_signals(in_pieces(rows, stash_path(d.spark, "signals"))), "append").select("source_ref", "content_hash")


@query("R6_created_rows", f"""SELECT sha256(concat_ws('|', {NORM.format("p_brand || ' / ' || p_type")}, 'apartment')) AS property_id, p_brand || ' / ' || p_type AS name, {NORM.format("p_brand || ' / ' || p_type")} AS name_normalized, p_brand AS project_name,
  p_type AS building_name, p_name || '|old ' || p_name AS aliases, 'dự án|' || lower(p_type) AS tags, count(*) AS n FROM part GROUP BY p_brand, p_type, p_name""")  # fmt: skip
def created_rows(d):
    """The rows that extractions create, with keys, aliases (without the row's own name) and tags."""
    p, none = d.properties(), _null()
    ext = p.select("name", F.concat(F.lit("dự án "), "project").alias("project_name"), F.col("property_type").alias("building_name"), none.alias("house_number"), none.alias("location_text"), F.array(F.concat(F.lit("old "), "name"), F.concat(F.col("project"), F.lit(" "), F.col("property_type"))).alias("aliases"), F.array(F.lower("property_type"), F.upper("property_type")).alias("tags"), F.lit("apartment").alias("type"), F.col("size").alias("area_m2"))
    made = R.created_entities(ext).withColumns({"aliases": F.array_join("aliases", "|"), "tags": F.array_join("tags", "|")})
    return made.groupBy("property_id", "name", "name_normalized", "project_name", "building_name", "aliases", "tags").agg(F.count("*").alias("n"))
