"""Queries on text functions, URLs, pages, distillation and resolution."""

from pyspark.sql import functions as F

from pricetide.functions import text as T
from pricetide.functions import urls as U
from pricetide.operators import dedup as K
from pricetide.operators import extract as X
from pricetide.operators import page_items as I
from pricetide.operators import pages as P
from pricetide.operators import blocking as B
from pricetide.operators import resolve as R
from pricetide.plans.registry import query

NORM = "trim(regexp_replace(lower(replace(replace(strip_accents({0}), 'Đ', 'D'), 'đ', 'd')), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = "list_filter(string_split({0}, ' '), lambda x: length(x) >= 3)"


@query("F1_F2_normalized_text", f"WITH n AS (SELECT doc_id, {NORM.format('text')} AS s FROM documents) SELECT doc_id, sha256(s) AS hash, len({TOKENS.format('s')}) AS n_tokens FROM n")
def normalized(d):
    n = d.table("documents").select("doc_id", T.normalize_name("text").alias("s"))
    return n.select("doc_id", F.sha2("s", 256).alias("hash"), F.size(T.tokens("s")).cast("bigint").alias("n_tokens"))


@query("F3_F5_U3_text_similarity", f"""WITH n AS (SELECT doc_id, {NORM.format('text')} AS s FROM documents), t AS (SELECT doc_id, s, list_distinct({TOKENS.format('s')}) AS t FROM n)
SELECT a.doc_id, round(CASE WHEN a.s = '' OR b.s = '' THEN 0.0 WHEN a.s = b.s THEN 1.0 WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) END::DOUBLE, 6) AS sim FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")  # fmt: skip
def similarity(d):
    a = d.table("documents").select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.text_sim("text", "other"), 6).alias("sim"))


@query("F12_F33_E8_hashes", "SELECT doc_id, sha256(text) AS text_hash, sha256(trim(text)) AS content_hash, strlen(text) AS n_bytes, length(text) AS n_chars FROM documents")
def hashes(d):
    return d.table("documents").select("doc_id", U.sha256("text").alias("text_hash"), U.content_hash("text").alias("content_hash"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.length("text").cast("bigint").alias("n_chars"))


HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query("F14_canonical_urls", f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {HOST} AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS q FROM pages)
SELECT page_id, scheme || '://' || host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM p""")  # fmt: skip
def canonical(d):
    return d.table("pages").select("page_id", U.canonical_url("url").alias("url"))


@query("F16_P29_P30_hosts", f"SELECT page_id, regexp_replace({HOST}, '^www[.]', '') AS label, regexp_replace({HOST}, '^www[.]', '') AS host, url AS ref FROM pages")
def hosts(d):
    return d.table("pages").select("page_id", U.host_label("url").alias("label"), U.normalize_host("url").alias("host"), U.web_ref(F.lit("web"), "url").alias("ref"))


@query("P24_url_allowlist", f"SELECT page_id, {HOST} = 'example.com' OR {HOST} LIKE '%.example.com' OR {HOST} LIKE '%.example.org' AS allowed FROM pages")
def allowlist(d):
    domains = F.array(F.lit("example.com"), F.lit("example.org"))
    return d.table("pages").select("page_id", U.allowed("url", domains).alias("allowed"))


@query("P25_P35_url_patterns", "SELECT page_id, regexp_matches(url, '/(en|de)/') AND NOT regexp_matches(url, 'utm_source|#top') AS passes FROM pages")
def patterns(d):
    from pricetide.operators.ops import config_columns, url_passes

    told = F.lit('{"max_pages": 900, "include": ["/(en|de)/"], "exclude": ["utm_source", "#top"]}')
    c = d.table("pages").withColumn("config", told).withColumns(config_columns("config"))
    return c.select("page_id", url_passes(F.col("url"), F.col("include"), F.col("exclude")).alias("passes"))


WALLS = " ".join(f"WHEN contains(lower(html), '{w}') THEN 'blocked'" for w in P.WALL_TEXTS)


@query("P27_P28_page_verdicts", f"SELECT page_id, CASE {WALLS} WHEN page_id % 50 IN (1, 3) THEN 'blocked' WHEN page_id % 50 >= 40 THEN 'error' ELSE 'ok' END AS kind FROM pages")
def verdicts(d):
    m = F.col("page_id") % 50
    code = F.when(m == 1, 401).when(m == 3, 403).when(m >= 40, 500).otherwise(200)
    return d.table("pages").withColumn("code", code).select("page_id", P.verdict("html", "html", "code")["kind"].alias("kind"))


@query("E2_page_metadata", "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages")
def metadata(d):
    return d.table("pages").select("page_id", P.metadata("html")["title"].alias("title"))


@query("E1_E3_page_text")
def page_text(d):
    found = P.parsed(d.table("pages"), "article, li", "a")
    return found.select("page_id", "title", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"), F.size("items").alias("n_items"), F.size("links").alias("n_links"))


@query("E4_page_links")
def page_links(d):
    return P.links(P.parsed(d.table("pages")))


@query("E1_E3_items_by_source", """WITH p AS (SELECT page_id, url, html, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS lang FROM pages),
t AS (SELECT page_id, lang, regexp_replace(regexp_replace(url, '/+$', ''), '#.*', '') AS page, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g')), '&lt;?', '<', 'g'), '&#x27;', ''''), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS head FROM p)
SELECT page_id, 1 AS place, CASE WHEN lang IN ('en', 'de') THEN page || '#item-1' ELSE page END AS ref, CASE WHEN lang = 'de' THEN left(head, 20) ELSE head END AS text FROM t WHERE head <> ''""")  # fmt: skip
def items_by_source(d):
    """Headlines of pages as their sources' selectors tell: English and German ones by item, with a bound for German ones, the others by page."""
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)", 1)
    by = {"en": ("article", None, "h1", ".ad", None), "de": ("body article", "a.more[href]", "h1", None, 20)}
    none = (None, None, "article h1", "p", None)
    column = lambda i: F.when(lang == "en", F.lit(by["en"][i])).when(lang == "de", F.lit(by["de"][i])).otherwise(F.lit(none[i]))
    return I.page_items(d.table("pages").withColumns({c: column(i) for i, c in enumerate(I.CONFIG)}))


@query("E4_links_by_selector", """WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1))) AS href FROM pages)
SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_replace(href, '/+$', '') AS link FROM l WHERE href <> ''""")  # fmt: skip
def links_by_selector(d):
    return I.page_links(d.table("pages").withColumn("link_selector", F.lit("nav a"))).select("page_id", "link")


@query("E9_changed_texts", "SELECT doc_id, source, sha256(text) <> lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS changed FROM documents")
def changed(d):
    return P.changes(d.table("documents"), "source", "doc_id", "text").select("doc_id", "source", "changed")


EDGES = "e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem)"


@query("E10_link_frontier", f"WITH RECURSIVE {EDGES}, r(url, depth) AS (SELECT min(l_orderkey)::BIGINT, 0 FROM lineitem UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 4) SELECT url, min(depth) AS depth FROM r GROUP BY url")
def frontier(d):
    items = d.table("lineitem")
    pairs = F.inline(F.array(F.struct(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), F.struct(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))))
    return P.frontier(items.select(pairs).distinct(), items.agg(F.min("l_orderkey").cast("bigint").alias("url")), 4)


ALL_EDGES = "e AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders)"


@query("E10_whole_link_frontier", f"WITH RECURSIVE {ALL_EDGES}, r(url, depth) AS (SELECT min(o_custkey)::BIGINT, 0 FROM orders UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 4) SELECT url, min(depth) AS depth FROM r GROUP BY url")
def whole_frontier(d):
    o = d.table("orders")
    edges = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).distinct()
    return P.frontier(edges, o.agg(F.min("o_custkey").cast("bigint").alias("url")), 4)


@query("E11_minimum_yield", "SELECT source, count(*) AS items, count(*) < 50 AS failed FROM documents GROUP BY source")
def minimum(d):
    return P.minimum_yield(d.table("documents"), "source", 50)


@query("E5_F32_listings")
def listings(d):
    found = X.extract_listings(d.table("documents").select("doc_id", "text"))
    return found.select("doc_id", "item", "type", "listing_type", "price_vnd", "price_basis", "area_m2", "bedrooms", "confidence")


@query("E6_F18_F19_distilled")
def distilled(d):
    return X.distilled_posts(d.table("documents"), "doc_id", "text", "source")


@query("F17_clean_lines", "SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS hash FROM documents")
def clean_lines(d):
    return d.table("documents").select("doc_id", F.sha2(T.clean_lines("text"), 256).alias("hash"))


@query("W6_W7_X6_keep_first_arrays", f"WITH n AS (SELECT p_brand, p_name, {NORM.format('p_name')} AS k, p_partkey FROM part), f AS (SELECT p_brand, k, arg_min(p_name, p_partkey) AS v, min(p_partkey) AS o FROM n GROUP BY 1, 2) SELECT p_brand AS project, array_to_string(list(v ORDER BY o), ',') AS names FROM f GROUP BY 1")
def keep_first(d):
    return K.keep_first_names(d.properties(), "project", "name", "property_id").select("project", F.array_join("names", ",").alias("names"))


@query("W8_W9_keep_first_rows", f"WITH n AS (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand, {NORM.format('p_name')} ORDER BY p_partkey) AS k FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS j FROM n WHERE k = 1) SELECT p_partkey AS property_id, p_brand AS project FROM r WHERE j <= 5")
def keep_rows(d):
    once = K.first_by(d.properties().withColumn("k", T.normalize_name("name")), ["project", "k"], "property_id")
    return K.first_by(once, ["project"], "property_id", k=5).select("property_id", "project")


@query("J11_J12_R7_grounded_parents", f"WITH k AS (SELECT DISTINCT {NORM.format('p_brand')} AS n FROM part WHERE p_type = 'PROMO') SELECT p_partkey AS property_id, {NORM.format('p_name')} IN (SELECT {NORM.format('p_name')} FROM part WHERE p_type = 'PROMO') AS grounded FROM part")
def grounded(d):
    p = d.properties()
    known = p.where("property_type = 'PROMO'").select(T.normalize_name("name").alias("key")).distinct().withColumn("grounded", F.lit(True))
    return p.withColumn("key", T.normalize_name("name")).join(known, "key", "left").select("property_id", F.coalesce("grounded", F.lit(False)).alias("grounded"))


def _resolution(d):
    """Extractions: suppliers that name a part; entities: the parts."""
    none, names = F.lit(None).cast("string"), F.array().cast("array<string>")
    p = d.properties()
    kind = F.when(F.col("property_type") == "SMALL", "house").otherwise("apartment")
    flat = {"project_name": none, "building_name": none, "house_number": none, "aliases": names}
    ext = d.table("supplier").join(p, F.col("s_suppkey") == F.col("property_id")).select(F.col("s_suppkey").alias("ext_id"), "name", kind.alias("type"), (F.col("size") * 1.05).alias("area_m2"), F.concat(F.lit("sector "), F.split("name", " ")[0]).alias("location_text")).withColumns(flat)
    ent = p.select("property_id", "name", kind.alias("type"), F.col("size").alias("area_m2"), none.alias("wiki_notes")).withColumns(flat)
    return ext, ent


RANKED = f"""x AS (SELECT s_suppkey AS ext_id, {NORM.format('p_name')} AS n, CASE WHEN p_type = 'SMALL' THEN 'house' ELSE 'apartment' END AS type, p_size * 1.05::DOUBLE AS area FROM supplier JOIN part ON p_partkey = s_suppkey),
c AS (SELECT p_partkey AS property_id, {NORM.format('p_name')} AS n, CASE WHEN p_type = 'SMALL' THEN 'house' ELSE 'apartment' END AS type, p_size::DOUBLE AS area FROM part),
t AS (SELECT ext_id, unnest(list_distinct(list_concat({TOKENS.format('n')}, ['sector']))) AS token FROM x), h AS (SELECT DISTINCT ext_id, property_id FROM t JOIN c ON contains(c.n, token)),
s AS (SELECT h.ext_id, h.property_id, round(0.72::DOUBLE * CASE WHEN x.n = c.n THEN 1.0 ELSE len(list_intersect({TOKENS.format('x.n')}, {TOKENS.format('c.n')}))::DOUBLE / len(list_distinct(list_concat({TOKENS.format('x.n')}, {TOKENS.format('c.n')}))) END::DOUBLE
  + 0.1::DOUBLE * (x.type = c.type)::INTEGER + 0.1::DOUBLE * (c.area > 0 AND abs(x.area - c.area) / c.area <= 0.1::DOUBLE)::INTEGER, 12) AS score FROM h JOIN x USING (ext_id) JOIN c USING (property_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY score DESC, property_id) AS rank FROM s WHERE score > 0)"""


@query("R1_R2_J14_P21_candidates", f"WITH {RANKED} SELECT ext_id, property_id FROM h")
def candidates(d):
    return R.candidates(*_resolution(d))


@query("R3_R4_W5_ranked_candidates", f"WITH {RANKED} SELECT ext_id, property_id, round(score, 9) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 10")
def ranked(d):
    return R.ranked_candidates(*_resolution(d)).withColumn("score", F.round("score", 9))


@query("R5_resolutions", f"WITH {RANKED} SELECT x.ext_id, CASE WHEN score >= 0.8 THEN 'link' WHEN score >= 0.45 THEN 'review' ELSE 'create' END AS action, CASE WHEN score >= 0.8 THEN property_id END AS property_id, round(score, 9) AS best FROM x LEFT JOIN (SELECT * FROM k WHERE rank = 1) b USING (ext_id)")
def resolutions(d):
    return R.resolve(*_resolution(d)).withColumn("best", F.round("best", 9))


@query("R9_U1_entity_search", f"""WITH t AS (SELECT s_suppkey AS ext_id, unnest(list_distinct({TOKENS.format("lower(c_mktsegment)")})) AS token FROM supplier JOIN customer ON c_custkey = s_suppkey),
h AS (SELECT DISTINCT ext_id, 0 AS place, 'project' AS entity_type, c_mktsegment AS id, c_mktsegment AS name FROM t JOIN (SELECT DISTINCT c_mktsegment FROM customer) ON contains(lower(c_mktsegment), token)
  UNION ALL SELECT DISTINCT ext_id, 1, 'building', o_orderpriority, o_orderpriority FROM t JOIN (SELECT DISTINCT o_orderpriority FROM orders) ON contains({NORM.format('o_orderpriority')}, token)),
r AS (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY place, name, id) AS k FROM h) SELECT ext_id, entity_type, id, name FROM r WHERE k <= 8""")  # fmt: skip
def entity_search(d):
    c = d.table("customer")
    wanted = d.table("supplier").join(c, F.col("c_custkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("ext_id"), F.explode(F.array_distinct(T.tokens(F.lower("c_mktsegment")))).alias("token"))
    named = lambda df, x: df.select(F.col(x).alias("id"), F.col(x).alias("name")).distinct()
    projects, buildings = named(c, "c_mktsegment"), named(d.table("orders"), "o_orderpriority")
    return R.search_entities(wanted, projects, buildings, buildings.where("false"))


@query("R9_U1_hierarchy_search", f"""WITH t AS (SELECT s_suppkey AS ext_id, unnest(list_distinct({TOKENS.format(NORM.format("concat_ws(' ', p_name, p_type)"))})) AS token FROM supplier JOIN part ON p_partkey = s_suppkey),
h AS (SELECT DISTINCT ext_id, 0 AS place, 'project' AS entity_type, p_brand AS id, p_brand AS name FROM t JOIN (SELECT DISTINCT p_brand FROM part) ON contains({NORM.format('p_brand')}, token)
  UNION ALL SELECT DISTINCT ext_id, 1, 'building', p_type, p_type FROM t JOIN (SELECT DISTINCT p_type FROM part) ON contains({NORM.format('p_type')}, token)
  UNION ALL SELECT DISTINCT ext_id, 2, 'property', p_partkey::VARCHAR, p_name FROM t JOIN part ON contains({NORM.format('p_name')}, token)),
r AS (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY place, name, id) AS k FROM h) SELECT ext_id, entity_type, id, name FROM r WHERE k <= 8""")  # fmt: skip
def hierarchy_search(d):
    p = d.properties()
    wanted = d.table("supplier").join(p, F.col("s_suppkey") == F.col("property_id")).select(F.col("s_suppkey").alias("ext_id"), F.explode(F.array_distinct(T.tokens(T.normalize_name(F.concat_ws(" ", "name", "property_type"))))).alias("token"))
    named = lambda x: p.select(F.col(x).alias("id"), F.col(x).alias("name")).distinct()
    return R.search_entities(wanted, named("project"), named("property_type"), p.select(F.col("property_id").alias("id"), "name"))


@query("R11_R12_W13_chosen_hierarchy", """WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT a.p_name AS ext, b.p_name AS name, CASE WHEN a.p_name = b.p_name THEN 1.0 WHEN contains(a.p_name, b.p_name) OR contains(b.p_name, a.p_name) THEN 0.86
  ELSE len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))) END AS score FROM n a, n b)
SELECT ext AS ext_id, name AS project_name, round(score::DOUBLE, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY score DESC, name) AS k, lead(score) OVER (PARTITION BY ext ORDER BY score DESC, name) AS nxt FROM s) WHERE k = 1 AND score >= 0.72 AND (nxt IS NULL OR score - nxt >= 0.12)""")  # fmt: skip
def hierarchy(d):
    n, none = d.properties().select("name").distinct(), F.lit(None).cast("string")
    wanted = n.select(F.col("name").alias("ext_id"), F.col("name").alias("project"), none.alias("building"))
    word = F.explode(F.split("name", " ")).alias("word")
    near = n.select("name", word).join(n.select(F.col("name").alias("project_name"), word), "word").select(F.col("name").alias("ext_id"), "project_name").distinct().withColumn("building_name", none)
    return R.choose_hierarchy(wanted, near).select("ext_id", "project_name", F.round("score", 9).alias("score"))


@query("G1_F20_F21_geocode_candidates", """WITH p AS (SELECT p_partkey AS id, p_brand || ' ' || p_type || ' ' || p_partkey AS w, p_type || ' ' || p_brand AS t, p_brand AS b, 'Q7, ' || p_name AS a, ', Quận 7, ' || p_name AS far, CASE WHEN length(p_name) > length(p_type) THEN p_name ELSE p_type END AS s FROM part)
SELECT id, pos, part.q || ', Vietnam' AS query, part.a AS address FROM (SELECT id, unnest(range(8))::INTEGER AS pos, unnest([{'q': w || far, 'a': a}, {'q': t || far, 'a': a}, {'q': b || far, 'a': a}, {'q': t, 'a': NULL}, {'q': w, 'a': NULL}, {'q': b, 'a': NULL}, {'q': w || ', ' || b, 'a': b}, {'q': w || ', ' || s, 'a': s}]) AS part FROM p)""")  # fmt: skip
def geocode(d):
    from pricetide.operators.geo import geocode_candidates

    none = F.lit(None).cast("string")
    p = d.properties().select(F.col("property_id").alias("id"), "name", F.col("project").alias("project_name"), F.col("property_type").alias("building_name"), F.col("property_id").cast("string").alias("house_number"), F.concat(F.lit("Q7, "), "name").alias("address"), none.alias("building_address"), F.col("project").alias("project_address"), F.array("property_type", "name").alias("location_texts"))
    return geocode_candidates(p)


@query("D8_G_within_radius", """WITH p AS (SELECT p_partkey AS id, 20 + (p_partkey * 7919 % 1000) / 1000.0::DOUBLE AS lat, 100 + (p_partkey * 104729 % 1000) / 1000.0::DOUBLE AS lng FROM part),
k AS (SELECT a.id AS left_id, b.id AS right_id, 2 * 6371.0088::DOUBLE * asin(sqrt(least(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lng - a.lng) / 2) ** 2, 1.0))) AS km FROM p a, p b)
SELECT left_id, right_id, round(km, 6) AS km FROM k WHERE km <= 2""")  # fmt: skip
def radius(d):
    from pricetide.operators.geo import within

    k = F.col("property_id")
    p = d.properties().select(k.alias("id"), (20 + (k * 7919 % 1000) / F.lit(1000.0)).alias("lat"), (100 + (k * 104729 % 1000) / F.lit(1000.0)).alias("lng"))
    return within(p, p, 2, 6)


DIMS, ALIKE = 64, 0.8


def _sides(column: str) -> str:
    """The vector blocks of a column as SQL: a list of tables' sides, from the same seed."""
    from pricetide.operators.blocking import planes

    bit = lambda plane, i: f"(list_dot_product({column}, {plane.tolist()}::DOUBLE[]) >= 0)::INTEGER * {1 << i}"
    return f"[{', '.join(' + '.join(bit(p, i) for i, p in enumerate(table)) for table in planes(DIMS))}]"


VECTORS = f"v AS MATERIALIZED (SELECT *, {_sides('x')} AS sides FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))"
COSINE = "list_dot_product({0}.x, {1}.x) / sqrt(list_dot_product({0}.x, {0}.x)) / sqrt(list_dot_product({1}.x, {1}.x))"


@query("D9_similar_vectors", f"""WITH {VECTORS}, s AS (SELECT vec_id, generate_subscripts(sides, 1) AS t, unnest(sides) AS side FROM v),
p AS (SELECT DISTINCT a.vec_id AS id, b.vec_id AS other FROM s a JOIN s b ON a.t = b.t AND a.side = b.side AND a.vec_id < b.vec_id)
SELECT id, other, round({COSINE.format("a", "b")}, 6) AS cosine FROM p JOIN v a ON a.vec_id = id JOIN v b ON b.vec_id = other WHERE {COSINE.format("a", "b")} >= {ALIKE}::DOUBLE""")  # fmt: skip
def similar_vectors(d):
    """Pairs of vectors of high cosine among those that share a block of hyperplane sides."""
    e = d.table("embeddings").select("vec_id", "embedding")
    return B.similar_pairs(e, "vec_id", "embedding", DIMS, ALIKE).withColumn("cosine", F.round("cosine", 6))


PLACE = "20 + ({0} * 7919 % 1000) / 1000.0::DOUBLE AS lat, 100 + ({0} * 104729 % 1000) / 1000.0::DOUBLE AS lng"
KM = "2 * 6371.0088::DOUBLE * asin(sqrt(least(sin(radians(c.lat - x.lat) / 2) ** 2 + cos(radians(x.lat)) * cos(radians(c.lat)) * sin(radians(c.lng - x.lng) / 2) ** 2, 1.0)))"
WARD_PAIRS = 300


def _placed(d):
    """Extractions and entities with brands as wards, places made of their keys, and vectors; suppliers stand a little off."""
    ext, ent = _resolution(d)
    brand = d.properties().select("property_id", F.col("project").alias("ward"))
    spot = lambda k: {"lat": 20 + (k * 7919 % 1000) / F.lit(1000.0), "lng": 100 + (k * 104729 % 1000) / F.lit(1000.0)}
    vector = d.table("embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"))
    placed = []
    for df, key, shift in ((ext, "ext_id", 1), (ent, "property_id", 0)):
        k = F.col(key)
        with_ward = df.join(brand.withColumnRenamed("property_id", key) if key != "property_id" else brand, key)
        placed.append(with_ward.withColumns(spot(k + shift)).join(vector, k + shift == F.col("_id"), "left").drop("_id"))
    return placed


@query("D8_D9_composite_scores", f"""WITH {RANKED.split("k AS (")[0].rstrip().rstrip(",")}, {VECTORS},
xp AS (SELECT s_suppkey AS ext_id, p_brand AS ward, {PLACE.format("(s_suppkey + 1)")}, v.x, v.sides FROM supplier JOIN part ON p_partkey = s_suppkey LEFT JOIN v ON vec_id = s_suppkey + 1),
cp AS (SELECT p_partkey AS property_id, p_brand AS ward, {PLACE.format("p_partkey")}, v.x, v.sides FROM part LEFT JOIN v ON vec_id = p_partkey),
xb AS (SELECT ext_id, 'ward' AS kind, ward AS block FROM xp UNION ALL SELECT ext_id, 'v' || generate_subscripts(sides, 1), unnest(sides)::VARCHAR FROM xp),
cb AS (SELECT property_id, 'ward' AS kind, ward AS block FROM cp UNION ALL SELECT property_id, 'v' || generate_subscripts(sides, 1), unnest(sides)::VARCHAR FROM cp),
small AS (SELECT kind, block FROM (SELECT kind, block, count(*) AS n FROM xb GROUP BY ALL) JOIN (SELECT kind, block, count(*) AS m FROM cb GROUP BY ALL) USING (kind, block) WHERE n * m <= {WARD_PAIRS}),
near AS (SELECT ext_id, property_id FROM xp x, cp c WHERE {KM} <= 2),
pairs AS (SELECT ext_id, property_id FROM h UNION SELECT ext_id, property_id FROM near UNION SELECT ext_id, property_id FROM xb JOIN small USING (kind, block) JOIN cb USING (kind, block)),
base AS (SELECT p.ext_id, p.property_id, 0.72::DOUBLE * CASE WHEN x.n = c.n THEN 1.0 ELSE len(list_intersect({TOKENS.format('x.n')}, {TOKENS.format('c.n')}))::DOUBLE / len(list_distinct(list_concat({TOKENS.format('x.n')}, {TOKENS.format('c.n')}))) END::DOUBLE
  + 0.1::DOUBLE * (x.type = c.type)::INTEGER + 0.1::DOUBLE * (c.area > 0 AND abs(x.area - c.area) / c.area <= 0.1::DOUBLE)::INTEGER AS score FROM pairs p JOIN x USING (ext_id) JOIN c USING (property_id)),
full_score AS (SELECT ext_id, property_id, round(score + 0.1::DOUBLE * greatest(1 - {KM} / 2, 0) + 0.1::DOUBLE * coalesce(greatest({COSINE.format("x", "c")}, 0), 0), 12) AS score FROM base JOIN xp x USING (ext_id) JOIN cp c USING (property_id)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY score DESC, property_id) AS rank FROM full_score WHERE score > 0)
SELECT ext_id, property_id, round(score, 9) AS score, rank::INTEGER AS rank FROM ranks WHERE rank <= 10""")  # fmt: skip
def composite_scores(d):
    """The ranked candidates of tokens, wards, distances and vectors together, with both in the score."""
    ext, ent = _placed(d)
    return B.ranked_composite(ext, ent, B.REACH_KM, DIMS, WARD_PAIRS).withColumn("score", F.round("score", 9))
