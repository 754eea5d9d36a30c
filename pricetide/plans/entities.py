"""Queries on entity lists, details, joins, windows and sets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricetide.operators import dedup as K
from pricetide.operators import entities as E
from pricetide.operators import geo as G
from pricetide.operators import location_stats as L
from pricetide.operators import stats as S
from pricetide.plans.market import DIST
from pricetide.plans.registry import query
from pricetide.session import stash_path
from pricetide.sources.domain import OBS
from pricetide.sources.versioned import VersionedTable, upsert_into

SALE = "CASE WHEN listing_type = 'sale' AND NOT needs_review THEN ppm2 END"


@query("A18_J4_J5_project_counts", f"""WITH {OBS}, d AS (SELECT p_brand AS project, count(DISTINCT p_type) AS n_buildings, count(DISTINCT p_partkey) AS n_properties FROM part GROUP BY 1), o AS (SELECT project, count(*) AS n_obs FROM obs GROUP BY 1)
SELECT project, n_buildings, n_properties, coalesce(n_obs, 0) AS n_obs FROM d LEFT JOIN o USING (project)""")  # fmt: skip
def projects(d):
    return E.list_projects(d.properties(), d.observations())


@query("A19_J6_building_counts", f"""WITH {OBS}, d AS (SELECT p_brand AS project, p_type AS property_type, count(DISTINCT p_partkey) AS n_properties FROM part GROUP BY 1, 2), o AS (SELECT project, property_type, count(*) AS n_obs FROM obs GROUP BY 1, 2)
SELECT project, property_type, n_properties, coalesce(n_obs, 0) AS n_obs FROM d LEFT JOIN o USING (project, property_type)""")  # fmt: skip
def buildings(d):
    return E.list_buildings(d.properties(), d.observations())


@query("W1_J8_A20_property_page", f"""WITH {OBS}, c AS (SELECT p_partkey AS property_id, p_name AS name, p_brand AS project, p_type AS property_type, coalesce(n, 0) AS n_obs FROM part LEFT JOIN (SELECT property_id, count(*) AS n FROM obs GROUP BY 1) o ON p_partkey = property_id),
t AS (SELECT * FROM c ORDER BY n_obs DESC, name, property_id LIMIT 100)
SELECT t.property_id, t.name, t.n_obs, strftime(max(seen_at), '%Y-%m-%d') AS last_seen, count({SALE}) AS n, quantile_cont({SALE}, 0.5) AS median, quantile_cont({SALE}, 0.25) AS p25, quantile_cont({SALE}, 0.75) AS p75 FROM t LEFT JOIN obs USING (property_id) GROUP BY ALL""", "median p25 p75")  # fmt: skip
def property_page(d):
    return E.list_properties(d.properties(), d.observations()).select("property_id", "name", "n_obs", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), "n", "median", "p25", "p75")


@query("A20_property_sales", f"WITH {OBS} SELECT property_id, strftime(max(seen_at), '%Y-%m-%d') AS last_seen, count({SALE}) AS n, quantile_cont({SALE}, 0.5) AS median, quantile_cont({SALE}, 0.25) AS p25, quantile_cont({SALE}, 0.75) AS p75, min({SALE}) AS min, max({SALE}) AS max FROM obs GROUP BY property_id", "median p25 p75 min max")
def property_sales(d):
    return E.sale_distribution(d.observations(), "property_id").withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


@query("A37_project_detail", f"WITH {OBS} SELECT 'Brand#7' AS project, (SELECT count(DISTINCT p_type) FROM part WHERE p_brand = 'Brand#7') AS n_buildings, (SELECT count(DISTINCT p_partkey) FROM part WHERE p_brand = 'Brand#7') AS n_properties, (SELECT count(*) FROM obs WHERE project = 'Brand#7') AS n_obs")
def project_detail(d):
    return E.project_detail(d.properties(), d.observations(), "Brand#7")


@query("A38_P37_W4_property_detail", f"WITH {OBS} SELECT property_id, signal_id, item, source_id, strftime(seen_at, '%Y-%m-%d') AS day, price, area_m2, ppm2, deal_status FROM obs WHERE property_id = 7", "ppm2")
def property_detail(d):
    return E.property_points(d.observations(), 7).select("property_id", "signal_id", "item", "source_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "price", "area_m2", "ppm2", "deal_status")


@query("A26_source_mix", f"WITH {OBS}, c AS (SELECT property_id, source_id, count(*) AS n FROM obs GROUP BY ALL) SELECT property_id, source_id, n, round(n / sum(n) OVER (PARTITION BY property_id), 6) AS share FROM c")
def source_mix(d):
    return E.source_mix(d.observations(), "property_id", "source_id")


@query("P31_reliability_levels", f"WITH {OBS}, c AS (SELECT property_id, count({SALE}) AS n FROM obs GROUP BY 1) SELECT CASE WHEN n >= 10 THEN 4 WHEN n >= 7 THEN 3 WHEN n >= 5 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS level, count(*) AS properties FROM c GROUP BY 1")
def levels(d):
    return E.sale_distribution(d.observations(), "property_id").groupBy(E.reliability_level(F.col("n")).alias("level")).agg(F.count("*").alias("properties"))


@query("P34_G5_map_weights", f"""WITH {OBS}, m AS (SELECT property_id, quantile_cont({SALE}, 0.5) AS median FROM obs GROUP BY 1), e AS (SELECT min(median) AS lo, max(median) AS hi FROM m)
SELECT property_id, median, CASE WHEN median IS NULL OR hi = lo THEN 0.5 ELSE (median - lo) / (hi - lo) END AS weight FROM m, e""", "median weight")  # fmt: skip
def weights(d):
    return E.map_weight(E.sale_distribution(d.observations(), "property_id").select("property_id", "median"), "median")


@query("G4_P6_map_points", f"""WITH {OBS}, s AS (SELECT property_id, quantile_cont({SALE}, 0.5) AS median_ppm2, count(ppm2) AS n, count({SALE}) AS n_sale FROM obs GROUP BY 1)
SELECT p_partkey AS id, p_brand || ' / ' || p_type AS label, p_partkey % 180 - 90.0::DOUBLE AS lat, p_size + 100.0::DOUBLE AS lng, median_ppm2, coalesce(n, 0) AS n, coalesce(n_sale, 0) AS n_sale FROM part LEFT JOIN s ON property_id = p_partkey""", "median_ppm2")  # fmt: skip
def map_points(d):
    from pricetide.functions.text import hierarchy_label

    none = F.lit(None).cast("string")
    points = d.properties().select(F.col("property_id").alias("id"), hierarchy_label("project", "property_type", none, "name").alias("label"), (F.col("property_id") % 180 - F.lit(90.0)).alias("lat"), (F.col("size") + 100.0).alias("lng"))
    return G.map_points(d.observations(), points)


@query("S9_F30_geojson", """SELECT p_partkey AS id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || p_size || '.0,' || p_partkey % 90 || '.0]},"properties":{"id":' || p_partkey || ',"name":"' || p_name || '"}}' AS feature FROM part""")
def geojson(d):
    return d.properties().select(F.col("property_id").alias("id"), G.feature({"id": F.col("property_id"), "name": F.col("name")}, F.col("size"), (F.col("property_id") % 90).cast("double")).alias("feature"))


@query("D7_F30_tree_rollup", f"""WITH {OBS}, o AS (SELECT r.*, n_regionkey FROM reviewed r JOIN nation ON area = n_name)
SELECT 'n' || n_nationkey AS id, count(*) AS n, quantile_cont(ppm2, 0.5) AS median, area AS name FROM o JOIN nation ON area = n_name GROUP BY 1, 4
UNION ALL SELECT 'r' || r_regionkey, count(*), quantile_cont(ppm2, 0.5), r_name FROM o JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 4""", "median")  # fmt: skip
def tree(d):
    return E.tree_rollup(d.locations(), d.reviewed(), "area")


@query("A17_X7_first_row_per_key", "SELECT p_name AS name, min(p_brand) AS project FROM part GROUP BY p_name")
def first_row(d):
    return K.first_by(d.properties(), ["name"], "project").select("name", "project")


@query("J13_X7_update_from", f"""WITH {OBS}, f AS (SELECT p_name AS name, min(p_brand) AS project_id FROM part GROUP BY 1) SELECT p_partkey AS property_id, p_name AS name, coalesce(project_id, p_brand) AS project_id FROM part LEFT JOIN f ON p_name = f.name""")
def update_from(d):
    first = first_row(d).withColumnRenamed("project", "new_project")
    return d.properties().join(first, "name", "left").select("property_id", "name", F.coalesce("new_project", "project").alias("project_id"))


@query("J9_U4_anti_join", "SELECT s_suppkey AS source_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-25') ")
def anti(d):
    recent = d.table("lineitem").where("l_shipdate >= timestamp '2001-10-25'").select(F.col("l_suppkey").alias("source_id"))
    return d.table("supplier").select(F.col("s_suppkey").alias("source_id")).join(recent, "source_id", "left_anti")


@query("J7_A28_session_rollup", "SELECT conv_id, count(*) AS draft_size, count(*) FILTER (WHERE role = 'user') AS committed FROM conversations GROUP BY conv_id")
def sessions(d):
    c = d.table("conversations")
    users = c.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("committed"))
    return c.groupBy("conv_id").agg(F.count("*").alias("draft_size")).join(users, "conv_id", "left").withColumn("committed", F.coalesce("committed", F.lit(0)))


@query("A29_transcripts", "SELECT conv_id, coalesce(string_agg(trim(text), ' | ' ORDER BY turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), '') AS transcript, count(*) FILTER (WHERE role = 'user') AS n_messages FROM conversations GROUP BY conv_id")
def transcripts(d):
    from pricetide.operators.ingest import transcript

    return transcript(d.table("conversations"), "conv_id", "turn", "role", "text", " | ")


@query("S2_J1_J3_provenance", f"WITH {OBS} SELECT o_orderkey AS signal_id, o_orderstatus AS status, count(*) AS n, sum(CASE WHEN needs_review THEN 1 ELSE 0 END)::BIGINT AS waiting FROM obs JOIN orders ON signal_id = o_orderkey GROUP BY 1, 2")
def provenance(d):
    signals = d.table("orders").select(F.col("o_orderkey").alias("signal_id"), F.col("o_orderstatus").alias("status"))
    return d.observations().join(signals, "signal_id").groupBy("signal_id", "status").agg(F.count("*").alias("n"), F.sum(F.col("needs_review").cast("int")).alias("waiting"))


@query("A33_A34_signal_status", f"""WITH {OBS}, s AS (SELECT signal_id, count(*) FILTER (WHERE deal_status = 'asking' AND NOT needs_review) AS created, count(*) FILTER (WHERE deal_status = 'transacted' AND NOT needs_review) AS linked, count(*) FILTER (WHERE needs_review AND ppm2 > 1000) AS review, count(*) FILTER (WHERE needs_review AND ppm2 <= 1000) AS rejected FROM obs GROUP BY 1)
SELECT *, CASE WHEN created + linked + review = 0 THEN 'ignored' WHEN review > 0 THEN 'needs_review' ELSE 'extracted' END AS status FROM s""")  # fmt: skip
def signal_status(d):
    from pricetide.operators.ingest import signal_status as status

    outcome = F.when(F.col("needs_review"), F.when(F.col("ppm2") > 1000, "review").otherwise("rejected")).when(F.col("deal_status") == "asking", "created").otherwise("linked")
    return status(d.observations().withColumn("outcome", outcome), "signal_id")


@query("W18_batches", f"WITH {OBS}, r AS (SELECT source_id, signal_id, item, property_id, row_number() OVER (PARTITION BY source_id ORDER BY seen_at, signal_id, item, property_id, price) AS k FROM obs) SELECT source_id, ((k - 1) // 10)::INTEGER AS batch, count(*) AS n, sum(signal_id)::BIGINT AS signals FROM r GROUP BY 1, 2")
def batches(d):
    return K.batches(d.observations(), "source_id", 10, "at", "signal_id", "item", "property_id", "price").groupBy("source_id", "batch").agg(F.count("*").alias("n"), F.sum("signal_id").alias("signals"))


@query("W20_scatter_band", f"WITH {OBS} SELECT property_id, least(min(ppm2), quantile_cont(ppm2, 0.25)) AS low, greatest(max(ppm2), quantile_cont(ppm2, 0.75)) AS high, count(*) AS n FROM obs GROUP BY property_id", "low high")
def scatter(d):
    x = F.col("ppm2")
    return d.observations().groupBy("property_id").agg(F.least(F.min(x), S.quantile(x, 0.25)).alias("low"), F.greatest(F.max(x), S.quantile(x, 0.75)).alias("high"), F.count("*").alias("n"))


@query("W2_W3_newest_page", f"WITH {OBS} SELECT signal_id, item, property_id, price FROM obs WHERE needs_review ORDER BY seen_at DESC, signal_id, item, property_id, price LIMIT 50")
def newest(d):
    from pricetide.operators.ops import newest as top

    return top(d.observations().where("needs_review"), "at", 50, "signal_id", "item", "property_id", "price").select("signal_id", "item", "property_id", "price")


@query("P19_P20_property_search", "SELECT p_partkey AS property_id, p_name AS name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand#1') AND p_type = 'ECONOMY'")
def search(d):
    return E.search(d.properties(), "Ring Brand#1", "name", "project", "property_type").where("property_type = 'ECONOMY'").select("property_id", "name")


@query("U1_U5_tagged_union", "SELECT 'project' AS entity_type, p_brand AS name, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'building', p_brand || ' / ' || p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'unit', p_name, count(*) FROM part GROUP BY 2")
def tagged(d):
    p = d.properties()
    tag = lambda kind, name: p.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("entity_type"), "name", "n")
    return tag("project", F.col("project")).unionByName(tag("building", F.concat_ws(" / ", "project", "property_type"))).unionByName(tag("unit", F.col("name")))


@query("J17_cascading_options", "SELECT DISTINCT p_type AS building, p_name AS unit FROM part WHERE p_brand = 'Brand#7'")
def options(d):
    return d.properties().where("project = 'Brand#7'").select(F.col("property_type").alias("building"), F.col("name").alias("unit")).distinct()


@query("D9_embedding_cosine", "SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 1")
def cosine(d):
    from pricetide.operators.resolve import cosine as score

    e = d.table("embeddings")
    other = e.select(F.col("vec_id").alias("other"), "label", F.col("embedding").alias("v"))
    return e.join(other, (e["label"] == other["label"]) & (F.col("other") == F.col("vec_id") + 1)).select(F.col("vec_id").alias("id"), "other", F.round(score(F.col("embedding"), F.col("v")), 5).alias("cosine"))


@query("D10_pointer_chase", """WITH RECURSIVE log AS (SELECT l_partkey AS f, max(l_partkey // 2) AS t FROM lineitem WHERE l_partkey > 0 GROUP BY 1), c AS (SELECT f AS id, t AS canonical FROM log UNION ALL SELECT c.id, log.t FROM c JOIN log ON c.canonical = log.f)
SELECT id, min(canonical) AS canonical FROM c GROUP BY id""")  # fmt: skip
def pointers(d):
    merges = d.table("lineitem").where("l_partkey > 0").select(F.col("l_partkey").alias("from_id"), F.floor(F.col("l_partkey") / 2).alias("to_id"), F.col("l_orderkey").alias("merge_id"), F.lit(False).alias("undone"))
    return K.resolve_pointers(merges)


@query("D10_undone_pointer_chase", """WITH RECURSIVE log AS (SELECT l_partkey AS f, max(l_partkey // 2) AS t FROM lineitem WHERE l_returnflag <> 'R' AND l_partkey > 0 GROUP BY 1), c AS (SELECT f AS id, t AS canonical FROM log UNION ALL SELECT c.id, log.t FROM c JOIN log ON c.canonical = log.f)
SELECT id, min(canonical) AS canonical FROM c GROUP BY id""")  # fmt: skip
def undone_pointers(d):
    merges = d.table("lineitem").where("l_partkey > 0").select(F.col("l_partkey").alias("from_id"), F.floor(F.col("l_partkey") / 2).alias("to_id"), F.col("l_orderkey").alias("merge_id"), (F.col("l_returnflag") == "R").alias("undone"))
    return K.resolve_pointers(merges)


#: A merge log made of the parts: each goes into the one before it of its brand and type, in chains of any length, for a time.
MERGES = """merges AS (
  SELECT p_partkey AS merge_id, p_partkey AS from_id, lag(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS to_id,
    DATE '1996-01-01' + p_size::INTEGER * 20 AS created_at, CASE WHEN p_retailprice > 990 THEN DATE '1996-01-01' + p_size::INTEGER * 40 END AS undone_at
  FROM part)"""
AS_OF = "1998-01-01"


def merge_log(d):
    size = F.col("p_size").cast("int")
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    day = lambda n: F.date_add(F.lit("1996-01-01").cast("date"), size * n)
    log = d.table("part").select(F.col("p_partkey").alias("merge_id"), F.col("p_partkey").alias("from_id"), before.alias("to_id"), day(20).alias("created_at"), F.when(F.col("p_retailprice") > 990, day(40)).alias("undone_at"))
    return log.where("to_id IS NOT NULL")


@query("Q16_D10_merged_sales", f"""WITH RECURSIVE {OBS}, {MERGES},
log AS (SELECT from_id, to_id FROM merges WHERE to_id IS NOT NULL AND created_at <= DATE '{AS_OF}' AND (undone_at IS NULL OR undone_at > DATE '{AS_OF}')),
c AS (SELECT from_id AS id, to_id AS canonical FROM log UNION ALL SELECT c.id, log.to_id FROM c JOIN log ON c.canonical = log.from_id),
p AS (SELECT id, min(canonical) AS canonical FROM c GROUP BY id),
o AS (SELECT coalesce(p.canonical, property_id) AS property_id, ppm2, seen_at, listing_type, needs_review FROM obs LEFT JOIN p ON p.id = property_id)
SELECT property_id, max(seen_at) AS last_seen, {DIST.format(f"({SALE})")} FROM o GROUP BY property_id""", "median p25 p75 min max")  # fmt: skip
def merged_sales(d):
    """Statistics of properties with what was merged into them, as of a time."""
    pointers = K.resolve_pointers(K.merges_as_of(merge_log(d), F.lit(AS_OF).cast("date")))
    return E.sale_distribution(K.followed(d.observations(), pointers, "property_id"), "property_id")


@query("D7_cached_location_stats", f"""WITH {OBS},
b AS (SELECT n_nationkey, n_regionkey, property_type, deal_status, floor(ln(ppm2) * 64)::BIGINT AS bucket, ppm2 FROM reviewed JOIN nation ON area = n_name WHERE ppm2 > 0),
s AS (SELECT place, property_type, deal_status, bucket, count(*) AS n, min(ppm2) AS lo, max(ppm2) AS hi
  FROM (SELECT 'n' || n_nationkey AS place, * FROM b UNION ALL SELECT 'r' || n_regionkey, * FROM b) GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY place, property_type, deal_status ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY place, property_type, deal_status) AS total FROM s)
SELECT place, property_type, deal_status, sum(n)::BIGINT AS n, min(lo) AS min, max(hi) AS max, {', '.join(f"max((lo + hi) / 2) FILTER (WHERE upto >= ceil(total * {q}) AND upto - n < ceil(total * {q})) AS {name}" for name, q in L.SHARES.items())}
FROM r GROUP BY place, property_type, deal_status""", "p25 median p75 min max")  # fmt: skip
def cached_location_stats(d):
    """Three increments of facts by time go into the stored state; its roll-up over all places is what comes out."""
    table = L.location_table(d.spark, stash_path(d.spark, "location-stats"))
    places = d.locations()
    facts = d.reviewed().join(places.select(F.col("name").alias("area"), F.col("id").alias("place_id")), "area")
    for when in ("at < '1997-01-01'", "at >= '1997-01-01' AND at < '1999-01-01'", "at >= '1999-01-01'"):
        L.add_facts(table, facts.where(when), "place_id")
    return L.summary(L.rolled_up(table.read(), places))


@query("X2_stored_upsert", "SELECT user_id AS device_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stored_upsert(d):
    """The last event of each device, upserted into a stored table in three loads, each of which rewrites the parts it touches."""
    rows = d.table("events").select(F.col("user_id").alias("device_id"), "event_id", F.col("event_type").alias("type"), "value", "ts")
    table = VersionedTable(d.spark, stash_path(d.spark, "devices"), "device_id bigint, event_id bigint, type string, value double", ["device_id"], 16)
    for days in ("> 20", "<= 10", "BETWEEN 11 AND 20"):  # out of order: the newer event stays
        upsert_into(table, rows.where(f"dayofmonth(ts) {days}").drop("ts"), "event_id")
    return table.read()
