"""The registered queries of this subpackage: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricetide.session import ship

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}
BATCH_ROWS = 1000  # rows of an Arrow batch; whole texts are in them


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        _queries[name] = run
        if sql:
            _oracle[name] = sql
        return run

    return put


def prepare(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL_WORDS = r"'[^\x20\x09-\x0D]+'"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query(
    "op1_ngram_jaccard_join",
    f"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {SQL_WORDS}) AS ws FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM t WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.secrets import secret_digest

    return secret_digest(read(spark, sf_dir, "documents"))


@query(
    "op3_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pricetide.llm.topk import exact_topk

    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query(
    "op4_backoff_lm",
    f"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SQL_WORDS}) AS ws FROM documents),
    u AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(list_concat([NULL], ws[:len(ws) - 1])) AS p FROM t WHERE len(ws) > 0),
    total AS (SELECT count(*) AS n FROM u),
    c AS (
      SELECT doc_id, n, i, w, p,
        count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS cw,
        count(*) OVER (PARTITION BY p, w) - count(*) OVER (PARTITION BY doc_id, p, w) AS cb FROM u),
    x AS (SELECT *, lag(cw) OVER (PARTITION BY doc_id ORDER BY i) AS cp, p IS NOT NULL AND cb > 0 AS hit FROM c),
    d AS (
      SELECT doc_id, n,
        sum(CASE WHEN hit THEN ln(cb) - ln(cp) ELSE ln(greatest(cw, 0.5)) - ln(greatest((SELECT n FROM total) - n, 1)) + CASE WHEN p IS NULL THEN 0 ELSE ln(0.4) END END) AS s,
        count(*) FILTER (WHERE NOT hit) AS n_unigram, count(*) FILTER (WHERE NOT hit AND p IS NOT NULL) AS n_backoff
      FROM x GROUP BY doc_id, n)
    SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_unigram, 0)::BIGINT AS n_unigram, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(s, 0), 3) AS log_score
    FROM t LEFT JOIN d USING (doc_id)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pricetide.llm.backoff_lm import backoff_scores

    return backoff_scores(read(spark, sf_dir, "documents"), order=2).select("doc_id", "n_words", "n_unigram", "n_backoff", F.round("log_score", 3).alias("log_score"))


@query("op5_bpe_trie")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.bpe import bpe_digest

    return bpe_digest(read(spark, sf_dir, "documents"), vocabulary())


@query("op6_compression_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.langid import identify

    return identify(read(spark, sf_dir, "documents"))


@query("op7_quality_mcd")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.quality import quality_verdicts

    return quality_verdicts(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_stratified_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.sharding import shard_digest

    return shard_digest(read(spark, sf_dir, "documents"), shards=16)


@query("op9_nnls_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), vocabulary(), window=1024, closing=0)


SQL_DIGITS = " || ".join(f"substr('{UPPER}234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))


@query(
    "op10_warc_round_trip",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {SQL_DIGITS} AS payload_digest,
      CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM m
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.warc import archive_round_trip

    return archive_round_trip(read(spark, sf_dir, "pages"))


SQL_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op11_line_dedup",
    rf"""
    WITH l AS (
      SELECT doc_id, i, line, translate(trim(line, {SQL_WHITE}), '{UPPER}', '{LOWER}') AS k
      FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
    c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.k)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL), '')) AS kept_sha256
    FROM l LEFT JOIN c USING (k) GROUP BY doc_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.line_dedup import line_digest

    return line_digest(read(spark, sf_dir, "documents"), least_docs=10, least_chars=1)


SQL_CRC32 = """crc AS MATERIALIZED (
      SELECT t, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(t) + 1), lambda i: ascii(t[i])::BIGINT)), lambda c, x:
        list_reduce(list_concat([xor(c, x)], range(8)), lambda v, j: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))) AS v FROM texts)"""


@query(
    "op12_turn_repair",
    rf"""
    WITH RECURSIVE raw AS (
      SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS t FROM conversations),
    texts AS (SELECT DISTINCT t FROM raw), {SQL_CRC32},
    seeded AS (SELECT raw.*, xor(v, 4294967295) % 20 AS k FROM raw JOIN crc USING (t)),
    damaged AS (
      SELECT c, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END))
      FROM seeded WHERE k <> 0),
    said AS (SELECT *, rtrim(text, {SQL_WHITE}) AS solid, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM damaged),
    ordered AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM said WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, again)),
    f AS (
      SELECT *, solid = '' AS b, solid <> '' AND again AS d, solid <> '' AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS tr, role[1] AS ini,
        before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au') AS bad
      FROM ordered),
    e(p, q, w, s) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
    x(p, q, w, s, ini) AS (VALUES (0, 0, 2, 'D', NULL), (1, 1, 2, 'D', NULL), (2, 2, 2, 'D', NULL), (3, 3, 2, 'D', NULL), (0, 2, 1, 'R', NULL), (1, 2, 1, 'R', NULL), (3, 2, 1, 'R', NULL), (2, 3, 1, 'R', NULL),
      (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a')),
    step AS (
      SELECT e.p, x.q, e.w + x.w AS w, e.s || x.s AS s, x.s AS edit, x.ini FROM e JOIN x ON e.q = x.p),
    walk AS (
      SELECT DISTINCT c, 0::BIGINT AS i, 0 AS q, struct_pack(w := 0, s := '') AS m FROM raw
      UNION ALL
      SELECT r.c, r.i + 1, step.q, min(struct_pack(w := r.m.w + step.w + CASE WHEN f.tr AND edit <> 'D' THEN 5 ELSE 0 END, s := r.m.s || step.s))
      FROM walk r JOIN f ON f.c IS NOT DISTINCT FROM r.c AND f.i = r.i + 1 JOIN step ON step.p = r.q AND (edit = 'D' OR (NOT f.b AND NOT f.d AND (edit = 'R' OR step.ini = f.ini)))
      GROUP BY r.c, r.i, step.q),
    n AS (
      SELECT c, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (b) AS blank, count(*) FILTER (d) AS duplicate, count(*) FILTER (tr) AS truncated, count(*) FILTER (bad) AS illegal FROM f GROUP BY c),
    best AS (
      SELECT walk.c, min(struct_pack(w := m.w + e.w, s := m.s || e.s)) AS m
      FROM walk LEFT JOIN n ON n.c IS NOT DISTINCT FROM walk.c JOIN e ON e.p = walk.q WHERE i = coalesce(n.n, 0) AND e.q IN (0, 3) GROUP BY walk.c),
    letters AS (SELECT c, j, m.s[j] AS edit FROM (SELECT c, m, unnest(range(1, len(m.s) + 1)) AS j FROM best)),
    placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY c ORDER BY j)),
    made AS (SELECT placed.*, f.role, f.text, max(CASE WHEN o = 1 AND edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.c) AS led FROM placed LEFT JOIN f ON f.c IS NOT DISTINCT FROM placed.c AND f.i = placed.i AND edit <> 'I'),
    out AS (
      SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - 1 - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole
      FROM made WHERE edit <> 'D' GROUP BY c)
    SELECT best.c AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
      best.m.w::BIGINT AS cost, best.m.s AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM best LEFT JOIN n ON n.c IS NOT DISTINCT FROM best.c LEFT JOIN out ON out.c IS NOT DISTINCT FROM best.c
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.turn_repair import damaged, repair_digest

    return repair_digest(damaged(read(spark, sf_dir, "conversations")))


@query(
    "op13_prefix_trie",
    rf"""
    WITH o AS (
      SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS ts
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    texts AS (SELECT c::VARCHAR AS t FROM o), {SQL_CRC32},
    h AS (SELECT o.c, ts, xor(v, 4294967295) % 4 AS h FROM o JOIN crc ON t = c::VARCHAR),
    b AS (SELECT h.c, list_concat(coalesce(o.ts[:h], []), h.ts[h + 1:]) AS ts FROM h LEFT JOIN o ON o.c = h.c - h.c % 20),
    m AS (SELECT c, len(ts) AS n, d, ts[:d] AS k FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM b)),
    x AS (
      SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
        CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].t, {SQL_WORDS})) END AS words
      FROM m GROUP BY k, d),
    u AS (SELECT k[:d - 1] AS k, count(*) AS n_children FROM x WHERE d > 0 GROUP BY 1),
    y AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM x LEFT JOIN u USING (k)),
    s AS (
      SELECT k[:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
      FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM y) GROUP BY 1)
    SELECT y.conv_id, y.d::BIGINT AS depth, p.conv_id AS parent_conv_id, y.n_convs, y.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, y.ends_sha256
    FROM y JOIN s ON s.k = y.k LEFT JOIN x p ON y.d > 0 AND p.k = y.k[:y.d - 1]
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricetide.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(read(spark, sf_dir, "conversations"), every=20, most=4)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
