import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture
def corpus(docs, words):
    rows = [(i, " ".join(words(90 + i % 60, "en", seed=i)), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, " ".join(words(90 + i % 60, "de", seed=i)), "de", f"s{i % 3}") for i in range(80)]
    rows += [(400, rows[3][1], "en", "s0"), (401, rows[4][1] + " extra", "en", "s1"), (402, " ".join(words(80, seed=77)) + " token=abcdefgh12", "en", "s1")]
    rows += [(500, "too short", "en", "s0"), (501, " ".join(x + "%%$#" for x in words(100, seed=9)), "en", "s0"), (502, None, "en", "s0")]
    return docs(rows).selectExpr("*", "cast(length(text) as bigint) AS n_chars")


def test_stages(spark, corpus):
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = set(range(120)) | set(range(200, 280))
    good = stage("quality_rules")(spark, corpus, "").cache()
    assert good.columns == corpus.columns
    assert ids(good) == clean | {400, 401, 402}
    told = stage("language_id")(spark, good, "").cache()
    assert told.columns == corpus.columns and ids(told) == ids(good)
    unique = stage("near_duplicates")(spark, told, "").cache()
    assert unique.columns == corpus.columns and ids(unique) == clean | {402}
    safe = stage("secret_scans")(spark, unique, "").cache()
    assert safe.columns == corpus.columns and ids(safe) == ids(unique)
    row = safe.where("doc_id = 402").first()
    assert row.text.endswith("<SECRET>") and row.n_chars == len(row.text)
    packed = stage("packing")(spark, safe, "")
    assert {r.doc_id for r in packed.collect()} == ids(safe)


def test_stages_take_empty_tables(spark, corpus):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, corpus.where("false"), "").count() == 0


def test_stages_take_columns_of_any_name(spark, docs, words):
    rows = [(i, " ".join(words(90 + i % 60, "en", seed=i)), "en", "s") for i in range(30)] + [(90, " ".join(words(90, "en", seed=0)), "en", "s"), (None, "token=abcdefgh12 " + " ".join(words(90, seed=3)), None, None)]
    df = docs(rows, extra=True).selectExpr("*", "'clash' AS tested", "'clash' AS ids")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, df, "")
        assert out.columns == df.columns, name
        assert {r["_tag"] for r in out.collect()} == {"clash"}, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() >= len(rows)
