import random

import pytest

SYLLABLES = {
    "en": "the and ing ion er re on th nd ly ent".split(),
    "de": "der die und sch ein ung keit ver ber ich auf".split(),
    "fr": "les que eau oir ment pour une elle ouv ais".split(),
}


@pytest.fixture
def words():
    """A seeded source of invented words of a language."""

    def make(n, lang="en", seed=0):
        r = random.Random(f"{lang}{seed}{n}")
        return ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)]

    return make


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(*r, *("en", "s0")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string")
        if extra:
            for c in ("n", "node", "root", "key", "tag", "tile", "side", "chunk", "shard", "slot", "length", "start", "spans", "base_spans", "group", "kept", "x0", "d2", "rank", "score", "offset", "_tag", "row", "text_tag", "own_id", "own_tag", "_h", "_by", "_bucket", "_part", "_base_spans", "_all_spans", "held_out", "lang_pred", "rejected", "parent", "bin", "volume", "sha1", "first"):
                df = df.selectExpr("*", f"'clash' AS {c}")
        return df

    return make
