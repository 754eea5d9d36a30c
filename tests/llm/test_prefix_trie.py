import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pricetide.llm import prefix_trie as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """All nodes by brute force, as tuples in the order of the operator's columns."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        own[c].append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(int(c / 20) * 20, [])[:h] + turns[h:]  # as in SQL, -1 % 20 is -1
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    below = {}
    for k in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(k[-1][1])) if k else 0
        parts = [below[x] for x in kids[k]]
        below[k] = (sum(p[0] for p in parts) or int(not kids[k]), sum(p[1] for p in parts) + (len(members[k]) - 1) * words)
    out = []
    for k, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(whole[c]) == len(k))
        out.append((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), len(kids[k]), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, DDL).selectExpr("*", *(f"'clash' AS {c}" for c in ("conv", "place", "hash1", "words", "block", "node1", "up1", "depth", "total", "head", "h", "n")))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in P.rebuilt_trie(df).collect()), key=repr)


@pytest.mark.parametrize("pieces", [2, 4096])
def test_against_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(P, "PIECE", pieces)
    monkeypatch.setattr(P, "HOT_PARENTS", 10)
    r = random.Random(3)
    rows = []
    for c in range(-3, 90):
        if c % 13 == 5:
            continue
        n = r.choice([1, 2, 3, 4, 5, 8, 9, 21])
        rows += [(c, t if t else None, r.choice(["user", "user", None]), r.choice(["one two", "a", "", None, "x y  z\tw\n"]) if t > 1 else "same start of all") for t in range(n)]
    assert found(spark, rows) == plain(rows)


def test_copies_ties_and_nulls(spark):
    talk = [(t, "user", f"turn number {t}") for t in range(11)]
    rows = [(100 + 20 * i, *t) for i in range(40) for t in talk] + [(None, 1, "user", "nobody"), (None, None, None, None)] + [(1, 5, "a", "x")] * 4
    assert found(spark, rows) == plain(rows)


def test_turnless_conversations_and_a_long_one(spark):
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 0, "user", "replaced")] + [(60, t, "user", f"{t} " * 3) for t in range(500)] + [(41, 0, "user", "word " * 100_000)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert got[0][3] == 3 and any(n[1] == 0 and n[0] == short for n in got)


def test_without_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []
