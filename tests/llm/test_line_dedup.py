import hashlib
import random
from collections import defaultdict

from pricetide.llm import line_dedup as L

WHITE = " \t\n\x0b\x0c\r"


def plain(rows, least=10):
    """(doc_id, n_lines, n_dropped, kept text) by brute force; every row is a document."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    where = defaultdict(set)
    for at, row in enumerate(rows):
        for line in (row[1] or "").split("\n"):
            where[key(line)].add(at)
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or len(where[key(x)]) < least]
        out.append((row[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df, least=10):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in L.deduplicated(df, least).collect()), key=repr)


def test_against_brute_force(docs, monkeypatch):
    r = random.Random(5)
    pool = [f"line {i}" for i in range(60)] + ["Über  Alles", "", "   ", "\x85x", "A", " a\t", "﻿a"]
    rows = [(i if i % 9 else None, r.choice(["\n", "\r\n"]).join(r.choice(["", " ", "\t"]) + r.choice([str.upper, str])(r.choice(pool)) for _ in range(r.choice([0, 1, 3, 70, 200])))) for i in range(120)]
    rows += [(7, None), (8, ""), (9, "\n\n"), (None, None)] + [(500, "said by\none row")] * 10 + [(600, "said by\nnine rows")] * 9
    want = plain(rows)
    assert any(x[2] for x in want)
    assert found(docs(rows, extra=True)) == want
    monkeypatch.setattr(L, "BROADCAST_KEYS", 20)  # most keys are joined by a shuffle
    assert found(docs(rows)) == want


def test_repeats_within_a_document_count_once(docs):
    rows = [(i, "twice\nown %d\ntwice\n TWICE " % i) for i in range(9)]
    assert all(r[2] == 0 for r in found(docs(rows)))
    assert all(r[2] == 3 for r in found(docs([*rows, (9, "twice")])) if r[0] != 9)


def test_very_long_text_and_bitmaps(docs):
    text = "\n".join(f"common {i}" if i % 1000 == 999 else f"own {i}" for i in range(200_000))
    rows = [(0, text)] + [(i, "\n".join(f"common {k}" for k in range(999, 200_000, 1000))) for i in range(1, 10)]
    bitmaps = {r.n_lines: r for r in L.deduplicated(docs(rows)).collect()}
    long = bitmaps[200_000]
    assert long.n_dropped == 200 and len(long["keep"]) == 200
    assert hashlib.sha256(long.kept_text.encode()).hexdigest() == hashlib.sha256("\n".join(x for x in text.split("\n") if x.startswith("own")).encode()).hexdigest()
    assert bitmaps[200].n_dropped == 200 and bitmaps[200].kept_text == ""


def test_empty_table_and_digest(docs):
    assert L.line_digest(docs([])).count() == 0
    got = L.line_digest(docs([(1, "a\nb")])).first()
    assert (got.doc_id, got.n_lines, got.n_dropped, got.kept_sha256) == (1, 2, 0, hashlib.sha256(b"a\nb").hexdigest())
