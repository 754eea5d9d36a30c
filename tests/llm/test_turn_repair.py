import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from pricetide.llm import turn_repair as T

WHITE = " \t\n\x0b\x0c\r"
DDL = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """(cost, audit) of [(initial, fault)] by a search that takes the least cost and then the least edits first."""
    heap, done = [(0, "", 0, "")], set()
    follows = lambda shape, c: c in {"": "su", "s": "u", "u": "a", "a": "u"}[shape]
    while True:
        cost, audit, i, shape = heapq.heappop(heap)
        if i == len(rows) and shape in ("", "a"):
            return cost, audit
        if (i, shape) in done:
            continue
        done.add((i, shape))
        for c in "ua":
            if follows(shape, c):
                heapq.heappush(heap, (cost + 5, audit + "I", i, c))
        if i < len(rows):
            initial, fault = rows[i]
            more = 5 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, shape))
            if fault not in ("blank", "duplicate"):
                if follows(shape, initial):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial))
                for c in "ua":
                    if follows(shape, c):
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, c))


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        convs[c] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in own:
            solid = text.rstrip(WHITE)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = cheapest([(r[1][:1] or "x", f) for r, f in zip(own, faults, strict=True)])
        left, made, last = iter(own), [], ""
        for edit in audit:
            row = None if edit == "I" else next(left)
            if edit == "D":
                continue
            role = row[1] if edit == "K" else "assistant" if last == "u" else "user"
            last = role[0]
            made.append(f"{role}:{row[2] if row else ''}")
        out.append((c, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, DDL).selectExpr("*", *(f"'clash' AS {c}" for c in ("symbols", "part", "place", "audit", "cost", "is_head", "hash1", "at", "col", "initial", "edit")))


def found(spark, rows):
    cols = ["conv_id", *T.COUNTS, "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in T.repair_digest(T.damaged(table(spark, rows))).collect()), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_against_a_search(spark, monkeypatch, rounds):
    monkeypatch.setattr(T.learned, "__defaults__", (rounds, 3 if rounds == 1 else 256))
    monkeypatch.setattr(T, "PART", 7)
    r = random.Random(11)
    texts = ["All well.", "Really?", "cut off", "", " \t", None, "Yes!  \n", "a.b"]
    rows = [(c if c else None, t if t != 3 else None, r.choice(["user", "assistant", "system", "tool", "", None]), r.choice([*texts, f"own {t}."])) for c in range(60) for t in range(r.choice([1, 2, 5, 9, 30])) if r.random() < 0.9]
    assert found(spark, rows) == plain(rows)


def test_every_short_sequence_over_any_grammar():
    r = random.Random(2)
    grammar = T.Grammar()
    for _ in range(4):
        known = len(grammar.matrices)
        grammar.add(list({(r.randrange(known), r.randrange(known)) for _ in range(30)}))
    fault = lambda s: "blank" if s == "d" else "truncated" if s.isupper() else ""
    for n in (0, 1, 2, 3, 8, 40):
        for _ in range(60):
            s = "".join(r.choice(T.SYMBOLS) for _ in range(n))
            assert grammar.repair(s) == cheapest([(x.lower(), fault(x)) for x in s]), s


def test_rules_are_shared_and_bottom_up(spark):
    seqs = spark.createDataFrame([("suauauaua",), ("uauauaua",), ("uauax",)], "symbols string")
    grammar = T.learned(seqs)
    assert grammar.rounds and len(grammar.names("uauauaua")) <= 2
    assert len(grammar.matrices) == len(T.SYMBOLS) + sum(map(len, grammar.rounds))


def test_repaired_rows_and_a_long_conversation(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(9000)] + [(2, 0, "system", "Be kind."), (2, 1, "user", "word " * 200_000 + ".")]
    assert found(spark, rows) == plain(rows)
    made = T.repaired_turns(spark.createDataFrame([(5, 0, "user", "Hello."), (5, 1, "user", "Are you there?")], DDL)).collect()
    assert [(m.place, m.edit, m.role, m.text) for m in made] == [(0, "K", "user", "Hello."), (1, "R", "assistant", "Are you there?")]


def test_nothing_left_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "x")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert found(spark, []) == []
