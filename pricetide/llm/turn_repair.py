"""Cheapest repair of a conversation's structure, over a grammar that conversations share.

A repaired conversation's role initials have the form ``(s?(ua)+)?``. Every row is one symbol: its role's initial and its
fault. Four states tell what may come next, so a row is a 4 x 4 matrix of the least costs between states (minimum and
plus), each with the edits that give it, and a conversation is the product of its rows' matrices.

Re-Pair names the pairs of neighbouring symbols that are found most often, a batch a round, until none is found twice or
the rounds end; a pair's name then counts as a symbol itself. Every name is a rule with one matrix, the product of its two parts',
made once, bottom-up; its edits are a rope that points at theirs. A conversation multiplies what is left of its sequence,
so parts that many conversations share are never worked out again. The bounds on rounds and rules touch no
result, only how much is shared. Pairs are counted over all distinct sequences of the table.

Nulls: a null role or text is one space, a null turn comes first, a null conv_id is a conversation like others. Rows of
equal turn are taken by role and the hash of the text; repeated rows are duplicates. Equal costs go to the edits least in
ASCII. Texts of any length are whole; they are moved once and pass through a task one at a time. A conversation's
symbols, one byte a row, and its edits are cells; its repaired rows are a stream of one task, as their digest must be. Tables
without rows give none. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import stash

WHITE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5  # costs
SYMBOLS = "dsuaxSUAX"  # to be deleted; by initial (x: another); upper case: truncated
START, SYSTEM, USER, ASSISTANT = range(4)
BEFORE = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,), "x": ()}  # states that a kept initial may follow
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROUNDS, RULES = 12, 256  # of Re-Pair at most, and rules a round
PART = 4096  # symbols that are put together at once
CACHED, SHORT = 50_000, 64  # whole sequences whose edits a task remembers, and their longest
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]

Rope = str | tuple  # edits, or two ropes
Matrix = list[list[tuple[int, Rope] | None]]


# the algebra


def spelled(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += [x[1], x[0]]
    return "".join(out)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product of two matrices: least cost, then least edits."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            ways = [(x[0] + y[0], (x[1], y[1])) for m in range(4) if (x := a[i][m]) and (y := b[m][j])]
            if ways:
                cost = min(w[0] for w in ways)
                best = [w for w in ways if w[0] == cost]
                out[i][j] = best[0] if len(best) == 1 else min(((c, spelled(r)) for c, r in best), key=lambda w: w[1])
    return out


def _blank() -> Matrix:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def inserts() -> Matrix:
    """What may be put in between two rows: as few turns as lead from one state to another."""
    out = _blank()
    for i in range(4):
        j = ASSISTANT if i == USER else USER
        out[i][j] = (INSERT, "I")
        if i in (START, SYSTEM):
            out[i][ASSISTANT] = (2 * INSERT, "II")
    return out


def row_matrix(symbol: str) -> Matrix:
    """Inserts, then one row."""
    out: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if symbol != "d":
        more = UNFINISHED if symbol.isupper() else 0
        for i in range(4):
            out[i][ASSISTANT if i == USER else USER] = (REROLE + more, "R")
        for i in BEFORE[symbol.lower()]:
            out[i][AFTER[symbol.lower()]] = (KEEP + more, "K")
    return times(inserts(), out)


class Grammar:
    """Rules by round: pair of symbols -> name (a number) and rank; and the matrix of every symbol and rule."""

    def __init__(self) -> None:
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.matrices: list[Matrix] = [row_matrix(s) for s in SYMBOLS]
        self.end = inserts()

    def add(self, pairs: list[tuple[int, int]]) -> None:
        first = len(self.matrices)
        self.rounds.append({p: first + i for i, p in enumerate(pairs)})
        self.matrices += [times(self.matrices[a], self.matrices[b]) for a, b in pairs]

    def names(self, symbols: str) -> list[int]:
        """A sequence by its rules: in each round pairs are replaced from left to right, unless the next pair, which shares a symbol, ranks higher."""
        seq = [SYMBOLS.index(s) for s in symbols]
        for rules in self.rounds:
            out, i, n = [], 0, len(seq)
            while i < n:
                name = rules.get((seq[i], seq[i + 1])) if i + 1 < n else None
                if name is not None and i + 2 < n and rules.get((seq[i + 1], seq[i + 2]), name) < name:
                    name = None
                out.append(seq[i] if name is None else name)
                i += 1 if name is None else 2
            seq = out
        return seq

    def repair(self, symbols: str) -> tuple[int, str]:
        """Cost and edits of a sequence; matrices that are left are multiplied by neighbours, so ropes stay balanced."""
        ms = [self.matrices[x] for x in self.names(symbols)] or [_blank()]
        while len(ms) > 1:
            ms = [times(*ms[i : i + 2]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
        whole = times(ms[0], self.end)[START]
        return min((x[0], spelled(x[1])) for x in (whole[START], whole[ASSISTANT]) if x)


def learned(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> Grammar:
    """Re-Pair over all sequences (symbols), ``rules`` pairs a round at most, for ``rounds`` rounds at most."""
    grammar = Grammar()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for symbols in batch.column(0).to_pylist():
                seq, last, apart = grammar.names(symbols), None, True
                for pair in zip(seq, seq[1:], strict=False):
                    apart = not (apart and pair == last and pair[0] == pair[1])  # three alike are one pair, four are two
                    found[pair] += apart
                    last = pair
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int32()), pa.array([p[1] for p in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["a", "b", "n"])

    for _ in range(rounds):
        pairs = sequences.select("symbols").mapInArrow(counts, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
        most = pairs.orderBy(F.desc("n"), "a", "b").limit(rules).collect()  # at most ``rules`` rows
        if not most:
            break
        grammar.add([(r["a"], r["b"]) for r in most])
    return grammar


# the rows


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after seeded damage by crc32(conv_id:turn) modulo 20; what is dropped keeps a row without role."""
    at = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), at.alias("at"))
    kind = F.col("at")
    changed = rows.select(
        "conv_id", "turn",
        F.when(kind == 0, None).when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return changed.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


def _hashes() -> list[Column]:
    return [F.xxhash64("role", "text").alias("hash1"), F.xxhash64(F.lit(1), "role", "text").alias("hash2")]


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, symbols and the counts of rows (conv_id, turn, role, text) as ``damaged`` returns them.

    A row without role only names its conversation; other rows have a text.
    """
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    lean = rows.select("conv_id", "turn", "role", initial.alias("initial"), *_hashes(), (solid == "").alias("blank"), F.right(solid, F.lit(1)).isin(*STOPS).alias("closed"))
    own = lean.where("role IS NOT NULL").repartition("conv_id")
    by = [F.asc_nulls_first("turn"), "role", "hash1", "hash2"]
    alike = Window.partitionBy("conv_id", "hash1", "hash2").orderBy(*by)
    order = Window.partitionBy("conv_id").orderBy(*by, "again")  # of equal rows of a turn, the first is the one not said before
    again = own.withColumn("again", F.row_number().over(alike) > 1)
    placed = again.select(
        "conv_id", "turn", "initial", (F.row_number().over(order) - 1).alias("place"), F.lag("initial").over(order).alias("before"),
        F.col("blank").alias("is_blank"), (~F.col("blank") & F.col("again")).alias("is_duplicate"), (~F.col("blank") & ~F.col("again") & ~F.col("closed")).alias("is_truncated"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"),
    )
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = F.when(F.col("is_blank") | F.col("is_duplicate"), "d").when(F.col("is_truncated"), F.upper(letter)).otherwise(letter)
    wrong = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    text_of = lambda a, b: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(a, b))), lambda x: x[b]), "")
    parts = placed.withColumns({"symbol": symbol, "part": F.expr(f"place div {PART}")}).groupBy("conv_id", "part").agg(
        text_of("place", "symbol").alias("symbols"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_if("new_turn").alias("turns"),
        *(F.count_if(f"is_{c}").alias(c) for c in ("blank", "duplicate", "truncated")), F.count_if(wrong).alias("illegal"),
    )
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")]
    none = F.lit(None).cast("bigint")
    gone = lean.where("role IS NULL").select("conv_id").distinct().select("conv_id", none.alias("part"), F.lit("").alias("symbols"), none.alias("low"), none.alias("high"), *zeros)
    whole = parts.unionByName(gone).groupBy("conv_id").agg(text_of("part", "symbols").alias("symbols"), F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in ("turns", *COUNTS[1:])))
    return whole.select("conv_id", "symbols", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("bigint")).alias("gaps"), *COUNTS[1:])


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, the counts, cost and audit (K keep, R rerole, D delete, I insert) of rows (conv_id, turn, role, text)."""
    held = stash(sequences(rows), "sequences")
    grammar = learned(held.where("symbols <> ''").select("symbols").distinct())
    kept = held.sparkSession.sparkContext.broadcast(grammar)  # at most ROUNDS x RULES rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = lru_cache(CACHED)(kept.value.repair)
        for batch in batches:
            found = [solve(s) if len(s) <= SHORT else kept.value.repair(s) for s in batch.column("symbols").to_pylist()]
            columns = [batch.column(c) for c in ("conv_id", *COUNTS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["conv_id", *COUNTS, "cost", "audit"])

    return held.mapInArrow(run, "conv_id bigint, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "cost")) + ", audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows as events: ("audit", batch, row) begins a conversation, (edit, role, text) is a row of its repaired form."""
    audit, at, state = "", 0, START

    def step(edit: str, role: str, text: str) -> tuple | None:
        nonlocal state
        if edit == "D":
            return None
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = AFTER[role[0]]
        return edit, role, text

    def filled() -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield step("I", "", "")

    for batch in batches:
        heads, roles, texts = (batch.column(c).to_pylist() for c in ("is_head", "role", "text"))
        for i, head in enumerate(heads):
            if head:
                yield from filled()
                audit, at, state = texts[i], 0, START
                yield "audit", batch, i
            else:
                yield from filled()
                at += 1
                if done := step(audit[at - 1], roles[i], texts[i]):
                    yield done
        yield "batch", None, None
    yield from filled()


def _together(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, within a partition. Texts are moved here, once."""
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    facts = [*COUNTS, "cost"]
    own = rows.where("role IS NOT NULL").select("conv_id", F.lit(False).alias("is_head"), "turn", "role", *_hashes(), "text", *(none.alias(c) for c in facts))
    heads = found.select("conv_id", F.lit(True).alias("is_head"), none.alias("turn"), F.lit("").alias("role"), zero.alias("hash1"), zero.alias("hash2"), F.col("audit").alias("text"), *facts)
    order = ["conv_id", F.desc("is_head"), F.asc_nulls_first("turn"), "role", "hash1", "hash2"]
    return heads.unionByName(own).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "is_head", "role", "text", *facts)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the repaired conversations of rows (conv_id, turn, role, text)."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out = None, 0, []
        for a, b, c in _edited(batches):
            if a == "audit":
                conv, place = b.column("conv_id")[c].as_py(), 0
            elif a == "batch":
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
            else:
                out.append({"conv_id": conv, "place": place, "edit": a, "role": b, "text": c})
                place += 1
        yield pa.RecordBatch.from_pylist(out, schema)

    return _together(rows, repairs(rows)).mapInArrow(run, "conv_id bigint, place bigint, edit string, role string, text string")


def repair_digest(rows: DataFrame) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 (of ``role:text`` joined by line ends) of rows (conv_id, turn, role, text)."""
    fields = ["conv_id", *COUNTS, "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, empty, out = None, hashlib.sha256(), True, []
        schema = pa.schema([*((c, pa.int64()) for c in fields[:-1]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for a, b, c in _edited(batches):
            if a == "audit":
                if now:
                    out.append(now | {"repaired_sha256": state.hexdigest()})
                now = {f: b.column(f)[c].as_py() for f in fields[:-1]} | {"audit": b.column("text")[c].as_py()}
                state, empty = hashlib.sha256(), True
            elif a == "batch":
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
            else:
                state.update(("" if empty else "\n").encode() + f"{b}:{c}".encode())
                empty = False
        if now:
            out.append(now | {"repaired_sha256": state.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema)

    return _together(rows, repairs(rows)).mapInArrow(run, ", ".join(f"{c} bigint" for c in fields[:-1]) + ", audit string, repaired_sha256 string")
