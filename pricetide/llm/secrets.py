"""Secret scans by patterns and by a randomness test battery; DataFrame functions only.

Patterns find assignments, access keys and hex runs. The battery takes every maximal run of 20 or more characters of
``[A-Za-z0-9+/_-]`` that mixes letters and digits, with '=' at its end only (so the value of NAME=value is a run of its
own), infers its encoding (hex and lower-case base36, each whole or parted by '-' and '_', base32 or base64) and tests
its symbols against random ones: chi-squared uniformity over the alphabet (in the parts of ``CELLS``, so that short runs
expect some symbols in each), runs above and below the middle, and serial correlation. The three depend on one another,
so their sum of logarithms is held against that of simulated random strings of the encoding and length band: the p-value
is the share of these with a larger sum, uniform for random strings and small for others.

False-discovery control is by encoding and length band over all runs of the table. Each band's runs by p-value are joined
by those of its neighbouring bands at falling weight, and by ``PRIOR`` runs of which half are random; so a band of one run
has a decision, and one of many decides by itself. p-values above a half tell how many runs are random. What lies above
a cutoff beyond the random runs' share, less what chance explains, is taken as false; the smallest cutoff with at most
``FDR`` false ones is used, and never one below ``LEAST_P``.

Spans are (start, end) in code points, end exclusive. A null text is an empty one, without spans. Rows are independent
but for the cutoffs, so repeated rows, ties and extra columns need nothing more; long texts are scanned whole; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from functools import cache
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters in all
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
RUN = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/=_-]))?"  # '=' only as padding at the end: NAME=value is cut in two
FDR = 0.05
BINS = 100
LEAST_P = 0.03  # random runs are above it 97 times of 100
NONE = 2.0  # a cutoff above all p
LEAST_RUN, TOP_BAND = 20, 11  # symbols; longer runs are held against those of the top band (from 905 symbols)
SHORT = 40  # symbols; shorter runs are counted in fewer parts of the alphabet
#: Widths of these parts by the alphabet's size, for short runs and for others; they keep letters of a case and digits apart.
CELLS = {16: ([2] * 8, [1] * 16), 32: ([6, 7, 6, 7, 6], [3, 3, 3, 4, 3, 3, 3, 4, 3, 3]), 36: ([5] * 6 + [6], [2] * 18), 64: ([13] * 4 + [12], [6, 7] * 4 + [6, 6])}
PRIOR, PRIOR_TAIL, PRIOR_FALL = 20.0, 0.2, 0.02  # of its runs that aren't random, a fifth has p above 0.01, falling from there
NEIGHBOURS = {-2: 0.25, -1: 0.5, 1: 0.5, 2: 0.25}  # weights of the bands beside one
CHANCE = 1.64  # standard errors
SIMULATED = 400  # strings of each of eight lengths of a band
MATCHES = 64  # located together
MARK = "<SECRET>"

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by encoding: the pattern that infers it (the first that fits), and its symbols in order. What isn't in the
#: alphabet (padding, and the '-' and '_' of the parted ones) is in the span but isn't tested.
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)=*$", "0123456789abcdef"),
    "hex_parted": (r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f_-]+|[0-9A-F_-]+)=*$", "0123456789abcdef"),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", _UPPER + "234567"),
    "base36": (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+=*$", "0123456789" + _UPPER.lower()),
    "base36_parted": (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9_-]+=*$", "0123456789" + _UPPER.lower()),
    "base64": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+=*$", _UPPER + _UPPER.lower() + "0123456789+/"),
}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _located(pieces: Column, found: Column, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the matches that ``keep`` (of the index from 1) lets pass, from the pieces of text between them.

    Matches are located in blocks, so the work of a text with very many of them stays near their number.
    """
    width = lambda i: F.length(F.get(pieces, i - 1)) + F.length(F.get(found, i - 1))
    last = F.size(found)
    within = lambda b: F.sequence(b * MATCHES + 1, F.least((b + 1) * MATCHES, last))
    blocks = F.sequence(F.lit(0), F.floor((last - 1) / MATCHES).cast("int"))
    total = F.transform(blocks, lambda b: F.aggregate(within(b), F.lit(0), lambda n, i: n + width(i)))

    def begin(acc: Column, n: Column) -> Column:
        return F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.length(F.get(pieces, i - 1))
        end = start + F.length(F.get(found, i - 1))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        more = F.concat(acc["out"], span)
        return F.struct(end.alias("pos"), (F.when(keep(i), more).otherwise(acc["out"]) if keep else more).alias("out"))

    def spans(starts: Column) -> Column:
        zero = lambda b: F.struct(F.get(starts, b).alias("pos"), F.array().cast(_SPANS).alias("out"))
        return F.flatten(F.transform(blocks, lambda b: F.aggregate(within(b), zero(b), step, lambda acc: acc["out"])))

    return let(F.aggregate(total, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")), begin, lambda acc: acc["out"]), spans)


def _matches(text: Column, pattern: str, then: Callable[[Column, Column], Column]) -> Column:
    """then(pieces between matches, matches) where the pattern occurs, else no spans."""
    p = F.lit(pattern)
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, p, F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(both, lambda b: then(b["pieces"], b["found"]))).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and kind."""

    def assigned(pieces: Column, found: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda value: _located(pieces, found, 0, lambda i: F.length(F.get(value, i - 1)) >= LEAST_VALUE))

    spans = [_matches(text, ASSIGN, assigned)]
    spans += [_matches(text, p, lambda pieces, found, k=k: _located(pieces, found, k)) for k, p in ((1, ACCESS), (2, HEX))]
    return F.array_sort(F.concat(*spans))


def _upper_tail(z: Column) -> Column:
    """Chance of a normal value above z, by a logistic curve with a cubic term."""
    return F.greatest(1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z)), F.lit(1e-12))


def _row(rows: list[str], index: Column) -> Column:
    """One of several rows of numbers, which are written with commas between them."""
    return F.split(F.get(F.split(F.lit(";".join(rows)), ";"), index), ",").cast("array<double>")


def p_random(run: Column) -> Column:
    """Struct (encoding, length, p) of a run; null where no encoding is inferred."""
    names, alphabets = list(ENCODINGS), [a for _, a in ENCODINGS.values()]
    which = F.lit(None).cast("int")
    for k, (pattern, _) in reversed(list(enumerate(ENCODINGS.values()))):
        which = F.when(run.rlike(pattern), F.lit(k)).otherwise(which)

    def battery(k: Column) -> Column:
        name, alphabet = F.get(F.array(*map(F.lit, names)), k), F.get(F.array(*map(F.lit, alphabets)), k)
        symbols = F.rtrim(F.translate(run, "=-_", " +/"))
        codes = F.transform(F.split(F.when(F.startswith(name, F.lit("hex")), F.lower(symbols)).otherwise(symbols), ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        tested = let(F.filter(codes, lambda x: x >= 0), lambda x: F.struct(name.alias("encoding"), F.size(x).alias("length"), _p_value(x, k).alias("p")))
        return F.when(k.isNotNull(), tested)

    return let(which, battery)


def _joined(x: Column, size: Column, edges: Column) -> Column:
    """Minus the logarithms of the three tests' tails, summed. edges: of the parts of the alphabet."""
    n = F.size(x).cast("double")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    def part(s: Column) -> Column:
        low, high = F.get(edges, s), F.get(edges, s + 1)
        return F.pow(F.size(F.filter(x, lambda v: (v >= low) & (v < high))), F.lit(2.0)) / (high - low)

    df = F.size(edges) - 2
    chi2 = total(F.transform(F.sequence(F.lit(0), df), part)) * size / n - n
    z_chi = (F.pow(F.greatest(chi2, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    pairs = F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b"))
    runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] >= size / 2) != (p["b"] >= size / 2))).cast("double")

    def rest(of: Column) -> Column:
        m, high = of["m"], of["high"]
        spread = total(F.transform(x, lambda v: (v - m) * (v - m)))
        lag = total(F.transform(pairs, lambda p: (p["a"] - m) * (p["b"] - m)))
        z_lag = F.when(spread > 0, F.abs(lag / spread) * F.sqrt(n)).otherwise(10.0)
        both = 2 * high * (n - high)
        var = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(var > 0, F.abs(runs - both / n - 1) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(10.0)
        return -(F.log(_upper_tail(z_chi)) + F.log(F.least(2 * _upper_tail(z_runs), F.lit(1.0))) + F.log(F.least(2 * _upper_tail(z_lag), F.lit(1.0))))

    return let(F.struct((total(x) / n).alias("m"), F.size(F.filter(x, lambda v: v >= size / 2)).cast("double").alias("high")), rest)


def joined(x: np.ndarray, size: int) -> np.ndarray:
    """``_joined`` of each row of codes."""
    n = x.shape[1]
    tail = lambda z: np.maximum(1 / (1 + np.exp(np.minimum(1.5976 * z + 0.07056 * z**3, 700))), 1e-12)
    edges = np.cumsum([0, *CELLS[size][n >= SHORT]])
    df = len(edges) - 2
    chi2 = sum(np.count_nonzero((x >= a) & (x < b), axis=1) ** 2.0 / (b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)) * size / n - n
    z_chi = ((np.maximum(chi2, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    above = x >= size / 2
    high = np.count_nonzero(above, axis=1).astype(float)
    runs = 1 + np.count_nonzero(above[:, 1:] != above[:, :-1], axis=1)
    off = x - x.mean(axis=1, keepdims=True)
    spread, lag = (off**2).sum(axis=1), (off[:, 1:] * off[:, :-1]).sum(axis=1)
    z_lag = np.where(spread > 0, np.abs(lag / np.maximum(spread, 1e-300)) * np.sqrt(n), 10.0)
    both = 2 * high * (n - high)
    var = both * (both - n) / (n * n * (n - 1))
    z_runs = np.where(var > 0, np.abs(runs - both / n - 1) / np.sqrt(np.maximum(var, 1e-9)), 10.0)
    return -(np.log(tail(z_chi)) + np.log(np.minimum(2 * tail(z_runs), 1)) + np.log(np.minimum(2 * tail(z_lag), 1)))


@cache
def null_table(size: int, band: int) -> tuple[float, ...]:
    """Sums of random strings over an alphabet of so many symbols, in a length band: those exceeded by each hundredth."""
    r = np.random.default_rng([size, band + 100])
    low, high = LEAST_RUN * 2 ** (band / 2), LEAST_RUN * 2 ** ((band + 1) / 2)
    lengths = sorted({max(2, int(np.ceil(low + (high - low) * k / 8))) for k in range(8)})
    sums = np.concatenate([joined(r.integers(0, size, (SIMULATED, n)), size) for n in lengths])
    return tuple(float(f"{v:.5g}") for v in np.quantile(sums, 1 - np.arange(1, BINS) / BINS))


def _p_value(x: Column, which: Column) -> Column:
    """The share of simulated random strings with a larger sum, in steps of 1 / BINS."""
    sizes = [len(a) for _, a in ENCODINGS.values()]
    tables = [",".join(map(repr, null_table(size, band))) for size in sizes for band in range(-1, TOP_BAND + 1)]
    parts = [",".join(map(str, accumulate(widths, initial=0))) for size in sizes for widths in CELLS[size]]
    size = F.get(F.array(*map(F.lit, map(float, sizes))), which)
    table = _row(tables, which * (TOP_BAND + 2) + length_band(F.size(x)) + 1)
    inputs = F.struct(size.alias("size"), _row(parts, 2 * which + (F.size(x) >= SHORT).cast("int")).alias("edges"), table.alias("table"))
    return let(inputs, lambda of: let(_joined(x, of["size"], of["edges"]), lambda t: F.size(F.filter(of["table"], lambda v: v >= t)).cast("double") / BINS))


def length_band(length: Column) -> Column:
    """Half-octaves of the number of symbols tested, from 20 on; the last is open, as is the one below 20."""
    return F.least(F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)) / float(LEAST_RUN)) * 2), F.lit(-1)), F.lit(TOP_BAND)).cast("int")


def cutoffs(docs: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], float]:
    """The least p accepted, by encoding and length band, over all runs of docs (text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = docs.select(F.when(text.rlike(RUN), F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("runs")).where("runs is not null").select(F.explode("runs").alias("run"))
    tested = runs.select(p_random(F.col("run")).alias("t")).where("t is not null")
    bins = tested.select("t.encoding", length_band(F.col("t.length")).alias("band"), F.least(F.floor(F.col("t.p") * BINS + 0.5), F.lit(BINS - 1)).cast("int").alias("bin"))
    held: dict[tuple[str, int], list[float]] = defaultdict(lambda: [0.0] * BINS)
    for r in bins.groupBy("encoding", "band", "bin").count().collect():  # encodings x bands x bins
        held[r["encoding"], r["band"]][r["bin"]] = r["count"]
    return decided(held, fdr)


def prior_runs() -> list[float]:
    """``PRIOR`` runs by bin of p: half random, and half not."""
    above = [1.0, *(PRIOR_TAIL * math.exp(-(k - 1) / BINS / PRIOR_FALL) for k in range(1, BINS)), 0.0]
    return [PRIOR / 2 * (1 / BINS + above[k] - above[k + 1]) for k in range(BINS)]


def _cutoff(count: list[float], fdr: float) -> float:
    """The least p of at least LEAST_P with at most a share ``fdr`` of false runs; above 1 where there is none."""
    random = min(2 * sum(count[BINS // 2 :]), sum(count))
    for k in range(round(LEAST_P * BINS), BINS):
        accepted, share = sum(count[k:]), 1 - k / BINS
        chance = CHANCE * math.sqrt(accepted + 2 * random * share * share)
        if accepted - random * share - (chance if accepted - random * share < chance else 0) <= fdr * accepted:
            return k / BINS
    return NONE


def decided(held: dict[tuple[str, int], list[float]], fdr: float = FDR) -> dict[tuple[str, int], float]:
    """A cutoff for every band of held (runs by bin of p), with its neighbours' runs and the prior ones."""
    out = {}
    for encoding, band in held:
        beside = [(1.0, held[encoding, band]), *((w, held[encoding, band + d]) for d, w in NEIGHBOURS.items() if (encoding, band + d) in held), (1.0, prior_runs())]
        out[encoding, band] = _cutoff([sum(w * c[k] for w, c in beside) for k in range(BINS)], fdr)
    return out


def random_spans(text: Column, accept: dict[tuple[str, int], float]) -> Column:
    """Spans of the runs that the cutoffs accept."""
    if not accept:
        return F.array().cast(_SPANS)

    def chosen(run: Column) -> Column:
        def judged(t: Column) -> Column:
            out = F.lit(False)
            for (encoding, band), least in sorted(accept.items()):
                out = out | ((t["encoding"] == encoding) & (length_band(t["length"]) == band) & (t["p"] >= least))
            return F.coalesce(out, F.lit(False))

        return let(p_random(run), judged)

    return _matches(text, RUN, lambda pieces, found: let(F.transform(found, chosen), lambda ok: _located(pieces, found, 3, lambda i: F.get(ok, i - 1))))


def scan(docs: DataFrame, fdr: float = FDR, names: tuple[str, str] = ("base_spans", "all_spans")) -> DataFrame:
    """docs with two columns ``names`` (arrays of start, kind, end): the patterns' spans and all; such columns are replaced."""
    accept = cutoffs(docs, fdr)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base, every = names
    found = docs.withColumn(base, base_spans(text)).withColumn(every, random_spans(text, accept))
    return found.withColumn(every, F.array_sort(F.concat(base, every)))


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    of = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint")
    return scan(docs.select("doc_id", "text")).select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"), spelled(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame, fdr: float = FDR, mark: str = MARK) -> DataFrame:
    """docs with every span of its text replaced by a mark; spans that overlap get one. Other columns may have any name."""
    found = scan(docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row")), fdr)
    text, every = F.col("text"), F.col("all_spans")

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["pos"]
        out = F.when(apart, F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    clean = F.aggregate(every, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return found.select(F.col("row").withField("text", F.when(F.size(every) > 0, clean).otherwise(text)).alias("row")).select("row.*")
