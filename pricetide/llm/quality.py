"""Quality rules, and robust multivariate outliers per language and source.

Base rules fail a text of few words, or one whose repeated three-word windows cover much of it. Over the texts that
pass, each group (language and source) gets a minimum-covariance-determinant estimate of location and scatter of the
transformed statistics; a text whose squared Mahalanobis distance is beyond the chi-squared cutoff is rejected.

The estimate has three fixed starts: medians and quartile ranges, the estimate that it leans on, and the moments of all
its rows. From each, concentration steps are made while the determinant falls: distances, the nearest share of the rows
(in whole bins of distance), and moments of those. Bins and leaning allow a step that raises it, which ends the start. The
least determinant of all counts, so no bound on the number of steps decides anything. All are aggregations over all rows
with partial sums before any shuffle, over whole numbers, so partitions and lost executors change no verdict. Every
language has its own estimate, which leans on ``PRIOR_ROWS`` rows that lie as the whole table's quartiles tell, and every
group, at every size, has one that leans on as many rows that lie as its language's estimate tells; so a group of a few
rows is judged nearly as its language, a large one by itself. A floor on each scatter keeps statistics that are constant in
clean text (no symbols, no repeats) from making tiny differences outliers.

Nulls: a null text has no words and fails; null language or source is a value of its own. Repeated rows
count once each and get the same verdict; ties in distance share a bin. Texts are measured whole, however long. Other
columns of docs pass through ``keep_good`` and are not looked at elsewhere. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm import kernel as K
from pricetide.session import cut

LEAST_WORDS, REPEAT_PERCENT = 50, 50
SHARE = 0.75  # of a group that the estimate rests on
PRIOR_ROWS = 30  # that lie as the language's, added to each group
UNIT = 10_000  # statistics are whole numbers of this part of one
BINS = 32  # of squared distances to a factor of two
BROADCAST_GROUPS = 50_000  # rows of estimates, three a group, about 10 MB; beyond that they are joined by a shuffle
TAIL = 1e-6  # of clean rows beyond the cutoff, were they normal
SYMBOLS = b"#*$%&|<>"

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def features() -> dict[str, tuple[Column, float]]:
    """Transformed statistics with the floors of their standard deviations."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": (F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))), 0.08),
        "symbols": (F.log1p(F.col("n_symbols") / n), 0.05),
        "repeated_lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.1),
        "repeated_words": (F.col("n_repeat_words") / n, 0.06),
    }


def _measure(part: K.Slice) -> dict[str, np.ndarray]:
    found = K.words(part)
    char = (part.data & 0xC0) != 0x80
    gram, at = K.grams(found, 3)
    text = found.text[at]
    order = np.lexsort((gram, text))
    same = (gram[order][1:] == gram[order][:-1]) & (text[order][1:] == text[order][:-1])
    again = np.append(same, False) | np.append(False, same) if len(order) else np.zeros(0, bool)
    covered = np.zeros(len(found.hashes), bool)
    for k in range(3):
        covered[at[order[again]] + k] = True
    dup, lines = [], []
    whole = part.data.tobytes()
    for lo, hi in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist(), strict=True):
        held = [x for x in whole[lo:hi].split(b"\n") if x.strip()]
        lines.append(len(held))
        dup.append(len(held) - len(set(held)))
    return {
        "n_words": found.counts,
        "word_chars": K.per_text(char & ~K.WHITE[part.data], part.bounds),
        "n_symbols": K.per_text(_symbol[part.data], part.bounds),
        "n_dup_lines": np.array(dup),
        "n_repeat_words": np.bincount(found.text[covered], minlength=part.hi - part.lo),
        "n_lines": np.array(lines),
    }


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_tag, lang, source and the counts of docs (doc_id, text, lang, source)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_tag", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in _counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_measure(part) for part in K.slices(batch.column("text"))]
            if found:
                kept = {c: batch.column(c) for c in ("doc_id", "text_tag", "lang", "source")}
                yield K.table(kept | {c: np.concatenate([x[c] for x in found]) for c in _counts}, schema)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_tag"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_tag bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _counts))


def _chi2_below(x: float, df: int) -> float:
    """Chance of a chi-squared value below x, for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_below(mid, df) < p else (lo, mid)
    return hi


def _distance(dims: int) -> Column:
    """Squared Mahalanobis distance of x0.. from centre c0.. with precision p00.."""
    total = F.lit(0.0)
    for i in range(dims):
        for j in range(i, dims):
            term = (F.col(f"x{i}") / UNIT - F.col(f"c{i}")) * (F.col(f"x{j}") / UNIT - F.col(f"c{j}")) * F.col(f"p{i}{j}")
            total = total + (term if i == j else 2 * term)
    return total


def bin_of(d2: Column) -> Column:
    """Squared distances by size, ``BINS`` to a factor of two."""
    return F.floor(F.log2(F.least(F.greatest(d2, F.lit(2.0**-20)), F.lit(2.0**40))) * BINS).cast("int")


def _estimates(rows: DataFrame, key: str, base: DataFrame, dims: int, floors: list[float], share: float, prior: float) -> DataFrame:
    """key, c0.. and k00.. and p00..: the location, scatter and precision of each key's rows; base has key, b0.. and v00.. to lean on.

    A start goes on while its determinant falls, and the least of all counts. Only keys with such a start are looked at again.
    """
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    scale = share / _chi2_below(chi2_quantile(share, dims), dims + 2)
    given = [*(f"b{i}" for i in range(dims)), *(f"v{i}{j}" for i, j in pairs)]
    names = [*(f"c{i}" for i in range(dims)), *(f"{k}{i}{j}" for k in "kp" for i, j in pairs)]
    head = [key, "start", "volume", *given, *names]
    ddl = f"{key} bigint, start int, volume double, " + ", ".join(f"{c} double" for c in [*given, *names])

    def held(r: dict, centre: str, scatter: str) -> tuple[np.ndarray, np.ndarray]:
        cov = np.zeros((dims, dims))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"{scatter}{i}{j}"]
        return np.array([r[f"{centre}{i}"] for i in range(dims)]), cov

    def row(r: dict, start: int, centre: np.ndarray, cov: np.ndarray, base: tuple[np.ndarray, np.ndarray]) -> list:
        whole = cov + np.diag(np.square(floors))
        p = np.linalg.inv(whole)
        flat = lambda m: (m[i, j] for i, j in pairs)
        return [r[key], start, round(float(np.linalg.slogdet(whole)[1]), 9), *base[0], *flat(base[1]), *centre, *flat(cov), *flat(p)]

    def mixed(n: float, centre: np.ndarray, cov: np.ndarray, base: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Location and scatter of n rows and ``prior`` rows that lie as the base tells."""
        off, w = centre - base[0], n / (n + prior)
        return w * centre + (1 - w) * base[0], w * cov + (1 - w) * base[1] + w * (1 - w) * np.outer(off, off)

    def moments(r: dict) -> tuple[np.ndarray, np.ndarray]:
        n, unit = int(r["n"]), float(UNIT)
        mean = np.array([int(r[f"m{i}"]) / n for i in range(dims)])
        cov = np.zeros((dims, dims))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = (n * int(r[f"s{i}{j}"]) - int(r[f"m{i}"]) * int(r[f"m{j}"])) / (n * n) / unit**2
        return mean / unit, cov

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            base, (centre, var) = held(r, "b", "v"), spread([r[f"q{i}"] for i in range(dims)])
            out.append(row(r, 0, *mixed(int(r["n"]), centre, np.diag(var), base), base))
            out.append(row(r, 1, *base, base))
            out.append(row(r, 2, *mixed(int(r["n"]), *moments(r), base), base))
        return pd.DataFrame(out, columns=head)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            base, (centre, cov) = held(r, "b", "v"), moments(r)
            out.append(row(r, r["start"], *mixed(int(r["n"]), centre, scale * cov, base), base))
        return pd.DataFrame(out, columns=head)

    def mapped(f):
        return lambda it: (f(pdf) for pdf in it if len(pdf))

    exact = lambda x: F.sum(x.cast("decimal(38,0)"))
    kinds = ["n", *(f"m{i}" for i in range(dims)), *(f"s{i}{j}" for i, j in pairs)]
    sums = [F.count("*").alias("n"), *(exact(F.col(f"x{i}")).alias(f"m{i}") for i in range(dims)), *(exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in pairs)]
    texts = [F.col(c).cast("string").alias(c) for c in kinds]
    own = rows.groupBy(key).agg(*sums, *_quartiles(dims)).select(key, *texts, *(f"q{i}" for i in range(dims)))
    params = cut(own.join(base, key).mapInPandas(mapped(first), ddl))
    few = params.count() <= BROADCAST_GROUPS
    beside = lambda df: F.broadcast(df) if few else df  # noqa: E731  a few rows a key
    state = [key, "start", "volume", *given, *names]

    def step(now: DataFrame) -> DataFrame:
        cells = rows.join(beside(now.select(key, "start", *names)), key).withColumn("bin", bin_of(_distance(dims))).groupBy(key, "start", "bin").agg(*sums)
        upto = Window.partitionBy(key, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        near = cells.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(key, "start"))).where(F.col("before") < F.ceil(share * F.col("all")))
        sum_up = near.groupBy(key, "start").agg(*(F.sum(c).alias(c) for c in kinds)).select(key, "start", *texts)
        return sum_up.join(beside(now.select(key, "start", *given)), [key, "start"]).mapInPandas(mapped(again), ddl)

    best = cut(step(params).withColumn("fell", F.lit(True)))
    while not (going := best.where("fell")).isEmpty():
        new = step(going).select(key, "start", F.struct(*state).alias("new"))
        fell = F.coalesce(F.col("new.volume") < F.col("volume"), F.lit(False))
        both = best.join(new, [key, "start"], "left")
        best = cut(both.select(key, "start", *(F.when(fell, F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in state[2:]), fell.alias("fell")))
    return best.groupBy(key).agg(F.min_by(F.struct(*names), F.struct("volume", "start")).alias("best")).select(key, "best.*")


def _quartiles(dims: int) -> list[Column]:
    return [F.percentile(f"x{i}", [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(dims)]


def spread(q: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Medians, and variances from quartile ranges."""
    return np.array([x[1] for x in q]) / UNIT, np.array([((x[2] - x[0]) / UNIT / 1.349) ** 2 for x in q])


def mcd_distances(rows: DataFrame, group: str, parent: str, dims: int, floors: list[float], share: float = SHARE, prior: float = PRIOR_ROWS) -> DataFrame:
    """rows (group, parent, x0.. bigint in 1 / UNIT) with ``d2``, the squared robust distance from the row's group.

    rows is read several times. Sums are of whole numbers and quantiles of binned ones, so the order in which partial
    results meet changes nothing.
    """
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    names = [*(f"c{i}" for i in range(dims)), *(f"p{i}{j}" for i, j in pairs)]
    every = rows.agg(*_quartiles(dims))
    middle = [(F.col(f"q{i}")[1] / UNIT).alias(f"b{i}") for i in range(dims)]
    wide = [(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / UNIT / 1.349, 2) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in pairs]
    whole = cut(every.select(*middle, *wide))  # one row
    parents = _estimates(rows.drop(group), parent, rows.select(parent).distinct().crossJoin(F.broadcast(whole)), dims, floors, share, prior)
    lean = parents.select(parent, *(F.col(f"c{i}").alias(f"b{i}") for i in range(dims)), *(F.col(f"k{i}{j}").alias(f"v{i}{j}") for i, j in pairs))
    best = _estimates(rows.drop(parent), group, rows.select(group, parent).distinct().join(lean, parent).drop(parent), dims, floors, share, prior).select(group, *names)
    few = cut(best)
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_GROUPS else few, group).withColumn("d2", _distance(dims)).drop(*names)


def quality_verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, text_tag, the counts, base_failed, distance (null where base_failed) and kept."""
    stats = cut(text_statistics(docs)).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    known = features()
    passed = stats.where("not base_failed").select("*", *(F.round(x * UNIT).cast("bigint").alias(f"x{i}") for i, (x, _) in enumerate(known.values())), F.xxhash64("lang", "source").alias("group"), F.xxhash64(F.lit("lang"), "lang").alias("parent"))
    floors = [f for _, f in known.values()]
    judged = mcd_distances(cut(passed), "group", "parent", len(floors), floors)
    edge = chi2_quantile(1 - tail, len(floors))
    columns = ["doc_id", "text_tag", *_counts, "base_failed"]
    none = F.lit(None).cast("double")
    failed = stats.where("base_failed").select(*columns, none.alias("distance"), F.lit(False).alias("kept"))
    return judged.select(*columns, F.col("d2").alias("distance"), (F.col("d2") <= edge).alias("kept")).unionByName(failed)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns, whatever their names."""
    good = quality_verdicts(docs).where("kept").select("doc_id", "text_tag").distinct()
    held = docs.select(F.col("doc_id").cast("bigint").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_tag"), F.struct(*docs.columns).alias("row"))
    return held.join(good, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_tag") == F.col("text_tag")), "left_semi").select("row.*")
