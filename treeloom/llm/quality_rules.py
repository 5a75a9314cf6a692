"""Quality rules: base counts of each text, and robust multivariate outliers
by minimum-covariance-determinant (MCD) estimates per language and source.

The counts come from whole texts.  A vector of variance-stabilised statistics
is compared with its group's MCD centre and scatter.  As no group fits into one
task, the search is FAST-MCD over distributed aggregates: three deterministic
starts (medians with quartile ranges, correlations of bounded scores, spatial
signs) take two concentration steps each; the start of least determinant goes
on, step by step, until no group's determinant falls any more.  A step keeps
the 75 % of a group's rows that are nearest and re-estimates mean and
covariance from them.  Scatter is scaled so that the median distance is the
chi-square median.  Counts that are zero in most texts get a fraction of one
count of hashed noise (randomised residuals), without which their scatter
would be singular.  Groups under ``least`` rows pool by language, then together.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm._bytes import SPACE, Words, mix, ngrams, text_slices
from treeloom.llm._store import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEEP, LEAST, TAIL = 0.75, 200, 1e-8
FIRST_STEPS, MOST_STEPS = 2, 40
QUANTILES = 10_000  # accuracy of a group's quantiles: 1 / 10000 of its rows
#: Guards against singular scatter, far below what the features vary.
SCALE_FLOOR = (0.02, 0.002, 0.005, 0.005, 0.005)
DIM = len(SCALE_FLOOR)
BROADCAST_GROUPS = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


SYMBOLS = _flags(b"#*$%&|<>")
UPPER = _flags(bytes(range(65, 91)))
MARKS = _flags(b"!,.;?")


def count_column(column) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {c: [] for c in COUNTS}
    for _, buf, offsets in text_slices(column):
        words = Words(buf, offsets, SPACE, False)
        points = words.points()
        total = lambda per_byte: np.diff(np.concatenate([[0], np.cumsum(per_byte)])[offsets])
        chars = np.concatenate([[0], np.cumsum(points[words.end] - points[words.start])])
        parts["n_words"].append(words.count)
        parts["word_chars"].append(np.diff(chars[words.first]))
        for name, flags in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_marks", MARKS)):
            parts[name].append(total(flags[buf]))
        raw, dup = buf.tobytes(), []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
            dup.append(len(lines) - len(set(lines)))
        parts["n_dup_lines"].append(np.array(dup, np.int64))
        repeat = np.zeros(words.docs, np.int64)
        if len(words.start) >= 8:
            owner = words.owner()
            grams = ngrams(words.hashes(), 8)
            at = np.flatnonzero(owner[: len(grams)] == owner[7:])  # windows inside one document
            keys = mix(grams[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(cover, at[twice], 1)
            np.add.at(cover, at[twice] + 8, -1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
            repeat = np.diff(covered[words.first])
        parts["n_repeat_words"].append(repeat)
    return {c: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for c, x in parts.items()}


def _count(batches):
    for batch in batches:
        found = count_column(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *[pa.array(found[c]) for c in COUNTS]], ["doc_id", "lang", "source", *COUNTS])


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def features(df: DataFrame) -> DataFrame:
    """x0..: mean word length, symbols, capitals, punctuation, repetition, each
    on a scale on which short and long texts vary alike."""
    n, c = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    noise = lambda k: F.shiftrightunsigned(F.xxhash64("doc_id", "n_words", "word_chars", F.lit(k)), 11).cast("double") / float(1 << 53)
    some = F.greatest(n, F.lit(1.0))
    return df.select(
        "*",
        ((c / some - 5.1) / F.sqrt(0.15 * 0.15 + 6.0 / some)).alias("x0"),
        (10 * F.sqrt((F.col("n_symbols") + noise(0)) / (c + 400))).alias("x1"),
        F.log((F.col("n_upper") + 3) / (0.018 * c + 3)).alias("x2"),
        F.log((F.col("n_marks") + 6) / (0.02 * c + 6)).alias("x3"),
        (4 * F.sqrt((F.col("n_repeat_words") + 8 * noise(1)) / (n + 100))).alias("x4"),
    )


PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
FIT = ["grp string", "start int", "logdet double", *[f"c{i} double" for i in range(DIM)], *[f"q{i}{j} double" for i, j in PAIRS]]
FIT_NAMES = [f.split()[0] for f in FIT]


def precision(cov: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(inverse, log-determinant, floored eigenvalues) of a scatter matrix,
    whose eigenvalues in units of ``SCALE_FLOOR`` are held at one or more."""
    unit = np.array(SCALE_FLOOR)
    values, vectors = np.linalg.eigh(cov / unit[:, None] / unit[None, :])
    held = np.maximum(values, 1.0)
    return (vectors / held) @ vectors.T / unit[:, None] / unit[None, :], float(np.log(held).sum()), int((values < 1.0).sum())


def _matrix(batch, name: str, r: int) -> np.ndarray:
    out = np.zeros((DIM, DIM))
    for i, j in PAIRS:
        out[i, j] = out[j, i] = batch.column(f"{name}{i}{j}")[r].as_py()
    return out


def _fits(rows: list[tuple]):
    """(grp, start, logdet, centre, precision) -> a batch of ``FIT``."""
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.float64()))]
    columns += [pa.array([float(r[3][i]) for r in rows]) for i in range(DIM)]
    columns += [pa.array([float(r[4][i, j] * (1 if i == j else 2)) for r in rows]) for i, j in PAIRS]
    return pa.RecordBatch.from_arrays(columns, FIT_NAMES)


def _starts(batches):
    """Medians and spreads (m, s), means and products of bounded scores (t, u)
    and products of spatial signs (v) -> three starts a group."""
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            grp = batch.column("grp")[r].as_py()
            centre, spread, mean = (np.array([batch.column(f"{k}{i}")[r].as_py() for i in range(DIM)]) for k in "mst")
            scored, signs = _matrix(batch, "u", r) - np.outer(mean, mean), _matrix(batch, "v", r)
            for k, shape in enumerate((np.eye(DIM), scored / np.sqrt(np.outer(d := np.maximum(np.diag(scored), 1e-9), d)), signs * DIM)):
                out.append((grp, k, 0.0, centre, precision(shape * np.outer(spread, spread))[0]))
        if out:
            yield _fits(out)


def _refit(batches):
    """Means and products (m, p) of the nearest rows -> their fit."""
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            mean = np.array([batch.column(f"m{i}")[r].as_py() for i in range(DIM)])
            inverse, logdet, _ = precision(_matrix(batch, "p", r) - np.outer(mean, mean))
            out.append((batch.column("grp")[r].as_py(), batch.column("start")[r].as_py(), logdet, mean, inverse))
        if out:
            yield _fits(out)


D2 = " + ".join(f"(x{i} - c{i}) * (x{j} - c{j}) * q{i}{j}" for i, j in PAIRS)


def estimate(rows: DataFrame, scratch: Scratch, join) -> DataFrame:
    """``rows``: (grp, x0..) -> one fit a group, by MCD (unscaled scatter).
    ``join(rows, small)`` joins on ``grp``."""
    start = rows.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), QUANTILES).alias(f"s{i}") for i in range(DIM)])
    start = scratch.put(start.select("grp", *[F.col(f"s{i}")[1].alias(f"m{i}") for i in range(DIM)], *[F.greatest((F.col(f"s{i}")[2] - F.col(f"s{i}")[0]) / 1.349, F.lit(SCALE_FLOOR[i])).alias(f"s{i}") for i in range(DIM)]))
    z = {i: (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(DIM)}
    scored = join(rows, start).select("*", *[z[i].alias(f"z{i}") for i in range(DIM)], *[F.tanh(z[i]).alias(f"h{i}") for i in range(DIM)])
    scored = scored.withColumn("length", F.greatest(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)), F.lit(1e-12)))
    sums = [*[F.first(f"{k}{i}").alias(f"{k}{i}") for k in "ms" for i in range(DIM)], *[F.avg(f"h{i}").alias(f"t{i}") for i in range(DIM)]]
    sums += [F.avg(F.col(f"h{i}") * F.col(f"h{j}")).alias(f"u{i}{j}") for i, j in PAIRS] + [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("length")).alias(f"v{i}{j}") for i, j in PAIRS]
    fits = scratch.put(scored.groupBy("grp").agg(*sums).mapInArrow(_starts, ", ".join(FIT)))

    def step(fits: DataFrame) -> DataFrame:
        near = join(rows, fits).withColumn("d2", F.expr(D2)).select("grp", "start", "d2", *[f"x{i}" for i in range(DIM)])
        cut = near.groupBy("grp", "start").agg(F.percentile_approx("d2", KEEP, QUANTILES).alias("cut"))
        near = join(rows, join(fits, cut.withColumnRenamed("start", "of")).where("start = of").drop("of")).where(f"{D2} <= cut")
        core = near.groupBy("grp", "start").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(DIM)], *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS])
        return scratch.put(core.mapInArrow(_refit, ", ".join(FIT)))

    def least(fits: DataFrame) -> DataFrame:
        return scratch.put(fits.groupBy("grp").agg(F.min_by(F.struct(*FIT_NAMES), F.struct("logdet", "start")).alias("best")).select("best.*"))

    for _ in range(FIRST_STEPS):
        fits = step(fits)
    best = least(fits)
    for _ in range(MOST_STEPS):
        new = step(best)
        falls = join(new.select("grp", F.col("logdet").alias("after")), best.select("grp", "logdet")).where("after < logdet - 1e-9")
        if falls.isEmpty():
            break
        best = least(new.unionAll(best))
    return best


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL, least: int = LEAST) -> DataFrame:
    """One row per input row: ``doc_id``, the base counts, ``base_failed``,
    ``distance`` (squared Mahalanobis distance; null if ``base_failed``) and
    ``kept``.  A null or empty text has no words and fails the base rules.
    Null languages and sources are a group of their own.  The estimates come
    from all rows that pass the base rules; if there are none, no distance is
    needed.  Columns besides the four named are not read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    counts = scratch.put(picked.mapInArrow(_count, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS)))
    lang, source = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    counts = features(counts.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    counts = counts.withColumns({"lang_key": lang, "pair_key": F.concat_ws("\x1f", lang, source)})
    # the finest group with enough rows; small ones pool by language, then together
    by_pair = counts.where("not base_failed").groupBy("lang_key", "pair_key").agg(F.count("*").alias("n"))
    by_lang = by_pair.where(F.col("n") < least).groupBy("lang_key").agg(F.sum("n").alias("m"))
    group = by_pair.join(by_lang, "lang_key", "left").select("pair_key", F.when(F.col("n") >= least, F.col("pair_key")).when(F.col("m") >= least, F.concat(F.lit("pool\x1f"), "lang_key")).otherwise("pool").alias("grp"))
    group = scratch.put(group)
    # one row a group: joined in the tasks that hold the documents while there are few
    few = group.count() <= BROADCAST_GROUPS
    join = lambda df, small, on="grp", how="inner": df.join(F.broadcast(small) if few else small, on, how)
    rows = scratch.put(join(counts.where("not base_failed"), group, "pair_key").select("grp", *[f"x{i}" for i in range(DIM)]))
    fits = estimate(rows, scratch, join)
    scale = join(rows, fits).groupBy("grp").agg((F.percentile_approx(F.expr(D2), 0.5, QUANTILES) / chi2_quantile(0.5, DIM)).alias("scale"))
    fits = scratch.put(join(fits, scale.withColumn("scale", F.greatest("scale", F.lit(1e-9)))))
    limit = chi2_quantile(1 - tail, DIM)
    placed = join(join(counts, group, "pair_key", "left"), fits, "grp", "left")
    out = placed.withColumn("distance", F.when(~F.col("base_failed"), F.expr(D2) / F.col("scale")))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"))
