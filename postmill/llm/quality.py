"""Quality rules as robust multivariate outliers.

Statistics of every text become five transformed numbers. For each language and source a minimum
covariance determinant estimate says where they lie. C-steps start from ``STARTS`` deterministic
estimates: medians and quartiles, and the same with the correlations of squashed values or of
directions. A step keeps the ``SUPPORT`` share of rows that is nearest by Mahalanobis distance and
estimates mean and covariance from it again, widened by the factor that makes it consistent for normal
data. After two steps the start with the least determinant goes on, until no group's determinant changes
by more than ``CONVERGED`` of itself. Distances shrink further where their median is beyond that of
chi-squared. A text is rejected beyond the chi-squared quantile ``CUTOFF``.

Estimates cover all rows and no group meets in one task: a C-step is one pass that sums counts and
products by (group, start, bin of distance), and the sums of the bins that are near enough are the new
estimate. Bins are narrow (``BINS`` to a doubling), and a bin is kept whole. Groups with fewer than
``MIN_GROUP`` rows are pooled by language, then over all languages; where even that is too small, no
text is an outlier. A statistic that varies less in a group than its own sampling error does
(``FLOORS``) counts as varying so much, else any other value would be an outlier.

Defined results: a null text has no words, so it fails the base rule; null languages and sources are
groups of their own; equal rows give equal rows; an empty table gives an empty result. New columns
replace columns of ``docs`` of the same name; all others but the text are kept, whatever their names. Texts of any length count whole, a
batch of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ._shared import mapped, remove, small_batches, table, written
from ._words import NOT_SPACE, Texts, mixed, per_text_sum, slices, span_hashes, window_hashes

SYMBOLS = b"#*$%&|<>"  #: Fixed value of the contract.
MIN_WORDS, REPEAT_PERCENT = 50, 50  #: Fixed values of the contract.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SUPPORT, MIN_GROUP, STARTS = 0.75, 50, 3
CONVERGED, MOST_STEPS = 0.02, 20
CONSISTENCY, MEDIAN, CUTOFF = 1.4121, 4.3515, 30.856  #: Fixed values: of chi-squared with five degrees of freedom, the factor at 0.75 and the quantiles 0.5 and 0.99999.
FLOORS = (0.1, 0.1, 0.15, 0.2, 0.15)  # least standard deviation of each transformed number
BINS = 32  # of distances, to a doubling


def text_stats(texts: Texts) -> list[np.ndarray]:
    """The five statistics of each text, in the order of STATS."""
    data, words = texts.data, texts.words(NOT_SPACE)
    per_byte = lambda flags: per_text_sum(texts.offsets, flags)
    inside = NOT_SPACE[data]
    chars = per_byte(inside & ((data & 0xC0) != 0x80))
    symbols = per_byte(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))

    owner = words.text_of()
    windows = window_hashes(words.hashes(), 3)
    windows = mixed(windows ^ owner[: len(windows)].astype(np.uint64))
    real = np.flatnonzero(np.arange(len(windows)) + 3 <= np.repeat(words.first[1:], words.counts)[: len(windows)])
    again = real[_repeated(windows[real])]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    repeated = per_text_sum(words.first, np.cumsum(cover)[:-1] > 0)

    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(texts.offsets[:-1][np.diff(texts.offsets) > 0], breaks + 1)
    starts = starts[starts < len(data)]
    text_of = np.searchsorted(texts.offsets, starts, "right") - 1
    at = np.searchsorted(breaks, starts)
    ends = np.minimum(texts.offsets[text_of + 1], np.append(breaks, len(data))[at])
    total = np.concatenate([[0], np.cumsum(inside)])
    full = total[ends] > total[starts]
    lines = mixed(span_hashes(data, starts[full], ends[full]) ^ text_of[full].astype(np.uint64))
    _, first = np.unique(lines, return_index=True)
    dups = np.bincount(text_of[full], minlength=len(words.counts)) - np.bincount(text_of[full][first], minlength=len(words.counts))
    return [words.counts, chars, symbols, dups, repeated]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five statistics."""
    small_batches(docs.sparkSession)
    rows = docs.drop(*STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [text_stats(t) for _, _, t in slices(b.column(b.schema.names.index(text)), lower=False)]
            own = [np.concatenate([*(p[k] for p in parts), np.empty(0, np.int64)]).astype(np.int64) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, own)], names=[*b.schema.names, *STATS])

    return mapped(rows, run, ", ".join(f"{s} bigint" for s in STATS))


def _vector() -> list[Column]:
    """The transformed numbers: logarithms of counts, and square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n) * 2,
        F.sqrt(F.least(F.col("n_symbols") / n, F.lit(4.0))),
        F.sqrt(F.log1p("n_dup_lines")) / 2,
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _distance(mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of x0..x4."""
    p = len(STATS)
    off = [F.col(f"x{i}") - mean[i] for i in range(p)]
    return reduce(lambda a, b: a + b, (off[i] * off[j] * inverse[i * p + j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)))


def floored(cov: np.ndarray) -> np.ndarray:
    """The covariance with each variance at its floor at least."""
    out = cov.copy()
    out[np.diag_indices(len(STATS))] = np.maximum(cov.diagonal(), np.array(FLOORS) ** 2)
    return out


def _full(q: np.ndarray) -> np.ndarray:
    """A symmetric matrix from its upper triangle, row by row."""
    out = np.zeros((len(STATS), len(STATS)))
    out[np.triu_indices(len(STATS))] = q
    return out + np.triu(out, 1).T


def nearest(bins: list[dict], share: float) -> list[dict]:
    """The bins, nearest first, with which ``share`` of the rows are reached."""
    bins = sorted(bins, key=lambda b: b["bin"])
    upto = np.cumsum([b["n"] for b in bins])
    return bins[: int(np.searchsorted(upto, np.ceil(share * upto[-1]))) + 1]


def started(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance to start from: a correlation of rows about ``mid``, with the scales ``sd``; start 0 has none."""
    cov = _full(np.array(row["q"]) / row["n"])
    if row["start"] == 0:
        cov = np.diag(cov.diagonal())
    scale = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
    return np.array(row["mid"]), floored(cov / np.outer(scale, scale) * np.outer(row["sd"], row["sd"]))


def stepped(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a group's nearest rows, widened so that it is consistent."""
    near = nearest(row["bins"], SUPPORT)
    n = sum(b["n"] for b in near)
    mean = np.sum([b["s"] for b in near], axis=0) / n
    return mean, floored(CONSISTENCY * (_full(np.sum([b["q"] for b in near], axis=0) / n) - np.outer(mean, mean)))


def _estimate(rows: DataFrame, of: Callable[[dict], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows of sums to each group's and start's mean, inverse covariance and determinant, and whether that still fell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                mean, cov = of(r)
                logdet = float(np.linalg.slogdet(cov)[1])
                out.append({"grp": r["grp"], "start": r["start"], "mean": mean.tolist(), "inverse": np.linalg.inv(cov).ravel().tolist(), "logdet": logdet, "fell": abs(r.get("was", np.inf) - logdet) > CONVERGED})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("grp", pa.string()), ("start", pa.int32()), ("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("logdet", pa.float64()), ("fell", pa.bool_())]))

    return rows.mapInArrow(run, "grp string, start int, mean array<double>, inverse array<double>, logdet double, fell boolean")


def _starts(rows: DataFrame) -> DataFrame:
    """The estimates that C-steps start from: no correlation, and those of squashed values and of directions."""
    p = len(STATS)
    middle = rows.groupBy("grp").agg(*(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(p)))
    sd = F.array(*(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(p)))
    middle = written(rows.sparkSession, middle.select("grp", F.array(*(F.col(f"q{i}")[1] for i in range(p))).alias("mid"), sd.alias("sd")), "middle")
    z = F.array(*((F.col(f"x{i}") - F.col("mid")[i]) / F.col("sd")[i] for i in range(p)))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c))
    direction = lambda v: let(length(v), lambda n: F.transform(v, lambda c: F.when(n > 0, c / n).otherwise(0.0)))
    kinds = let(z, lambda v: F.array(v, F.transform(v, F.tanh), direction(v)))
    each = rows.join(middle, "grp").select("grp", "mid", "sd", F.posexplode(kinds).alias("start", "v"))
    products = F.array(*(F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(p) for j in range(i, p)))
    return _estimate(each.groupBy("grp", "start").agg(F.first("mid").alias("mid"), F.first("sd").alias("sd"), F.count("*").alias("n"), products.alias("q")), started)


def _binned(rows: DataFrame, now: DataFrame, *sums: Column) -> DataFrame:
    """A row for each group and start: ``was`` and ``bins``, the counts and ``sums`` of its rows by bin of their distance."""
    each = rows.join(now.select("grp", "start", "mean", "inverse", F.col("logdet").alias("was")), "grp")  # a written table, so its size is known
    bins = F.floor(F.log2(_distance(F.col("mean"), F.col("inverse")) + 1e-6) * BINS)
    each = each.select("grp", "start", "was", bins.alias("bin"), *(f"x{i}" for i in range(len(STATS))))
    counted = each.groupBy("grp", "start", "was", "bin").agg(F.count("*").alias("n"), *sums)
    return counted.groupBy("grp", "start", "was").agg(F.collect_list(F.struct(*counted.columns[3:])).alias("bins"))  # as many as there are bins


def estimates(rows: DataFrame) -> DataFrame:
    """(grp, mean, inverse, spread) of each group of rows (grp, x0..x4); distances count as multiples of ``spread``."""
    spark, p = rows.sparkSession, len(STATS)
    x = [F.col(f"x{i}") for i in range(p)]
    sums = F.array(*(F.sum(c) for c in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p))).alias("q")
    now = written(spark, _starts(rows), "start")
    for k in range(MOST_STEPS):
        step = _estimate(_binned(rows, now, *sums), stepped)
        if k == 1:  # of two steps on, the start with the least determinant goes on alone
            step = step.groupBy("grp").agg(F.min(F.struct("logdet", "start", "mean", "inverse", "fell")).alias("best")).select("grp", "best.*")
        last, now = now, written(spark, step, "estimate")
        remove(spark, last)
        if k and now.where("fell").isEmpty():
            break

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            medians = [2 ** ((nearest(bins, 0.5)[-1]["bin"] + 0.5) / BINS) for bins in b["bins"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["grp"], pa.array([max(1.0, m / MEDIAN) for m in medians], pa.float64())], names=["grp", "spread"])

    return now.select("grp", "mean", "inverse").join(_binned(rows, now).select("grp", "bins").mapInArrow(spread, "grp string, spread double"), "grp")


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with the statistics, base_failed, distance (null where no estimate could be had) and kept."""
    spark = docs.sparkSession
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = with_stats(docs.drop("base_failed", "distance", "kept"), text).withColumn("base_failed", base_failed)
    name = lambda *c: F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("null")) for x in c)))
    # The caller's columns travel in one struct, so that none of their names meets another.
    others = [c for c in stats.columns if c not in (text, *STATS, "base_failed")]
    own_columns = F.struct(F.lit(0).alias("_"), *(F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(others)))
    narrow = stats.select(own_columns.alias("own"), *STATS, "base_failed", name(lang, source).alias("g2"), name(lang).alias("g1"), *(c.alias(f"x{i}") for i, c in enumerate(_vector())))
    narrow = written(spark, narrow, "stats")
    fit = narrow.where(~F.col("base_failed"))
    sizes = fit.groupBy("g2", "g1").count()
    small = F.col("count") < MIN_GROUP
    rest = F.sum(F.when(small, F.col("count"))).over(Window.partitionBy("g1"))
    grp = F.when(~small, F.col("g2")).when(rest >= MIN_GROUP, F.col("g1")).otherwise(F.lit("all"))
    groups = written(spark, sizes.select(F.col("g2").alias("of"), grp.alias("grp")), "groups")
    placed = narrow.join(groups, F.col("g2") == F.col("of"), "left").drop("of", "g1", "g2")
    own = estimates(placed.where(~F.col("base_failed")).select("grp", *(f"x{i}" for i in range(len(STATS)))))
    enough = placed.where(~F.col("base_failed")).groupBy("grp").count().where(F.col("count") >= MIN_GROUP).select("grp")
    own = written(spark, own.join(enough, "grp"), "estimates")
    judged = placed.join(own, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(F.col("mean"), F.col("inverse")) / F.col("spread")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return judged.select(*(F.col(f"own.c{i}").alias(c) for i, c in enumerate(others)), *STATS, "base_failed", "distance", kept.alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *STATS, "base_failed", "kept")


QUERIES = {"op7_quality": op7_quality}
ORACLE_SQL: dict[str, str] = {}
