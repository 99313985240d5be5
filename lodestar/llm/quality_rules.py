"""Operator 3, quality rules by robust multivariate outliers.

Counts of every whole text become a vector of transformed statistics. For each language and source a
minimum-covariance-determinant estimate describes the ordinary texts: from each of several robust
starts, each step orders the group by Mahalanobis distance, takes the nearest half of it, and estimates
mean and covariance from those, until the determinant falls no more. Of the starts, the one that ends
with the least determinant stands; mean and covariance of the texts near it are the group's estimate,
so junk below half of a group has no part in it. Languages and the whole corpus are estimated likewise,
and each estimate is drawn to the one above it as if that were PRIOR texts of the group: one of many texts
stays what it is, one of few is mostly its language's. The corpus itself is drawn to WIDE floors of
spread, so in a table of few texts only the wildest are far. A text whose distance from its group's
estimate exceeds CUTOFF is rejected; so is one that fails the base rules.

A step is one grouped aggregation: rows fall into bins of distance, each bin sums its vectors and
their products, and the bins below the support's share, the last of them in part, give the next one. So a group of any
size is spread over all tasks, and what meets in one place is some hundred bins of sums.

Null text counts as empty, and has no words; null language and source are groups of their own. An empty
table gives an empty result; equal rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, grams, materialise, mix, slices, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Base rules: fewer words than this, or a larger percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Share of a group that the steps rest on; a fall of the determinant's log below which they end; the
#: share of normal texts within the distance up to which texts count in the final estimate.
SUPPORT, CONVERGED, INSIDE = 0.5, 1e-3, 0.975
#: Squared Mahalanobis distance beyond which a text is rejected.
CUTOFF = 40.0
#: Texts that the estimate above a group's counts as; floors of spread of the prior of all.
PRIOR, WIDE = 100, 10.0
#: The vector: name, and the least standard deviation a group is credited with. Statistics that are
#: zero in most texts have no spread of their own, so a small departure must not count as far.
VECTOR = {
    "word_length": 0.08,  # log of code points per word
    "symbols": 0.07,  # root of symbols per word
    "repeated_lines": 0.2,  # root of the share of lines that repeat an earlier one
    "repeated_words": 0.2,  # root of the share of words in repeated windows
    "capitals": 0.08,  # root of capitals per code point
    "marks": 0.10,  # root of punctuation marks per word
    "variety": 0.25,  # log of distinct words per word, against the length
    "length": 0.9,  # log of words
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct")

_SYMBOL, _CAPITAL, _MARK = (np.isin(np.arange(256), list(x)) for x in (SYMBOLS, bytes(range(65, 91)), b".,;:!?"))


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    words = Words(texts, lower=False)
    raw, at, first, n = words.raw, words.spans, words.first, len(texts)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])
    in_word = np.zeros(len(raw) + 1, np.int8)
    in_word[words.starts] += 1
    np.add.at(in_word, words.ends, -1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    h, n_words = words.hashes(), words.counts()
    own = np.repeat(np.arange(n), n_words)  # the text of each word
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))

    covered = np.zeros(len(h) + 1, np.int32)
    if len(h) >= WINDOW:
        inside = np.flatnonzero(own[: len(h) - WINDOW + 1] == own[WINDOW - 1 :])
        g = grams(h, WINDOW)[inside] ^ salt[own[inside]]
        order = np.argsort(g)
        same = g[order[1:]] == g[order[:-1]]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(covered, inside[twice], 1)
        np.add.at(covered, inside[twice] + WINDOW, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    distinct = np.bincount(own[np.unique(h ^ salt[own], return_index=True)[1]], minlength=n) if len(h) else np.zeros(n, np.int64)

    lines = Lines(words)
    return {
        "n_words": n_words, "word_chars": sums(in_word & ((raw & 0xC0) != 0x80)), "n_symbols": sums(_SYMBOL[raw]),
        "n_dup_lines": lines.repeated(salt), "n_repeat_words": np.diff(repeated[first]), "n_lines": lines.n_lines,
        "n_capitals": sums(_CAPITAL[raw]), "n_marks": sums(_MARK[raw]), "n_distinct": distinct,
    }


class Lines:
    """The \\n-split lines of the texts behind some words, those with a word only."""

    def __init__(self, words: Words):
        raw, at = words.raw, words.spans
        breaks = np.flatnonzero(raw == 10)
        text_of = np.searchsorted(at, breaks, "right") - 1
        start = np.concatenate([at[:-1], breaks + 1])
        text = np.concatenate([np.arange(len(at) - 1), text_of])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        end = np.append(start[1:] - 1, 0)
        last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
        end = np.where(last, at[text + 1], end)[: len(start)]
        has_word = np.searchsorted(words.starts, end) > np.searchsorted(words.starts, start)
        self.start, self.end, self.text, self.words = start[has_word], end[has_word], text[has_word], words
        self.n_lines = np.bincount(self.text, minlength=len(at) - 1)

    def repeated(self, salt: np.ndarray) -> np.ndarray:
        """For each text, how many lines equal an earlier one."""
        if not len(self.start):
            return np.zeros(len(salt), np.int64)
        as_words = Words.__new__(Words)
        as_words.data, as_words.starts, as_words.ends = self.words.raw, self.start, self.end
        seen = np.unique(as_words.hashes() ^ salt[self.text], return_index=True)[1]
        return self.n_lines - np.bincount(self.text[seen], minlength=len(salt))


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep of docs, as a struct called row, and the counts of each text."""
    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in keep])), *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "scanned"):
                found = count_texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(found[c], pa.int64()) for c in COUNTS]], names=["row", *COUNTS])

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("scanned")).mapInArrow(run, schema)


def vector() -> Column:
    """The transformed statistics of a row of counts, as an array of doubles; null for no words."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    length = F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    parts = {
        "word_length": F.log(F.greatest(per("word_chars", "n_words"), F.lit(1.0))),
        "symbols": F.sqrt(per("n_symbols", "n_words")),
        "repeated_lines": F.sqrt(per("n_dup_lines", "n_lines")),
        "repeated_words": F.sqrt(per("n_repeat_words", "n_words")),
        "capitals": F.sqrt(per("n_capitals", "word_chars")),
        "marks": F.sqrt(per("n_marks", "n_words")),
        "variety": F.log(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double")) - length + 0.15 * length,
        "length": length,
    }
    return F.when(F.col("n_words") > 0, F.array(*[parts[k].cast("double") for k in VECTOR]))


def distance(x: Column, mean: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance; precision: the upper triangle, its off-diagonal doubled."""
    p, k, out = len(VECTOR), 0, F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            out = out + F.get(precision, F.lit(k)) * (F.get(x, F.lit(i)) - F.get(mean, F.lit(i))) * (F.get(x, F.lit(j)) - F.get(mean, F.lit(j)))
            k += 1
    return F.greatest(out, F.lit(0.0))


def _chi2(x: float, p: int) -> float:
    """The share of a chi-squared distribution of p (even) degrees of freedom below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def _chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, p) < share else (low, middle)
    return low


def _scale(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by to describe all of them."""
    p = len(VECTOR)
    return share / _chi2(_chi2_quantile(share, p), p + 2)


def _precision(cov: np.ndarray) -> tuple[list[float], float]:
    """The inverse, and the log of the determinant in floors, of cov with a variance of a squared floor at least in every direction."""
    floors = np.array(list(VECTOR.values()))
    scaled = cov / np.outer(floors, floors)
    values, vectors = np.linalg.eigh(scaled) if np.isfinite(scaled).all() else (np.ones(len(floors)), np.eye(len(floors)))
    values = np.maximum(values, 1.0)
    inverse = (vectors / values) @ vectors.T / np.outer(floors, floors)
    return [float(inverse[i, j] * (1 if i == j else 2)) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))], float(np.log(values).sum())


#: level: 2 for a language and source, 1 for a language, 0 for all; what does not tell groups of a level apart is null.
KEYS = ["level", "lang", "source"]
_KEYS = "level int, lang string, source string"
_STARTED = f"{_KEYS}, n long, mean array<double>, precision array<double>, start int, size double, moved boolean"
_MOMENTS = f"{_KEYS}, n long, m long, mean array<double>, cov array<double>"
#: Quantiles of each coordinate that the starts rest on.
_QUANTILES = [i / 20 for i in range(21)]


def _start(rows: DataFrame) -> DataFrame:
    """Starts of each group: the median with the interquartile spread, with the length of the shortest half as spread,

    the middle of the shortest half with its length, and that middle with the floors.
    """
    parts = [F.percentile_approx(F.get("x", F.lit(i)), _QUANTILES, 1000).alias(f"q{i}") for i in range(len(VECTOR))]
    spread = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *parts)

    def estimate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                q = np.array([list(getattr(r, f"q{i}")) for i in range(len(VECTOR))])
                wide = q[:, 10:] - q[:, :11]
                k, each = wide.argmin(1), np.arange(len(q))
                half, middle = wide[each, k] / 1.349, (q[each, k] + q[each, k + 10]) / 2
                for start, (mean, deviation) in enumerate([(q[:, 10], (q[:, 15] - q[:, 5]) / 1.349), (q[:, 10], half), (middle, half), (middle, 0 * half)]):
                    out.append((r.level, r.lang, r.source, r.n, mean.tolist(), _precision(np.diag(deviation**2))[0], start, math.inf, True))
            yield pd.DataFrame(out, columns=[*KEYS, "n", "mean", "precision", "start", "size", "moved"])

    return spread.mapInPandas(estimate, _STARTED)


def _with(rows: DataFrame, estimates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """rows with the columns of the estimate of their group, which are named e_ where rows has such ones; nulls are groups too."""
    e = estimates.select(*[F.col(c).alias(f"e_{c}" if c in (*keys, "n", "m") else c) for c in estimates.columns])
    on = [rows[k].eqNullSafe(e[f"e_{k}"]) for k in keys]
    return rows.join(e, on, "left")


def _sums(weight: Column | None = None) -> list[Column]:
    """Sums of a group's vectors and of their products."""
    p = len(VECTOR)
    x = lambda i: F.get("x", F.lit(i))
    of = lambda c: F.sum(c if weight is None else F.when(weight, c))
    return [of(x(i)).alias(f"s{i}") for i in range(p)] + [of(x(i) * x(j)).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]


def _moments(f: pd.DataFrame, weights: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from the sums in the rows of f, each with a weight; m: weighted number of vectors."""
    p = len(VECTOR)
    mean = np.array([(f[f"s{i}"].to_numpy() * weights).sum() for i in range(p)]) / m
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = (f[f"p{i}_{j}"].to_numpy() * weights).sum() / m - mean[i] * mean[j]
    return mean, cov


def _step(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimate from the nearest SUPPORT of each group; of the border bin, the share that completes it."""
    d = F.greatest(distance(F.col("x"), F.col("mean"), F.col("precision")), F.lit(2.0**-20))
    binned = _with(rows, estimates).withColumn("bin", F.least(F.floor(16 * F.log2(d)), F.lit(400)).cast("int"))
    bins = binned.groupBy(*KEYS, "start", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), *_sums())
    scale = _scale(SUPPORT)

    def estimate(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("bin")
        n = f["n"].to_numpy().astype(float)
        m = SUPPORT * n.sum()
        mean, cov = _moments(f, np.clip((m - (n.cumsum() - n)) / n, 0, 1), m)
        precision, size = _precision(cov * scale)
        return pd.DataFrame({**{k: [f[k].iloc[0]] for k in KEYS}, "n": [int(n.sum())], "mean": [mean.tolist()], "precision": [precision], "start": [f["start"].iloc[0]], "size": [size], "moved": [bool(size < f["size"].iloc[0] - CONVERGED)]})

    return bins.groupBy(*KEYS, "start").applyInPandas(estimate, _STARTED)


def _reweighted(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Number, mean and covariance of the rows within the quantile INSIDE of each estimate.

    Whether a row is inside is a column of its own: within each of the sums, every task would bind and compile the
    distance as often as there are sums. The mean goes by its coordinates, as an array makes tasks sort their rows.
    """
    scale, p = _scale(INSIDE), len(VECTOR)
    within = distance(F.col("x"), F.col("mean"), F.col("precision")) <= _chi2_quantile(INSIDE, p)
    told = _with(rows, estimates).withColumn("inside", within)
    means = [F.first(F.get("mean", F.lit(i))).alias(f"mean{i}") for i in range(p)]
    sums = told.groupBy(*KEYS).agg(F.first("e_n").alias("n"), F.count(F.when(F.col("inside"), 1)).alias("m"), *means, *_sums(F.col("inside")))

    def estimate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mean = f[[f"mean{i}" for i in range(p)]].to_numpy()
            found = [_moments(f.iloc[k : k + 1], np.ones(1), float(m)) if m else (mean[k], np.zeros((p, p))) for k, m in enumerate(f["m"])]
            yield f[[*KEYS, "n", "m"]].assign(mean=[list(mean) for mean, _ in found], cov=[(cov * scale).ravel().tolist() for _, cov in found])

    return sums.mapInPandas(estimate, _MOMENTS)


def _drawn(groups: DataFrame, above: DataFrame | None) -> DataFrame:
    """groups with mean and covariance drawn to those of the level above, as if that were PRIOR rows of each group."""
    floors = np.array(list(VECTOR.values()))
    wide = np.diag((WIDE * floors) ** 2).ravel().tolist()
    if above is None:
        joined = groups.withColumns({"mean_above": F.col("mean"), "cov_above": F.array(*map(F.lit, wide))})
    else:
        # the one of all has no language, so each language's is matched by a null
        level = above.select(F.col("lang").alias("lang_above"), F.col("mean").alias("mean_above"), F.col("cov").alias("cov_above"))
        of = F.when(F.col("level") > 1, F.col("lang"))
        joined = groups.join(level, of.eqNullSafe(F.col("lang_above"))).drop("lang_above")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            means, covs = [], []
            for r in f.itertuples(index=False):
                share, apart = r.m / (r.m + PRIOR), np.array(r.mean) - np.array(r.mean_above)
                means.append((np.array(r.mean_above) + share * apart).tolist())
                cov = share * np.array(r.cov) + (1 - share) * np.array(r.cov_above) + share * (1 - share) * np.outer(apart, apart).ravel()
                covs.append(cov.tolist())
            yield f[[*KEYS, "n", "m"]].assign(mean=means, cov=covs)

    return materialise(joined.mapInPandas(draw, _MOMENTS), "drawn")


def estimates(rows: DataFrame) -> DataFrame:
    """(lang, source, n, mean, precision) of each group of rows (lang, source, x)."""
    levels = [F.struct(F.lit(k).alias("level"), F.when(F.lit(k > 0), F.col("lang")).alias("lang"), F.when(F.lit(k > 1), F.col("source")).alias("source")) for k in range(3)]
    rows = materialise(rows.select(F.explode(F.array(*levels)).alias("g"), "x").select("g.*", "x"), "vectors")
    found, ended = materialise(_start(rows), "start"), []
    while True:
        stepped = materialise(_step(rows, found), "estimates")
        ended.append(stepped.where(~F.col("moved")))
        found = stepped.where("moved")
        if found.isEmpty():
            break
    every = ended[0]
    for f in ended[1:]:
        every = every.unionByName(f)
    best = every.groupBy(*KEYS).agg(F.min_by(F.struct("n", "mean", "precision"), F.struct("size", "start")).alias("e")).select(*KEYS, "e.*")
    raw = materialise(_reweighted(rows, materialise(best, "best")), "moments")
    discard(rows)  # the largest of the tables between; the others hold a row for each group
    drawn = None
    for k in range(3):
        drawn = _drawn(raw.where(F.col("level") == k), drawn)

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["lang", "source", "n", "mean"]].assign(precision=[_precision(np.array(c).reshape(len(VECTOR), -1))[0] for c in f["cov"]])

    return materialise(drawn.mapInPandas(invert, "lang string, source string, n long, mean array<double>, precision array<double>"), "precisions")


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Columns keep of docs (all by default), counts, distance, base_failed and kept.

    Estimates rest on all texts that pass the base rules. Where keep holds the text, the texts are
    read a second time for the verdicts, as the counts alone are written down. Input columns named
    as those added are replaced.
    """
    keep = list(docs.columns if keep is None else keep)
    narrow = [c for c in dict.fromkeys([*keep, lang, source]) if c != text]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))

    def counted(columns: list[str]) -> DataFrame:
        found = text_counts(docs, columns, text).withColumn("base_failed", failed).withColumn("x", vector())
        return found.withColumns({"lang": F.col(f"row.`{lang}`").cast("string"), "source": F.col(f"row.`{source}`").cast("string")})

    seen = materialise(counted(narrow), "counts")
    found = estimates(seen.where(~F.col("base_failed")).select("lang", "source", "x"))
    every = seen if text not in keep else counted(list(dict.fromkeys([*keep, lang, source])))
    far = distance(F.col("x"), F.col("mean"), F.col("precision"))
    added = [*COUNTS, "distance", "base_failed", "kept"]
    return _with(every, found, ["lang", "source"]).withColumn("distance", far).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).select(*[F.col(f"row.`{c}`") for c in keep if c not in added], *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
