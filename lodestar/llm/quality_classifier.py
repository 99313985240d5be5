"""Operator 1, quality classifier by ordinal cumulative-link regression.

Ratings become grades 0, 1, 2, ...; P(grade <= k) = sigmoid(threshold_k - s), where s sums one weight
for each distinct hashed feature of a text: its words, the shapes its words end in, and bins of its
counts. All grades share the weights, the thresholds are ordered, and a text gets its expected grade
and the probability of the top grade, by which it is selected.

The fit rests on at most SAMPLE rated texts, those with the least hashes of their ids, so it costs
the same at any size; weights shrink to zero unless the sample supports them (follow-the-regularised-
leader with an absolute penalty). Every text is scored, whole, by a map over the table.

Null and empty texts have features too (no words) and are scored. Ratings without a grade do not train;
ids that are rated twice train twice, rated ids without a text do not train. Without any rated text
all weights are zero, and all texts get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, slices, table
from .language_model import held_out
from .licenses import bare_words
from .quality_rules import count_texts

#: Rated texts the fit rests on, at most.
SAMPLE = 20_000
#: Hash bits of features; passes over the sample; texts between updates.
BITS, PASSES, BATCH = 18, 12, 16
#: Step, smoothing and penalties of the fit; the absolute penalty is per text of the sample.
STEP, SMOOTH, ABSOLUTE, SQUARE = 0.5, 1.0, 0.004, 0.1
#: Thresholds lie this far apart at least.
APART = 1e-3
#: Rarer grades count more, by this power of how rare they are; texts a feature must be in.
BALANCE, LEAST_TEXTS = 0.8, 8
#: A text is kept from this probability of the top grade on.
SELECT = 0.6
GRADES = 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct, in order of text."""
    words = bare_words(texts)
    n = len(texts)
    own = np.repeat(np.arange(n), words.counts())
    found = [(own, words.hashes())]
    # shapes: what a word ends in, whether it begins and goes on in capitals
    if len(words):
        end = np.minimum(words.ends, len(words.raw) - 1)
        last = np.where(words.ends < len(words.raw), words.raw[end], 32).astype(np.uint64)
        capital = lambda at: ((words.raw[at] >= 65) & (words.raw[at] <= 90)).astype(np.uint64)
        shape = last * np.uint64(4) + capital(words.starts) * np.uint64(2) + capital(words.ends - 1)
        found.append((own, mix(shape + np.uint64(1 << 40))))
    c = {k: v.astype(float) for k, v in count_texts(texts).items()}
    share = lambda a, b: c[a] / np.maximum(c[b], 1)
    bins = {
        "symbols": np.sqrt(share("n_symbols", "n_words")), "lines": np.sqrt(share("n_dup_lines", "n_lines")), "repeats": np.sqrt(share("n_repeat_words", "n_words")),
        "capitals": np.sqrt(share("n_capitals", "word_chars")), "marks": np.sqrt(share("n_marks", "n_words")), "variety": share("n_distinct", "n_words"), "words": np.log2(1 + c["n_words"]) / 8,
    }
    for k, v in enumerate(bins.values()):
        found.append((np.arange(n), mix(np.minimum(v * 8, 255).astype(np.uint64) + np.uint64((k + 2) << 40))))
    key = np.unique(np.concatenate([o.astype(np.uint64) << np.uint64(BITS) | h & np.uint64((1 << BITS) - 1) for o, h in found]))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds from the features and grade of each text.

    Features that fewer than LEAST_TEXTS of the texts have get no weight.
    """
    common = np.bincount(np.concatenate(rows), minlength=1 << BITS) >= min(LEAST_TEXTS, len(rows))
    rows = [r[common[r]] for r in rows]
    w, z, square = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)[:-1] / (len(grades) + n_grades)
    theta = np.log(share / (1 - share))
    balance = (len(grades) / (n_grades * (np.bincount(grades, minlength=n_grades) + 1.0))) ** BALANCE
    for turn in range(PASSES):
        order = np.random.default_rng(turn).permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = [len(rows[i]) for i in some]
            index = np.concatenate([rows[i] for i in some])
            of = np.repeat(np.arange(len(some)), sizes)
            s = np.bincount(of, w[index], minlength=len(some))
            y = grades[some]
            below = np.column_stack([np.zeros(len(some)), _sigmoid(theta[None, :] - s[:, None]), np.ones(len(some))])
            rows_ = np.arange(len(some))
            p = np.maximum(below[rows_, y + 1] - below[rows_, y], 1e-9)
            slope = below * (1 - below)
            g = (slope[rows_, y + 1] - slope[rows_, y]) / p  # of -log p by s
            step = np.zeros(n_grades + 1)
            np.add.at(step, y + 1, -balance[y] * slope[rows_, y + 1] / p)
            np.add.at(step, y, balance[y] * slope[rows_, y] / p)
            apart = APART * np.arange(len(theta))
            theta = np.maximum.accumulate(theta - 0.05 / np.sqrt(1 + turn) * step[1:-1] / len(some) - apart) + apart
            touched, where = np.unique(index, return_inverse=True)
            gradient = np.bincount(where, (g * balance[y])[of])
            grown = square[touched] + gradient**2
            z[touched] += gradient - (np.sqrt(grown) - np.sqrt(square[touched])) / STEP * w[touched]
            square[touched] = grown
            w[touched] = -np.sign(z[touched]) * np.maximum(np.abs(z[touched]) - ABSOLUTE * len(rows), 0) / ((SMOOTH + np.sqrt(grown)) / STEP + SQUARE)
    return w.astype(np.float32), theta


def rated(docs: DataFrame, ratings: DataFrame, id: str, grade: str, sample: int) -> DataFrame:
    """(text, grade) of the rated texts with the least hashes of their ids, sample at most."""
    picked = ratings.select(F.col(f"`{id}`").alias("r_id"), F.col(f"`{grade}`").cast("int").alias("grade"), F.xxhash64(F.col(f"`{id}`")).alias("h")).where(F.col("r_id").isNotNull() & F.col("grade").isNotNull())
    picked = picked.orderBy("h", "r_id", "grade").limit(sample)
    texts = docs.select(F.col(f"`{id}`").alias("d_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), F.col("d_id") == F.col("r_id")).select("h", "r_id", "grade", "text")


def train(sampled: DataFrame, n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """The fit, in one task, over a sample whose size is bounded."""
    found = sampled.mapInArrow(_featured, "h long, r_id long, grade int, features array<int>")

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            w, theta = np.zeros(1 << BITS, np.float32), np.arange(n_grades - 1, dtype=float) - 1
        else:
            t = t.sort_by([("h", "ascending"), ("r_id", "ascending"), ("grade", "ascending")])
            lists = t.column("features").combine_chunks()
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            w, theta = fit([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], t.column("grade").to_numpy().astype(np.int64), n_grades)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([theta.tobytes()])], names=["w", "theta"])

    w, theta = found.repartition(1).mapInArrow(fit_all, "w binary, theta binary").first() or (None, None)
    if w is None:
        return np.zeros(1 << BITS, np.float32), np.arange(n_grades - 1, dtype=float) - 1
    return np.frombuffer(w, np.float32), np.frombuffer(theta)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            own, feature = features(part.column(3))
            offsets = pa.array(np.searchsorted(own, np.arange(part.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(feature))], names=["h", "r_id", "grade", "features"])


def grade_texts(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, keep: list[str] | None = None, text: str = "text", select: float = SELECT) -> DataFrame:
    """Columns keep of docs (all by default), expected_grade, top_probability and kept.

    Input columns of those names are replaced.
    """
    added = ["expected_grade", "top_probability", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in keep])), T.StructField("expected_grade", T.DoubleType()), T.StructField("top_probability", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own, feature = features(part.column(1))
                s = np.bincount(own, weights[feature].astype(float), minlength=part.num_rows)
                above = 1 - _sigmoid(thresholds[None, :] - s[:, None])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, -1])], names=["row", *added[:2]])

    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)
    return found.select(*[F.col(f"row.`{c}`") for c in keep], *added[:2], (F.col("top_probability") >= select).alias("kept"))


def grade_of() -> Column:
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 0: poor; 1: good but toxic; 2: good; none where the labels leave it open. Ids held out as in operator 2 do not train."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratings = labels.where(~held_out(F.col("doc_id"))).withColumn("grade", grade_of())
    found = grade_texts(docs, *train(rated(docs, ratings, "doc_id", "grade", SAMPLE)), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "top_probability", "kept")
