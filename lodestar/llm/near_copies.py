"""What fingerprints miss of near copies: pairs by the exact Jaccard similarity of their sets of word shingles.

A helper of operator 7. Two rows are near copies when their sets of shingles have the similarity. Rows have an
order; a row is dropped when it is a near copy of a row before it that is kept. So no two rows that stay are
near copies, and each row that goes is one of a row that stays.

Candidates come from a prefix filter, which loses no pair: under one order of all shingles, two sets of
that similarity share a shingle among the first n - ceil(similarity n) + 1 of each, n being its size.
Shingles that are frequent in a sample come last, and before them those that more than COMMON rows would meet
in; any order gives the same result, this one keeps common passages out of the prefixes.

Pairs whose shingle parities differ in more places than the similarity allows are not compared in full.
Of the others, one for each row is compared before the rest, as most near copies fall by it.

Rows that share a prefix shingle meet in their order; each is compared with the first few of them only. A
row with no unseen row before it is decided; the others meet again among themselves, with more
comparisons, until none is left. A group of near copies falls in the first round, in linear work.

A text of fewer words is one shingle. Null and empty texts have none, and meet no other. Shingles are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, among, discard, grams, materialise, mix, slices

#: Texts in which frequent shingles are looked for, and how many of those are known.
SAMPLE, FREQUENT = 20_000, 1 << 17
#: Rows whose prefixes may hold a shingle before it counts as common; bits of the bitmap of common ones.
COMMON, COMMON_BITS = 8, 1 << 24
#: Rows of a shingle that others are compared with in the first round, and how that grows by round.
REACH, WIDEN = 8, 8
#: Counters, of one bit each, of a set's shingles: no more of them differ than shingles do.
PARITY = 512
#: Pairs made at once; shingles of pairs compared at once.
STRIPE, HELD = 1 << 18, 1 << 18


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within a text, and where each text's begin (and end)."""
    words = Words(texts)
    h, first, n_words = words.hashes(), words.first, words.counts()
    own = np.repeat(np.arange(len(texts)), n_words)
    at = np.flatnonzero(own[: len(h) - shingle + 1] == own[shingle - 1 :]) if len(h) >= shingle else np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < shingle))
    whole = [grams(h[first[i] : first[i + 1]], int(n_words[i]))[0] for i in short]
    g = np.concatenate([grams(h, shingle)[at], mix(np.array(whole, np.uint64) + n_words[short].astype(np.uint64))])
    text = np.concatenate([own[at], short])
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return g[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _with_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(at, shingles) of texts (at, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(*shingle_sets(part.column(1), shingle))], names=["at", "shingles"])

    return texts.mapInArrow(run, "at long, shingles array<long>")


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of texts, sorted, and their counts: at most FREQUENT of them."""
    every = -(-texts.count() // SAMPLE) or 1
    sample = _with_sets(texts.where(F.pmod(F.xxhash64("at"), F.lit(every)) == 0), shingle)
    counts = sample.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2)
    top = np.array([tuple(r) for r in counts.orderBy(F.col("n").desc(), "s").limit(FREQUENT).collect()], np.int64).reshape(-1, 2)
    top = top[np.argsort(top[:, 0].copy().view(np.uint64))]
    return top[:, 0].copy().view(np.uint64), top[:, 1]


def _taken(g: np.ndarray, offsets: np.ndarray, rank: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sets' shingles are their prefixes, in the order of rank, and how long these are."""
    n = np.diff(offsets)
    own = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((g, rank, own))
    length = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
    return order[np.arange(len(g)) - offsets[:-1][own] < length[own]], length


def _rank(g: np.ndarray, frequent: np.ndarray, times: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    """A shingle's place in the order: zero, one if it may be common, more if it is frequent in the sample."""
    rank = np.zeros(len(g), np.int64)
    if common is not None:
        slot = g & np.uint64(COMMON_BITS - 1)
        rank = (common[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(np.int64)
    if len(frequent):
        slot = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
        rank = np.where(frequent[slot] == g, times[slot] + 1, rank)
    return rank


def _common(texts: DataFrame, shingle: int, similarity: float, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A bitmap of the shingles that more than COMMON rows have in their prefixes by the sample's order. Others may be in it by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                g, offsets = shingle_sets(part.column(0), shingle)
                taken, _ = _taken(g, offsets, _rank(g, frequent, times, None), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(g[taken].view(np.int64))], names=["token"])

    often = texts.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON)
    slot = F.col("token").bitwiseAND(F.lit(COMMON_BITS - 1))
    words = materialise(often.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")), "common")
    bitmap = np.zeros(COMMON_BITS // 64, np.int64)
    for word, bits in words.collect():  # at most COMMON_BITS / 64 rows
        bitmap[word] = bits
    discard(words)
    return bitmap.view(np.uint64)


def prefixes(texts: DataFrame, shingle: int, similarity: float, fingerprint: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(at, id, fp, n, prefix, odd) of texts (at, id, text): fingerprint, size of the set, its prefix and its parities."""
    frequent, times = _frequent(texts.select("at", "text"), shingle)
    common = _common(texts, shingle, similarity, frequent, times)
    whole = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([whole("at"), texts.schema["id"], whole("fp"), whole("n"), *[T.StructField(name, T.ArrayType(T.LongType())) for name in ("prefix", "odd")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                g, offsets = shingle_sets(part.column(2), shingle)
                n = np.diff(offsets)
                own = np.repeat(np.arange(len(n)), n)
                taken, length = _taken(g, offsets, _rank(g, frequent, times, common), similarity)
                slots = own * PARITY + (mix(g) % np.uint64(PARITY)).astype(np.int64)
                odd = np.packbits(np.bincount(slots, minlength=len(n) * PARITY) & 1).view(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fingerprint(part.column(2)).view(np.int64)), pa.array(n, pa.int64()), _lists(g[taken], np.concatenate([[0], np.cumsum(length)])), _lists(odd, np.arange(len(n) + 1) * (PARITY // 64))],
                    names=["at", "id", "fp", "n", "prefix", "odd"],
                )

    return texts.mapInArrow(run, schema)


def _meet(batches: Iterator[pa.RecordBatch], reach: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows of one shingle, a among its first reach rows and before b, of sizes that allow the

    similarity; (-1, b) for each b with rows before it that it did not meet. Batches (token, at, n) are
    sorted by token and order; a token may go on in the next batch.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        old = len(held[0])
        token, at, n = (np.concatenate([held[i], batch.column(i).to_numpy(zero_copy_only=False)]) for i in range(3))
        if not len(token):
            continue
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        begin = np.repeat(edge, np.diff(np.append(edge, len(token))))
        place = np.arange(len(token)) - begin
        late = np.arange(old, len(token))[place[old:] >= reach]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(late), -1)), pa.array(at[late])], schema=schema)
        times = np.minimum(place, reach)
        times[:old] = 0
        total = np.cumsum(times)
        x = old
        while x < len(token):
            y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + STRIPE)))
            some = np.arange(x, min(y, len(token)))
            t = times[some]
            b = np.repeat(some, t)
            a = begin[b] + np.arange(len(b)) - np.repeat(np.cumsum(t) - t, t)
            fit = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(at[a[fit]]), pa.array(at[b[fit]])], schema=schema)
            x = y
        last = slice(edge[-1], min(edge[-1] + reach, len(token)))
        held = (token[last], at[last], n[last])


def _close(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose parities do not show more differences than the similarity allows."""
    both = pairs
    for k in "ab":
        both = both.join(sketches.select(F.col("at").alias(k), F.col("n").alias(f"n_{k}"), F.col("odd").alias(f"odd_{k}")), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (pc.list_flatten(batch.column(k)).to_numpy().view(np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
            yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= n * (1 - similarity) / (1 + similarity) + 1e-6))

    return both.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose sets have the similarity."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct()
    sets = materialise(_with_sets(among(texts, materialise(needed, "needed"), "at").select("at", "text"), shingle), "sets")
    both = pairs.join(sets.select(F.col("at").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("at").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [pc.list_value_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3)]
            total, at = np.cumsum(sizes[0] + sizes[1]), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD)))
                part, own, value = batch.slice(at, end - at), [], []
                for k in (2, 3):
                    own.append(np.repeat(np.arange(part.num_rows), sizes[k - 2][at:end]))
                    value.append(part.column(k).flatten().to_numpy())
                own, value = np.concatenate(own), np.concatenate(value)
                order = np.lexsort((value, own))
                own, value = own[order], value[order]
                common = np.bincount(own[1:][(own[1:] == own[:-1]) & (value[1:] == value[:-1])], minlength=part.num_rows)
                yield part.select([0, 1]).filter(pa.array(common >= similarity * (sizes[0][at:end] + sizes[1][at:end] - common) - 1e-9))
                at = end

    found = materialise(both.mapInArrow(run, "a long, b long"), "similar")
    discard(sets)
    return found


def _decide(links: DataFrame, late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (at) that links (a, b) to kept rows drop, and rows whose verdict waits for those of late (at)."""
    spark = links.sparkSession
    dropped = spark.createDataFrame([], "at long")
    while True:
        waiting = links.select(F.col("b").alias("at")).unionByName(late).distinct()
        fell = materialise(links.join(waiting.withColumnRenamed("at", "a"), "a", "left_anti").select(F.col("b").alias("at")).distinct(), "fell")
        if fell.isEmpty():
            return dropped, waiting
        dropped = dropped.unionByName(fell)
        late = late.join(fell, "at", "left_anti")
        links = materialise(_of_open(links, fell), "links")


def _of_open(pairs: DataFrame, fell: DataFrame) -> DataFrame:
    """Those pairs (a, b) of which neither row fell."""
    return pairs.join(fell.withColumnRenamed("at", "a"), "a", "left_anti").join(fell.withColumnRenamed("at", "b"), "b", "left_anti").select("a", "b")


def copies(live: DataFrame, sketches: DataFrame, texts: DataFrame, shingle: int, similarity: float, reach: int = REACH) -> DataFrame:
    """(at) of the rows that are near copies of a row before them that is kept.

    live: (token, at, n, no_id, id) for each shingle of each prefix, in whose order of no_id, id and at rows
    stand; sketches: as prefixes gives them; texts: (at, text).
    """
    dropped = []
    while True:
        met = live.repartition("token").sortWithinPartitions("token", "no_id", "id", "at").select("token", "at", "n").mapInArrow(lambda batches, reach=reach: _meet(batches, reach, similarity), "a long, b long")
        met = materialise(met.distinct(), "pairs")
        close = materialise(_close(met.where("a >= 0"), sketches, similarity), "close")
        late = materialise(met.where("a < 0").select(F.col("b").alias("at")), "late")
        discard(met)
        first = materialise(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
        rest = materialise(close.join(first, ["a", "b"], "left_anti"), "rest")
        links = _similar(first, texts, shingle, similarity)
        early = materialise(_decide(links, late.unionByName(rest.select(F.col("b").alias("at"))))[0], "early")
        more = _similar(_of_open(rest, early), texts, shingle, similarity)
        links = materialise(_of_open(links, early).unionByName(more), "similar")
        fell, waiting = _decide(links, late.join(early, "at", "left_anti"))
        dropped += [early, materialise(fell, "dropped")]
        waiting = materialise(waiting, "waiting")
        discard(close, first, rest, links)
        if waiting.isEmpty():
            break
        live = materialise(live.join(waiting, "at", "left_semi").select("token", "at", "n", "no_id", "id"), "tokens")
        reach *= WIDEN
    gone = dropped[0]
    for fell in dropped[1:]:
        gone = gone.unionByName(fell)
    return gone
