"""Operator 4, benchmark decontamination by greedy string tiling.

A document and a test item are compared by tiles: the longest run of words that both have unmarked,
of TILE words at least, is marked in both, again and again, until no such run is left. The share of
the item's words under tiles is its coverage; reordered passages keep theirs, as tiles may come in
any order. A pair with a coverage of COVERAGE or more is reported.

Pairs to compare come from seeds, runs of TILE words that both have. A tile holds only seeds, and a
seed of an item lies over TILE words of it for each place it has there; so there is a least number of
distinct seeds that a document must share with an item, and no pair above the threshold is lost by
asking for it. For the same reason an item need not be found by its seeds that most other items have:
all but one less than that least number are enough, so wording common to a benchmark makes no pairs.

Bitmaps of the items' seeds, of fixed size, keep most other seeds of the documents from being shuffled;
what passes by chance falls out in the join. Only texts with enough seeds for some item are written
down and joined.

Items of fewer than TILE words have no seeds and are never reported. Null texts count as empty, null
ids are carried. Words are compared with A-Z in lower case. Rows that repeat an item_id are separate
items; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, grams, materialise, rolling, slices, table, without

TILE, COVERAGE = 5, 0.5
#: Bits of a bitmap of seeds, whatever the benchmark's size.
BITMAP_BITS = 1 << 24
#: Numbers of seeds that items ask for at least, as bitmaps tell them apart.
LEVELS = (1, 2, 4, 8)


def _seeds(words: Words, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word offset of each run of tile words inside a text."""
    h = words.hashes()
    own = np.repeat(np.arange(len(words.first) - 1), words.counts())
    if len(h) < tile:
        return np.zeros(0, np.uint64), own[:0], own[:0]
    at = np.flatnonzero(own[: len(h) - tile + 1] == own[tile - 1 :])
    return grams(h, tile)[at], own[at], at - words.first[own[at]]


def tiles(doc: np.ndarray, item: np.ndarray, tile: int = TILE) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of each tile, in the order they are marked.

    doc, item: hashes of words. Running Karp-Rabin: the length of the longest run that both have unmarked
    is found by bisection over rolling hashes of all unmarked runs of a length, and matches are compared
    word by word. In a round the longest matches are marked, those first in the item and then in the
    document before others. Matches are never listed as pairs of places, of which there may be many.
    """
    if len(item) < tile or len(doc) < tile:
        return []
    hit = np.flatnonzero(np.isin(grams(doc, tile), grams(item, tile)))
    if not len(hit):
        return []
    under = np.bincount(hit, minlength=len(doc) + 1) - np.bincount(hit + tile, minlength=len(doc) + 1)
    place = np.flatnonzero(np.cumsum(under)[: len(doc)] > 0)  # words under shared seeds; others are left out
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    place = np.insert(place, gap, -1)  # a marked word for each run of others
    words = np.where(place >= 0, doc[place], np.uint64(0))
    used_d, used_i = place < 0, np.zeros(len(item), bool)
    roll_d, roll_i = rolling(words), rolling(item)

    def runs(used: np.ndarray, roll: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the unmarked runs of n words."""
        marks = np.concatenate([[0], np.cumsum(used)])
        at = np.flatnonzero(marks[n:] == marks[: len(marks) - n]) if n < len(marks) else np.zeros(0, np.int64)
        return at, roll(at, n)

    def shared(n: int) -> bool:
        return len(np.intersect1d(runs(used_i, roll_i, n)[1], runs(used_d, roll_d, n)[1])) > 0

    out: list[tuple[int, int, int]] = []
    longest = min(len(item), len(words))
    while shared(tile):
        low, high = tile, longest
        if low < high and shared(high):
            low = high
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        longest = low
        (at_i, h_i), (at_d, h_d) = runs(used_i, roll_i, longest), runs(used_d, roll_d, longest)
        order = np.argsort(h_d, kind="stable")
        h_d, at_d = h_d[order], at_d[order]
        begin, end = np.searchsorted(h_d, h_i, "left"), np.searchsorted(h_d, h_i, "right")
        seen: dict[int, int] = {}  # by first place of a hash: places before are marked
        marked = False
        for k in np.flatnonzero(end > begin):
            i, first = int(at_i[k]), int(begin[k])
            if used_i[i : i + longest].any():
                continue
            at = seen.get(first, first)
            while at < end[k] and used_d[at_d[at] : at_d[at] + longest].any():
                at += 1
            seen[first] = at
            if at < end[k]:
                d = int(at_d[at])
                if (words[d : d + longest] == item[i : i + longest]).all():
                    used_i[i : i + longest] = used_d[d : d + longest] = marked = True
                    out.append((i, int(place[d]), longest))
        if not marked:  # hashes that agree by chance
            break
    return out


def item_seeds(items: DataFrame, tile: int, coverage: float, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Items (item, id, text) and their seeds (seed, item, least, entry).

    least: distinct seeds that a document shares with the item at least; entry: whether it is to be found by this one.
    """
    rows = materialise(items.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1))
                seed, own, _ = _seeds(words, tile)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), part.column(0).take(pa.array(own)), pa.array(words.counts()[own])], names=["seed", "item", "words"])

    each = materialise(rows.select("item", "text").mapInArrow(run, "seed long, item long, words long").groupBy("item", "seed").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("times")), "seeds")
    spread = materialise(each.groupBy("seed").agg(F.count(F.lit(1)).alias("items")), "spread")
    of_item = Window.partitionBy("item")
    least = F.greatest(F.ceil(coverage * F.col("words") / (tile * F.max("times").over(of_item)) - 1e-9), F.lit(1)).cast("long")
    place = F.row_number().over(of_item.orderBy(F.col("items").desc(), "seed"))
    ranked = each.join(spread, "seed").select("seed", "item", least.alias("least"), place.alias("place"))
    out = materialise(ranked.select("seed", "item", "least", (F.col("place") >= F.col("least")).alias("entry")), "seeds")
    discard(each, spread)
    return rows, out


def _bitmaps(seeds: DataFrame) -> np.ndarray:
    """For each of LEVELS the seeds of items that ask for no more than that, and last the entries: a row of bits each."""
    slot = F.col("seed").bitwiseAND(F.lit(BITMAP_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    above = [F.col("least") >= low for low in LEVELS]
    planes = [F.coalesce(F.bit_or(F.when(c, bit)), F.lit(0)) for c in (*[~x for x in above[1:]], F.lit(True), F.col("entry"))]
    found = seeds.withColumn("slot", slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(*[p.alias(f"b{k}") for k, p in enumerate(planes)])
    out = np.zeros((len(planes), BITMAP_BITS // 64), np.int64)
    for word, *bits in found.collect():  # at most BITMAP_BITS / 64 rows
        out[:, word] = bits
    return out.view(np.uint64)


def shared_seeds(docs: DataFrame, seeds: DataFrame, keep: list[str], text: str, tile: int) -> DataFrame:
    """(row, text, hits): the texts with as many seeds as some item asks for, perhaps, and those that are entries."""
    planes = _bitmaps(seeds)
    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in keep])), T.StructField("text", T.StringType()), T.StructField("hits", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seed, own, _ = _seeds(Words(part.column(1)), tile)
                hold = lambda plane, s: (plane[s >> np.uint64(6) & np.uint64(BITMAP_BITS // 64 - 1)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
                hit = hold(planes[-2], seed)
                pairs = np.unique(np.stack([own[hit].astype(np.uint64), seed[hit]], 1), axis=0)
                text_of, seed = pairs[:, 0].astype(np.int64), pairs[:, 1].copy()
                enough = np.zeros(part.num_rows, bool)
                for plane, low in zip(planes, LEVELS, strict=False):
                    enough |= np.bincount(text_of[hold(plane, seed)], minlength=part.num_rows) >= low
                entry = hold(planes[-1], seed) & enough[text_of]
                text_of, seed = text_of[entry], seed[entry]
                count = np.bincount(text_of, minlength=part.num_rows)
                some = np.flatnonzero(count)
                offsets = pa.array(np.concatenate([[0], np.cumsum(count[some])]), pa.int32())
                picked = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.ListArray.from_arrays(offsets, pa.array(seed.view(np.int64)))], names=["row", "text", "hits"])

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and item above the coverage: columns keep of docs, and

    item_id, coverage, item_words, covered_words, tiles (start in item, start in document, length).
    Input columns of those names are replaced.
    """
    added = ["item_id", "coverage", "item_words", "covered_words", "tiles"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows, seeds = item_seeds(items, tile, coverage, item_id, item_text)
    texts = materialise(shared_seeds(docs, seeds, keep, text, tile).withColumn("at_row", F.monotonically_increasing_id()), "seeded")
    entries = materialise(seeds.where("entry").select("seed", "item"), "entries")
    pairs = materialise(texts.select("at_row", F.explode("hits").alias("seed")).join(entries, "seed").select("at_row", "item").distinct(), "pairs")
    discard(seeds)
    full = pairs.join(texts.drop("hits"), "at_row").join(rows.withColumnRenamed("text", "item_text"), "item").select("row", "text", "id", "item_text")
    schema = T.StructType([texts.schema["row"], T.StructField("item_id", items.schema[item_id].dataType), T.StructField("item_words", T.LongType()), T.StructField("tiles", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_start", "start", "length")])))])
    of_tiles = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_start", "start", "length")]))

    def compared(doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
        """The tiles, where the item's words under shared seeds allow the coverage."""
        if len(item) < tile or len(doc) < tile:
            return []
        at = np.flatnonzero(np.isin(grams(item, tile), grams(doc, tile)))
        under = np.bincount(at, minlength=len(item) + 1) - np.bincount(at + tile, minlength=len(item) + 1)
        return tiles(doc, item, tile) if (np.cumsum(under) > 0).sum() >= coverage * len(item) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, item = Words(part.column(1)), Words(part.column(3))
                hd, hi = doc.hashes(), item.hashes()
                found = [compared(hd[doc.first[k] : doc.first[k + 1]], hi[item.first[k] : item.first[k + 1]]) for k in range(part.num_rows)]
                listed = pa.array([[{"item_start": a, "start": b, "length": n} for a, b, n in f] for f in found], of_tiles)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(item.counts()), listed], names=["row", "item_id", "item_words", "tiles"])

    covered = F.aggregate("tiles", F.lit(0).cast("long"), lambda acc, t: acc + t["length"])
    found = full.mapInArrow(run, schema).where(F.size("tiles") > 0).withColumn("covered_words", covered).withColumn("coverage", F.col("covered_words") / F.col("item_words"))
    return found.where(F.col("coverage") >= coverage).select(*[F.col(f"row.`{c}`") for c in keep], *added)


def decontaminate(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that cover an item. Rows are told apart by id and text."""
    key = F.concat_ws(":", F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("\0")), F.xxhash64(F.col(f"`{text}`")).cast("string")).alias("lodestar_key")
    found = materialise(contaminated(docs.select(key, F.col(f"`{text}`").alias("text")), items, ["lodestar_key"]).select("lodestar_key").distinct(), "contaminated")
    return without(docs.withColumn("lodestar_key", key), found, "lodestar_key").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "item_id", "coverage", "item_words", "covered_words", F.size("tiles").cast("long").alias("n_tiles"))
