"""Operator 7, near duplicates by SimHash and vantage-point trees.

A fingerprint sums the bits of the hashes of a text's word shingles. Two fingerprints link when at
most MOST_BITS bits differ; a component is what links reach.

Only distinct fingerprints are searched, so copies cost one row. Fingerprints of unrelated texts all
lie about 32 bits apart, so a radius of MOST_BITS prunes next to nothing under the plain distance. But
of m bits that differ, some one of m // 2 + 1 blocks of bits holds one at most. So there is a
vantage-point tree for each block, whose metric is the Hamming distance within the block, and whose
radius is the least that some block must meet; what a tree brings together is compared in full.

* planting: the upper levels of each tree are fitted to a bounded sample. A node has a vantage point
  and shells of distance from it.
* shards: every fingerprint goes down each tree to the shell that is its home, and visits those lower
  shells that the triangle inequality does not rule out. The leaves are shards, dealt to Spark's tasks.
* branches: inside a task the same rule splits further. What lies within MOST_BITS of a vantage point
  is linked through it and not compared again; where the block's distances no longer differ, the
  distance of all bits takes over; branches of few rows are compared in full.

Each task returns a spanning forest of the links it found, never all pairs; components come from
propagating least labels with pointer jumping, on tables cut by writes. Nothing of this is collected
but the sample.

Null and empty texts have fingerprint zero, linked like any other. Null doc_ids have no part in a
component's smallest doc_id. Equal rows give equal rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies
from .common import Words, discard, materialise, slices, table, without

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: For dropping near duplicates: words of a shingle, and similarity of sets of shingles.
SET_SHINGLE, SIMILARITY = 5, 0.8
#: Rows at home in a shard, about; sampled fingerprints for each shard, and of all at most.
SHARD_ROWS, PER_SHARD, SAMPLE = 8192, 32, 1 << 17
#: Rows times rows that a branch compares in full; rows compared at once; visitors of a shard taken at once.
LEAF, STRIPE, VISITORS = 1 << 16, 64, 1 << 20
#: Members of a component that one member is linked to by a task.
FAN = 64
ALL_BITS = np.uint64((1 << 64) - 1)


# ---------------------------------------------------------------------------- fingerprints


def _fingerprints(texts: pa.Array, n: int, seed: int) -> np.ndarray:
    words = Words(texts)
    length = words.ends - words.starts
    # the words of all texts, one blank after each
    start = np.cumsum(length + 1) - length - 1
    take = np.repeat(words.starts - start, length + 1) + np.arange(int(length.sum()) + len(length))
    joined = words.data[np.minimum(take, max(len(words.data) - 1, 0))] if len(length) else np.zeros(0, np.uint8)
    joined[start + length] = 0x20
    data, end = joined.tobytes(), start + length
    out = np.zeros(len(texts), np.uint64)
    first = words.first
    digest = xxhash.xxh64_intdigest
    for i in np.flatnonzero(np.diff(first)):
        a, b = first[i], first[i + 1]
        m = max(b - a - n + 1, 1)
        froms, tos = start[a : a + m].tolist(), end[max(b - m, a) : b].tolist()
        h = np.array([digest(data[x:y], seed) for x, y in zip(froms, tos, strict=True)], "<u8")
        ones = np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > m, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Columns keep of docs and fp, the fingerprint as a long."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns([*map(str, range(batch.num_columns - 1)), "scanned"]), "scanned"):
                fp = _fingerprints(part.column(part.num_columns - 1), shingle, seed)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("scanned")).mapInArrow(run, schema)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------------------- shells


def blocks(most: int) -> tuple[list[np.uint64], int]:
    """Masks of the blocks of bits, and how many bits differ at most in some block of linked fingerprints."""
    n = most // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], most // n


def distances(fp: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fp ^ vantage) & mask).astype(np.int64)


def shells(d: np.ndarray, reach: int) -> np.ndarray:
    """Borders of shells that are 2 reach + 1 wide, one of them at the median; none if a shell holds all."""
    wide, low, high, middle = 2 * reach + 1, int(d.min()), int(d.max()), int(np.median(d))
    return np.arange(middle - (middle - low) // wide * wide, high, wide)


def visits(d: np.ndarray, borders: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shell of each distance, and the lowest and highest that the triangle inequality leaves open."""
    return np.searchsorted(borders, d), np.searchsorted(borders, d - reach), np.searchsorted(borders, d + reach)


# ---------------------------------------------------------------------------- search in a task


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) as a spanning forest, in which no fingerprint has more than FAN links to greater ones."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    order = np.argsort(label, kind="stable")
    first = np.searchsorted(label[order], label[order])
    place = np.arange(len(nodes)) - first
    up = order[first + np.maximum(place - 1, 0) // FAN]
    return nodes[order[place > 0]], nodes[up[place > 0]]


def _compare(home: np.ndarray, others: np.ndarray, most: int) -> tuple[list, list]:
    """Links between home and home or others, enough of them to connect what is linked."""
    us, vs = [], []
    for at in range(0, len(home), STRIPE):
        rows = home[at : at + STRIPE]
        columns = np.concatenate([home[at:], others])
        linked = np.bitwise_count(rows[:, None] ^ columns[None, :]) <= most
        some = np.flatnonzero(linked.any(axis=0))
        first = linked[:, some].argmax(axis=0)
        us.append(columns[some])
        vs.append(rows[first])
        for f in np.unique(first):  # rows that share a column are linked through it
            through = np.flatnonzero(linked[:, some[first == f]].any(axis=1))
            us.append(rows[through])
            vs.append(np.full(len(through), rows[f]))
    return us, vs


def branch(h: np.ndarray, w: np.ndarray, vantage: np.uint64, mask: np.uint64, reach: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Homes h and visitors w by shells around the vantage point; nothing where neither distance tells them apart."""
    best: list[tuple[np.ndarray, np.ndarray]] = []
    for m, r in ((mask, reach), (ALL_BITS, most)):
        d = distances(h, vantage, m)
        borders = shells(d, r)
        if not len(borders):
            continue
        own, low, _ = visits(d, borders, r)
        _, low_w, high_w = visits(distances(w, vantage, m), borders, r)
        parts = [(h[own == k], np.concatenate([w[(low_w <= k) & (k <= high_w)], h[(low <= k) & (k < own)]])) for k in range(len(borders) + 1)]
        parts = [p for p in parts if len(p[0])]
        if not best or _work(parts) < _work(best):
            best = parts
        if 4 * _work(best) < 3 * _work([(h, w)]):
            break
    return best


def _work(parts: list[tuple[np.ndarray, np.ndarray]]) -> int:
    return sum(len(h) * (len(h) + 2 * len(w)) for h, w in parts)


def links(home: np.ndarray, visitors: np.ndarray, mask: np.uint64 = ALL_BITS, reach: int = MOST_BITS, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links among home, and between home and visitors, that connect all those linked and within reach under the mask."""
    us, vs, branches = [home[:0]], [home[:0]], [(home, visitors)]
    while branches:
        h, w = branches.pop()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if len(h) * (len(h) + len(w)) > LEAF:
            vantage = h[len(h) // 2]
            near, near_w = distances(h, vantage, ALL_BITS) <= most, distances(w, vantage, ALL_BITS) <= most
            for x in (h[near], w[near_w]):
                us.append(x)
                vs.append(np.full(len(x), vantage))
            h, w = h[~near], np.concatenate([w, h[near & (h != vantage)]])
            if not len(h):
                continue
            parts = branch(h, w, vantage, mask, reach, most)
        if parts:
            branches += parts
        else:
            u, v = _compare(h, w, most)
            us += u
            vs += v
    u, v = np.concatenate(us), np.concatenate(vs)
    return _forest(u[u != v], v[u != v])


def _search(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of shards. Batches are sorted by shard, homes first; a shard may go on in the next batch."""
    masks, reach = blocks(most)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    own, home, away, new = -1, [], [], True  # new: the homes were not compared with each other yet

    def found() -> Iterator[pa.RecordBatch]:
        if home and (new or away):
            u, v = links(np.concatenate(home), np.concatenate([home[0][:0], *away]), masks[own >> TREE], reach, most)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    for batch in batches:
        shard, fp, at_home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp, at_home = fp.view(np.uint64), at_home.astype(bool)
        edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if shard[a] != own:
                yield from found()
                own, home, away, new = int(shard[a]), [], [], True
            x, y = fp[a:b][at_home[a:b]], fp[a:b][~at_home[a:b]]
            home += [x] if len(x) else []
            away += [y] if len(y) else []
            if sum(map(len, away)) > VISITORS:
                yield from found()
                away, new = [], False
    yield from found()


# ---------------------------------------------------------------------------- search over shards

#: A node: vantage point, mask, reach, borders of its shells, and the node of each shell; None is a leaf.
Node = tuple[np.uint64, np.uint64, int, np.ndarray, list[int]] | None
#: Shards are numbered from here on by tree.
TREE = 40


def plant(sample: np.ndarray, mask: np.uint64, reach: int, most: int, leaf: int = PER_SHARD) -> list[Node]:
    """A vantage-point tree whose leaves hold leaf of the sample at most, where distances tell them apart."""
    tree: list[Node] = [None]
    open_ = [(0, sample)]
    while open_:
        k, x = open_.pop()
        if len(x) <= leaf:
            continue
        for m, r in ((mask, reach), (ALL_BITS, most)):
            candidates = x[:: max(1, len(x) // 8)][:8]
            vantage = max(candidates, key=lambda v: distances(x, v, m).var())  # noqa: B023
            d = distances(x, vantage, m)
            borders = shells(d, r)
            if len(borders):
                own = np.searchsorted(borders, d)
                children = list(range(len(tree), len(tree) + len(borders) + 1))
                tree += [None] * len(children)
                tree[k] = (vantage, m, r, borders, children)
                open_ += [(c, x[own == i]) for i, c in enumerate(children)]
                break
    return tree


def deal(tree: list[Node], fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf that some fp reach: its number, those fp, and whether they are at home there."""
    stack = [(0, fp, np.ones(len(fp), bool))]
    while stack:
        k, x, home = stack.pop()
        if tree[k] is None:
            yield k, x, home
            continue
        vantage, mask, reach, borders, children = tree[k]
        own, low, high = visits(distances(x, vantage, mask), borders, reach)
        high = np.where(home, own, high)
        for i, c in enumerate(children):
            here = (low <= i) & (i <= high)
            if here.any():
                stack.append((c, x[here], home[here] & (own[here] == i)))


def forest(fps: DataFrame, most: int = MOST_BITS, shard_rows: int = SHARD_ROWS) -> list[list[Node]]:
    """A tree for each block of bits, fitted to a sample of fps (distinct, column fp)."""
    n = fps.count()
    wanted = min(SAMPLE, PER_SHARD * ceil(n / shard_rows))
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(ceil(wanted / max(n, 1) * (1 << 30)))
    sample = np.array([r.fp for r in fps.where(share).select("fp").limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    masks, reach = blocks(most)
    return [plant(np.sort(sample), m, reach, most) for m in masks]


def link_forest(fps: DataFrame, most: int = MOST_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (u, v) that connect all that fps (distinct, column fp) within most bits of each other connects."""
    trees = forest(fps, most, shard_rows)

    def dealt(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t, tree in enumerate(trees):
            for leaf, x, home in deal(tree, fp):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t << TREE | leaf)), pa.array(x.view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= 1 << 18:
                yield from dealt(np.concatenate(held))
                held = []
        if held:
            yield from dealt(np.concatenate(held))

    shards = fps.select("fp").mapInArrow(run, "shard long, fp long, home boolean")
    return shards.repartition("shard").sortWithinPartitions("shard", F.desc("home")).mapInArrow(lambda batches: _search(batches, most), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links (u, v) reach. Nodes without links are left out."""
    both = materialise(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = materialise(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "labels")
        if lower.where("moved").isEmpty():
            discard(both, lower)
            return labels
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = materialise(lower.join(up, "label").select("node", F.least("label", "up").alias("label")), "labels")
        discard(labels, lower)
        labels = jumped


def classes(fps: DataFrame, least: Column, most: int = MOST_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, first) of each distinct fingerprint of the table fps: the minimum of least over all rows that its links reach.

    Joins on a label that many rows share have written tables on both sides, so that adaptive execution
    can split them.
    """
    distinct = materialise(fps.groupBy("fp").agg(F.min(least).alias("first")), "distinct")
    labels = components(link_forest(distinct.select("fp"), most, shard_rows))
    named = materialise(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "named")
    first = materialise(named.groupBy("label").agg(F.min("first").alias("first")), "first")
    out = materialise(named.drop("first").join(first, "label").select("fp", "first"), "classes")
    discard(distinct, labels, named, first)
    return out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = MOST_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: its id, fp, and component_id, the smallest id that its links reach."""
    fps = materialise(fingerprints(docs, [id], text), "fingerprints")
    linked = classes(fps, F.col(id), most, shard_rows).withColumnRenamed("first", "component_id")
    return fps.join(linked, "fp").select(id, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SET_SHINGLE, similarity: float = SIMILARITY, most: int = MOST_BITS, reach: int = near_copies.REACH) -> DataFrame:
    """docs with one row of each group of near duplicates; columns as they are.

    Rows stand in order of id (nulls last), then of their place in the table. Of fingerprints that links
    reach, the first row stays. Sets of shingles with the least similarity differ in some ten bits, which no
    tree can search; so of the rows that stay, those whose sets have the similarity with a row that stands
    before them and is kept are found exactly, and go as well (see near_copies).
    """
    rows = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), "rows")
    texts = rows.select("at", F.col(f"row.`{id}`").alias("id"), F.col(f"row.`{text}`").cast("string").alias("text"))
    sketches = materialise(near_copies.prefixes(texts, shingle, similarity, lambda t: _fingerprints(t, shingle, SEED)), "sketches")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "at")
    found = classes(sketches.select("fp", "id", "at"), order, most)
    copied = materialise(sketches.select("fp", "at").join(found, "fp").where(F.col("at") != F.col("first.at")).select("at"), "copied")
    live = without(sketches, copied, "at").select(F.explode("prefix").alias("token"), "at", "n", F.col("id").isNull().alias("no_id"), "id")
    gone = copied.unionByName(near_copies.copies(live, sketches, texts.drop("id"), shingle, similarity, reach))
    discard(sketches, found)
    return without(rows, gone, "at").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
