"""Operator 10, sharding by histogram sort. DataFrame functions only.

Every row has a key: the hash of its text, then the hash of its other columns, as 32 hexadecimal
digits, so equal texts are neighbours and a group of copies of any size still has places to be cut.
The job looks for splitters of that key space: it counts exact bytes and rows of the cells below
candidate boundaries (one grouped count over all partitions), takes for each target the nearest
boundary, and probes again, with finer candidates, only inside the cells whose weight exceeds the
tolerance. When all splitters meet it, the rows move once, by splitter interval, and are numbered.

What the driver holds is a histogram: 65,536 cells at first, then 256 for each cell still too heavy;
there are at most shards x parts + shards of those, whatever the input.

Null text: no bytes, and it sorts as the empty text. Equal rows are interchangeable; an empty table
gives an empty result; input columns called shard or slot are replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty

LAW = "bytes"
#: Hexadecimal digits of a key, of the first probes, and of each finer round.
DIGITS, FIRST, FINER = 32, 4, 2
#: A splitter may miss its byte target by this share of a shard.
TOLERANCE = 0.002
#: Rows of one shard are numbered in this many parts at least and at most, of about PART_BYTES.
PARTS, MOST_PARTS, PART_BYTES = 32, 4096, 256 << 20


def sort_key(df: DataFrame, text: str = "text") -> Column:
    """Hash of the text, then of all other columns; maps cannot be hashed and are left out."""
    rest = [F.col(f"`{f.name}`") for f in df.schema if f.name != text and "map<" not in f.dataType.simpleString()]
    return F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (F.xxhash64(text_or_empty(text)), F.xxhash64(*rest) if rest else F.lit(0).cast("long"))])


def byte_size(text: str = "text") -> Column:
    return F.octet_length(text_or_empty(text)).cast("long") + 8


def find_splitters(keys: DataFrame, shards: int, parts: int | None = None, tolerance: float = TOLERANCE) -> list[tuple[str, int, int]]:
    """(smallest key, shard, rows of the shard before it) of each interval, in key order.

    keys: columns key and size. Refines the histogram until each byte splitter is within tolerance
    of its target, or the cell it lies in is one row or one key.
    """
    count = lambda df, digits: [tuple(r) for r in df.groupBy(F.substring("key", 1, digits).alias("cell")).agg(F.sum("size"), F.count(F.lit(1))).collect()]

    cells, digits = sorted(count(keys, FIRST)), FIRST
    total_bytes, total_rows = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not total_rows:
        return [("", 0, 0)]
    parts = parts or min(MOST_PARTS, max(PARTS, math.ceil(total_bytes / shards / PART_BYTES)))
    # (bytes or rows, target, tolerance): shards by bytes, the parts they are numbered in by rows
    wanted = [(1, total_bytes * i / shards, tolerance * total_bytes / shards) for i in range(1, shards)]
    wanted += [(2, total_rows * i / (shards * parts), total_rows / (2 * shards * parts)) for i in range(1, shards * parts)]

    shard_cuts: list[tuple[str, int]] = []  # (smallest key above, rows below)
    part_cuts: list[tuple[str, int]] = []
    open_cells = {"": (cells, (0, 0), wanted)}
    while open_cells:
        heavy: dict[str, tuple[tuple, list]] = {}
        for cells, start, targets in open_cells.values():
            sums = []
            at = start
            for c in cells:
                sums.append(at)
                at = (at[0] + c[1], at[1] + c[2])
            for target in targets:
                measure, value, most = target
                i = bisect_right(sums, value, key=lambda s: s[measure - 1]) - 1
                cell, low = cells[max(i, 0)], sums[max(i, 0)]
                under, over = value - low[measure - 1], low[measure - 1] + cell[measure] - value
                if min(under, over) > most and cell[2] > 1 and digits < DIGITS:
                    heavy.setdefault(cell[0], (low, []))[1].append(target)
                    continue
                j = max(i, 0) + (over < under)
                cut = (cells[j][0], sums[j][1]) if j < len(cells) else None
                if cut is None:  # the boundary above the last cell of this group
                    cut = (_after(cell[0]), low[1] + cell[2])
                (shard_cuts if measure == 1 else part_cuts).append(cut)
        if not heavy:
            break
        finer = min(DIGITS, digits + FINER)
        inside: dict[str, list] = {}
        for c in count(keys.where(F.substring("key", 1, digits).isin(list(heavy))), finer):
            inside.setdefault(c[0][:digits], []).append(c)
        open_cells = {cell: (sorted(inside[cell]), low, targets) for cell, (low, targets) in heavy.items()}
        digits = finer

    shard_cuts.sort()
    first = [""] + [c[0] for c in shard_cuts]
    rows = [0] + [c[1] for c in shard_cuts]
    out: dict[str, tuple[int, int]] = {}
    for key, under in [("", 0), *shard_cuts, *part_cuts]:
        shard = bisect_right(first, key) - 1
        out[key] = (shard, under - rows[shard])
    return [(k, s, r) for k, (s, r) in sorted(out.items())]


def _after(cell: str) -> str:
    """The least key above all keys that begin with cell."""
    return f"{int(cell, 16) + 1:0{len(cell)}X}" if set(cell) != {"F"} else "G"


def interval_of(key: Column, starts: list[str]) -> Column:
    """How many starts are at or below key: a binary search, as SQL functions.

    The sorted starts are one folded literal.
    """
    found = F.split(F.lit(",".join(starts)), ",")
    steps = max(1, math.ceil(math.log2(len(starts) + 1)))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        go, up = acc["lo"] < acc["hi"], F.get(found, mid) <= key
        return F.struct(F.when(go & up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(go & ~up, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(starts)).alias("hi")), step, lambda acc: acc["lo"])


def histogram_sort(docs: DataFrame, shards: int = 24, text: str = "text", parts: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """All rows of docs with shard (0 to shards - 1, near equal in bytes) and slot (gapless from 0)."""
    cuts = find_splitters(materialise(docs.select(sort_key(docs, text).alias("key"), byte_size(text).alias("size")), "keys"), shards, parts, tolerance)
    at = lambda values, i: F.get(F.split(F.lit(",".join(map(str, values))), ","), i)
    dealt = docs.select(F.struct("*").alias("row"), sort_key(docs, text).alias("key")).withColumn("part", interval_of(F.col("key"), [c[0] for c in cuts[1:]]) if len(cuts) > 1 else F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return dealt.select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")],
        at([c[1] for c in cuts], F.col("part")).cast("int").alias("shard"),
        (place + at([c[2] for c in cuts], F.col("part")).cast("long")).alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_sort(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", byte_size().alias("size"), F.crc32(text_or_empty()).alias("text_crc32"), F.lit(LAW).alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
