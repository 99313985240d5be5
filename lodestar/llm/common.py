"""Shared pieces: where intermediate tables go, and vectorised words of a batch of texts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local masters only: the folder made where the session names no checkpoint folder.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary folder; a cluster gets an error, as no
    local folder would do there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    return _OWN[app]


#: Rows that Spark hands to Python at once while a table is written; texts and sets of shingles may be long.
BATCH_ROWS = 1000


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Bits of a bitmap of keys, whatever their number: what is broadcast has a row for 64 of them.
KEY_BITS = 1 << 24


def _marked(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df with _hit: whether keys may hold the key of a row. False is certain, true may be chance."""
    slot = F.xxhash64(key).bitwiseAND(F.lit(KEY_BITS - 1))
    of_keys = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("_bits"))
    bits = F.broadcast(materialise(of_keys, "bitmap"))
    hit = F.coalesce(F.expr("shiftright(_bits, cast(_slot & 63 as int)) & 1") == 1, F.lit(False))
    return df.withColumn("_slot", slot).join(bits, F.shiftright("_slot", 6) == F.col("_word"), "left").withColumn("_hit", hit).drop("_slot", "_word", "_bits")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df less the rows whose key is in keys (that column alone, no nulls).

    Rows that a bitmap of keys rules out are not moved. With very many keys it rules out few, and this is
    a plain join.
    """
    marked = _marked(df, keys, key)
    return marked.where(~F.col("_hit")).drop("_hit").unionByName(marked.where("_hit").drop("_hit").join(keys, key, "left_anti"))


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in keys (that column alone, no nulls); others are ruled out as in without."""
    return _marked(df, keys, key).where("_hit").drop("_hit").join(keys, key, "left_semi")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------------------- words of a batch

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
#: Bytes hashed at a time, but for longer words.
BLOCK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        out = np.full(max(n, BLOCK + 1), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[name] = out
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, as arrays.

    data: the bytes (A-Z lower-cased if asked); starts, ends: byte range of each word; first: for
    each text, the index of its first word, with the total at the end; spans: byte offsets of texts.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.spans = at - at[0]
        self.raw = raw
        self.data = _LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 2, np.int8)  # a byte of white space at both ends
        np.logical_not(_SPACE[raw], out=inside[1:-1].view(bool))
        step = np.diff(inside)
        # words end and begin where a text does
        border = self.spans[(self.spans > 0) & (self.spans < len(raw))]
        border = border[(inside[border] == 1) & (inside[border + 1] == 1)]
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(border):
            border = np.unique(border)
            self.starts, self.ends = (np.insert(x, np.searchsorted(x, border), border) for x in (self.starts, self.ends))
        self.first = np.searchsorted(self.starts, self.spans)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process; made of some BLOCK bytes at a time."""
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            at = int(self.starts[a])
            b = max(a + 1, int(np.searchsorted(self.ends, at + BLOCK, "right")))
            n = int(self.ends[a:b].max()) - at
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data[at : at + n].astype(np.uint64) + np.uint64(1)) * _power(_P, n, "p"), out=sums[1:])
            start, end = self.starts[a:b] - at, self.ends[a:b] - at
            h = (sums[end] - sums[start]) * _power(_P_INV, n + 1, "inv")[start]
            out[a:b] = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            a = b
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours in h (runs over text borders included; the caller drops them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : len(h) - n + 1 + k]
    return mix(out)


def rolling(h: np.ndarray):
    """A function from places and a length to the Karp-Rabin hashes of the runs of h that begin there."""
    n = len(h)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h) * _power(_P, n, "p") if n else h, out=sums[1:])
    return lambda at, length: (sums[at + length] - sums[at]) * _power(_P_INV, max(n, 1), "inv")[at]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """Pieces of a batch whose texts take about most_bytes (one long text may take more)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        below = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, below + most_bytes)))
        yield batch.slice(at, end - at)
        at = end
