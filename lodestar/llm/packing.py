"""Operator 8, packing by minimum bin slack.

Documents become token ids, an end id after each. What exceeds a window is cut into full windows of
its own; the rest of every document, shorter than a window, is packed with others. Only the histogram
of these lengths, at most window - 1 counts, reaches the driver. There a window takes the longest
rest that is left, and a bitset subset-sum over the lengths still there (each at most as often as it
is left) finds the multiset that comes closest to the remaining capacity; its counts are traced back,
and the same multiset fills as many windows as the counts allow. So the work depends on the window,
not on the number of documents.

Spark then numbers the pieces of each length. Numbers are given inside groups salted by place, so a
length that a third of all documents share, or equal rows, are spread over tasks; a piece's number says
which multiset, and which window and place of it, it takes. How many pieces the groups before one hold is
joined by the groups' own partitioning, as it grows with the pieces.

Null and empty texts are an end id alone. Equal rows are interchangeable. An empty table gives an
empty result. Input columns beside the id and the text are not carried.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, table

WINDOW, END = 4096, 2
VOCABULARY = "word_bpe_49k.json"
#: Rows of one length that are numbered together, about; groups of a length at least.
SALT_ROWS, LEAST_SALTS = 1_000_000, 64
#: Words whose ids a worker remembers.
REMEMBERED = 600_000

_tokenizers: dict[str, tuple] = {}


def _encoder(path: str):
    """A function from texts to their ids as little-endian bytes.

    This vocabulary drops white space and never merges across it, so the ids of a text are those of
    its words, and a word that was seen before need not be encoded again. New words of letters only
    are encoded many at once, as each of them ends in an id that marks the end of a word; a text
    that lower-casing or splitting here could change is encoded as it is.
    """
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        _tokenizers[path] = (tokenizer, ends, {}, {})
    tokenizer, ends, known, known_letters = _tokenizers[path]

    def one(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_letters(new: list[str]) -> None:
        groups = [new[i : i + 256] for i in range(0, len(new), 256)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(group):
                data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
                known_letters.update(zip(group, (data[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
            else:
                known_letters.update(zip(group, one(group), strict=True))

    def learn(new: list[str]) -> None:
        whole, split = [], []
        for w in new:
            core = w[:-1] if w[-1] in ".," else w
            (split if core.isalpha() else whole).append(w)
        learn_letters(list(dict.fromkeys(c for c in (w if w.isalpha() else w[:-1] for w in split) if c not in known_letters)))
        for mark in ".,":
            if mark not in known_letters:
                known_letters[mark] = one([mark])[0]
        for w in split:
            known[w] = known_letters[w] if w in known_letters else known_letters[w[:-1]] + known_letters[w[-1]]
        known.update(zip(whole, one(whole), strict=True))

    def lowered(text: str) -> str | None:
        if text.isascii():
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.lower()
        low = text.lower()
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f\u0130\u03a3") or not (is_normalized("NFC", text) and is_normalized("NFC", low))
        return None if odd else low

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > REMEMBERED:
            known.clear()
            known_letters.clear()
        split = [None if (low := lowered(t)) is None else low.split() for t in texts]
        learn(list(dict.fromkeys(w for words in split if words for w in words if w not in known)))
        return [one([t])[0] if words is None else b"".join([known[w] for w in words]) for t, words in zip(texts, split, strict=True)]

    return encode


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def cut(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """Pieces of at most window tokens: id, start, length, ids_crc32, doc_tokens, and the ids if asked."""
    path = path or vocabulary_path()
    more = [T.StructField("ids", T.ArrayType(T.LongType()))] if ids else []
    names = ("start", "length", "ids_crc32", "doc_tokens")
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *[T.StructField(n, T.LongType()) for n in names], *more])
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for part in slices(batch, "scanned"):
                rows, of, kept = [], [], []
                for i, data in enumerate(encode([t.as_py() or "" for t in part.column(1)])):
                    data += last
                    n = len(data) // 4
                    for start in range(0, n, window):
                        piece = data[4 * start : 4 * (start + window)]
                        of.append(i)
                        rows.append((start, len(piece) // 4, zlib.crc32(piece), n))
                        if ids:
                            kept.append(np.frombuffer(piece, "<u4").astype(np.int64))
                columns = [part.column(0).take(pa.array(of, pa.int64())), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int64()))] if ids else []), names=["id", *names, *[f.name for f in more]])

    return docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("scanned")).mapInArrow(run, schema)


def closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How often to take each length so that the sum comes closest to capacity, never above it.

    Bit s of a set says that the sum s can be reached. A length is offered in doubling numbers of
    copies, at most as many as there are and as fit, until the capacity itself is reached.
    """
    full, reach, history = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(copies, left)
            history.append((reach, length, take))
            reach |= (reach << (take * length)) & full
            left, copies = left - take, copies * 2
        if reach >> capacity:
            break
    rest, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(history):
        if not before >> rest & 1:
            rest -= take * length
            used[length] = used.get(length, 0) + take
    return used


def layout(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first number, per window, first window, first offset), by length and number.

    A row says: pieces of this length from this number on go, so many to a window, into windows
    from the first one on, at the offset and after it.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    taken = dict.fromkeys(left, 0)
    out, windows = [], 0
    while left:
        longest = max(left)
        others = {k: v - (k == longest) for k, v in left.items() if v - (k == longest) > 0}
        used = closest(others, window - longest) if longest < window else {}
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            out.append((length, taken[length], n, windows, offset))
            taken[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        windows += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (with a column length, at most window) and the sequence_id and offset of each."""
    written = materialise(pieces.withColumn("lodestar_at", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in written.groupBy("length").count().collect()}  # at most window rows
    plan = layout(counts, window)
    salts = max(LEAST_SALTS, sum(counts.values()) // SALT_ROWS)
    salted = written.withColumn("salt", F.pmod(F.xxhash64("lodestar_at"), F.lit(salts)))
    sizes = materialise(salted.groupBy("length", "salt").count(), "sizes")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    firsts = materialise(sizes.select("length", "salt", before.alias("before")), "firsts")
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("lodestar_at")) - 1
    numbered = salted.withColumn("number", number.cast("long")).join(firsts.hint("merge"), ["length", "salt"]).withColumn("number", F.col("number") + F.col("before"))
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    keys = plan[:, 0] << 48 | plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            row = plan[np.searchsorted(keys, length << 48 | at, "right") - 1] if len(at) else np.zeros((0, 5), np.int64)
            nth = at - row[:, 1]
            placed = (row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, placed)], names=schema.names)

    return numbered.select(*pieces.columns, "number").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset; ids: with their token ids."""
    return pack(cut(docs, id, text, path, window, end, ids), window).withColumnRenamed("id", id)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the windows themselves, of pieces packed with their ids. At most a window each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda s: s["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
