"""Operator 2, language-model scores from Elias-Fano n-gram tries.

The model is a bigram model over the words of the training texts, smoothed by absolute discounting into
their add-half unigram: with c the counts, T(v) the distinct words after v and D the discount,
p(w | v) = (c(v, w) - D) / c(v) for pairs in training, plus D T(v) / c(v) times (c(w) + 0.5) / (N + 0.5 (V + 1)).
A word never seen has no successors and leaves all to the unigram. A frequent word, of more than 1 / HOT of
all tokens, leaves a fixed share to it, as no single shard knows all its successors:
p(w | v) = (1 - FREQUENT_MASS) c(v, w) / c(v), plus FREQUENT_MASS times the unigram.

It is held in shards. A chunk of documents sends each shard the distinct words, and after each the
distinct successors, that it has there, with their training counts. A shard sums what all chunks sent,
builds a trie of it, and answers each chunk in the order of its keys; the chunk then scores its texts
with the answers. So what moves is distinct keys of a chunk, never tokens, no task holds more than its
shard or its chunk, and the model may be of any size. A word and its successors are dealt to the shard of
the word; the successors of the frequent words (HOT of them at most) are dealt by pairs to all shards.

A trie has Elias-Fano levels: the words; monotone pointers to where the successors of each begin; and
the successors, numbered within the shard's own vocabulary and coded relative to their context, so that
one monotone sequence holds them all. A pair is found by looking up its context, reading the range of
its successors from the pointers, and a successor search inside that range. Beside the levels are, for
words, their counts and smoothing masses, and for successors their discounted probabilities, both in
logarithmic steps of 16 bits, rounded down, so that the probabilities after a context never exceed one
together. The levels are written to a file and mapped; high parts are selected through a directory of
64-bit words, so pages that no query touches take no memory.

Words are known by 64-bit hashes, successors within their context by the upper 48 bits. Null and empty texts are the end token alone; null doc_ids are in
training. Equal rows get equal scores, and are dealt to chunks by their place; an empty table gives an
empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, materialise, mix, slices, table

#: What each pair's count gives up to words not seen after its context. Counts of counts of sf0.1 and check_s
#: give n1 / (n1 + 2 n2) = 0.76 and 0.77.
DISCOUNT = 0.75
#: What a frequent context leaves to the unigram.
FREQUENT_MASS = 0.05
#: Bytes of text of a chunk; bytes of text whose keys make up a shard.
CHUNK_BYTES, SHARD_BYTES = 6 << 20, 4 << 20
#: Words that a counting task holds before it sends their counts on.
HELD_WORDS = 1 << 20
#: The successors of words with more than this share of all tokens, 1 / HOT, are spread over all shards.
HOT = 1024
START, STOP = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bytes of the number by which a successor is known within its context.
ID_BYTES = 6
_RANK, _LOW_RANK = np.uint64(32), np.uint64((1 << 32) - 1)


# ---------------------------------------------------------------------------- the trie


class EliasFano:
    """A sorted sequence of n 64-bit numbers: low bits packed, high parts in unary, and a directory of the unary part.

    low: bytes of the packed low parts, of width bits each; unary: 64-bit words, a one for each number after a
    zero for each high part that ended; zeros: how many zeros precede each of those words.
    """

    def __init__(self, low: np.ndarray, unary: np.ndarray, zeros: np.ndarray, n: int, width: int):
        self.low, self.unary, self.zeros, self.n, self.width = low, unary, zeros, n, width
        self.mask = np.uint64((1 << width) - 1)
        # a 64-bit number from each byte on: the packed part ends in eight bytes more
        self.loads = np.ndarray((max(len(low) - 7, 0),), "<u8", buffer=low, strides=(1,)) if len(low) > 7 else np.zeros(1, np.uint64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8) if n and width else np.zeros((0, 0), np.uint8)
        low = np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)])
        high = (values >> np.uint64(width)).astype(np.int64) if n else np.zeros(0, np.int64)
        unary = np.zeros(-(-(int(high[-1]) + n + 2 if n else 2) // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        unary = np.packbits(unary, bitorder="little").view("<u8")
        return cls(low, unary, cls.directory(unary), n, width)

    @staticmethod
    def directory(unary: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(64 - np.bitwise_count(unary).astype(np.int64))])[: len(unary)].astype("<u4" if len(unary) < 1 << 26 else "<u8")

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.unary, self.zeros]

    def low_of(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        return self.loads[bit >> 3] >> (bit & 7).astype(np.uint64) & self.mask if self.width else np.zeros(len(i), np.uint64)

    def _select(self, before: np.ndarray, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the bit number k that is set, of bits in words, of which before precede each word."""
        at = np.searchsorted(before, k, "right") - 1
        x, rest, place = words(at), k - before[at].astype(np.int64), np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(x & np.uint64((1 << step) - 1)).astype(np.int64)
            up = inside <= rest
            rest, place = np.where(up, rest - inside, rest), place + up * step
            x = np.where(up, x >> np.uint64(step), x)
        return at * 64 + place

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below this."""
        at = self._select(self.zeros, lambda at: ~self.unary[at], np.maximum(high - 1, 0))
        return np.where(high > 0, np.minimum(at - (high - 1), self.n), 0)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros.astype(np.int64)
        high = self._select(ones, lambda at: self.unary[at], i) - i
        return high.astype(np.uint64) << np.uint64(self.width) | self.low_of(i)

    def find(self, q: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Place of q among the numbers from begin to end: the successor of q there, if it is q; otherwise -1."""
        if not self.n or not len(q):
            return np.full(len(q), -1)
        high = (q >> np.uint64(self.width)).astype(np.int64)
        most = 64 * len(self.unary) - self.n  # high parts that have a zero of their own
        inside = (high >= 0) & (high < most)
        high = np.where(inside, high, 0)
        lo = np.maximum(self.below(high), begin)
        end = np.minimum(self.below(high + 1), self.n if end is None else end)
        end = np.where(inside, np.maximum(end, lo), lo)
        hi, low = end.copy(), q & self.mask
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            under = self.low_of(mid) < low[open_]
            hi[open_] = np.where(under, hi[open_], mid)
            lo[open_] = np.where(under, mid + 1, lo[open_])
        found = lo < end
        found[found] = self.low_of(lo[found]) == low[found]
        return np.where(found, lo, -1)


#: Steps of a halving in a code of probability.
STEPS = 1600


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit codes whose values are not above them: 0 for none, then 2 ** -((code - 1) / STEPS)."""
    with np.errstate(divide="ignore"):
        code = np.where(p > 0, np.minimum(np.ceil(-np.log2(np.minimum(p, 1)) * STEPS) + 1, 65536), 0).astype(np.int64)
    code = np.where((code > 0) & (2.0 ** (-(code - 1.0) / STEPS) > p), code + 1, code)
    return np.where(code > 65535, 0, code).astype("<u2")


def dequantised(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 2.0 ** (-(code.astype(float) - 1) / STEPS), 0.0)


class Trie:
    """Words with exact counts and smoothing masses, and their successors with probabilities, in mapped levels.

    heads: sorted words; counts: of each; totals: of each as a context; frequent: whether it is; sizes: successors
    of each; tails: successors, sorted after each head; pairs: their counts.
    """

    def __init__(self, heads: np.ndarray, counts: np.ndarray, totals: np.ndarray, frequent: np.ndarray, sizes: np.ndarray, tails: np.ndarray, pairs: np.ndarray, discount: float = DISCOUNT):
        vocabulary, number = np.unique(tails, return_inverse=True)
        self.words = len(vocabulary)
        pointers = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
        context = np.repeat(np.arange(len(heads)), sizes)
        levels = [EliasFano.of(heads), EliasFano.of(pointers), EliasFano.of(vocabulary), EliasFano.of(context.astype(np.uint64) * np.uint64(self.words) + number.astype(np.uint64))]
        total = np.maximum(totals, 1)
        mass = np.where(frequent, FREQUENT_MASS, discount * sizes / total)
        p = np.where(frequent[context], (1 - FREQUENT_MASS) * pairs, pairs - discount) / total[context]
        beside = [counts.astype("<i8"), quantised(mass), quantised(p)]
        arrays = [a for e in levels for a in e.parts()] + beside
        self.file = tempfile.TemporaryFile()
        places = []
        for a in arrays:
            self.file.write(b"\0" * (-self.file.tell() % 8))
            places.append((self.file.tell(), a.dtype, len(a)))
            self.file.write(a.tobytes())
        self.file.write(b"\0" * 8)
        self.file.flush()
        mapped = np.memmap(self.file, np.uint8, "r")
        views = [mapped[at : at + n * dtype.itemsize].view(dtype) for at, dtype, n in places]
        self.heads, self.pointers, self.vocabulary, self.tails = (EliasFano(*views[3 * k : 3 * k + 3], e.n, e.width) for k, e in enumerate(levels))
        self.counts, self.masses, self.codes = views[-3:]

    def find_words(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, count and code of the smoothing mass of each word; place -1, zero and zero for others."""
        at = self.heads.find(q)
        known = at >= 0
        out = [np.zeros(len(q), a.dtype) for a in (self.counts, self.masses)]
        for o, a in zip(out, (self.counts, self.masses), strict=True):
            o[known] = a[at[known]]
        return at, *out

    def pair_codes(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of the probability of each word, by its id, after the word at a place of the heads; zero where it has none."""
        out = np.zeros(len(word), "<u2")
        number = self.vocabulary.find(word)
        some = np.flatnonzero((context >= 0) & (number >= 0))
        c = context[some]
        begin, end = (self.pointers.get(i).astype(np.int64) for i in (c, c + 1))
        at = self.tails.find(c.astype(np.uint64) * np.uint64(self.words) + number[some].astype(np.uint64), begin, end)
        out[some[at >= 0]] = self.codes[at[at >= 0]]
        return out

    def close(self) -> None:
        self.file.close()


# ---------------------------------------------------------------------------- keys of a chunk


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Tokens of some texts; the distinct words and pairs among them, in the order of shard, word and successor.

    Nodes are words in a shard: each word in its own, and frequent words also where their successors are.
    """

    def __init__(self, texts: pa.Array, shards: int, hot: np.ndarray):
        words = Words(texts)
        n = len(texts)
        self.first = words.first + np.arange(n + 1)  # an end after each text
        token = np.empty(len(words) + n, np.uint64)
        stop = self.first[1:] - 1
        inside = np.ones(len(token), bool)
        inside[stop] = False
        token[inside], token[stop] = words.hashes(), STOP
        self.texts = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.first))
        del words, inside

        self.distinct, rank = np.unique(np.append(token, START), return_inverse=True)
        rank = rank.astype(np.uint64)
        self.rank = rank[:-1]
        before = np.concatenate([rank[-1:], self.rank[:-1]])
        before[self.first[:-1]] = rank[-1]
        pairs, pair_of = np.unique(before << _RANK | self.rank, return_inverse=True)
        led, word = pairs >> _RANK, pairs & _LOW_RANK
        home = _shard_of(self.distinct, shards)
        is_hot = np.isin(self.distinct, hot)
        shard = np.where(is_hot[led], _shard_of(mix(self.distinct[led]) ^ self.distinct[word], shards), home[led])
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair_of = place[pair_of]
        led, self.word, self.pair_shards = led[order], word[order], shard[order]
        #: shard and rank of the node of each pair, and of the own node of each word
        own = home.astype(np.uint64) << _RANK | np.arange(len(home), dtype=np.uint64)
        under = self.pair_shards.astype(np.uint64) << _RANK | led
        self.nodes = np.unique(np.concatenate([own, under]))
        self.node_of_word, self.node_of_pair = np.searchsorted(self.nodes, own), np.searchsorted(self.nodes, under)
        self.node_rank, self.node_shards = (self.nodes & _LOW_RANK).astype(np.int64), (self.nodes >> _RANK).astype(np.int64)
        self.before = before


_BLOCK = "chunk long, shard long, words array<long>, counts array<int>, sizes array<int>, successors binary, pairs array<int>"
_ANSWER = "chunk long, shard long, counts array<long>, masses binary, codes binary"


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def successor_ids(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - 8 * ID_BYTES)


def _packed(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """For each part of ids its numbers, in ID_BYTES bytes each."""
    data = np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ID_BYTES])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * ID_BYTES).astype("<i4")), pa.py_buffer(data)])


def _unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in column if x.is_valid]
    out = np.zeros((sum(map(len, parts)) // ID_BYTES, 8), np.uint8)
    out[:, :ID_BYTES] = np.concatenate(parts).reshape(-1, ID_BYTES) if parts else 0
    return out.view("<u8").ravel(), np.array([len(p) for p in parts]) // ID_BYTES


def _blocks(docs: pa.Table, shards: int, hot: np.ndarray) -> pa.Table:
    """What a chunk sends to each shard: nodes, with counts of words in training; successors, with those of pairs."""
    chunk = Chunk(docs.column("text"), shards, hot)
    trained = ~docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[chunk.texts]
    counts = np.zeros(len(chunk.nodes), np.int32)
    counts[chunk.node_of_word] = np.bincount(chunk.rank[trained].astype(np.int64), minlength=len(chunk.node_of_word))
    pairs = np.bincount(chunk.pair_of[trained], minlength=len(chunk.word)).astype(np.int32)
    sizes = np.bincount(chunk.node_of_pair, minlength=len(chunk.nodes)).astype(np.int32)
    used = np.unique(chunk.node_shards)
    w, b = (np.append(np.searchsorted(of, used), len(of)) for of in (chunk.node_shards, chunk.pair_shards))
    own = docs.column("chunk")[0].as_py() if docs.num_rows else 0
    return pa.Table.from_arrays([
        pa.array(np.full(len(used), own, np.int64)), pa.array(used), _lists(chunk.distinct[chunk.node_rank].view(np.int64), w), _lists(counts, w), _lists(sizes, w),
        _packed(successor_ids(chunk.distinct[chunk.word]), b), _lists(pairs, b),
    ], names=["chunk", "shard", "words", "counts", "sizes", "successors", "pairs"])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy() if len(column) else np.zeros(0, np.int64)


def trie_of(words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, pairs: np.ndarray, hot: dict[int, int], discount: float) -> Trie:
    """The trie of all that chunks sent: keys without a count in training are left out. successors: their ids."""
    heads, head = np.unique(words, return_inverse=True)
    count = np.bincount(head, counts, minlength=len(heads)).astype(np.int64)
    _, number = np.unique(successors, return_inverse=True)
    key, of = np.unique(head[np.repeat(np.arange(len(words)), sizes)].astype(np.uint64) << _RANK | number.astype(np.uint64), return_index=False, return_inverse=True)
    times = np.bincount(of, pairs, minlength=len(key)).astype(np.int64)
    tail = np.zeros(len(key), np.uint64)
    tail[of] = successors
    keep = times > 0
    key, times, tail = (key[keep] >> _RANK).astype(np.int64), times[keep], tail[keep]
    total = np.bincount(key, times, minlength=len(heads)).astype(np.int64)
    size = np.bincount(key, minlength=len(heads))
    seen = (count > 0) | (size > 0)
    words, totals = np.array(sorted(hot), np.uint64), np.array([hot[w] for w in sorted(hot)], np.int64)
    frequent = np.isin(heads, words)  # their successors are only in part here
    total[frequent] = totals[np.searchsorted(words, heads[frequent])]
    seen |= frequent
    return Trie(heads[seen], count[seen], total[seen], frequent[seen], size[seen], tail, times, discount)


def _answers(blocks: pa.Table, hot: dict[int, int], discount: float) -> pa.Table:
    words, (successors, held) = _flat(blocks.column("words")).view(np.uint64), _unpacked(blocks.column("successors"))
    sizes = _flat(blocks.column("sizes"))
    trie = trie_of(words, _flat(blocks.column("counts")), sizes, successors, _flat(blocks.column("pairs")), hot, discount)
    at, counts, masses = trie.find_words(words)
    codes = trie.pair_codes(np.repeat(at, sizes), successors)
    trie.close()
    w, b = (np.concatenate([[0], np.cumsum(n)]) for n in (blocks.column("words").combine_chunks().value_lengths().to_numpy(), held))
    cut = lambda a, at: pa.array([a[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
    return pa.Table.from_arrays([blocks.column("chunk").combine_chunks(), blocks.column("shard").combine_chunks(), _lists(counts, w), cut(masses, w), cut(codes, b)], names=["chunk", "shard", "counts", "masses", "codes"])


# ---------------------------------------------------------------------------- the jobs


def held_out(id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 1."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 5 == 1


def totals(docs: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Training tokens and distinct training tokens of docs (text, held_out), and the counts of frequent words.

    Frequent is what makes up more than 1 / HOT of the tokens; the start of a text, which is no token, counts
    as many times as there are texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            words, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(of, np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                words, n = np.unique(Words(part.column(0)).hashes(), return_counts=True)
                held.append((np.append(words, STOP), np.append(n, part.num_rows)))
                if sum(len(k) for k, _ in held) > HELD_WORDS:
                    yield block()
                    held.clear()
        if held:
            yield block()

    train = docs.where(~F.col("held_out")).select("text")
    counts = materialise(train.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n, v = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n = n or 0
    hot = {int(np.int64(r.word).view(np.uint64)): r.n for r in counts.where(F.col("n") * HOT > n).collect()}  # HOT rows at most
    discard(counts)
    return n, v, hot | {int(START): hot.get(int(STOP), train.count())}


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", discount: float = DISCOUNT, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("id")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens, distinct, hot = totals(rows)
    chunks, shards = max(16, ceil(size / chunk_bytes)), max(16, ceil(size / shard_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(chunks)))
    below = float(np.log10(tokens + 0.5 * (distinct + 1)))
    frequent = np.array(sorted(hot), np.uint64)
    schema = T.StructType([rows.schema["id"], T.StructField("held_out", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def meet(own: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(own.column("text"), shards, frequent)
        answers = answers.take(pa.array(np.argsort(answers.column("shard").to_numpy())))
        codes = lambda name: np.concatenate([np.frombuffer(x, "<u2") for x in answers.column(name).to_pylist()])
        c = _flat(answers.column("counts"))[chunk.node_of_word][chunk.rank]
        mass = dequantised(codes("masses")[chunk.node_of_word])
        mass[mass == 0] = 1  # after a word never seen
        base = np.log10(c + 0.5) - below
        full = np.log10(dequantised(codes("codes"))[chunk.pair_of] + mass[chunk.before] * 10**base)
        by = lambda x: np.bincount(chunk.texts, x, minlength=own.num_rows)
        n = np.diff(chunk.first)
        return pa.Table.from_arrays([own.column("id").combine_chunks(), own.column("held_out").combine_chunks(), pa.array(n, pa.int64()), pa.array(by(c > 0).astype(np.int64)), pa.array(np.full(len(n), tokens, np.int64)), pa.array(by(base)), pa.array(by(full))], names=schema.names)

    blocks = rows.groupBy("chunk").applyInArrow(lambda t: _blocks(t, shards, frequent), _BLOCK)
    answers = blocks.groupBy("shard").applyInArrow(lambda t: _answers(t, hot, discount), _ANSWER)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema).withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
