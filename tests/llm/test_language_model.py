"""The n-gram trie: its sequences, its probabilities, and scores against counting."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import language_model
from lodestar.llm.language_model import START, STOP, EliasFano, dequantised, quantised, trie_of

from .conftest import documents


def test_elias_fano_finds_in_ranges():
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 1 << 63, 500), rng.integers(0, 1 << 64, 20_000, dtype=np.uint64), np.arange(300), np.zeros(0), [7, 1 << 63], [0], [(1 << 64) - 1], rng.integers(0, 50, 400)):
        v = np.sort(np.array(values, np.uint64))
        e = EliasFano.of(v)
        assert (e.get(np.arange(len(v))) == v).all()
        assert sum(a.nbytes for a in e.parts()) <= (4.6 + e.width) / 8 * len(v) + 70
        q = np.concatenate([np.unique(v), rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        begin = rng.integers(0, len(v) + 1, len(q))
        end = np.minimum(begin + rng.integers(0, 40, len(q)), len(v))
        for lo, hi in ((np.zeros(len(q), int), np.full(len(q), len(v))), (begin, end)):
            at = np.array([lo[k] + np.searchsorted(v[lo[k] : hi[k]], q[k]) for k in range(len(q))])
            hit = at < hi
            hit[hit] = v[at[hit]] == q[hit]
            assert (e.find(q, lo, hi) == np.where(hit, at, -1)).all()


def test_codes_are_never_above():
    p = np.concatenate([[0, 1, 1e-12], np.random.default_rng(1).random(10_000) ** 5])
    back = dequantised(quantised(p))
    assert (back <= p).all() and (back[p > 1e-12] >= p[p > 1e-12] * 0.9995).all() and back[0] == 0 and back[1] == 1


def corpus(rng, n=60, v=40):
    return [[min(int(rng.paretovariate(0.7)), v) for _ in range(rng.randrange(1, 60))] for _ in range(n)]


def sent(texts, shards, hot):
    """What chunks of ten texts send, by shard."""
    out = defaultdict(list)
    for at in range(0, len(texts), 10):
        part = [" ".join(map(str, t)) for t in texts[at : at + 10]]
        table = pa.table({"text": part, "held_out": [False] * len(part), "chunk": pa.array([at] * len(part), pa.int64())})
        for row in language_model._blocks(table, shards, np.array(sorted(hot), np.uint64)).to_pylist():
            out[row["shard"]].append(row)
    return out


def trie(rows, hot):
    of = lambda c, kind=np.int64: np.array([x for r in rows for x in r[c]], kind)
    successors, _ = language_model._unpacked(pa.chunked_array([pa.array([r["successors"] for r in rows], pa.binary())]))
    return trie_of(of("words").view(np.uint64), of("counts"), of("sizes"), successors, of("pairs"), hot, language_model.DISCOUNT)


def hashes(texts):
    return {w: int(h) for w, h in zip(texts, language_model.Words(pa.array(texts)).hashes(), strict=True)}


def after(pair, led, frequent):
    """What a pair's count gives, without the share of the unigram."""
    return (1 - language_model.FREQUENT_MASS) * pair / led if frequent else max(pair - language_model.DISCOUNT, 0) / led


@pytest.mark.parametrize("spread", [False, True])
def test_probabilities_after_a_context_sum_to_one_at_most(spread):
    rng = random.Random(2)
    texts = corpus(rng)
    of = hashes(sorted({str(w) for t in texts for w in t}))
    tokens = [[of[str(w)] for w in t] + [int(STOP)] for t in texts]
    c, pairs = Counter(w for t in tokens for w in t), Counter(p for t in tokens for p in zip([int(START), *t[:-1]], t, strict=True))
    hot = {int(START): len(texts), of["1"]: c[of["1"]]} if spread else {}
    tries = [trie(rows, hot) for rows in sent(texts, 7, hot).values()]
    words = np.array(sorted(c), np.uint64)
    n, v = sum(c.values()), len(c)
    unigram = np.array([(c[int(w)] + 0.5) / (n + 0.5 * (v + 1)) for w in words])
    for context in [int(START), *map(int, words)]:
        p, mass = np.zeros(v), 0.0
        for t in tries:
            at, _, code = t.find_words(np.array([context], np.uint64))
            p += dequantised(t.pair_codes(np.repeat(at, v), language_model.successor_ids(words)))
            mass = max(mass, float(dequantised(code)[0]))
        led = sum(k for (a, _), k in pairs.items() if a == context)
        expected = np.array([after(pairs[context, int(w)], max(led, 1), context in hot) for w in words])
        assert np.allclose(p, expected, rtol=1e-3, atol=0)
        if led:  # with the share of a word never seen
            total = p.sum() + mass * (unigram.sum() + 0.5 / (n + 0.5 * (v + 1)))
            assert 0.998 < total <= 1 + 1e-12


def test_pairs_are_found_through_the_pointers():
    texts = corpus(random.Random(3))
    rows = [r for own in sent(texts, 1, {}).values() for r in own]
    whole = trie(rows, {})
    words = np.array(sorted({w for r in rows for w in np.array(r["words"], np.int64).view(np.uint64).tolist()}), np.uint64)
    at, _, _ = whole.find_words(words)
    context, word = np.repeat(at, len(words)), np.tile(language_model.successor_ids(words), len(words))
    before = whole.pair_codes(context, word)
    whole.pointers = EliasFano.of(np.zeros(whole.heads.n + 1, np.uint64))
    assert (before > 0).sum() > 100 and not whole.pair_codes(context, word).any()


def scores(rows):
    """With probabilities that are not quantised."""
    lowered = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    train = [lowered(t) + [None] for i, t in rows if not held(i)]
    c, b = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>"] + t[:-1], t, strict=True))
    led, types = Counter(), Counter()
    for (a, _), k in b.items():
        led[a] += k
        types[a] += 1
    n, v = sum(c.values()), len(c)
    frequent = {w for w, k in (c | {"<s>": c[None]}).items() if k * language_model.HOT > n} | {"<s>"}
    share = lambda p: language_model.FREQUENT_MASS if p in frequent else language_model.DISCOUNT * types[p] / led[p]
    out = []
    for i, t in rows:
        t = lowered(t) + [None]
        base = full = 0.0
        for p, w in zip(["<s>"] + t[:-1], t, strict=True):
            one = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(one)
            full += math.log10(after(b[p, w], led[p], p in frequent) + share(p) * one if led[p] else one)
        out.append((i, held(i), len(t), sum(c[w] > 0 for w in t), n, base, full))
    return out


@pytest.mark.parametrize(("sizes", "hot"), [({}, 1024), ({"chunk_bytes": 3000, "shard_bytes": 500}, 1024), ({"chunk_bytes": 3000, "shard_bytes": 500}, 50)])
def test_scores_match_counting(docs, monkeypatch, sizes, hot):
    monkeypatch.setattr(language_model, "HOT", hot)
    got = sorted((tuple(r) for r in language_model.score(docs, **sizes).collect()), key=str)
    expected = sorted(scores([(r[0], r[1]) for r in documents()]), key=str)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5] for g in got], [e[5] for e in expected], rtol=1e-9)
    assert all(e[6] - 5e-4 * e[2] <= g[6] <= e[6] + 1e-9 * e[2] for g, e in zip(got, expected, strict=True))


def test_equal_rows_are_spread_and_score_alike(spark):
    same = spark.createDataFrame([(None, "")] * 9000 + [(5, "a b a b")] * 1000, "doc_id long, text string")
    rows = language_model.score(same, chunk_bytes=100, shard_bytes=100).groupBy("doc_id", "n_tokens", "score").count().collect()
    assert sorted(r["count"] for r in rows) == [1000, 9000]


def test_scores_of_nothing(no_docs):
    assert language_model.score(no_docs).count() == 0
