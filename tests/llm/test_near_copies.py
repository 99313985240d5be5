"""Near copies against brute force, and in the pipeline's stage."""

import random

import corpus_pipeline
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import common, simhash

from .conftest import documents


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def kept(rows):
    """Places of the rows that stay; rows: (id, text)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    fps, label = [fingerprint(t) for _, t in rows], {}
    for i in order:  # the first row that links reach
        if i not in label:
            open_, label[i] = [i], i
            while open_:
                a = open_.pop()
                for b in order:
                    if b not in label and (fps[a] ^ fps[b]).bit_count() <= 4:
                        label[b] = i
                        open_.append(b)
    out = []
    for i in order:
        x = shingles(rows[i][1])
        if label[i] == i and not any((len(x & y) >= 0.8 * len(x | y) - 1e-9) for y in (shingles(rows[j][1]) for j in out) if x):
            out.append(i)
    return sorted(out)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus():
    """Copies with edits, chains of edits, a common passage, ids that differ in text, nulls."""
    rng = random.Random(4)
    line = [f"common{i}" for i in range(12)]
    rows = [(r[0], r[1]) for r in documents()]
    for group in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 250]))]
        for k in range(rng.choice([2, 5, 40])):
            rows.append((1000 * group + rng.randrange(60), " ".join(edited(rng, base, rng.randrange(6)) + line * (k % 2))))
            if k % 7 == 0:
                base = edited(rng, base, 3)
    rows += [(7000 + i, " ".join([f"u{i}_{j}" for j in range(2)] + line)) for i in range(60)]
    rng.shuffle(rows)
    return rows


def test_near_copies_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").coalesce(1)
    got = sorted(r.n for r in simhash.drop_near_duplicates(df, reach=2).collect())
    assert got == kept(rows)


def test_bitmaps_change_no_join(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_BITS", 128)
    df = spark.createDataFrame([(i % 70, i) for i in range(200)], "k long, n int")
    for keys in ([], [3, 3, 69, 900], list(range(65))):
        of = spark.createDataFrame([(k,) for k in keys], "k long")
        assert sorted(r.n for r in common.without(df, of, "k").collect()) == [i for i in range(200) if i % 70 not in keys]
        assert sorted(r.n for r in common.among(df, of, "k").collect()) == [i for i in range(200) if i % 70 in keys]


def test_stage_drops_edited_copies_row_by_row(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(248)]
    copy = list(base)
    for at in (20, 90, 160, 230):
        copy[at] = "edited"
    other = " ".join(f"v{i}" for i in range(50))
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (2, other), (None, other), (3, "")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted((r.doc_id, r.text[:2]) for r in stage(spark, df, "").collect()) == [(1, base[0][:2]), (2, "v0"), (3, "")]
    assert stage(spark, df.where(F.lit(False)), "").count() == 0
