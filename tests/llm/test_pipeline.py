"""The pipeline's stages against plain versions, on awkward tables and on very long texts."""

import random
import time
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontamination, language_model, licenses, packing, pii, quality_rules, secret_owners, sharding, simhash
from lodestar.llm.common import materialise

from .conftest import SCHEMA, documents
from .test_near_copies import edited
from .test_near_copies import kept as without_copies
from .test_operators import base_personal, counts, plain_tiles

STAGES = dict(corpus_pipeline.STAGES)


def planted():
    """Awkward rows; good texts; short and repetitive ones; copies with edits; leaks; personal data."""
    rng = random.Random(17)
    words = [f"word{i}" for i in range(700)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(f"item{k}x{i}" for i in range(30))) for k in range(3)] + [(9, "too short"), (10, None)]
    rows = [(*r[:5],) for r in documents()]
    for i in range(60):
        rows.append((2000 + i, " ".join(prose(rng.randrange(25, 90))), rng.choice(["en", "de", None]), rng.choice("ab"), i))
    for i in range(6):
        rows.append((3000 + i, " ".join(["again"] * 4 + prose(2)) * (5 if i % 2 else 1), "en", "a", i))
        base = prose(80)
        rows += [(4000 + 10 * i + k, " ".join(edited(rng, base, k)), "en", "b", 1) for k in range(3)]
        item = items[i % 3][1].split()
        rows.append((5000 + i, " ".join(prose(30) + item[15:] + ["gap"] + item[: 15 if i % 2 else 2] + prose(9)), "de", "a", 2))
        rows.append((6000 + i, " ".join(prose(30) + [f"mail me{i}@example.org or 10.1.2.{i}"] + prose(5)), None, None, None))
    return [r + (1, "s", "x", 2, "l", "i", 5, "z") for r in rows], items


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    rows, items = planted()
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at, rows, items


def ids(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_stages_match_plain_versions(spark, inputs):
    at, rows, items = inputs
    docs = spark.read.parquet(f"{at}/documents.parquet")
    # rules: the counts by hand; so few texts are never far, which is asserted
    found = materialise(STAGES["quality_rules"](spark, docs, at), "test")
    base = [r for r in rows if (c := counts(r[1]))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    judged = quality_rules.judge(docs.select("doc_id", "text", "lang", "source")).where(~F.col("base_failed"))
    near = {(r.doc_id, r.text) for r in judged.where(F.col("distance") <= quality_rules.CUTOFF).collect()}
    expected = [r for r in base if (r[0], r[1]) in near]
    assert len(expected) > 0.9 * len(base) and found.columns == docs.columns
    assert ids(found) == sorted((str(r[0]), r[1] or "") for r in expected)
    # near duplicates, in the table's order
    docs = spark.createDataFrame(expected, SCHEMA).coalesce(1)
    found = STAGES["near_duplicates"](spark, docs, at)
    expected = [expected[i] for i in without_copies([r[:2] for r in expected])]
    assert ids(found) == sorted((str(r[0]), r[1]) for r in expected) and found.columns == docs.columns
    # leaks
    docs = spark.createDataFrame(expected, SCHEMA)
    found = STAGES["decontamination"](spark, docs, at)
    leaked = lambda t: any(i and 2 * plain_tiles(t.lower().split(), i.lower().split(), 5) >= len(i.split()) >= 5 for _, i in items)
    clean = [r for r in expected if not leaked(r[1])]
    assert len(clean) < len(expected)
    assert ids(found) == sorted((str(r[0]), r[1]) for r in clean) and found.columns == docs.columns
    # personal data: where base kinds alone occur
    docs = spark.createDataFrame(clean, SCHEMA)
    got = {r.doc_id: r for r in STAGES["personal_data"](spark, docs, at).collect()}
    for r in clean:
        if r[0] != 10:
            text, spans = r[1], base_personal(r[1])
            for kind, a, b in sorted(spans, key=lambda s: -s[1]):
                text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
            assert got[r[0]].text == text and got[r[0]].n_chars == len(text)
    assert any("<EMAIL>" in r.text and "<IP>" in r.text for r in got.values()) and len(got) == len({r[0] for r in clean})
    # packing: every id once
    docs = spark.createDataFrame(clean, SCHEMA)
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(packing.vocabulary_path()), defaultdict(list)
    for p in STAGES["packing"](spark, docs, at).collect():
        pieces[p.doc_id].append(p)
    for r in clean:
        if sum(x[0] == r[0] for x in clean) == 1:
            t = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2]
            for p in pieces[r[0]]:
                assert zlib.crc32(np.array(t[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
            assert sum(p.length for p in pieces[r[0]]) == len(t)


def test_run_is_the_stages_in_order(spark, inputs):
    at, rows, _ = inputs
    packed = corpus_pipeline.run(spark, at)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, at), f"by_{name}")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() > 50
    assert packed.agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()


def test_stages_take_no_rows_and_odd_rows(spark, inputs, no_docs, docs):
    at, _, _ = inputs
    names = docs.columns
    for given in (no_docs, docs.where("text is null or text = ''")):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, given, at)
            assert name == "packing" or found.columns == names
            n = found.count()
            assert n <= given.count() and (n == 0 if name == "quality_rules" else True)


def test_texts_of_megabytes(spark):
    """One text of 5 MB of prose, one of a single word, one without white space, one of headers: each operator, in bounded time."""
    rng = random.Random(18)
    words = [f"w{i}" for i in range(5000)]
    prose = " ".join(rng.choice(words) for _ in range(850_000))
    texts = [prose, "same " * 1_000_000, "x" * 5_000_000, "-----BEGIN RSA PRIVATE KEY-----\n" * 60_000, "a@b " * 400_000, "under the mit " * 120_000]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    items = spark.createDataFrame([(1, " ".join(prose.split()[400:500])), (2, "same " * 900)], "item_id long, text string")
    began = time.perf_counter()
    assert language_model.score(df).count() == 6
    assert quality_rules.judge(df).count() == 6
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, items, ["doc_id"]).collect()} == {(0, 1), (1, 2)}
    assert pii.find_personal_data(df, ["doc_id"]).count() == 6
    assert secret_owners.find_secrets(df, ["doc_id"]).count() == 6
    assert simhash.near_duplicates(df).count() == 6
    assert simhash.drop_near_duplicates(df).count() == 6
    assert licenses.find_licenses(df, ["doc_id"]).count() == 0
    assert sharding.histogram_sort(df, 3).count() == 6
    assert packing.pack_documents(df.where("doc_id in (0, 1)")).select("doc_id").distinct().count() == 2
    assert time.perf_counter() - began < 600

