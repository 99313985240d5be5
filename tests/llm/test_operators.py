"""Each operator on awkward tables, and against brute force on small ones."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import (
    decontamination,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    queries,
    secret_owners,
    sharding,
    simhash,
)
from lodestar.llm.common import Words, table

from .conftest import SF, documents


def words(text):
    return (text or "").encode().split()


def lowered(text):
    return (text or "").encode().lower().split()


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_words_are_runs_without_ascii_space():
    texts = ["a  b\tc", None, "", " é\x0b漢 \n", "x\x1cy z", "end"]
    w = Words(pa.array(texts), lower=False)
    got = [w.raw[s:e].tobytes() for s, e in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in words(t)]
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    assert len(set(w.hashes().tolist())) == len(set(got))


# ------------------------------------------------------------------ 1


def test_classifier_takes_awkward_rows_and_nothing(docs, no_docs):
    ratings = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    for d, r in ((docs, ratings), (docs, ratings.limit(0)), (no_docs, ratings)):
        found = quality_classifier.grade_texts(d, *quality_classifier.train(quality_classifier.rated(d, r, "doc_id", "grade", 50)))
        rows = found.collect()
        assert len(rows) == d.count() and set(found.columns) >= {"doc_id", "text", "kept", "expected_grade"}
        assert all(0 <= x.top_probability <= 1 and 0 <= x.expected_grade <= 2 for x in rows)


def test_labels_that_are_open_do_not_train(spark):
    labels = [(1, 0, None), (2, 1, 1), (3, 1, 0), (4, 1, None), (5, None, 0), (6, None, None), (None, 1, 0), (7, 0, 1)]
    ratings = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("grade", quality_classifier.grade_of())
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(1, 8)] + [(3, None)], "doc_id long, text string")
    got = quality_classifier.rated(texts, ratings, "doc_id", "grade", 100).collect()
    assert sorted((r.r_id, r.grade) for r in got) == [(1, 0), (2, 1), (3, 2), (3, 2), (7, 0)]
    assert len(quality_classifier.rated(texts, ratings, "doc_id", "grade", 2).collect()) <= 3


def test_classifier_orders_grades_and_selects(spark):
    """Held-out accuracy of a fit in Spark, for grades that rise with two words."""
    rng = random.Random(16)
    rows = [(i, " ".join([f"w{rng.randint(0, 90)}" for _ in range(30)] + ["fine", "great"][: i % 3]), i % 3) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    w, theta = quality_classifier.train(quality_classifier.rated(df.where("doc_id < 900"), df.select("doc_id", "grade"), "doc_id", "grade", 5000))
    assert (np.diff(theta) >= quality_classifier.APART * 0.99).all()
    got = quality_classifier.grade_texts(df.where("doc_id >= 900"), w, theta, ["doc_id"]).collect()
    by = [[r.expected_grade for r in got if r.doc_id % 3 == k] for k in range(3)]
    assert np.mean(by[0]) + 0.3 < np.mean(by[1]) < np.mean(by[2]) - 0.3
    assert np.mean([r.kept == (r.doc_id % 3 == 2) for r in got]) > 0.9


def test_classifier_learns_a_bad_word():
    rng = random.Random(1)
    texts, grades = [], []
    for i in range(900):
        grade = rng.choice([0, 1, 2, 2])
        text = [f"w{rng.randint(0, 200)}" for _ in range(40)] + [["%%%"], ["awful"], []][grade]
        rng.shuffle(text)
        texts.append(" ".join(text))
        grades.append(grade)
    own, feature = quality_classifier.features(pa.array(texts))
    rows = [feature[own == i] for i in range(900)]
    w, theta = quality_classifier.fit(rows[:700], np.array(grades[:700]))
    assert theta[0] < theta[1]
    s = np.array([w[r].sum() for r in rows[700:]])
    top = 1 - quality_classifier._sigmoid(theta[-1] - s)
    assert np.mean((top >= 0.5) == (np.array(grades[700:]) == 2)) > 0.95


# ------------------------------------------------------------------ 3


def counts(text):
    text = text or ""
    w, seen, repeated_lines = words(text), set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), repeated_lines, len(covered)


def test_counts_match_brute_force(spark, docs, no_docs):
    judged = quality_rules.judge(docs)
    for r in judged.collect():
        n, chars, symbols, lines, repeats = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)
    assert judged.count() == docs.count() and judged.columns.count("kept") == 1
    assert quality_rules.judge(no_docs).count() == 0
    odd = ["a\n\nb a\n a\n#%&", "\n\n", "x " * 30, "p q r s t u v w " * 2 + "z", None]
    got = quality_rules.count_texts(pa.array(odd))
    assert [tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(5)] == [counts(t) for t in odd]


def test_concentration_finds_the_ordinary_texts(spark):
    """Estimates against the same steps in numpy, with the exact order in place of bins."""
    rng = np.random.default_rng(3)
    p = len(quality_rules.VECTOR)
    x = rng.normal(0, 1, (400, p))
    x[:60] += 25
    rows = spark.createDataFrame([("en", "a", r.tolist()) for r in x], "lang string, source string, x array<double>")
    e = quality_rules.estimates(rows).first()
    precision = np.zeros((p, p))
    precision[np.triu_indices(p)] = e.precision
    precision = (precision + precision.T) / 2
    d = np.einsum("ni,ij,nj->n", x - e.mean, precision, x - e.mean)
    assert e.n == 400 and d[:60].min() > 4 * d[60:].max()
    near = x[60:]
    for _ in range(6):  # the determinant's minimum over subsets that steps reach from the clean rows
        mean, cov = near.mean(0), np.cov(near.T, bias=True) + np.diag(np.array(list(quality_rules.VECTOR.values())) ** 2)
        dist = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        near = x[np.argsort(dist)[:300]]
    assert np.abs(np.array(e.mean) - near.mean(0)).max() < 0.1


# ------------------------------------------------------------------ 4


def plain_tiles(doc, item, least):
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and free_i[i + k] and free_d[d + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, d)]
                elif k == best and k >= least:
                    found.append((i, d))
        if not found:
            return covered
        for i, d in found:
            if all(free_i[i : i + best]) and all(free_d[d : d + best]):
                free_i[i : i + best] = free_d[d : d + best] = [False] * best
                covered += best


def test_tiles_match_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        doc, item = ([rng.randint(0, 3) for _ in range(rng.randint(0, 30))] for _ in range(2))
        got = decontamination.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert sum(n for _, _, n in got) == plain_tiles(doc, item, 3)
        assert all(item[a : a + n] == doc[b : b + n] for a, b, n in got)


def test_tiles_of_repeated_words_stay_small():
    rng = np.random.default_rng(1)
    same = np.full(20_000, 7, np.uint64)
    assert decontamination.tiles(same, same[:1000]) == [(0, 0, 1000)]
    few = rng.integers(0, 2, 20_000).astype(np.uint64)
    item = rng.integers(0, 2, 300).astype(np.uint64)
    got = decontamination.tiles(np.concatenate([few, item[100:], few, item[:100]]), item)
    assert got[0][2] >= 200 and sum(n for *_, n in got) == 300
    words = rng.integers(0, 1 << 62, 900_000).astype(np.uint64)  # 5 MB of text
    assert sum(n for *_, n in decontamination.tiles(np.concatenate([words, words[50:90], words[10:50]]), words[10:90])) == 80


def test_contamination_matches_brute_force(spark):
    """Items that repeat themselves, share wording with each other, are short, are equal; texts that hold parts of them."""
    rng = random.Random(13)
    common = [f"c{i}" for i in range(8)]
    items = []
    for k in range(30):
        own = [f"i{k}_{rng.randrange(12)}" for _ in range(rng.choice([1, 6, 14, 40]))]
        items.append((k % 28, " ".join(common[: rng.randrange(9)] + own + own[: rng.randrange(7)] * 2)))
    texts = []
    for k in range(120):
        w = [f"n{rng.randrange(50)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            w += own[a : a + rng.randrange(4, 50)] + own[:a] * rng.randrange(2)
        texts.append((k, " ".join(w)))
    got = sorted((r.doc_id, r.item_id, r.covered_words) for r in decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    expected = []
    for i, t in texts:
        for j, item in items:
            n, covered = len(item.split()), plain_tiles(t.split(), item.split(), 5)
            if covered and covered >= 0.5 * n:
                expected.append((i, j, covered))
    assert got == sorted(expected) and len(got) > 40


def test_contamination_survives_reordering(spark, docs, no_docs):
    item = [f"t{i}" for i in range(40)]
    mixed = " ".join(["noise"] * 9 + item[20:] + ["gap"] + item[:20])
    part = " ".join(item[:12])
    more = spark.createDataFrame([(500, mixed), (501, part), (None, " ".join(item).upper())], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    all_docs = docs.unionByName(more, allowMissingColumns=True)
    found = {(r.doc_id, r.item_id): r.coverage for r in decontamination.contaminated(all_docs, items).collect()}
    assert found == {(500, 1): 1.0, (None, 1): 1.0}
    assert decontamination.decontaminate(all_docs, items).count() == all_docs.count() - 2
    assert decontamination.contaminated(no_docs, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


# ------------------------------------------------------------------ 5 and 6


def base_personal(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_personal_data_matches_patterns():
    rng, find = random.Random(3), pii.finder()
    for _ in range(20_000):
        t = "".join(rng.choice("@@.+- 0123456789a()é") for _ in range(rng.randint(0, 60)))
        assert [s for s in find(t) if s[0] in pii.BASE] == base_personal(t), t
    for length in range(11, 21):  # cards
        for _ in range(40):
            t = "x" + " ".join("".join(rng.choice("0123456789") for _ in range(length)) for _ in range(3))
            assert [s for s in find(t) if s[0] in pii.BASE] == base_personal(t), t


def test_personal_data_of_awkward_rows(docs, no_docs):
    found = pii.find_personal_data(docs)
    assert found.count() == docs.count() and found.columns.count("spans") == 1
    ten = found.where("doc_id = 10").first()
    assert {s.kind for s in ten.spans} == {"email", "ip", "card", "phone", "iban"}
    clean = pii.redact(docs).where("doc_id = 10").first().text
    assert "<EMAIL>" in clean and "@" not in clean and "4111" not in clean
    assert pii.redact(docs).where("doc_id = 1").first().text is None
    assert pii.find_personal_data(no_docs).count() == 0


def base_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_owners.BASE.index(s[0])))


def test_secrets_match_patterns():
    rng, find = random.Random(4), secret_owners.finder()
    parts = ["token", "Api_Key", "PASSWORD", "ſecret", "toKen", " ", "=", ":", '"', "abcdef012", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in find(t) if s[0] in secret_owners.BASE] == base_secrets(t), t


def test_owners_decide(spark, docs, no_docs):
    shared, own = "Zx9" * 5, "aB3dE5fG7hJ9kL1"
    rows = [(i, f"password={shared}", f"s{i % 4}", "en") for i in range(8)] + [(90, f"secret: {own} token={shared}", "s0", None), (None, "token=aaaaaaaaaaaa", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: [h.verdict for h in r.held] for r in secret_owners.find_secrets(df).where("text is not null").collect()}
    assert got[0] == ["copied"] and got[90] == ["live", "copied"] and got[None] == ["weak"]
    assert secret_owners.find_secrets(docs).count() == docs.count()
    assert secret_owners.find_secrets(no_docs).count() == 0


def test_ownership_matches_brute_force(spark):
    rng = random.Random(14)
    values = ["".join(rng.choice("abcdefghijkmnpqrstuvwxyz123456789") for _ in range(16)) for _ in range(12)] + ["b" * 16, "cd" * 8]
    spread = {v: rng.choice([1, 2, 3, 9]) for v in values}
    rows = []
    for k in range(400):
        some = rng.sample(values, rng.randrange(4))
        owner = rng.randrange(9)
        rows.append((k, " ".join(f"token = {v}" for v in some if owner < spread[v]), f"o{owner}", f"r{rng.randrange(12)}"))
    rows += [(1000 + i, f"token={'qwert12345' * 2}", "one", f"r{i}") for i in range(50)]  # one owner, many repositories
    owners, repositories = defaultdict(set), defaultdict(set)
    found = lambda t: [v for v in re.findall("[= ]([a-z0-9]{16,})", t)]
    for _, t, o, r in rows:
        for v in found(t):
            owners[v].add(o)
            repositories[v].add((o, r))
    entropy = lambda v: -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())
    verdict = lambda v: "copied" if len(owners[v]) >= 3 or len(repositories[v]) >= 8 else "live" if entropy(v) >= 2.5 else "weak"
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: [tuple(h) for h in r.held] for r in secret_owners.find_secrets(df, repository=["source", "repo"]).collect()}
    assert got == {k: [(verdict(v), len(owners[v]), len(repositories[v])) for v in found(t)] for k, t, _, _ in rows}
    assert {h[0] for held in got.values() for h in held} == {"copied", "live", "weak"} and got[1000][0][0] == "copied"


def test_key_blocks_are_found_in_linear_time():
    pattern = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
    rng, parts = random.Random(15), ["-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "AbC+/=", "\n", "!", "-----", "BEGIN "]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert secret_owners.pem_blocks(t) == [m.span() for m in pattern.finditer(t)], t
    began = time.perf_counter()
    assert secret_owners.pem_blocks("-----BEGIN RSA PRIVATE KEY-----\n" * 200_000) == []
    assert len(secret_owners.pem_blocks("-----BEGIN RSA PRIVATE KEY-----\n" * 200_000 + "-----END PRIVATE KEY-----")) == 1
    assert time.perf_counter() - began < 10


# ------------------------------------------------------------------ 7


def fingerprint(text):
    w = lowered(text)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_match_brute_force(docs, no_docs):
    rows = [(r[0], fingerprint(r[1])) for r in documents()]
    groups, members = Groups(), defaultdict(list)
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 4:
                groups.join(i, j)
    for i in range(len(rows)):
        members[groups.find(i)].append(rows[i][0])
    least = {k: min((m for m in v if m is not None), default=None) for k, v in members.items()}
    expected = sorted(((rows[i][0], f"{rows[i][1]:016x}", least[groups.find(i)]) for i in range(len(rows))), key=str)
    found = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(F.col("fp")), "component_id")
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def clustered(rng):
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ (np.uint64(1) << rng.integers(0, 64, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, dtype=np.uint64)) for b in base for _ in range(4)]
    hub = [base[0] ^ sum((np.uint64(1) << np.uint64(k) for k in rng.choice(64, 3, replace=False)), np.uint64(0)) for _ in range(500)]
    return np.unique(np.concatenate([base, np.array(near, np.uint64), np.array(hub, np.uint64)]))


def linked(x):
    groups = Groups()
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 4) + i + 1:
            groups.join(i, int(j))
    return [groups.find(i) for i in range(len(x))]


def reached(u, v, nodes):
    groups = Groups()
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        groups.join(a, b)
    return [groups.find(int(f)) for f in nodes]


def test_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 128)
    x = clustered(np.random.default_rng(5))
    expected = [int(x[k]) for k in linked(x)]
    assert reached(*simhash.links(x, x[:0]), x) == expected
    masks, reach = simhash.blocks(4)
    assert sum(m.bit_count() for m in map(int, masks)) == 64 and reach == 1
    found = [simhash.links(x, x[:0], m, reach, 4) for m in masks]
    assert reached(*(np.concatenate([f[i] for f in found]) for i in (0, 1)), x) == expected
    # visitors that come in pieces, shards split by Spark, far below the usual sizes
    monkeypatch.setattr(simhash, "VISITORS", 20)
    fps = spark.createDataFrame([(int(f),) for f in x.view(np.int64)], "fp long")
    assert all(sum(node is None for node in tree) > 4 for tree in simhash.forest(fps, shard_rows=50))
    labels = {r.node: r.label for r in simhash.components(simhash.link_forest(fps, shard_rows=50)).collect()}
    groups = defaultdict(set)
    for f, k in zip(x.view(np.int64).tolist(), expected, strict=True):
        groups[k].add(labels.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_visitors_are_compared_with_homes():
    """Homes of one leaf and the visitors it was dealt hold each link of a home, for some tree."""
    x = clustered(np.random.default_rng(6))
    masks, reach = simhash.blocks(4)
    pairs = set()
    for m in masks:
        for _, fp, home in simhash.deal(simhash.plant(x[::4], m, reach, 4, leaf=8), x):
            near = np.bitwise_count(fp[home][:, None] ^ fp[None, :]) <= 4
            pairs |= {(min(a, b), max(a, b)) for i, j in np.argwhere(near) for a, b in [(int(fp[home][i]), int(fp[j]))]}
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    assert {(min(a, b), max(a, b)) for i, j in np.argwhere(near) for a, b in [(int(x[i]), int(x[j]))]} <= pairs


def test_trees_prune_at_production_size(spark, monkeypatch):
    """Over the texts of sf0.1: all links of all pairs, from branches around vantage points, few pairs compared in full."""
    rows = simhash.fingerprints(table(spark, "/root/testdata/sf0.1", "documents"), []).distinct()
    x = np.unique(np.array([r.fp for r in rows.collect()], np.int64).view(np.uint64))
    branches, compared = [], []
    branch, compare = simhash.branch, simhash._compare
    monkeypatch.setattr(simhash, "branch", lambda *a: branches.append(len(a[0])) or branch(*a))
    monkeypatch.setattr(simhash, "_compare", lambda h, w, most: compared.append(len(h) * (len(h) // 2 + len(w))) or compare(h, w, most))
    masks, reach = simhash.blocks(4)
    found = [simhash.links(x, x[:0], m, reach, 4) for m in masks]
    assert reached(*(np.concatenate([f[i] for f in found]) for i in (0, 1)), x) == [int(x[k]) for k in linked(x)]
    assert len(branches) > 100 and sum(compared) < 0.3 * len(x) ** 2 / 2


# ------------------------------------------------------------------ 8


def test_subset_sums_come_closest():
    rng = random.Random(6)
    for _ in range(200):
        counts, capacity = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}, rng.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= capacity}
        used = packing.closest(counts, capacity)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_packing_is_an_exact_round_trip(docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    window = 64
    packed = packing.pack_documents(docs, window=window, ids=True)
    rows = packed.collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist() and sum(r.length for r in s) <= window
    for i, _, text in ((r[0], 0, r[1]) for r in documents() if r[0] not in (None, 2)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == ids and all(p.doc_tokens == len(ids) for p in pieces)
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= math.ceil(total / window) + 1
    assert packing.sequences(packed).count() == len(by_sequence)
    assert packing.pack_documents(no_docs).count() == 0


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, encode, rng = Tokenizer.from_file(packing.vocabulary_path()), packing._encoder(packing.vocabulary_path()), random.Random(8)
    alphabet = "aAbB sS'’.,!é ÉßİΣσςǰJ̌\x1c\x85\xa0  09日本\n<|>🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


# ------------------------------------------------------------------ 10


@pytest.mark.parametrize("shards", [1, 5])
def test_shards_are_even_and_numbered(docs, no_docs, shards):
    rows = sharding.histogram_sort(docs, shards, parts=4).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    bytes_of, sizes = lambda t: len((t or "").encode()) + 8, defaultdict(int)
    for r in rows:
        sizes[r.shard] += bytes_of(r.text)
    total, largest = sum(sizes.values()), max(bytes_of(r.text) for r in rows)
    assert all(abs(sum(sizes[k] for k in range(i)) - total * i / shards) <= largest + 0.002 * total / shards for i in range(1, shards))
    assert sorted(map(str, (r[:2] for r in rows))) == sorted(map(str, (r[:2] for r in documents())))
    assert sharding.histogram_sort(no_docs, shards).count() == 0


def test_splitters_cut_a_group_of_copies(spark):
    same = spark.createDataFrame([(i, "copy " * 50, "en") for i in range(900)] + [(1000 + i, f"text {i} " * 9, "en") for i in range(900)], "doc_id long, text string, lang string")
    sizes = sharding.histogram_sort(same, 6).groupBy("shard").agg(F.sum(sharding.byte_size()).alias("b")).collect()
    total = sum(r.b for r in sizes)
    assert len(sizes) == 6 and all(abs(r.b - total / 6) < 0.03 * total / 6 + 300 for r in sizes)


def test_sharding_is_native(spark):
    assert "Python" not in sharding.query(spark, SF)._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    found = queries.QUERIES[name](spark, SF)
    n = table(spark, SF, "documents").count()
    if name.split("_")[0] in ("op4", "op9"):
        assert "doc_id" in found.columns and found.count() > 0
    elif name.startswith("op8"):
        assert found.select("doc_id").distinct().count() == n
    else:
        assert found.count() == n


def test_digests_follow_their_spans(spark):
    r = pii.query(spark, SF).where("n_email > 0").first()
    base = [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE]
    assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), f"test_{name}")
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    groups = simhash.near_duplicates(docs)
    assert groups.where("doc_id <> component_id").isEmpty()
    assert decontamination.contaminated(docs, table(spark, SF, "benchmark"), ["doc_id"]).isEmpty()
    assert pii.find_personal_data(docs, ["doc_id"]).where(F.exists("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))).isEmpty()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == before
