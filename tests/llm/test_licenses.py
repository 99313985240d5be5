"""The license scan against all windows, on notices that look alike, and on awkward texts."""

import random
import re
import time

import numpy as np

from lodestar.llm import licenses
from lodestar.llm.licenses import NOTICES, Notice, Template

BODY = {n.license: n.text for n in NOTICES}


def found(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in licenses.find_licenses(df, **options).collect():
        out[r.doc_id].append((r.license, round(r.license_coverage, 3), texts[r.doc_id][r.start : r.end]))
    return out


def test_alignment_pairs_equal_words_in_order():
    rng = random.Random(9)
    for _ in range(500):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert licenses.align(list("abcXdef"), list("abcdef")) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4), (6, 5)]


def test_increasing_is_longest():
    rng = random.Random(10)
    for _ in range(200):
        places = rng.sample(range(20), rng.randint(0, 8))
        best = max((bin(m).count("1") for m in range(1 << len(places)) if (s := [p for k, p in enumerate(places) if m >> k & 1]) == sorted(s)), default=0)
        assert len(licenses._increasing([(p, k) for k, p in enumerate(places)])) == best


def test_relatives_are_told_apart(spark):
    none = ["Released under the BSD License.", "under the Elastic License.", "Apache License, Version 1.1", "Licensed under the Apache License, Version 1.1", "Released under the MIT-like License", "", None, "under"]
    lines = {
        "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
        "This is under the GNU General Public License, version 2": "GPL-2.0", "(This work is licensed under the GNU General Public License, version 3.)": "GPL-3.0",
        "under the GNU Affero General Public License, version 3": "AGPL-3.0", "under the GNU Lesser General Public License v2.1": "LGPL-2.1", "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "a Creative Commons work, under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    }
    got = found(spark, none + list(lines))
    assert all(not got[i] for i in range(len(none)))
    assert [[g[0] for g in got[i + len(none)]] for i in range(len(lines))] == [[x] for x in lines.values()]
    assert all(g[1] == 1 for i in range(len(lines)) for g in got[i + len(none)])
    bodies = list(BODY)
    got = found(spark, [BODY[b] for b in bodies])
    assert [[g[0] for g in got[i]] for i in range(len(bodies))] == [[b] for b in bodies]


def test_changed_far_and_repeated_notices(spark):
    noise = " ".join(f"w{i % 97}" for i in range(3000))
    mit = BODY["MIT"]
    changed = mit.replace("hereby", "thereby")
    commented = "\n".join(f" * {line.strip()}" for line in BODY["Apache-2.0"].splitlines())
    line = "Released under the MIT License."
    got = found(spark, [changed, f"{changed} {noise} hereby", f"{mit} {changed} {mit}", f"{noise}\n{line}\n{noise}\n{line} {line}", commented, mit.upper().replace("COPIES", "COPIES,,"), " ".join(mit.split()[:60])])
    assert [x[:2] for x in got[0]] == [("MIT", round(1 - 1 / len(mit.split()), 3))] == [x[:2] for x in got[1]]
    assert [x[0] for x in got[2]] == ["MIT"] * 3 and sorted(x[1] < 1 for x in got[2]) == [False, False, True]
    assert [x[2] for x in got[3]] == ["under the MIT License"] * 3
    assert [x[:2] for x in got[4]] == [("Apache-2.0", 1.0)] and [x[:2] for x in got[5]] == [("MIT", 1.0)] and got[6] == []


def plain(text, template):
    """As the module's text says, over all windows that begin at a word of the template."""
    best = None
    for at in range(len(text)):
        for width in template.widths:
            window = text[at : at + width]
            count = sum(min(window.count(w), template.words.count(w)) for w in set(template.words))
            shown = licenses.stretch(window, template) if window and window[0] in template.words else None
            if shown and (best is None or (shown[0], count, at, -width) > best[0]):
                best = ((shown[0], count, at, -width), at + shown[1], at + shown[2])
    if best is None:
        return []
    a, b = best[1:]
    return [*plain(text[:a], template), (best[0][0], a, b), *[(n, x + b + 1, y + b + 1) for n, x, y in plain(text[b + 1 :], template)]]


def test_windows_match_brute_force(monkeypatch):
    monkeypatch.setattr(licenses, "WHOLE", 4)
    rng, shown = random.Random(11), 0
    for trial in range(300):
        n = rng.choice([3, 6, 10])
        words = [f"x{rng.randrange(n)}" for _ in range(n)]
        template = Template("t", Notice("t", " ".join(words), (" ".join(words[1:3]),) if trial % 2 else ()), 0.7)
        text = []
        for _ in range(rng.randrange(5)):
            text += [rng.choice(words + ["other"]) for _ in range(rng.randrange(8))]
            text += [w for w in words if rng.random() < 0.9]
        h = licenses.words_of(" ".join(text))
        got = licenses.stretches(np.array(h, np.uint64), template)
        assert got == plain(h, template)
        shown += len(got)
    assert shown > 200


def test_awkward_tables_and_templates(spark, docs, no_docs):
    rows = licenses.find_licenses(docs).where("doc_id = 12").collect()
    assert [r.license for r in rows] == ["GPL-3.0"] * 3 and rows[0].item_id == "i"
    assert licenses.find_licenses(no_docs).count() == 0
    assert licenses.find_licenses(docs, templates={}).count() == 0
    assert licenses.find_licenses(docs, templates={"empty": Notice("x", "")}).count() == 0
    own = {"w": Notice("W", "word word")}
    assert found(spark, ["word word word", "no"], templates=own)[0] == [("W", 1.0, "word word")]


def test_long_texts_of_template_words_take_bounded_time():
    words = re.findall(r"\S+", BODY["MIT"])
    rng = random.Random(12)
    text = licenses.words_of(" ".join(rng.choice(words) for _ in range(300_000)) + " " + BODY["MIT"])
    began = time.perf_counter()
    got = licenses.stretches(np.array(text, np.uint64), Template("MIT", licenses.TEMPLATES["MIT"], 0.8))
    assert [g[0] for g in got] == [len(words)] and time.perf_counter() - began < 60
