"""Operator 6, secrets judged by who holds them.

Candidates are found in every whole text: assigned passwords and tokens, access key ids, long
hexadecimal strings, private key blocks and credentials in web addresses. The corpus then says how
often each is held: candidate hashes are grouped by distinct repositories and owners. A value that
COPIED_OWNERS owners hold, or that stands in COPIED_REPOSITORIES repositories of whatever owners, is a
copied example; one that is held by fewer, and looks random, is taken for live; the rest are weak. Both
counts are returned with the verdict.

Null and empty texts have no candidates. A null owner or repository counts as one of that name.
A row of the input gives a row of the result; equal rows count once for ownership.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table
from .spans import Finder, as_text, count, digest, find_spans

#: The order in which spans with the same start are reported.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "basic")
#: From this many distinct owners or repositories on, a value is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 8
#: Values with fewer bits of entropy a character are too plain to be live.
LIVE_BITS = 2.5

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM_BEGIN, _PEM_END = (re.compile(rf"-----{word} (?:[A-Z0-9]+ )*PRIVATE KEY-----") for word in ("BEGIN", "END"))
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*")
_BASIC = re.compile(r"://[^\s/:@]+:([^\s/:@]{6,})@[A-Za-z0-9.-]+")
_RANK = {k: i for i, k in enumerate(KINDS)}


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """From a header of a private key to the first footer after it, where only a key's characters lie between."""
    ends, out, free, run = list(_PEM_END.finditer(text)), [], 0, 0
    k = 0
    for begin in _PEM_BEGIN.finditer(text):
        while k < len(ends) and ends[k].start() < begin.end():
            k += 1
        if k == len(ends):
            break
        if begin.start() < free:
            continue
        if run < begin.end():  # a run of such characters holds all headers in it
            run = _PEM_BODY.match(text, begin.end()).end()
        if ends[k].start() <= run:
            free = ends[k].end()
            out.append((begin.start(), free))
    return out


def finder() -> Finder:
    """A function from a text to its candidate spans, in order of start, then kind."""

    def find(text: str) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        low = text.lower()
        if any(c in low for c in _CUES):
            out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
        if "PRIVATE KEY-----" in text:
            out += [("pem", *s) for s in pem_blocks(text)]
        if "://" in text:
            out += [("basic", *m.span(1)) for m in _BASIC.finditer(text)]
        return sorted(out, key=lambda s: (s[1], _RANK[s[0]], s[2]))

    return find


def secret_of(kind: str, found: str) -> str:
    """The value itself, which is what copies share: an assignment without its name and quotes."""
    return _ASSIGN.match(found)[2] if kind == "assign" else re.sub(r"\s+", "", found)


def _candidates(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, the spans, and for each span the digest of its value and whether that looks random."""
    import hashlib
    from collections import Counter
    from math import log2

    found = find_spans(docs, finder, [*keep, text], text)
    schema = T.StructType([*[found.schema[c] for c in keep], found.schema["spans"], T.StructField("values", T.ArrayType(T.StringType())), T.StructField("random", T.ArrayType(T.BooleanType()))])

    def bits(value: str) -> float:
        n = len(value)
        return -sum(c / n * log2(c / n) for c in Counter(value).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, randoms = [], []
            for t, spans in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True):
                own = [secret_of(s["kind"], t.as_py()[s["start"] : s["end"]]) for s in spans.as_py()] if len(spans) else []
                values.append([hashlib.sha256(v.encode()).hexdigest() for v in own])
                randoms.append([bits(v) >= LIVE_BITS for v in own])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], batch.column(len(keep) + 1), pa.array(values, pa.list_(pa.string())), pa.array(randoms, pa.list_(pa.bool_()))], names=[*keep, "spans", "values", "random"])

    return found.mapInArrow(run, schema)


def find_secrets(docs: DataFrame, keep: list[str] | None = None, text: str = "text", owner: list[str] = ("source",), repository: list[str] = ("source", "lang"), copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Columns keep of docs (all by default), spans, and held, for each span its verdict (copied, live or weak), owners and repositories.

    Ownership is counted over distinct (value, owner, repository) rows, so a value that a third of
    all documents hold shrinks to one row for each holder before it is grouped by value. The verdicts are
    written before they are joined, so that adaptive execution can split the rows of a value that many hold.
    Input columns named spans or held are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "held")]
    name = lambda cs: F.concat_ws("\x1f", *[F.coalesce(F.col(f"row.`{c}`").cast("string"), F.lit("\x00")) for c in cs])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *owner, *repository])]).alias("row"), F.col(f"`{text}`").alias("scanned"))
    found = materialise(_candidates(rows, ["row"], "scanned").withColumn("at", F.monotonically_increasing_id()), "candidates")
    each = found.select("at", name(owner).alias("owner"), name(repository).alias("repository"), F.posexplode(F.arrays_zip("values", "random")).alias("i", "x")).select("at", "owner", "repository", "i", F.col("x.values").alias("value"), F.col("x.random").alias("random"))
    held = each.select("value", "owner", "repository").distinct().groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    held = materialise(held, "held")
    verdict = F.when((F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories), "copied").when(F.col("random"), "live").otherwise("weak")
    one = F.struct("i", F.struct(verdict.alias("verdict"), "owners", "repositories").alias("held"))
    judged = each.join(held, "value").select("at", one.alias("one")).groupBy("at").agg(F.transform(F.array_sort(F.collect_list("one")), lambda s: s["held"]).alias("held"))
    none = F.array().cast("array<struct<verdict:string,owners:bigint,repositories:bigint>>")
    out = found.where(F.size("spans") > 0).join(judged, "at", "left").unionByName(found.where(F.size("spans") == 0).withColumn("held", none))
    return out.select(*[F.col(f"row.`{c}`") for c in keep], "spans", "held")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    spans = F.col("spans")
    return found.select(
        "doc_id", *[count(spans, k).alias(f"n_{k}") for k in BASE], digest(spans, *BASE).alias("base_sha256"), as_text(spans).alias("spans"),
        *[F.array_join(F.col(f"held.{c}").cast("array<string>"), ",").alias(n) for c, n in (("verdict", "verdicts"), ("owners", "owners"), ("repositories", "repositories"))],
    )
