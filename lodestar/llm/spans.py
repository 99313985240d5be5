"""Running a span finder over whole texts, and what queries derive from spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
#: A finder gives (kind, start, end) of a text in code points, end exclusive, in the order to report.
Finder = Callable[[str], list[tuple[str, int, int]]]


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping spans as one, under the first one's kind."""
    out: list[tuple[str, int, int]] = []
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((kind, start, end))
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for kind, start, end in merged(spans):
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(parts) + text[at:]


def find_spans(docs: DataFrame, make: Callable[[], Finder], keep: list[str] | None = None, text: str = "text", redact: bool = False, name: str = "spans") -> DataFrame:
    """Columns keep of docs (all of them by default) and the spans, under a name; redact: the text with its spans replaced.

    make builds the finder once in each task. Null text has no spans, and stays null when redacted.
    An input column of that name is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("lodestar_scanned"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, SPAN)])
    at = keep.index(text) if redact and text in keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = make()
        for batch in (part for whole in batches for part in slices(whole.rename_columns([*map(str, range(len(keep))), "scanned"]), "scanned")):
            columns = batch.columns[:-1]
            texts = [x.as_py() for x in batch.columns[-1]]
            found = [finder(t) if t else [] for t in texts]
            offsets = [0]
            for f in found:
                offsets.append(offsets[-1] + len(f))
            flat = [s for f in found for s in f]
            spans = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], t.type) for i, t in enumerate(_ARROW)], fields=list(_ARROW))
            if at is not None:
                columns[at] = pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], names=[*keep, name])

    return rows.mapInArrow(run, schema)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest(spans: Column, *kinds: str) -> Column:
    return F.sha2(as_text(of_kinds(spans, *kinds)), 256)


def count(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, kind)).cast("long")
