"""Readers and writers of requests, results, catalogs and report rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.textrules import UNSAFE

RESULT = "id long, query string, system string, sql string, params map<string,string>, status string, error string"
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lodestar-"))
    return f"{root.rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question) of files that each hold one JSON array of strings; ids count from 1.

    A long list is dealt to folders first=N, N being the number of questions before the folder's file.
    """
    listed = spark.read.text(path, wholetext=True)
    before = F.col("first").cast("long") if "first" in listed.columns else F.lit(0)
    each = listed.select(before.alias("first"), F.posexplode(F.from_json("value", "array<string>")).alias("i", "question"))
    return each.select((F.col("first") + F.col("i") + 1).cast("long").alias("id"), "question")


def read_results(spark: SparkSession, path: str, schema: str = RESULT, lines: bool = False) -> DataFrame:
    """Rows of files that each hold one JSON array of objects; lines: that hold one such array a line."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_report_catalog(spark: SparkSession, path: str, report: str, lines: bool = False) -> DataFrame:
    """(id, and the fields of report, a struct type) of files that each hold one JSON object keyed by id.

    lines: that hold one such object a line.
    """
    each = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", f"map<string,{report}>")).alias("id", "report"))
    return each.select("id", "report.*")


#: A comment, a quoted text or name, the end of a statement, or any other character.
_TOKEN = re.compile(r"(?s)(--[^\n]*|/\*.*?\*/|/\*)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`[^`]*`|['\"`])|(;)|(.)")
#: What a statement may begin with, and calls that leave the engine.
_READS = re.compile(r"(?i)[\s(]*(select|with)\b")
_LEAVES = re.compile(r"(?i)\b(reflect|java_method|try_reflect)\s*\(|\busing\s*''")


def read_only_statements(text: str) -> list[str]:
    """The statements of a text, without comments, split outside quotes.

    Refused if one does not begin with SELECT or WITH, has a word that writes outside quotes, or calls
    code outside the engine; so are comments and quotes without an end.
    """
    statements, code = [""], [""]
    for m in _TOKEN.finditer(text):
        comment, quoted, end, other = m.groups()
        if comment == "/*" or (quoted and len(quoted) == 1):
            raise ValueError("only read-only statements are run: a comment or quote has no end")
        if end:
            statements.append("")
            code.append("")
        else:
            statements[-1] += " " if comment else m[0]
            code[-1] += " " if comment else "''" if quoted else other
    found = [(s.strip(), c) for s, c in zip(statements, code, strict=True) if s.strip()]
    writes = re.compile(r"(?i)\b(" + "|".join(UNSAFE["long"]) + r")(?:\b|$)")
    if not found or any(not _READS.match(c) or writes.search(c) or _LEAVES.search(c) for _, c in found):
        raise ValueError("only read-only statements are run")
    return [s for s, _ in found]


def run_saved_query(spark: SparkSession, text: str, params: dict | None = None) -> DataFrame:
    """The result of the last statement of a stored text with :name parameters; refused if not read-only."""
    statements = read_only_statements(text)
    out = None
    for s in statements:
        out = spark.sql(s, args=params or {})
    return out


def normalise_result(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as ISO strings."""

    def as_plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):  # as it is, in no zone
            return F.concat(F.substring(c.cast("string"), 1, 10), F.lit("T"), F.substring(c.cast("string"), 12, 8)).alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
        return c

    return df.select(*map(as_plain, df.schema))


def write_annotations(df: DataFrame, path: str) -> None:
    """As JSON lines and as CSV with a header, under path."""
    df.write.mode("overwrite").json(f"{path}/json")
    as_is = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**as_is).csv(f"{path}/csv")


def read_annotations(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of write_annotations' JSON, and those of its CSV.

    In the CSV nothing is null and "" the empty text. A reader takes for null what equals its nullValue, by default
    both of these; no text equals this one. Without an escape of the escape, characters of code 0 in quoted texts are lost.
    """
    as_is = {"header": True, "multiLine": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "nullValue": uuid.uuid4().hex}
    return spark.read.schema(schema).json(f"{path}/json"), spark.read.options(**as_is).schema(schema).csv(f"{path}/csv")


def write_catalog(df: DataFrame, path: str) -> None:
    """The whole catalog anew. path must not be one that df reads: readers switch when it is complete."""
    df.write.mode("overwrite").parquet(path)
