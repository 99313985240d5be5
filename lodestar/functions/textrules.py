"""Rule tables as Columns: tagging of requests, and scanning and scoring of SQL texts, row by row."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dimensions import DIMENSIONS
from .metrics import METRICS
from .rule_values import (
    DIM_SQL_TOKENS,
    DIMENSION_KEYWORDS,
    EXPECTED_DIMENSION,
    EXPECTED_METRIC,
    EXPECTED_TIME,
    INTENT_ALIASES,
    INTENT_PATTERNS,
    METRIC_KEYWORDS,
    METRIC_SQL_TOKENS,
    SCORE_REASONS,
    TIME_SQL_TOKENS,
    UNSUPPORTED_MARKERS,
)

#: Time phrases of a request, and keyword sets of unsafe SQL.
TIME_PHRASES = (
    ("today", "today"), ("yesterday", "yesterday"), ("this morning", "today"), ("last week", "last week"), ("this week", "this week"),
    ("last month", "last month"), ("this month", "this month"), ("last year", "last year"), ("this year", "this year"), ("current quarter", "this month"),
)
UNSAFE = {
    "short": ("drop", "delete", "update", "insert", "truncate", "alter", "xp_"),
    "long": ("drop", "delete", "update", "insert", "truncate", "alter", "create", "grant", "revoke", "exec", "xp_"),
    "full": ("insert", "update", "delete", "drop", "alter", "truncate", "exec", r"xp_\w+", "union", "except", "intersect", r"sys\.", "information_schema", "create", "grant", "revoke"),
}
UNSAFE_SUBSTRINGS = ("drop", "delete", "update", "insert")
#: Parts of a name that decide a request class that is no alias.
INTENT_PARTS = (("top", "ranking"), ("trend", "trend"), ("comp", "comparison"), ("segment", "segment"), ("funnel", "funnel"), ("cohort", "cohort"), ("correlat", "correlate"), ("list", "tabular"), ("detail", "tabular"), ("lookup", "tabular"))
#: Fixed value: how a request says over (group 1) or under (group 2) an amount.
THRESHOLD = r"\b(?:exceeds?|greater than|more than|above|over)\s+\$?([\d,]+)|\b(?:less than|below|under)\s+\$?([\d,]+)"
#: Patterns that ask for groups; what shows a refusal, and what shows SQL.
GROUPED_PATTERNS = ("Ranking", "Trend", "Comparison", "Summary", "Segment", "Cohort", "Correlate", "Tabular")
REFUSALS = ("cannot answer", "not available", "not supported", "outside", "clarify")
ACTIONS = ("select ", "update ", "delete ", "insert ", "drop ", "alter ")
#: What normalised texts have a hyphen and nothing for.
DASHES, MARKS = "‑–—", "`[]"


def any_of(text: Column, phrases: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def one_pass(phrases: Iterable[str]) -> str:
    """A pattern that finds whether a text holds any of the phrases, in one pass: their common beginnings are shared."""
    tree: dict = {}
    for phrase in phrases:
        at = tree
        for c in phrase:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        if "" in at:  # what goes on behind a phrase is found with it
            return ""
        each = [re.escape(c) + written(below) for c, below in sorted(at.items())]
        return each[0] if len(each) == 1 else "(?:" + "|".join(each) + ")"

    return written(tree)


def first_keyword(text: Column, rules: Iterable[tuple[str, Iterable[str]]]) -> Column:
    return F.coalesce(*[F.when(any_of(text, phrases), F.lit(label)) for label, phrases in rules])


def lower_case(text: Column, lowered: bool) -> Column:
    """Rules that take lowered expect a column in lower case: as a column of its own it is made once for all of them."""
    return text if lowered else F.lower(text)


def _begins(pattern: str) -> str:
    """The fixed letters with which a pattern of requests begins, at the edge of a word."""
    return re.match(r"(?:\^\\s\*|\\b)([^\\.?*+^$|()\[\]{}]+)", pattern)[1]


def intent_gate() -> str:
    """A pattern that a text matches if any of the request patterns does; others may."""
    return r"\b" + one_pass(_begins(p) for _, patterns in INTENT_PATTERNS for p in patterns)


def classify_intent(text: Column, lowered: bool = False) -> Column:
    """The first class with a pattern in the request, else kpi.

    Every pattern begins, at the edge of a word, with letters that are fixed: a text without any of these has no
    class, and a pattern is tried where its own are.
    """
    q = lower_case(text, lowered)
    fits = lambda patterns: reduce(lambda a, b: a | b, [F.contains(q, F.lit(_begins(p))) & q.rlike(p) for p in patterns])
    found = F.coalesce(*[F.when(fits(patterns), F.lit(label)) for label, patterns in INTENT_PATTERNS])
    return F.coalesce(F.when(q.rlike(intent_gate()), found), F.lit("kpi"))


def classify_metric(text: Column, lowered: bool = False) -> Column:
    return first_keyword(lower_case(text, lowered), METRIC_KEYWORDS)


def classify_dimension(text: Column, lowered: bool = False) -> Column:
    return first_keyword(lower_case(text, lowered), DIMENSION_KEYWORDS)


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_time_term(text: Column, lowered: bool = False) -> Column:
    q = lower_case(text, lowered)
    past, ago = _number(q, r"\bpast (\d+) days?\b"), _number(q, r"\b(\d+) days? ago\b")
    phrases = [F.when(q.rlike(rf"\b{p}\b"), F.lit(label)) for p, label in TIME_PHRASES]
    return F.coalesce(F.concat(F.lit("past "), past, F.lit(" days")), F.concat(ago, F.lit(" days ago")), *phrases)


def extract_topn(text: Column, lowered: bool = False) -> Column:
    """(n, sort) of top N or bottom N; null fields without either."""
    q = lower_case(text, lowered)
    top, bottom = _number(q, r"\btop (\d+)"), _number(q, r"\bbottom (\d+)")
    return F.struct(F.coalesce(top, bottom).cast("long").alias("n"), F.when(top.isNotNull(), "desc").when(bottom.isNotNull(), "asc").alias("sort"))


def extract_threshold(text: Column, lowered: bool = False) -> Column:
    """(op, amount) of an over or under phrase, where a dimension was found; null otherwise."""
    q = lower_case(text, lowered)
    over, under = _number(q, THRESHOLD, 1), _number(q, THRESHOLD, 2)
    amount = F.try_to_number(F.regexp_replace(F.coalesce(over, under), ",", ""), F.lit("999999999999999999")).cast("long")
    found = (over.isNotNull() | under.isNotNull()) & classify_dimension(q, lowered=True).isNotNull()
    return F.when(found, F.struct(F.when(over.isNotNull(), ">").otherwise("<").alias("op"), amount.alias("amount")))


def normalise_intent(name: Column) -> Column:
    """A class name as one of the known classes: aliases, then the first part that fits; kpi for null."""
    v = F.lower(name)
    out = F.when(v.isNull(), "kpi")
    for alias, target in INTENT_ALIASES.items():
        out = out.when(v == alias, target)
    for part, target in INTENT_PARTS:
        out = out.when(F.contains(v, F.lit(part)), target)
    return out.otherwise(v)


_FILTER = "struct<field:string,dimension:string,metric:string,name:string,operator:string,op:string,value:string>"
REQUEST = f"struct<intent:string,intent_class:string,metric_term:string,dimension_term:string,filters:array<{_FILTER}>,confidence:string,needs_clarification:boolean>"


def normalise_request(raw: Column) -> Column:
    """One request in JSON, perhaps fenced, perhaps in a list: class, terms, clean filters, defaults."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(raw))
    listed = F.when(F.startswith(body, F.lit("[")), F.get(F.from_json(body, f"array<{REQUEST}>"), F.lit(0))).otherwise(F.from_json(body, REQUEST))

    def clean(f: Column) -> Column:
        return F.struct(F.coalesce(f["field"], f["dimension"], f["metric"], f["name"]).alias("field"), F.coalesce(f["operator"], f["op"], F.lit("=")).alias("operator"), f["value"].alias("value"))

    filters = F.filter(F.transform(F.coalesce(listed["filters"], F.array().cast(f"array<{_FILTER}>")), clean), lambda f: f["field"].isNotNull() & f["value"].isNotNull())
    return F.struct(
        normalise_intent(F.coalesce(listed["intent_class"], listed["intent"])).alias("intent_class"), listed["metric_term"].alias("metric_term"), listed["dimension_term"].alias("dimension_term"),
        filters.alias("filters"), F.coalesce(listed["confidence"], F.lit("high")).alias("confidence"), F.coalesce(listed["needs_clarification"], F.lit(False)).alias("needs_clarification"),
    )


def vocabulary(kind: str) -> list[tuple[int, str, str, str]]:
    """(position, id, description, label) of the metrics or dimensions, a bounded list."""
    return [(i, o.id, o.description, o.label) for i, o in enumerate((METRICS if kind == "metric" else DIMENSIONS).values())]


def resolve_term(term: Column, kind: str, clean: bool = False) -> Column:
    """The id a term stands for: equal, then part of one another, then in a description, then a label.

    clean: the term is trimmed and in lower case, as a column of its own.
    """
    t, words = term if clean else F.lower(F.trim(term)), vocabulary(kind)
    tiers = [
        [(t == id.lower(), id) for _, id, _, _ in words],
        [(F.contains(t, F.lit(id.lower())) | F.contains(F.lit(id.lower()), t), id) for _, id, _, _ in words],
        [(F.contains(F.lit(d.lower()), t), id) for _, id, d, _ in words],
        [(t == label.lower(), id) for _, id, _, label in words],
    ]
    out = F.when(t.isNull() | (t == ""), "")
    for tier in tiers:
        for condition, id in tier:
            out = out.when(condition, id)
    return out.otherwise("unknown")


def resolve_terms(requests: DataFrame, column: str, kind: str, as_name: str) -> DataFrame:
    """requests with the id of each term. Terms are resolved once each, then joined back."""
    terms = requests.select(F.col(column).alias("term")).distinct().withColumn("clean", F.lower(F.trim("term"))).withColumn(as_name, resolve_term(F.col("clean"), kind, clean=True))
    return requests.join(terms, requests[column].eqNullSafe(terms["term"]), "left").drop("term", "clean")


def coverage(metric_term: Column, dimension_term: Column, clean: bool = False) -> Column:
    """(valid, reason): whether both terms of a request are known. clean: as for resolve_term."""
    def part(term: Column, kind: str) -> Column:
        t = term if clean else F.lower(F.trim(term))
        known = ", ".join(sorted(METRICS if kind == "metric" else DIMENSIONS))
        return F.when(resolve_term(t, kind, clean=True) == "unknown", F.concat(F.lit(f"Unknown {kind} '"), t, F.lit(f"'. Available: {known}")))

    reasons = F.array_compact(F.array(part(metric_term, "metric"), part(dimension_term, "dimension")))
    return F.struct((F.size(reasons) == 0).alias("valid"), F.array_join(reasons, ". ").alias("reason"))


# ------------------------------------------------------------------ expected labels and scores


def normalise_text(text: Column) -> Column:
    """Lower case, no backticks and brackets, one kind of dash, single blanks; empty for null."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for found, instead in [(c, "-") for c in DASHES] + [(c, "") for c in MARKS] + [(c, " ") for c in "\n\t\x0b\f\r"]:
        plain = F.replace(plain, F.lit(found), F.lit(instead))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def raw_pattern(phrases: Iterable[str]) -> str:
    """A pattern that a text matches if its normalised form holds any of the phrases; blanks at their ends do not count."""
    marks = r"[`\[\]]*"
    special = {" ": r"[\s\x0B][\s\x0B`\[\]]*", "-": f"[-{DASHES}]", "i": "[iI\u0130]", "k": "[kK\u212a]"}  # the other letters that lower case makes an i or k of
    letter = lambda c: special.get(c) or (f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c))
    return "|".join(marks.join(letter(c) for c in p.strip()) for p in phrases)


def may_hold(text: Column, phrases: Iterable[str]) -> Column:
    """False only if the normalised text holds none of the phrases: one pass over the text as it is for all of them."""
    pattern = raw_pattern(phrases)

    @F.arrow_udf("boolean")
    def search(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return F.coalesce(search(text), F.lit(False))


def unsupported_reasons(q: Column) -> Column:
    """The reasons a question cannot be answered, each once, in the order of the rules.

    q: a column that holds the question's normalised text. As a column of its own it is made once
    for all rules; an expression would be evaluated anew by each of them.
    """
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(q, F.lit(m)), F.lit(r)) for m, r in UNSUPPORTED_MARKERS]))), "; ")


def expected_metric(q: Column) -> Column:
    return F.when(F.contains(q, F.lit("average number of items per order")), "quantity").otherwise(F.coalesce(first_keyword(q, EXPECTED_METRIC), F.lit("order_count")))


def expected_dimension(q: Column, pattern: Column) -> Column:
    grouped = F.when(any_of(q, ("by month", "daily", "weekly")), "date").otherwise(first_keyword(q, EXPECTED_DIMENSION))
    return F.when(pattern.isin(*GROUPED_PATTERNS), grouped).when(F.contains(q, F.lit(" per payment method")), "payment_method")


def expected_time(q: Column) -> Column:
    return first_keyword(q, EXPECTED_TIME)


def expected_behavior(unsupported: Column) -> Column:
    return F.when(unsupported == "", "answer").otherwise("clarify_or_reject")


def expected_labels(q: Column, pattern: Column) -> Column:
    """(behavior, metric, dimension, time, unsupported) expected of an answer. q: as for unsupported_reasons."""
    why = unsupported_reasons(q)
    return F.struct(expected_behavior(why).alias("behavior"), expected_metric(q).alias("metric"), expected_dimension(q, pattern).alias("dimension"), expected_time(q).alias("time"), why.alias("unsupported"))


def extract_sql(text: Column) -> Column:
    """The body of the first fenced block, else the text, trimmed."""
    fenced = F.regexp_extract(text, r"(?is)```(?:sql)?\s*(.*?)```", 1)
    whole = F.regexp_extract(text, r"(?is)```(?:sql)?\s*(.*?)```", 0)
    return F.trim(F.when(F.contains(text, F.lit("```")) & (whole != ""), fenced).otherwise(F.coalesce(text, F.lit(""))))


def unsafe_word(sql: Column, rules: str = "long") -> Column:
    """The first keyword of a rule set in the SQL, in lower case; null if none. One alternation."""
    found = F.regexp_extract(F.lower(extract_sql(sql)), r"\b(" + "|".join(UNSAFE[rules]) + r")(?:\b|$)", 1)
    return F.nullif(found, F.lit(""))


def unsafe_substring(sql: Column) -> Column:
    """Whether the SQL holds one of four words anywhere, even inside a longer word."""
    return any_of(F.lower(F.coalesce(sql, F.lit(""))), UNSAFE_SUBSTRINGS)


def _has_group(text: Column, groups: list[list[str]]) -> Column:
    out = F.lit(False)
    for g in groups:
        each = F.lit(True)
        for token in g:
            each = each & F.contains(text, F.lit(token))
        out = out | each
    return out


def _shows(text: Column, label: Column, tokens: dict[str, list[list[str]]]) -> Column:
    """Whether the text shows the label; labels without tokens always do."""
    out = F.when(label.isNull(), True)
    for name, groups in tokens.items():
        out = out.when(label == name, _has_group(text, groups))
    return out.otherwise(True)


def score_text(sql: Column, params: Column) -> Column:
    """The normalised text by which an answer is scored: its SQL and parameters."""
    return normalise_text(F.concat_ws(" ", extract_sql(sql), normalise_text(params)))


def _no(reason: Column) -> Column:
    return F.struct(F.lit(False).alias("correct"), reason.alias("reason"))


def _yes(reason: Column) -> Column:
    return F.struct(F.lit(True).alias("correct"), reason.alias("reason"))


def score_by_metric(s: Column, behavior: Column, m: Column, unsupported: Column, executed: Column) -> Column:
    """What score finds before it looks at dimension and time; null if those decide."""
    say = {k: F.lit(v) for k, v in SCORE_REASONS.items()}
    refused = any_of(s, REFUSALS) & ~any_of(s, ACTIONS)
    both = any_of(s, ("date_format", "month")) & F.contains(s, F.lit("ordertotal")) & F.contains(s, F.lit("customer")) & any_of(s, ("limit 5", "top 5"))
    reject = behavior.isin("clarify_or_reject", "reject_write_request")
    return (
        F.when(reject & refused, _yes(say["avoided"]))
        .when(reject, _no(F.coalesce(F.nullif(unsupported, F.lit("")), say["should_reject"])))
        .when((behavior == "multi_part_answer") & ~executed, _no(say["not_executed"]))
        .when(behavior == "multi_part_answer", F.struct(both.alias("correct"), say["multi_part"].alias("reason")))
        .when(~executed, _no(say["not_executed"]))
        .when(unsupported != "", _no(unsupported))
        .when(~_shows(s, m, METRIC_SQL_TOKENS), _no(F.concat(say["metric"], m)))
    )


def score_by_groups(s: Column, pattern: Column, d: Column, t: Column) -> Column:
    """(correct, reason) of an answer that score_by_metric leaves open."""
    say = {k: F.lit(v) for k, v in SCORE_REASONS.items()}
    groups = ~F.coalesce(pattern.isin(*GROUPED_PATTERNS), F.lit(False)) & d.isNull() & F.contains(s, F.lit(" group by "))
    return (
        F.when(~_shows(s, d, DIM_SQL_TOKENS), _no(F.concat(say["dimension"], d)))
        .when(~_shows(s, t, TIME_SQL_TOKENS), _no(F.concat(say["time"], t)))
        .when(groups, _no(say["grouped"]))
        .otherwise(_yes(say["correct"]))
    )


def score(s: Column, behavior: Column, pattern: Column, m: Column, d: Column, t: Column, unsupported: Column, executed: Column) -> Column:
    """(correct, reason) of an answer, by keywords, conservatively. s: a column that holds its score_text."""
    return F.coalesce(score_by_metric(s, behavior, m, unsupported, executed), score_by_groups(s, pattern, d, t))


def _phrases(rules: Iterable[tuple[str, Iterable[str]]]) -> list[str]:
    return [p for _, phrases in rules for p in phrases]


def score_questions(rows: DataFrame) -> DataFrame:
    """rows (text, executed) with unsupported, m (the expected metric, where it matters) and q (the text, if it may have a dimension or time).

    A text is normalised and searched phrase by phrase only if one pass says that it may hold one.
    """
    groups = ["by month", "daily", "weekly", " per payment method", *_phrases(EXPECTED_DIMENSION), *_phrases(EXPECTED_TIME)]
    may = {"marked": [m for m, _ in UNSUPPORTED_MARKERS], "named": ["average number of items per order", *_phrases(EXPECTED_METRIC)], "grouped": groups}
    rows = rows.withColumns({k: may_hold(F.col("text"), phrases) for k, phrases in may.items()})
    searched = F.col("marked") | (F.col("named") & F.col("executed"))
    rows = rows.withColumn("q", normalise_text(F.when(searched, F.col("text"))))
    rows = rows.withColumn("unsupported", F.when(F.col("marked"), unsupported_reasons(F.col("q"))).otherwise(""))
    open_ = F.col("executed") & (F.col("unsupported") == "")
    m = F.when(open_, F.when(F.col("named"), expected_metric(F.col("q"))).otherwise("order_count"))
    q = F.when(open_ & F.col("grouped"), F.when(searched, F.col("q")).otherwise(F.col("text")))
    return rows.withColumns({"m": m, "q": q}).drop("text", *may)


def score_answers(rows: DataFrame) -> DataFrame:
    """rows (text) with s: its score_text, or nothing if it can show neither a refusal nor a metric, which then decides."""
    shown = [max(group, key=len) for groups in METRIC_SQL_TOKENS.values() for group in groups]
    rows = rows.withColumn("shows", may_hold(F.col("text"), [*REFUSALS, *shown]))
    rows = rows.withColumn("s", F.when(F.col("shows"), F.col("text")))
    return rows.withColumn("s", score_text(F.col("s"), F.lit(""))).drop("text", "shows")


def score_texts(rows: DataFrame) -> DataFrame:
    """rows (q, unsupported, pattern, executed, s) with f: the score against the labels that are expected of q."""
    return score_labelled(rows.withColumn("m", F.when(F.col("executed") & (F.col("unsupported") == ""), expected_metric(F.col("q")))))


def score_labelled(rows: DataFrame) -> DataFrame:
    """rows (q, unsupported, m, pattern, executed, s) with f; q may be as it came, and null if it has no dimension and time.

    Most answers fall before their dimension and time matter, so these are sought only for those that are left.
    Each step is a column of its own, made once.
    """
    behavior = expected_behavior(F.col("unsupported"))
    rows = rows.withColumn("head", score_by_metric(F.col("s"), behavior, F.col("m"), F.col("unsupported"), F.col("executed")))
    left = F.col("head").isNull()
    rows = rows.withColumn("q", normalise_text(F.when(left, F.col("q"))))
    rows = rows.withColumns({"d": F.when(left, expected_dimension(F.col("q"), F.col("pattern"))), "t": F.when(left, expected_time(F.col("q")))})
    tail = F.when(left, score_by_groups(F.col("s"), F.col("pattern"), F.col("d"), F.col("t")))
    return rows.withColumn("f", F.coalesce("head", tail))
