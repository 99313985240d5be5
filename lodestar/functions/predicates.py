"""Filters, business terms and row policies as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dimensions import DIMENSIONS, Dimension, dimension
from .metrics import METRICS

#: Spellings of operators.
OPERATORS = {
    "=": "=", "==": "=", "eq": "=", "!=": "!=", "<>": "!=", "neq": "!=", ">": ">", "gt": ">", ">=": ">=", "gte": ">=",
    "<": "<", "lt": "<", "<=": "<=", "lte": "<=", "contains": "contains", "in": "in", "not in": "not in", "not_in": "not in",
    "between": "between", "is_null": "is null", "is null": "is null", "is_not_null": "is not null", "is not null": "is not null",
}
_RANGE = (">", ">=", "<", "<=")
_NEGATIVE = ("!=", "not in", "is not null")
_DATE = re.compile(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})")


@dataclass(frozen=True)
class Predicate:
    """field: a dimension or metric id, or a business term; value: a scalar, a list, or comma-split text."""

    field: str
    operator: str = "="
    value: Any = None


@dataclass(frozen=True)
class Term:
    table: str
    columns: tuple[str, ...]
    expr: Callable[[], Column]


#: Named conditions; they may stand in a predicate's field or in its value.
TERMS = {
    "abandoned": Term("Order", ("OrderStatusId",), lambda: F.col("o.OrderStatusId") == 40),
    "referral_source": Term("Customer", ("AdminComment",), lambda: F.col("cu.AdminComment").contains("ref:")),
}

#: Role: (table, columns, condition from parameters).
POLICIES: dict[str, tuple[str, tuple[str, ...], Callable[[dict], Column]] | None] = {
    "public": None,
    "read_only": None,
    "dept_chair": ("Order", ("StoreId",), lambda p: F.col("o.StoreId") == F.lit(p["department_id"])),
    "regional_manager": ("Address", ("CountryId",), lambda p: F.col("addr.CountryId") == F.lit(p["region_id"])),
    "analyst": ("Customer", ("Active",), lambda p: F.col("cu.Active") == 1),
    "store_manager": ("Order", ("StoreId",), lambda p: F.col("o.StoreId") == F.lit(p["store_id"])),
}


def policy(role: str) -> tuple[str, tuple[str, ...], Callable[[dict], Column]] | None:
    """What a role may see; an unknown role is refused."""
    if role not in POLICIES:
        raise ValueError(f"unknown role {role!r}; known: {', '.join(sorted(POLICIES))}")
    return POLICIES[role]


def term_of(p: Predicate) -> Term | None:
    return TERMS.get(p.field.lower()) or (TERMS.get(p.value.lower()) if isinstance(p.value, str) else None)


def bound_to(p: Predicate) -> tuple[str, tuple[str, ...]]:
    """The table and columns a predicate reads."""
    found = term_of(p) or DIMENSIONS.get(p.field) or METRICS.get(p.field)
    if found is None:
        raise ValueError(f"unknown filter field {p.field!r}; known: {', '.join(sorted([*DIMENSIONS, *METRICS, *TERMS]))}")
    return found.table, found.columns


def _values(value: Any) -> list:
    parts = value if isinstance(value, (list, tuple)) else str(value).split(",")
    return [int(v) if isinstance(v, str) and v.strip().isdigit() else v.strip() if isinstance(v, str) else v for v in parts]


def _day(value: Any) -> Column | None:
    m = _DATE.fullmatch(str(value).strip())
    return F.lit(f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}").cast("date") if m else None


def _compare(op: str, x: Column, value: Column) -> Column:
    return {"=": x == value, "!=": x != value, ">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value}[op]


def _day_compare(op: str, x: Column, day: Column) -> Column:
    """A timestamp's day against a day, as a range of the raw column."""
    start, end = day.cast("timestamp_ntz"), F.date_add(day, 1).cast("timestamp_ntz")
    return {"=": (x >= start) & (x < end), "!=": (x < start) | (x >= end), ">": x >= end, ">=": x >= start, "<": x < start, "<=": x < end}[op]


def as_column(p: Predicate) -> Column:
    """One predicate. Text compares without case; a metric's predicate tests the row before grouping."""
    if term := term_of(p):
        return term.expr()
    op = OPERATORS.get(p.operator.lower().strip())
    if op is None:
        raise ValueError(f"unknown operator {p.operator!r}")
    if p.field in METRICS:
        row = METRICS[p.field].row
        if row is None:
            raise ValueError(f"metric {p.field!r} has no value for a row")
        x, dtype = row(), "number"
    else:
        d: Dimension = dimension(p.field)
        x, dtype = d.expr(), d.dtype
    if op == "is null":
        return x.isNull()
    if op == "is not null":
        return x.isNotNull()
    if op == "contains":
        return F.contains(F.lower(x.cast("string")), F.lit(str(p.value).lower()))
    if op in ("in", "not in"):
        values = _values(p.value)
        found = F.lower(x).isin([str(v).lower() for v in values]) if dtype == "string" else x.isin(values)
        return ~found if op == "not in" else found
    if op == "between":
        low, high = _values(p.value)
        if dtype == "date":
            return _day_compare(">=", x, _day(low)) & _day_compare("<=", x, _day(high))
        return x.between(_typed(low, dtype), _typed(high, dtype))
    if dtype == "date" and (day := _day(p.value)) is not None:
        return _day_compare(op, x, day)
    return _compare(op, F.lower(x), F.lit(str(p.value).lower())) if dtype == "string" else _compare(op, x, _typed(p.value, dtype))


def _typed(value: Any, dtype: str) -> Column:
    if dtype == "number":
        return F.lit(str(value)).cast("decimal(28,4)")
    return F.lit(value)


def combined(predicates: Iterable[Predicate]) -> Column | None:
    """Predicates on one field: any of them, but a pair of bounds means both, and what must not be holds for all of them;

    different fields: all.
    """
    fields: dict[str, list[Predicate]] = {}
    for p in predicates:
        fields.setdefault(p.field, []).append(p)
    parts = []
    for group in fields.values():
        kinds: dict[str, list[Column]] = {"bound": [], "not": [], "either": []}
        for p in group:
            op = OPERATORS.get(p.operator.lower().strip())
            kinds["either" if term_of(p) else "bound" if op in _RANGE else "not" if op in _NEGATIVE else "either"].append(as_column(p))
        either = kinds["either"] + ([reduce(lambda a, b: a & b, kinds["bound"])] if kinds["bound"] else [])
        parts += kinds["not"] + ([reduce(lambda a, b: a | b, either)] if either else [])
    return reduce(lambda a, b: a & b, parts) if parts else None
