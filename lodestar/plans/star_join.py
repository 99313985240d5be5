"""Joins over the star: fixed edges, only the tables that a report needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.star import StarSchema, pieces

#: Fixed values, in the order in which tables join: (table, join type, its key, the other key, table it needs).
EDGES = (
    ("OrderItem", "left", "oi.OrderId", "o.Id", "Order"),
    ("Product", "left", "p.Id", "oi.ProductId", "OrderItem"),
    ("Product_Category_Mapping", "left", "pcm.ProductId", "p.Id", "Product"),
    ("Category", "left", "c.Id", "pcm.CategoryId", "Product_Category_Mapping"),
    ("Customer", "inner", "cu.Id", "o.CustomerId", "Order"),
    ("Product_Manufacturer_Mapping", "inner", "pmm.ProductId", "p.Id", "Product"),
    ("Manufacturer", "inner", "mf.Id", "pmm.ManufacturerId", "Product_Manufacturer_Mapping"),
    ("Address", "inner", "addr.Id", "o.BillingAddressId", "Order"),
    ("Country", "inner", "co.Id", "addr.CountryId", "Address"),
    ("Shipment", "inner", "sh.OrderId", "o.Id", "Order"),
    ("Store", "inner", "st.Id", "o.StoreId", "Order"),
)
_NEEDS = {e[0]: e[4] for e in EDGES}


def _way(table: str) -> list[str]:
    """The table, and what lies between it and Order, which comes last."""
    out = [table]
    while out[-1] != "Order":
        out.append(_NEEDS[out[-1]])
    return out


def root_of(tables: Iterable[str]) -> str:
    """The table nearest to Order among those that connect the tables: where they all meet on their way to it."""
    ways = [_way(t) for t in tables]
    return next(t for t in ways[0] if all(t in w for w in ways))


def closure(tables: Iterable[str], root: str = "Order") -> set[str]:
    """The tables, and those on their way to the root."""
    return {root}.union(*[(w := _way(t))[: w.index(root) + 1] for t in tables])


def star_join(star: StarSchema, tables: Iterable[str], columns: dict[str, set[str]] | None = None, root: DataFrame | None = None, at: str = "Order") -> DataFrame:
    """The table at joined with the tables and what lies between, each under its alias.

    columns: by table, what will be read of it. root: the table at, if it is already filtered.
    Joins are equi-joins; small sides broadcast when Spark knows them to be small.
    """
    wanted, columns = closure(tables, at), columns or {}
    out = root if root is not None else star.table(at, columns.get(at, ()))
    for table, how, key, other, _ in EDGES:
        if table in wanted and table != at:
            out = out.join(star.table(table, columns.get(table, ())), F.col(key) == F.col(other), how)
    return out


def by_order(star: StarSchema, tables: Iterable[str], columns: dict[str, set[str]] | None = None, root: DataFrame | None = None) -> DataFrame:
    """The rows of star_join from Order, in pieces of whole orders that stay small however many lines there are.

    For groupings that keep something for each order, such as distinct counts: lines meet their products first,
    then move once, to their order. What is grouped by order and more needs no further shuffle.
    """
    wanted, columns = closure(tables), columns or {}
    of_lines = {t for t in wanted if "OrderItem" in _way(t)}
    n = pieces(star.table("OrderItem")) if of_lines else None
    if n is None:
        return star_join(star, tables, columns, root)
    lines = star_join(star, of_lines, columns, at="OrderItem").repartition(n, "oi.OrderId")
    how = "inner" if any(how == "inner" for table, how, *_ in EDGES if table in of_lines) else "left"
    out = root if root is not None else star.table("Order", columns.get("Order", ()))
    out = out.join(lines, F.col("oi.OrderId") == F.col("o.Id"), how)
    for table, how, key, other, _ in EDGES:
        if table in wanted - of_lines:
            out = out.join(star.table(table, columns.get(table, ())), F.col(key) == F.col(other), how)
    return out


def product_items(star: StarSchema) -> DataFrame:
    """All products with their lines, if any."""
    return star.table("Product").join(star.table("OrderItem"), F.col("p.Id") == F.col("oi.ProductId"), "left")
