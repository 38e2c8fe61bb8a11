"""A checked statement as a DataFrame: scan, filter, aggregate, project, limit, in this order."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.aggregates import aggregate
from lamina.plans.dialect import Select
from lamina.plans.predicate import Both, ColumnRef, Compare, Either, Literal
from lamina.sources.catalog import TableSchema
from lamina.sources.parts import PartTable

COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def narrowed(p: object, schema: TableSchema) -> object:
    """The predicate with literals beside a column in the column's type: F32 literals are rounded to it."""
    if isinstance(p, (Both, Either)):
        return type(p)(narrowed(p.left, schema), narrowed(p.right, schema))
    if not isinstance(p, Compare):
        return p
    column = next((schema.column(x.name) for x in (p.left, p.right) if isinstance(x, ColumnRef)), None)

    def one(x: object) -> object:
        if not isinstance(x, Literal) or column is None or column.type.kind != "float":
            return x
        v = float(x.value)
        with np.errstate(over="ignore"):
            return Literal(float(np.float32(v)) if column.data_type == "F32" else v)

    return Compare(one(p.left), p.op, one(p.right))


def condition(p: object, schema: TableSchema) -> Column:
    if isinstance(p, Both):
        return condition(p.left, schema) & condition(p.right, schema)
    if isinstance(p, Either):
        return condition(p.left, schema) | condition(p.right, schema)
    column = next((schema.column(x.name) for x in (p.left, p.right) if isinstance(x, ColumnRef)), None)

    def operand(x: object) -> Column:
        if isinstance(x, ColumnRef):
            return F.col(f"`{x.name}`")
        if column is None:
            return F.lit(x.value)
        return F.lit(Decimal(x.value) if column.type.integral else x.value).cast(column.type.carrier)

    return COMPARE[p.op](operand(p.left), operand(p.right))


def planned(s: Select, table: PartTable, empty_as_default: bool = False) -> DataFrame:
    """Aggregates' columns are in the order of the SELECT list; LIMIT holds for the whole result.

    Grouping columns without aggregates are distinct rows. Only a result without GROUP BY has a row for no input.
    """
    schema = table.schema
    where = None if s.where is None else narrowed(s.where, schema)
    rows = table.scan(where=where)
    if where is not None:
        rows = rows.where(condition(where, schema))
    if s.group_by or any(i.function for i in s.items):
        calls = {(i.function, i.column) for i in s.items if i.function}
        by = [aggregate(f, c, schema.column(c).type, empty_as_default and not s.group_by) for f, c in sorted(calls)]
        keys = [F.col(f"`{g}`") for g in dict.fromkeys(s.group_by)]
        rows = rows.groupBy(*keys).agg(*by) if by else rows.select(*keys).distinct()
    source = [f"{i.function}({i.column})" if i.function else i.column for i in s.items]
    rows = rows.select(*[F.col(f"`{c}`").alias(i.name) for c, i in zip(source, s.items)])
    return rows if s.limit is None else rows.limit(s.limit)
