"""The five aggregates with the declared types' results."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.types import TYPES, U64_CARRIER, DeclaredType

AGGREGATES = ("sum", "count", "min", "max", "avg")


def check(function: str, t: DeclaredType) -> None:
    """sum, min, max and avg take numbers, count any type."""
    if function not in AGGREGATES:
        raise ValueError(f"no aggregate {function!r}; there are {', '.join(AGGREGATES)}")
    if function != "count" and not t.numeric:
        raise ValueError(f"{function}() takes a number, not {t.name}")


def result_type(function: str, t: DeclaredType) -> T.DataType:
    """Sums are as wide as their kind gets, min and max keep the column's type."""
    if function == "count":
        return T.LongType()
    if function == "avg":
        return T.DoubleType()
    if function == "sum":
        return {"signed": T.LongType(), "unsigned": U64_CARRIER, "float": T.DoubleType()}[t.kind]
    return t.carrier


def aggregate(function: str, column: str, t: DeclaredType, empty_as_default: bool = False) -> Column:
    """function(column), named like that. Over no rows NULL, or with empty_as_default 0, and NaN for avg.

    Sums that don't fit their result type raise an error (ANSI mode) rather than wrap.
    """
    check(function, t)
    c = F.col(f"`{column}`")
    if function == "sum" and t.kind == "float":
        c = c.cast("double")
    if function == "avg":
        c = c.cast("double")
    out = getattr(F, function)(c)
    if function == "sum" and t.kind == "unsigned":
        # The carrier of U64 is wider than U64.
        fits = out.isNull() | (out <= F.lit(Decimal(TYPES["U64"].high)))
        out = F.when(fits, out).otherwise(F.raise_error(F.lit(f"ARITHMETIC_OVERFLOW: sum({column}) is over U64")))
    out = out.cast(result_type(function, t))
    if empty_as_default and function != "count":
        out = F.coalesce(out, F.lit(float("nan") if function == "avg" else 0).cast(result_type(function, t)))
    return out.alias(f"{function}({column})")
