"""The twelve declared types, their Spark carriers and ranges."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T


@dataclass(frozen=True)
class DeclaredType:
    name: str
    carrier: T.DataType
    kind: str  # signed, unsigned, float, bool or str
    low: int = 0
    high: int = 0

    @property
    def numeric(self) -> bool:
        return self.kind in ("signed", "unsigned", "float")

    @property
    def integral(self) -> bool:
        return self.kind in ("signed", "unsigned")


def _signed(bits: int, carrier: T.DataType) -> DeclaredType:
    return DeclaredType(f"I{bits}", carrier, "signed", -(1 << (bits - 1)), (1 << (bits - 1)) - 1)


def _unsigned(bits: int, carrier: T.DataType) -> DeclaredType:
    return DeclaredType(f"U{bits}", carrier, "unsigned", 0, (1 << bits) - 1)


U64_CARRIER = T.DecimalType(20, 0)
TYPES: dict[str, DeclaredType] = {
    t.name: t
    for t in (
        _signed(8, T.ByteType()),
        _signed(16, T.ShortType()),
        _signed(32, T.IntegerType()),
        _signed(64, T.LongType()),
        _unsigned(8, T.ShortType()),
        _unsigned(16, T.IntegerType()),
        _unsigned(32, T.LongType()),
        _unsigned(64, U64_CARRIER),
        DeclaredType("F32", T.FloatType(), "float"),
        DeclaredType("F64", T.DoubleType(), "float"),
        DeclaredType("Bool", T.BooleanType(), "bool"),
        DeclaredType("Str", T.StringType(), "str"),
    )
}


def declared(name: str) -> DeclaredType:
    if name not in TYPES:
        raise ValueError(f"unknown type {name!r}; there are {', '.join(TYPES)}")
    return TYPES[name]


def literal_problem(t: DeclaredType, value: object) -> str | None:
    """Why a literal can't stand beside a column of type t, None if it can."""
    if value is None:
        return "NULL can't be compared; columns are never null"
    if isinstance(value, bool):
        return None if t.kind == "bool" else f"boolean literal against {t.name}"
    if isinstance(value, str):
        return None if t.kind == "str" else f"string literal against {t.name}"
    if not t.numeric:
        return f"number literal against {t.name}"
    if t.integral:
        exact = Decimal(str(value))
        if not exact.is_finite() or exact.adjusted() > 40:
            return f"{str(value)[:40]} is out of the range of {t.name}"
        if exact and exact.adjusted() < 0 or exact != int(exact):
            return f"fractional literal against {t.name}"
        if not t.low <= int(value) <= t.high:
            return f"{value} is out of the range of {t.name}"
    return None
