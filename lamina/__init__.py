"""Append-only columnar tables on Spark: declared schemas, immutable parts with statistics, and a compact SQL dialect."""

from lamina.session import Engine
from lamina.sources.catalog import ColumnSchema, TableSchema

__all__ = ["ColumnSchema", "Engine", "TableSchema"]
