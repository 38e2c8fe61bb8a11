"""Declared table schemas and the catalog that keeps them as JSON beside their parts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from lamina.functions.types import DeclaredType, declared
from lamina.sources.files import Files


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    data_type: str

    @property
    def type(self) -> DeclaredType:
        return declared(self.data_type)


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnSchema, ...]
    sort_key: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError("column names must differ")
        for c in self.columns:
            declared(c.data_type)
        if any(not 0 <= i < len(names) for i in self.sort_key):
            raise ValueError("sort_key holds positions of columns")

    @staticmethod
    def of(name: str, columns: dict[str, str], sort_key: tuple[int, ...] = ()) -> "TableSchema":
        return TableSchema(name, tuple(ColumnSchema(n, t) for n, t in columns.items()), tuple(sort_key))

    def column(self, name: str) -> ColumnSchema | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.carrier, False) for c in self.columns])

    def to_json(self) -> str:
        columns = [{"name": c.name, "data_type": c.data_type} for c in self.columns]
        return json.dumps({"name": self.name, "columns": columns, "sort_key": list(self.sort_key)}, indent=2)

    @staticmethod
    def from_json(text: str) -> "TableSchema":
        raw = json.loads(text)
        columns = tuple(ColumnSchema(c["name"], c["data_type"]) for c in raw["columns"])
        return TableSchema(raw["name"], columns, tuple(raw.get("sort_key", ())))


class Catalog:
    """The tables under a folder, each a folder with schema.json and its parts."""

    FILE = "schema.json"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.files.make()

    def tables(self) -> list[str]:
        return [n for n in self.files.names() if self.files.exists(f"{n}/{self.FILE}")]

    def create(self, schema: TableSchema) -> TableSchema:
        if self.files.exists(f"{schema.name}/{self.FILE}"):
            raise ValueError(f"table {schema.name!r} exists")
        self.files.make(schema.name)
        self.files.write(f"{schema.name}/{self.FILE}", schema.to_json())
        return schema

    def open(self, name: str) -> TableSchema:
        if name not in self.tables():
            raise ValueError(f"unknown table {name!r}")
        return TableSchema.from_json(self.files.read(f"{name}/{self.FILE}"))
