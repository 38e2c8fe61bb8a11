"""The engine: tables under a folder, SQL over them, and inserts."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lamina.operators.relational import planned
from lamina.plans.catalyst import filters
from lamina.plans.dialect import DialectError, Insert, analyze_insert, analyze_select, parse
from lamina.sources.catalog import Catalog, TableSchema
from lamina.sources.parts import Part, PartTable


_NAME = r"""(?:[^\W\d]\w*|"[^"]+"|`[^`]+`)"""
#: INSERT of any query, in default mode.
INSERT = re.compile(rf"\s*INSERT\s+INTO\s+(?:TABLE\s+)?({_NAME})\s*(?:\(\s*({_NAME}(?:\s*,\s*{_NAME})*)\s*\))?\s*((?:VALUES|SELECT|WITH|FROM)\b.*|\(.*)", re.I | re.S)
#: An empty folder of each table that is queried.
NOTHING = "nothing"
KINDS = {"signed": T.NumericType, "unsigned": T.NumericType, "float": T.NumericType, "bool": T.BooleanType, "str": T.StringType}


@dataclass(frozen=True)
class QueryStatistics:
    """Parts of the query's tables, those read, their rows and bytes, rows of the result and seconds."""

    parts: int
    parts_read: int
    rows_read: int
    bytes_read: int
    rows: int
    seconds: float

    def __str__(self) -> str:
        return f"{self.rows} rows in {self.seconds:.3f} s; {self.parts_read} of {self.parts} parts, {self.rows_read} rows, {self.bytes_read} bytes"


class Engine:
    """Tables under `root`.

    strict: SQL is the dialect of lamina.plans.dialect, names are case-sensitive, and aggregates have the declared
    types' results. Otherwise SELECT is all of Spark SQL over the tables as views, of which only the parts are read
    that the plan's filters need, and INSERT takes any query or VALUES. empty_as_default: in strict mode sum, min and max over no rows are 0 and avg NaN instead of NULL.
    """

    def __init__(self, spark: SparkSession, root: str, strict: bool = False, empty_as_default: bool = False):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.caseSensitive", str(strict).lower())
        self.strict, self.empty_as_default = strict, empty_as_default
        self.catalog = Catalog(self.spark, root)
        self._tables: dict[str, PartTable] = {}

    def create_table(self, schema: TableSchema) -> PartTable:
        self.catalog.create(schema)
        return self.table(schema.name)

    def table(self, name: str) -> PartTable:
        if name not in self._tables:
            self._tables[name] = PartTable(self.spark, self.catalog, name)
        return self._tables[name]

    def insert(self, name: str, rows: DataFrame | Iterable[tuple], options: dict | None = None) -> Part | None:
        """Publishes rows as a part. options go to the Parquet writer: compression (lz4_raw, zstd, none and so on),
        parquet.writer.version (v2 has delta encoding), parquet.page.row.count.limit."""
        table = self.table(name)
        return table.insert(rows, options=options) if isinstance(rows, DataFrame) else table.insert_rows(rows, options)

    def compact(self, name: str, at_least: int = 2, **options) -> list[Part]:
        """Merges small parts; see PartTable.compact. Replaced parts stay until PartTable.vacuum."""
        return self.table(name).compact(at_least, **options)

    def _open(self, name: str) -> PartTable:
        try:
            return self.table(name)
        except ValueError as e:
            raise DialectError(str(e)) from None

    def execute(self, sql: str) -> DataFrame | Part | None:
        """A SELECT's DataFrame, or the part that an INSERT published."""
        if sql.split(None, 1)[:1] and sql.split(None, 1)[0].upper() == "INSERT":
            if not self.strict and (m := INSERT.fullmatch(sql.rstrip().rstrip(";"))):
                return self._insert_query(*m.groups())
            statement = parse(sql)
            table = self._open(statement.table)
            return table.insert_rows(analyze_insert(statement, table.schema))
        return self.sql(sql)

    def _insert_query(self, name: str, columns: str | None, query: str) -> Part | None:
        """INSERT INTO name (columns) query: each column once, of the kinds of the table's; values are checked as in any insert."""
        plain = lambda n: n[1:-1] if n[0] in "`\"" else n
        table = self._open(plain(name))
        names = [c.name for c in table.schema.columns]
        given = [plain(c) for c in re.findall(_NAME, columns)] if columns else names
        if sorted(c.lower() for c in given) != sorted(c.lower() for c in names):
            raise DialectError("INSERT gives each column once; there are no defaults")
        rows = self.sql(query)
        if len(rows.columns) != len(given):
            raise DialectError(f"a query of {len(rows.columns)} columns for {len(given)} columns")
        at = {c.lower(): k for k, c in enumerate(given)}
        rows = rows.toDF(*[f"c{k}" for k in range(len(given))])
        for c in table.schema.columns:
            t = rows.schema[at[c.name.lower()]].dataType
            if not isinstance(t, KINDS[c.type.kind]):
                raise DialectError(f"column {c.name}: {t.simpleString()} for {c.data_type}")
        return table.insert(rows.select(*[f"c{at[c.name.lower()]}" for c in table.schema.columns]))

    def sql(self, sql: str) -> DataFrame:
        """A SELECT's DataFrame; INSERT is an error."""
        if not self.strict:
            if sql.split(None, 1)[:1] and sql.split(None, 1)[0].upper().split("(")[0] not in ("SELECT", "WITH", "", "VALUES", "FROM"):
                raise DialectError("sql() takes queries; execute() takes INSERT too")
            return self._pruned(sql)
        statement = parse(sql)
        if isinstance(statement, Insert):
            raise DialectError("sql() takes SELECT; execute() takes INSERT too")
        table = self._open(statement.table)
        return planned(analyze_select(statement, table.schema), table, self.empty_as_default)

    def _pruned(self, sql: str) -> DataFrame:
        """The query over views of the parts that it needs.

        It is planned first over empty folders in the tables' places: what the optimised plan filters each of them by
        decides which parts its view has.
        """
        names = [n for n in self.catalog.tables() if n.lower() in sql.lower()]
        where: dict[str, object] = {}
        try:
            for n in names:
                self.catalog.files.make(f"{n}/{NOTHING}")
        except Py4JJavaError:  # a store that can only be read: all parts are
            pass
        else:
            for n in names:
                empty = self.spark.read.schema(self.table(n).schema.spark).parquet(self.catalog.files.where(f"{n}/{NOTHING}"))
                empty.createOrReplaceTempView(n)
            where = filters(self.spark.sql(sql), {n: n for n in names}) if names else {}
        for n in names:
            self.table(n).scan(where=where.get(n)).createOrReplaceTempView(n)
        return self.spark.sql(sql)

    def collect(self, sql: str) -> pa.Table:
        return self.sql(sql).toArrow()

    def measure(self, sql: str) -> tuple[pa.Table, QueryStatistics]:
        """A query's rows and what it took."""
        began = time.perf_counter()
        df = self.sql(sql)
        rows = df.toArrow()
        seconds = time.perf_counter() - began
        read = {tuple(f.rsplit("/", 3)[1:3]) for f in df.inputFiles()}
        tables = {t for t in self.catalog.tables() if any(t == r[0] for r in read) or t.lower() in sql.lower()}
        parts = [(t, p) for t in tables for p in self.table(t).parts()]
        held = [p for t, p in parts if (t, p.folder) in read]
        return rows, QueryStatistics(len(parts), len(held), sum(p.rows or 0 for p in held), sum(p.bytes for p in held), rows.num_rows, seconds)

    def explain(self, sql: str, mode: str = "formatted") -> str:
        """Spark's plan as text: simple, extended, cost or formatted."""
        df = self.sql(sql)
        return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
