"""A Spark data source over any database with a Python driver (DB-API 2), read by ranges of a growing numeric key.

``spark.read.format("keyset")`` plans as many ranges of keys as asked between the smallest and the largest one; each is one partition,
read by one ordered query whose rows are fetched some at a time. Comparisons with the key and with other columns are pushed into
those queries where ``spark.sql.python.filterPushdown.enabled`` is on; load the table anew for each query then, as Spark keeps what it
has pushed into one. ``spark.readStream`` gives rows behind the keys that it has
given before: an offset is the last key, so a stopped query goes on from Spark's own checkpoint, and a batch that is planned again
has the same ranges.

Options: ``module`` (the driver's name, sqlite3 by default), ``connect`` (its arguments, a JSON object; ``database`` alone for short),
``table``, ``key``, ``columns`` (a DDL schema that names and types the columns), ``ranges`` (8), ``fetch`` (10,000 rows at a time),
``after`` (a stream's first key is behind it, -1 of nothing by default: all), ``marker`` (the driver's parameter mark, ?).

Rows whose key is null are not read. A key may not be a text.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class Range(InputPartition):
    """Keys above ``after`` up to ``upto``, and what else rows have to meet."""

    after: int
    upto: int
    where: tuple[tuple[str, str, object], ...] = ()


@dataclass
class Table:
    """How to reach a table: names are checked, values go as parameters."""

    module: str
    connect: dict
    table: str
    key: str
    schema: StructType
    ranges: int = 8
    fetch: int = 10_000
    marker: str = "?"
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.names = self.schema.fieldNames()
        for name in (self.table, self.key, *self.names):
            if not _NAME.fullmatch(name):
                raise ValueError(f"{name!r} is no name")
        if self.ranges < 1 or self.fetch < 1:
            raise ValueError("there is at least one range, and one row is fetched at least")

    @staticmethod
    def of(options, schema: StructType) -> Table:
        connect = json.loads(options["connect"]) if "connect" in options else {"database": options["database"]}
        return Table(options.get("module", "sqlite3"), connect, options["table"], options["key"], schema, int(options.get("ranges", 8)), int(options.get("fetch", 10_000)), options.get("marker", "?"))

    def _ask(self, sql: str, values: tuple) -> Iterator[list[tuple]]:
        connection = importlib.import_module(self.module).connect(**self.connect)
        try:
            cursor = connection.cursor()
            cursor.execute(sql.replace("?", self.marker), values)
            while rows := cursor.fetchmany(self.fetch):
                yield rows
        finally:
            connection.close()

    def ends(self, after: int | None = None) -> tuple[int | None, int | None]:
        """The smallest and the largest key, of those behind ``after`` if given."""
        behind = "" if after is None else f" WHERE {self.key} > ?"
        rows = [r for some in self._ask(f"SELECT min({self.key}), max({self.key}) FROM {self.table}{behind}", () if after is None else (after,)) for r in some]
        return rows[0]

    def split(self, least: int, most: int) -> list[Range]:
        """Ranges that hold every key from ``least`` to ``most`` once."""
        step = max(1, -(-(most - least + 1) // self.ranges))
        return [Range(a - 1, min(a + step - 1, most)) for a in range(least, most + 1, step)]

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        conditions = [f"{self.key} > ?", f"{self.key} <= ?", *(f"{name} {sign} ?" for name, sign, _ in part.where)]
        sql = f"SELECT {', '.join(self.names)} FROM {self.table} WHERE {' AND '.join(conditions)} ORDER BY {self.key}"
        schema = to_arrow_schema(self.schema)
        for some in self._ask(sql, (part.after, part.upto, *(value for *_, value in part.where))):
            yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, table: Table):
        self.table, self.where = table, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            sign = _SIGNS.get(type(f))
            plain = sign and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool)
            if plain and not (isinstance(f.value, float) and f.value != f.value):
                self.where.append((f.attribute[0], sign, f.value))
            if not plain or isinstance(f.value, (float, str)):
                yield f  # texts and floats are compared by Spark's rules once more

    def partitions(self) -> list[Range]:
        least, most = self.table.ends()
        if least is None:
            return [Range(0, -1)]
        for name, sign, value in self.where:
            if name == self.table.key and isinstance(value, int):
                least = max(least, {">": value + 1, ">=": value, "=": value}.get(sign, least))
                most = min(most, {"<": value - 1, "<=": value, "=": value}.get(sign, most))
        found = self.table.split(least, most) or [Range(0, -1)]
        return [Range(p.after, p.upto, tuple(self.where)) for p in found]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.table.rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, table: Table, after: int | None):
        self.table, self.after = table, after

    def initialOffset(self) -> dict:
        if self.after is not None:
            return {"key": self.after}
        least, _ = self.table.ends()
        return {"key": 0 if least is None else min(0, least - 1)}

    def latestOffset(self) -> dict:
        _, most = self.table.ends()
        return self.initialOffset() if most is None else {"key": max(most, self.initialOffset()["key"])}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.table.split(start["key"] + 1, end["key"]) or [Range(0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.table.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside Spark's checkpoint."""


class Keyset(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(Table.of(self.options, schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        after = self.options.get("after")
        return _StreamReader(Table.of(self.options, schema), None if after is None else int(after))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Keyset)
