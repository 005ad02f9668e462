"""Map tiles of a SQLite file as a Python data source: ``spark.read.format("tiles").option("path", ...)``.

With the option ``pushdown`` comparisons of z, x, y and s with values become part of the SQL, so that one tile's filter
reads one row.  Spark keeps pushed filters with the DataFrame that ``load`` gave, so such a one is for one query only, as
``tile`` uses it; without the option a DataFrame may be used again and again.  What is left is cut into ranges of x within a zoom level, of about ``rowsPerPartition`` tiles each.  The file must be on a path that
all executors see.
"""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
KEYS = ("z", "x", "y", "s")


class TileRange(InputPartition):
    def __init__(self, zoom: int, first: int, last: int):
        self.zoom, self.first, self.last = zoom, first, last


class TileReader(DataSourceReader):
    def __init__(self, path: str, rows: int, pushdown: bool = False):
        self.path, self.rows, self.pushdown = path, rows, pushdown
        self.conditions: list[str] = []
        self.values: list = []

    def pushFilters(self, filters):
        """Comparisons of keys with values go to SQLite; all others are left to Spark."""
        for f in filters:
            key = f.attribute[0] if self.pushdown and len(getattr(f, "attribute", ())) == 1 else None
            if key in KEYS and type(f) in COMPARISONS:
                self.conditions.append(f"{key} {COMPARISONS[type(f)]} ?")
                self.values.append(f.value)
            elif key in KEYS and isinstance(f, In):
                self.conditions.append(f"{key} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            else:
                yield f

    def rows_of(self, sql: str, more: str = "", values: tuple = (), tail: str = ""):
        where = " AND ".join([*self.conditions, *([more] if more else [])])
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            yield from db.execute(f"{sql}{' WHERE ' + where if where else ''}{tail}", (*self.values, *values))

    def partitions(self) -> list[TileRange]:
        out = []
        for zoom, first, last, n in self.rows_of("SELECT z, min(x), max(x), count(*) FROM tiles", tail=" GROUP BY z ORDER BY z"):
            step = max(1, -(-(last - first + 1) // max(1, -(-n // self.rows))))
            out += [TileRange(zoom, a, min(a + step - 1, last)) for a in range(first, last + 1, step)]
        return out or [TileRange(0, 0, -1)]

    def read(self, part: TileRange):
        yield from self.rows_of("SELECT z, x, y, s, image FROM tiles", "z = ? AND x BETWEEN ? AND ?", (part.zoom, part.first, part.last))


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return "z int, x int, y int, s int, image binary"

    def reader(self, schema) -> TileReader:
        return TileReader(self.options["path"], int(self.options.get("rowsPerPartition", 20_000)), self.options.get("pushdown", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)


def tile(spark: SparkSession, path: str, z: int, x: int, y: int, s: int = 0) -> DataFrame:
    """One tile's image, or no row."""
    rows = spark.read.format("tiles").option("path", path).option("pushdown", True).load()
    return rows.filter(f"z = {int(z)} and x = {int(x)} and y = {int(y)} and s = {int(s)}").select("image").limit(1)
