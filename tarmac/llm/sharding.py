"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` equal cells; every shard owns ``vnodes`` points of it, which don't depend on the other shards.
A key lies in the cell of its hash and wants the shard of the first point at or after that cell, clockwise.  A shard
takes no more rows than its bound; what goes beyond it continues clockwise to the next point whose shard has room.
The bounds add up to the number of rows and differ by one at most, and so do the shards' counts.

Only the number of rows of each cell reaches the driver: ``cells`` numbers, whatever the table's size.  From them come
a few rank intervals for each cell, each sent to one shard; rows find theirs by an equi-join on the cell.

Rows of a cell are ranked by the key.  A cell with more than ``most`` rows (a hot key, null keys) is split into parts
that are ranked apart, each from where the parts before it end.

Null keys hash like any other value.  Rows with the same key and order columns are interchangeable and ranked
arbitrarily among themselves.  An empty table gives an empty result.  Columns ``shard`` and ``slot`` are replaced;
other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import brought_back, set_aside, stored, table, text_or_empty


def mixed(x: int) -> int:
    """A fixed 64-bit mixing function (multiply and shift)."""
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ x >> 31) * factor & (1 << 64) - 1
    return x ^ x >> 29


def ring_points(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order."""
    return sorted((mixed((s + 1) * 1_000_003 + v) % cells, s) for s in range(shards) for v in range(vnodes))


def fill(points: list[tuple[int, int]], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (cell, first rank, end rank, shard, slot of the first rank) that respect every shard's bound.

    First each cell fills the shard it wants, in ring order; then overflow goes clockwise, in ring order too.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out = []

    def take(cell: int, start: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            out.append((cell, start, start + n, shard, used[shard]))
            used[shard] += n
        return n

    over, at = [], 0
    for cell, n in enumerate(counts):
        while at < len(points) and points[at][0] < cell:
            at += 1
        got = take(cell, 0, n, points[at % len(points)][1]) if n else 0
        if got < n:
            over.append((cell, at, got, n))
    for cell, at, start, end in over:
        while start < end:
            at += 1
            start += take(cell, start, end - start, points[at % len(points)][1])
    return out


def cell_of(key: Column, cells: int) -> Column:
    """Top bits of the key's hash; ``cells`` is a power of two."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - (cells.bit_length() - 1)).cast("int")


#: Rows that a task ranks at most, about.
MOST = 1 << 20


def ranked(placed: DataFrame, key: str, order: tuple[str, ...], counts: list[int], most: int) -> DataFrame:
    """``placed`` with ``__rank``, which numbers each cell's rows from 0."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(key, *order)).cast("long") - 1
    if max(counts) <= most:
        return placed.withColumn("__rank", rank("__cell"))
    spark = placed.sparkSession
    parts = [(cell, -(-n // most)) for cell, n in enumerate(counts) if n > most]
    # at most a row for each ``most`` rows of the table, and one for each cell
    split = F.broadcast(spark.createDataFrame(parts, "__cell int, __parts int"))
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1))).cast("int")
    # stored, so that a repeated task can't deal the rows out anew
    dealt = stored(placed.join(split, "__cell", "left").withColumn("__part", part).drop("__parts"), "ring-parts")
    sizes = dealt.groupBy("__cell", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__cell").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__cell", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    own = dealt.withColumn("__own", rank("__cell", "__part")).join(sizes, ["__cell", "__part"])
    return own.withColumn("__rank", F.col("__own") + F.col("__before"))


def shard_ring(
    df: DataFrame, key: str, shards: int = 16, vnodes: int = 256, cells: int = 1 << 14, order: tuple[str, ...] = (), most: int = MOST
) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; the slots of a shard run from 0 without a gap.

    Rows of a cell are ranked by the key and ``order``.  A cell holds about one in ``cells`` of the keys; raise
    ``cells`` with the table.
    """
    spark = df.sparkSession
    df, names = set_aside(df, key, *order)
    placed = df.withColumn("__cell", cell_of(F.col(key), cells))
    counts = [0] * cells
    for r in placed.groupBy("__cell").agg(F.count("*").alias("n")).collect():
        counts[r["__cell"]] = r["n"]
    # bounded by the ring: an interval for each cell, and one more whenever a shard becomes full
    plan = spark.createDataFrame(
        fill(ring_points(shards, vnodes, cells), counts, shards), "__of int, __start long, __end long, __shard int, __base long"
    )
    inside = (F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__end"))
    out = ranked(placed, key, order, counts, most).join(F.broadcast(plan), (F.col("__cell") == F.col("__of")) & inside)
    slot = F.col("__base") + F.col("__rank") - F.col("__start")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    return brought_back(out.select(*kept, F.col("__shard").alias("shard"), slot.alias("slot")), names)


def op10_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, by the law ``rows``: counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
    )
    out = shard_ring(docs, "doc_id", order=("size", "text_crc32"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
