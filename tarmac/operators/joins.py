"""Joins: lookups, as-of, positional, band and nearest matches, semi and anti joins.

Nothing is broadcast by hint: the planner broadcasts what is below its threshold, and adaptive execution splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, alias: str, default: Column | None = None) -> DataFrame:
    """Left lookup of one column of a dimension; ``default`` where there is none."""
    d = dim.select(F.col(dim_key).alias("__k"), F.col(value).alias(alias))
    out = df.join(d, F.col(key) == F.col("__k"), "left").drop("__k")
    return out if default is None else out.withColumn(alias, F.coalesce(F.col(alias), default))


def nearest_asof(left: DataFrame, right: DataFrame, key: str, time: str, order: str, values: list[str], span: float | None = None) -> DataFrame:
    """Each left row with the values of the right row of its key that is nearest in time; ties: earlier time, then order.

    One shuffle by key: both sides are laid into one time line, and windows carry the nearest row before and after.
    Rows per key are sorted, never paired, so long tracks cost n log n.  Keys without right rows keep nulls.
    With a ``span`` a key's line is cut into cells of that length, one task each; the first and last right row of each
    cell, one short row, travel on to the cells beside it.
    """
    own = [c for c in left.columns]
    point = F.struct(F.col(time).alias("__t"), F.col(order).alias("__o"), *values)
    one = left.select(F.col(key).alias("__k"), F.col(time).alias("__time"), F.lit(1).alias("__side"), F.struct(*own).alias("__row"), F.lit(None).cast(right.select(point).schema[0].dataType).alias("__p"))
    two = right.select(F.col(key).alias("__k"), F.col(time).alias("__time"), F.lit(0).alias("__side"), F.lit(None).cast(one.schema["__row"].dataType).alias("__row"), point.alias("__p"))
    side, t, o = F.col("__side"), F.col("__time"), F.col("__p.__o")
    line = one.unionByName(two).withColumn("__cell", F.lit(0).cast("long") if span is None else F.floor(t / F.lit(float(span))))
    # of points with one time, the first in order counts: it comes last before a row and first after it
    past = Window.partitionBy("__k", "__cell").orderBy(t, side, o.desc()).rowsBetween(Window.unboundedPreceding, 0)
    coming = Window.partitionBy("__k", "__cell").orderBy(t, side.desc(), o).rowsBetween(0, Window.unboundedFollowing)
    both = line.withColumn("__a", F.last("__p", True).over(past)).withColumn("__b", F.first("__p", True).over(coming)).filter("__row is not null")
    if span is not None:
        first, last = (F.min_by("__p", F.when(side == 0, F.struct(at, o))) for at in (t, -t))
        cells = line.groupBy(F.col("__k").alias("__ck"), F.col("__cell").alias("__cc")).agg(first.alias("__first"), last.alias("__last"))
        track = Window.partitionBy("__ck").orderBy("__cc")
        earlier = F.last("__last", True).over(track.rowsBetween(Window.unboundedPreceding, -1))
        later = F.first("__first", True).over(track.rowsBetween(1, Window.unboundedFollowing))
        edges = cells.select("__ck", "__cc", earlier.alias("__earlier"), later.alias("__later"))
        both = both.join(edges, F.col("__k").eqNullSafe(F.col("__ck")) & F.col("__cell").eqNullSafe(F.col("__cc")), "left")
        both = both.withColumns({"__a": F.coalesce("__a", "__earlier"), "__b": F.coalesce("__b", "__later")})
    a, b = F.abs(t - F.col("__a.__t")), F.abs(F.col("__b.__t") - t)
    pick = F.when(F.col("__b").isNull() | (a <= b), F.col("__a")).otherwise(F.col("__b"))
    return both.withColumn("__n", pick).select("__row.*", F.col("__n.__t").alias(f"matched_{time}"), *[F.col(f"__n.{v}").alias(v) for v in values])


def positional_link(rows: DataFrame, points: DataFrame, key: str, seconds: str, duration: str, index: str, values: list[str]) -> DataFrame:
    """Rows with the point at the same fraction of the track: index = min(floor(seconds / duration * n), n - 1)."""
    n = points.groupBy(key).agg(F.count("*").alias("__n"))
    share = F.when(F.col(duration) > 0, F.col(seconds) / F.col(duration)).otherwise(0.0)
    at = rows.join(n, key, "left").withColumn("__i", F.least(F.floor(share * F.col("__n")), F.col("__n") - 1))
    p = points.select(F.col(key).alias("__k"), F.col(index).alias("__j"), *values)
    return at.join(p, (F.col(key) == F.col("__k")) & (F.col("__i") == F.col("__j")), "left").drop("__k", "__j", "__n", "__i")


def band_join(left: DataFrame, right: DataFrame, key: str, time: str, width: float, how: str = "inner") -> DataFrame:
    """Pairs of a key whose times differ by less than ``width`` (strictly); right columns get the prefix ``r_``.

    Times fall into cells of that width, so only three neighbouring cells meet, by an equi-join.
    """
    cell = lambda c: F.floor(c / F.lit(width))
    # a left row without a partner has no cell to be dropped with: pairs are found first, the rest is added
    l = left.withColumn("__cell", F.explode(F.array(*[cell(F.col(time)) + d for d in (-1, 0, 1)])))  # noqa: E741
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], cell(F.col(time)).alias("__rcell"))
    near = F.abs(F.col(time) - F.col(f"r_{time}")) < width
    pairs = l.join(r, (F.col(key) == F.col(f"r_{key}")) & (F.col("__cell") == F.col("__rcell")) & near).drop("__cell", "__rcell")
    if how == "inner":
        return pairs
    met = pairs.select(F.col(key).alias("__k"), F.col(time).alias("__t")).distinct()
    alone = left.join(met, F.col(key).eqNullSafe(F.col("__k")) & F.col(time).eqNullSafe(F.col("__t")), "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def band_lists(left: DataFrame, right: DataFrame, key: str, time: str, width: float, id_col: str, value: str) -> DataFrame:
    """(id, values): every left row with the sorted values of the right rows near it in time, empty where there's none."""
    pairs = band_join(left, right, key, time, width, "left")
    return pairs.groupBy(id_col).agg(F.sort_array(F.collect_list(f"r_{value}")).alias("values"))


def nearest_k(df: DataFrame, key: str, distance: Column, order: str, k: int = 3) -> DataFrame:
    """The k rows of each key with the smallest distance; ties by order."""
    w = Window.partitionBy(key).orderBy(distance, order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    """One row of each key, the first by order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def present(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    return df.join(other.select(F.col(other_key or key).alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def absent(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    return df.join(other.select(F.col(other_key or key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def round_robin(files: DataFrame, roads: DataFrame, file_order: str, road_order: str) -> DataFrame:
    """Each road with file number (road number mod number of files); none without files."""
    total = files.agg(F.count("*").alias("__total"))
    r = numbered(roads, "__n", road_order).join(F.broadcast(total)).filter("__total > 0")
    r = r.withColumn("__i", F.pmod(F.col("__n") - 1, "__total")).drop("__n", "__total")
    return r.join(numbered(files, "__n", file_order).withColumn("__i", F.col("__n") - 1).drop("__n"), "__i").drop("__i")


def merged_models(rows: DataFrame, key: str, model: str, detections: str) -> DataFrame:
    """A map of model to detections for each frame; models without rows are absent."""
    entries = F.map_from_entries(F.collect_list(F.struct(model, detections)))
    return rows.groupBy(key).agg(entries.alias("by_model"))
