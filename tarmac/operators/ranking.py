"""Versions, latest flags, ranks, pages and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_versions(surveys: DataFrame, route: str, *order) -> DataFrame:
    """Version 1, 2, ... of each route's surveys."""
    return surveys.withColumn("survey_version", F.row_number().over(Window.partitionBy(route).orderBy(*order)))


def with_latest(surveys: DataFrame, route: str, *order) -> DataFrame:
    """``is_latest`` true for one survey of each route, the first by order."""
    return surveys.withColumn("is_latest", F.row_number().over(Window.partitionBy(route).orderBy(*order)) == 1)


def next_version(surveys: DataFrame, route: str, version: str = "survey_version") -> DataFrame:
    return surveys.groupBy(route).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def newest(df: DataFrame, n: int, time: str, key: str) -> DataFrame:
    return df.orderBy(F.col(time).desc_nulls_last(), key).limit(n)


def tail_per_key(df: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def downsampled(points: DataFrame, track: str, index: str, target: int = 150) -> DataFrame:
    """Every max(1, floor(n / target))-th point of a track, with its first and last one."""
    n = F.count("*").over(Window.partitionBy(track))
    rate = F.greatest(F.lit(1), F.floor(n / target))
    rows = points.withColumn("__n", n).withColumn("__rate", rate)
    return rows.filter((F.col(index) % F.col("__rate") == 0) | (F.col(index) == F.col("__n") - 1)).drop("__n", "__rate")


def progress(df: DataFrame, key: str, order: str) -> DataFrame:
    """Share of each row's place among its key's rows in percent (whole), and from 0 to 1 for the first to the last."""
    at, all_ = F.row_number().over(Window.partitionBy(key).orderBy(order)), F.count("*").over(Window.partitionBy(key))
    share = F.when(all_ > 1, (at - 1) / (all_ - 1)).otherwise(0.0)
    return df.withColumns({"progress": F.floor(at * 100 / all_).cast("int"), "fraction": share})


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Counts and percent of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("count"))
    return counts.withColumn("percent", F.round(100 * F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1))), 4))


def colours_by_first(df: DataFrame, name: str, order: str, palette: int = 6) -> DataFrame:
    """Number of each class by first appearance, modulo the palette."""
    first = df.groupBy(name).agg(F.min(order).alias("first_seen"))
    return numbered(first, "__n", "first_seen", name).withColumn("colour", F.pmod(F.col("__n") - 1, F.lit(palette)).cast("int")).drop("__n")


def numbered(df: DataFrame, name: str, *order: str, buckets: int = 64) -> DataFrame:
    """Rows numbered from 1 without gaps by ascending columns (nulls first, ties by a hash of the row), in many tasks.

    A sample of 16 rows a bucket, those with the smallest hashes, sets the buckets' bounds.  Rows are counted by bucket
    before any shuffle and numbered in their bucket from what the buckets before it hold.  Ties are dealt out by their
    other columns; only rows alike in all columns stay together.  An empty table stays empty.
    """
    tie = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
    rows = df.withColumn("__at", F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], tie.alias("tie")))
    sample = rows.select("__at").orderBy(F.hash("__at.tie"), "__at").limit(16 * buckets)
    bounds = sample.agg(F.sort_array(F.collect_list("__at")).alias("__all")).select(F.filter("__all", lambda _, i: i % 16 == 15).alias("__bounds"))
    placed = rows.join(F.broadcast(bounds)).withColumn("__bucket", F.size(F.filter("__bounds", lambda b: b < F.col("__at")))).drop("__bounds")
    # at most one row a bucket
    counts = placed.groupBy(F.col("__bucket").alias("__b")).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy("__at"))
    out = placed.withColumn("__w", within).join(F.broadcast(counts.select("__b", before.alias("__before"))), F.col("__bucket") == F.col("__b"))
    return out.withColumn(name, F.col("__before") + F.col("__w")).drop("__at", "__bucket", "__b", "__w", "__before")


def surrogate_keys(new: DataFrame, existing: DataFrame, key: str, *order: str) -> DataFrame:
    """New rows numbered on from the largest key in use."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    return numbered(new, "__n", *order).join(F.broadcast(top)).withColumn(key, F.col("__top") + F.col("__n")).drop("__top", "__n")


def union_first(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """All sources under each other, one row of each key: the first source wins, then order."""
    all_ = None
    for i, df in enumerate(sources):
        one = df.withColumn("source", F.lit(i))
        all_ = one if all_ is None else all_.unionByName(one)
    w = Window.partitionBy(key).orderBy("source", order)
    return all_.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def page_with_total(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """A page with the number of all rows and of pages on each of its rows; an empty page has none."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return page(df, number, size, *order).join(F.broadcast(total))


def latest_rows(df: DataFrame, key: str, date: str) -> DataFrame:
    """All rows of each key's latest date."""
    last = df.groupBy(F.col(key).alias("__k")).agg(F.max(date).alias("__d"))
    return df.join(last, (F.col(key) == F.col("__k")) & (F.col(date) == F.col("__d"))).drop("__k", "__d")


def rows_of_date(df: DataFrame, key: str, date: str, wanted: Column | None = None) -> DataFrame:
    """All rows of the wanted date, or of each key's latest date where none is wanted (null)."""
    if wanted is None:
        return latest_rows(df, key, date)
    last = df.groupBy(F.col(key).alias("__k")).agg(F.max(date).alias("__d"))
    return df.join(last, F.col(key) == F.col("__k")).filter(F.col(date) == F.coalesce(wanted, F.col("__d"))).drop("__k", "__d")


def history(surveys: DataFrame, route: str, value, version: str = "survey_version") -> DataFrame:
    return surveys.filter(F.col(route) == F.lit(value)).orderBy(F.desc(version))


def unique_names(df: DataFrame, name: str, *order) -> DataFrame:
    """The first row of a name keeps it; the others get _1, _2, ... before its extension, without names that are there.

    Of the numbers that a name's rows would get, those in use are left out by a running count: the i-th number in use, t,
    comes before the j-th free one if t - i < j.  One shuffle by name; no row meets another.
    """
    stem, ending = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    rank = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    rows = df.withColumns({"__stem": stem, "__end": ending, "__n": rank})
    used = df.select(stem.alias("s"), ending.alias("__end")).distinct()
    used = used.select(F.regexp_extract("s", r"^(.*)_[1-9][0-9]*$", 1).alias("__stem"), "__end", F.regexp_extract("s", r"_([1-9][0-9]{0,17})$", 1).try_cast("long").alias("t")).filter("t is not null")
    of = Window.partitionBy("__stem", "__end")
    used = used.withColumn("__at", F.col("t") - F.row_number().over(of.orderBy("t")) + 0.5).select("__stem", "__end", "__at", F.lit(1).alias("__used"))
    line = rows.withColumns({"__at": F.col("__n").cast("double"), "__used": F.lit(0)}).unionByName(used, allowMissingColumns=True)
    before = F.sum("__used").over(of.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0))
    made = F.concat("__stem", F.lit("_"), (F.col("__n") + F.col("__before")).cast("long").cast("string"), "__end")
    out = line.withColumn("__before", before).filter("__used = 0").withColumn("unique_name", F.when(F.col("__n") == 0, F.col(name)).otherwise(made))
    return out.select(*df.columns, "unique_name")
