"""Filters and projections.  Predicates reach the scan; arrays are filtered in place, without exploding them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFF = (None, "", "all")


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Equality on every column that has a value (None, "" and "all" don't count); a list means any of its values."""
    for c, v in wanted.items():
        if isinstance(v, (list, tuple, set)):
            df = df.filter(F.col(c).isin(*v)) if v else df
        elif v not in OFF:
            df = df.filter(F.col(c) == v)
    return df


def with_detections(df: DataFrame, count_col: str = "detections_count") -> DataFrame:
    return df.filter(F.col(count_col) > 0)


def containing(df: DataFrame, text: str, *cols: str) -> DataFrame:
    """Rows where any column holds ``text``, whatever its case."""
    if not text:
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False)) for c in cols]))


def tokens(*cols: str) -> Column:
    return F.array_distinct(F.split(F.lower(F.concat_ws(" ", *cols)), r"[^\p{L}\p{N}]+"))


def any_term(df: DataFrame, query: str, *cols: str) -> DataFrame:
    """Rows that have any of the query's words."""
    words = sorted(set(query.lower().split()))
    return df.filter(F.arrays_overlap(tokens(*cols), F.array(*[F.lit(w) for w in words]))) if words else df


def confident(detections: Column, least: float = 0.25) -> Column:
    return F.filter(detections, lambda d: F.coalesce(d["confidence"], F.lit(0.0)) >= least)


def of_classes(detections: Column, classes: list[str]) -> Column:
    return F.filter(detections, lambda d: d["class_name"].isin(*classes)) if classes else detections


def without_class_like(detections: Column, part: str) -> Column:
    return F.filter(detections, lambda d: ~F.coalesce(F.lower(d["class_name"]).contains(part.lower()), F.lit(False)))


def has_class(detections: Column, classes: list[str]) -> Column:
    return F.exists(detections, lambda d: d["class_name"].isin(*classes))


def every_nth(df: DataFrame, position: str = "frame_number", n: int = 3) -> DataFrame:
    return df.filter(F.pmod(F.col(position), F.lit(n)) == 0)


def shown_keyframes(sequence: Column) -> Column:
    """Enabled keyframes; a sole keyframe counts even if disabled."""
    return F.filter(sequence, lambda s: s["enabled"] | (F.size(sequence) <= 1))


def missing_keys(*cols: str) -> Column:
    """Names of required columns that are null or empty."""
    named = F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in cols])
    return F.filter(named, lambda x: x.isNotNull())


def allowed_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in allowed])


def surveys_listing(surveys: DataFrame, latest_only: bool = True, **equal) -> DataFrame:
    """Surveys by equal values; only the latest ones unless told otherwise."""
    rows = matching(surveys, **equal)
    return rows.filter("is_latest") if latest_only else rows


def visible_to(df: DataFrame, owner: str, user, role: str, everything: tuple[str, ...] = ("admin",)) -> DataFrame:
    """A user's own rows; roles in ``everything`` see all."""
    return df if role in everything else df.filter(F.col(owner) == F.lit(user))


def lacking(df: DataFrame, c: str) -> DataFrame:
    """Rows whose column is missing or isn't a text with something in it."""
    return df.filter(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
