"""Fill-in-the-middle rows: each text is cut into prefix, middle and suffix at two ranks of its units.

A unit begins wherever a predicate on two adjacent characters says so, and at the text's first character.  Texts are
decomposed into chunks that overlap by the one character that the predicate looks back.  The chunks' boundaries are
counted independently; prefix sums of the counts tell which chunk owns the boundary of a rank, and only the two owners
are scanned again for its place.  A text's chunks are counted by the task that reads it up to ``DEALT_CHARS``; those
of longer texts are dealt out to many tasks and their counts summed by a window, the same way.

Null texts count as empty, a null id as the empty string.  Every row gives one row, repeated ones too; an empty table
gives none.  Input columns other than id and text are ignored, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_CHARS = 1 << 14
#: Texts beyond this are dealt out in chunks of their own size.
DEALT_CHARS, DEALT_CHUNK = 1 << 18, 1 << 16
#: Percent of texts that take part, and of these the percent with the suffix first.
TAKEN, SUFFIX_FIRST = 90, 20

Unit = Callable[[np.ndarray, np.ndarray], np.ndarray]


def every_code_point(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.ones(len(after), bool)


def every_word(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A unit begins where a character other than white space (ASCII) follows white space."""
    white = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    return white(before) & ~white(after)


def begins(piece: str, first: bool, unit: Unit) -> np.ndarray:
    """Places in a chunk where units begin; unless it's the text's first one, it has one character more before it."""
    points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
    inside = np.flatnonzero(unit(points[:-1], points[1:]))
    return np.concatenate([[0], inside + 1]) if first and len(points) else inside


def chunks(text: str, size: int) -> Iterator[tuple[int, str]]:
    for at in range(0, len(text), size):
        yield at, text[max(at - 1, 0) : at + size]


def place(text: str, counts: np.ndarray, rank: int, size: int, unit: Unit) -> int:
    """Where the unit of a rank (from 0) begins; the text's end for the rank behind the last."""
    if rank >= counts.sum():
        return len(text)
    before = np.concatenate([[0], np.cumsum(counts)])
    owner = int(np.searchsorted(before, rank, "right")) - 1
    at = owner * size
    return at + int(begins(text[max(at - 1, 0) : at + size], at == 0, unit)[rank - before[owner]])


def composed(text: str, form: str, a: int, b: int) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text of an output.  Parts hold no marker, and none arises where a part meets one, so the first one counts."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    one, rest = output[len(PREFIX) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def draws(id_col: Column) -> list[Column]:
    """Four unsigned integers from the SHA-256 of ``1:`` and the decimal id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, third: Column, fourth: Column) -> Column:
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (third % 100 >= TAKEN)
    return F.when(plain, "plain").when(fourth % 100 < SUFFIX_FIRST, "spm").otherwise("psm")


def dealt_places(longer: DataFrame, unit: Unit, size: int) -> DataFrame:
    """(key, n, a, b) of long texts: units, and where prefix and middle end."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["key"], b["text"], strict=True):
                for at, piece in chunks(text, size):
                    yield pd.DataFrame({"key": [key], "at": [at], "piece": [piece]})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [len(begins(p, at == 0, unit)) for p, at in zip(b["piece"], b["at"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "at": b["at"], "own": n})

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [at + int(begins(p, at == 0, unit)[r]) for p, at, r in zip(b["piece"], b["at"], b["rank"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "cut": b["cut"], "place": found})

    dealt = longer.select("key", "text").mapInPandas(cut, "key long, at long, piece string").repartition("key", "at")
    counts = dealt.mapInPandas(counted, "key long, at long, own long")
    so_far = Window.partitionBy("key").orderBy("at")
    before = F.coalesce(F.sum("own").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumns({"before": before, "n": F.sum("own").over(Window.partitionBy("key"))}).join(longer.select("key", "h1", "h2", "chars"), "key")
    ranks = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    cuts = F.array(*[F.struct(F.lit(i).alias("cut"), f(*ranks).alias("rank")) for i, f in enumerate((F.least, F.greatest))])
    each = sums.select("key", "at", "own", "before", "n", "chars", F.explode(cuts).alias("c")).select("*", "c.cut", "c.rank").drop("c")
    owners = each.filter("rank >= before and rank < before + own").select("key", "at", "cut", (F.col("rank") - F.col("before")).alias("rank"))
    places = dealt.join(owners, ["key", "at"]).select("key", "at", "cut", "rank", "piece").mapInPandas(scanned, "key long, cut int, place long")
    end = each.filter("rank >= n").select("key", "cut", F.col("chars").alias("place")).distinct()
    by_cut = places.unionByName(end).groupBy("key").agg(*[F.max(F.when(F.col("cut") == i, F.col("place"))).alias(c) for i, c in enumerate("ab")])
    return by_cut.join(sums.select("key", "n").distinct(), "key")


def finished(docs: DataFrame, id_col: str, text_col: str, unit: Unit, chunk_chars: int, dealt_chars: int, columns: str, finish) -> DataFrame:
    """Id, n, form, prefix_chars, middle_chars, and the columns that ``finish`` gives for (text, output, form)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = draws(F.col(id_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form_of(text, h[2], h[3]).alias("form"))
    out = f"id {dict(rows.dtypes)['id']}, n long, form string, prefix_chars long, middle_chars long, {columns}"
    names = [c.strip().split()[0] for c in out.split(",")]

    def row(id_, text, form, n, a, b):
        plain = form == "plain"
        return (id_, n, form, None if plain else a, None if plain else b - a, *finish(text, composed(text, form, a, b), form))

    def frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for id_, t, h1, h2, form in batch.itertuples(index=False, name=None):
                counts = np.array([len(begins(p, at == 0, unit)) for at, p in chunks(t, chunk_chars)], np.int64)
                n = int(counts.sum())
                a, b = (place(t, counts, r, chunk_chars, unit) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                found.append(row(id_, t, form, n, a, b))
            yield frame(found)

    def there(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame([row(*r) for r in batch.itertuples(index=False, name=None)])

    long = F.length("text") > dealt_chars
    short = rows.filter(~long).mapInPandas(here, out)
    longer = rows.filter(long).withColumns({"key": F.xxhash64("id", "text"), "chars": F.length("text").cast("long")})
    places = dealt_places(longer.dropDuplicates(["key"]), unit, max(chunk_chars, min(DEALT_CHUNK, dealt_chars)))
    placed = longer.join(places, "key").select("id", "text", "form", "n", "a", "b")
    return short.unionByName(placed.mapInPandas(there, out)).withColumnRenamed("id", id_col)


def transform(docs: DataFrame, id_col: str, text_col: str = "text", unit: Unit = every_code_point, chunk_chars: int = CHUNK_CHARS, dealt_chars: int = DEALT_CHARS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): the rearranged texts; lengths are null where nothing was cut."""
    return finished(docs, id_col, text_col, unit, chunk_chars, dealt_chars, "output string", lambda text, output, form: (output,))


def digests(docs: DataFrame, id_col: str, text_col: str = "text", unit: Unit = every_code_point, chunk_chars: int = CHUNK_CHARS, dealt_chars: int = DEALT_CHARS) -> DataFrame:
    """The same with SHA-256 of the output and of the text restored from it, without moving texts back to the JVM."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    columns = "output_sha256 string, restored_sha256 string"
    return finished(docs, id_col, text_col, unit, chunk_chars, dealt_chars, columns, lambda text, output, form: (sha(output), sha(restored(output, form))))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document, cut into code points."""
    return digests(table(spark, sf_dir, "documents"), "doc_id")


OP13_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 r AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
   WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
 c AS (SELECT *, substring(t, 1, least(x, y)) AS p, substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substring(t, greatest(x, y) + 1) AS s FROM r)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM c"""
