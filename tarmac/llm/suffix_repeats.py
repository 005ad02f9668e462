"""Repeats across texts by the common-prefix interval tree of an enhanced suffix array.

Texts are strings of bytes.  The suffixes of all texts are dealt out so that any two with a common prefix of ``least``
bytes meet, without moving each of them: the first ``least`` bytes of a suffix, its window, have an anchor, the
``CORE``-byte string in it with the smallest hash (the leftmost such).  Equal windows have equal anchors, and windows
with one anchor are neighbours, so each anchor owns a short piece of its text.  Pieces meet by the hash of their core,
the bytes that all their windows share:

* a core that stands nowhere else has no repeat and goes no further;
* where all pieces of a core are equal, the whole piece is a repeat, without any text being moved;
* else one copy of each different piece goes to the suffix array of its core.  A core with more than ``MOST`` pieces
  is split: its windows are halved, the halves share longer cores, and these deal them out anew.

The suffix array of a bounded batch of pieces sorts the suffixes that begin in it by their bytes, with the lengths of
their neighbours' common prefixes.  One scan with a stack finds its intervals (runs of suffixes with a common prefix
that is longer than outside); the bytes before an interval's suffixes tell whether it can be extended to the left.
Those that can't are the maximal repeats, and each comes with all its occurrences: a suffix stands at the innermost
repeat that it begins with, a repeat names the one around it, so a repeat's occurrences are its own rows and those of
the repeats within.  Windows that all extend to the left alike begin no maximal repeat and aren't sorted.

A repeat longer than a piece comes as a chain of repeats, one for each anchor; the bytes they cover are the same.
Hashes only bring suffixes together; bytes are compared before anything counts as equal, but for pieces that are equal
by their cores' and their own 64-bit hashes.

Null texts count as empty; texts shorter than ``least`` repeat nothing.  Repeated rows are copies of each other.  An
empty table gives none.  Columns other than id and text are ignored, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, streamed_by, table

LEAST, CORE = 400, 128
#: Pieces of one core that are sorted in one task; more are split by longer cores.
MOST = 2048
#: Bytes of text that are worked off at a time.
BLOCK = 1 << 19
MULTIPLIER, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2 ** 64."""
    both = []
    for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        both.append(np.multiply.accumulate(factors))
    return tuple(both)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes."""
    room = 1 << max(len(data), 1).bit_length()
    up, down = powers(room)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    h = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1] * MIX
    return h ^ (h >> np.uint64(29))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def owned(data: bytes, offsets: np.ndarray, least: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and anchor of each piece in texts that stand behind each other, ending at ``offsets``."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none
    h = rolling(np.frombuffer(data, np.uint8), core)
    keys = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    anchor = (window_minima(keys, least - core + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, bool)
    for a, b in zip(np.concatenate([[0], offsets[:-1]]), offsets, strict=True):
        if b - a >= least:
            inside[a : b - least + 1] = True
    new = np.ones(len(anchor) + 1, bool)
    new[1:-1] = (anchor[1:] != anchor[:-1]) | ~inside[:-2]
    first = np.flatnonzero(inside & new)
    last = np.flatnonzero(inside[:-1] & (new[1:] | ~inside[1:]))
    return first, last, anchor[first]


def blocks(texts: list[bytes], least: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, text numbers, places): about ``BLOCK`` bytes of texts behind each other; long ones in parts."""
    parts, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - least + 1, 0), BLOCK):
            part = t[at : at + BLOCK + least - 1]
            parts.append((part, i, at))
            size += len(part)
            if size >= BLOCK:
                yield joined(parts)
                parts, size = [], 0
    if parts:
        yield joined(parts)


def joined(parts):
    return b"".join(p[0] for p in parts), np.cumsum([len(p[0]) for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts])


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def anchors(rows: DataFrame, least: int, core: int) -> DataFrame:
    """(row, row2, core, own, back, length, at): every piece of every text of ``rows`` (row, row2, raw).

    ``core`` and ``own`` are hashes of the piece's core and of its bytes, ``back`` is the anchor's place in the piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest as xxh

        for b in batches:
            row, row2 = b["row"].to_numpy(), b["row2"].to_numpy()
            for data, end, text, place in blocks(list(b["raw"]), least):
                first, last, anchor = owned(data, end, least, core)
                part = np.searchsorted(end, first, "right")
                view = memoryview(data)
                stop = last + least
                yield pd.DataFrame(
                    {
                        "row": row[text[part]], "row2": row2[text[part]],
                        "core": signed([xxh(view[a : a + core]) for a in anchor.tolist()]),
                        "own": signed([xxh(view[a:z]) for a, z in zip(first.tolist(), stop.tolist(), strict=True)]),
                        "back": anchor - first, "length": stop - first, "at": first - (end - np.diff(end, prepend=0))[part] + place[part],
                    }
                )

    return rows.mapInPandas(run, "row long, row2 int, core long, own long, back int, length int, at int")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


UNSEEN, DIFFER = -2, -1


def met(a: int, b: int) -> int:
    """The one byte before all of two sets of suffixes, or ``DIFFER``."""
    if a == UNSEEN:
        return b
    return a if a == b else DIFFER


def intervals(prefixes: list[int], left: list[int], least: int) -> tuple[list[list[int]], list[int]]:
    """Maximal repeats among sorted suffixes, and the innermost one of each suffix (-1: none).

    ``prefixes[i]`` is the common prefix of suffixes i and i + 1; ``left`` has the byte before each suffix, or -1 where
    none is known, which differs from all.  A repeat is [length, one of its suffixes, the repeat around it or -1].
    """
    found: list[list[int]] = []
    of = [-1] * len(left)
    # open intervals: length, byte before, one suffix, suffixes and inner repeats that no repeat within has taken
    stack: list[list] = [[0, UNSEEN, -1, [], []]]

    def into(outer: list, done: list) -> None:
        length, before, one, own, inner = done
        if before == DIFFER and length >= least:
            for i in own:
                of[i] = len(found)
            for k in inner:
                found[k][2] = len(found)
            own, inner = [], [len(found)]
            found.append([length, one, -1])
        outer[1] = met(outer[1], before)
        outer[2] = one
        outer[3] += own
        outer[4] += inner

    for i in range(len(left) + 1):
        length = prefixes[i - 1] if 0 < i < len(left) else 0
        while stack[-1][0] > length:
            done = stack.pop()
            if stack[-1][0] < length:
                stack.append([length, UNSEEN, -1, [], []])
            into(stack[-1], done)
        if i < len(left):
            if i + 1 < len(left) and prefixes[i] > stack[-1][0]:
                stack.append([prefixes[i], UNSEEN, -1, [], []])
            top = stack[-1]
            top[1] = met(top[1], left[i])
            top[2] = i
            top[3].append(i)
    return found, of


def repeats(pieces: list[bytes], least: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start, length, repeat, around) for every suffix of the pieces that begins a maximal repeat.

    ``repeat`` is the hash of its bytes, ``around`` that of the next shorter repeat with the same beginning, 0 for none.
    """
    from xxhash import xxh3_64_intdigest as xxh

    data, end = b"".join(pieces), np.cumsum([len(p) for p in pieces])
    if len(data) < least:
        return []
    begin = end - np.diff(end, prepend=0)
    raw, h = np.frombuffer(data, np.uint8), rolling(np.frombuffer(data, np.uint8), least)
    inside = np.zeros(len(data), bool)
    for a, z in zip(begin, end, strict=True):
        inside[a : max(a, z - least + 1)] = True
    at = np.flatnonzero(inside[: len(h)])
    at = at[np.argsort(h[at], kind="stable")]
    piece = np.searchsorted(end, at, "right")
    before = np.where(at == begin[piece], DIFFER, raw[at - 1].astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], h[at[1:]] != h[at[:-1]]]))
    size = np.diff(np.append(first, len(at)))
    low, high = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    out = []
    for k in np.flatnonzero((size > 1) & ((low != high) | (low == DIFFER))).tolist():
        group = slice(first[k], first[k] + size[k])
        suffixes = sorted((data[a : end[p]], a, p, b) for a, p, b in zip(at[group].tolist(), piece[group].tolist(), before[group].tolist(), strict=True))
        found, of = intervals([common(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:])], [s[3] for s in suffixes], least)
        names = [xxh(suffixes[one][0][:length]) for length, one, _ in found]
        for (_, a, p, _), k_ in zip(suffixes, of, strict=True):
            if k_ >= 0:
                around = found[k_][2]
                out.append((p, int(a - begin[p]), found[k_][0], names[k_], names[around] if around >= 0 else 0))
    return out


REPEAT = "struct<start:int,length:int,repeat:long,around:long>"


def scanned(pieces: DataFrame, least: int) -> DataFrame:
    """(core, own, spans) of each piece (core, own, copies, back, piece) with a repeat; cores' pieces stay together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest as xxh

        def work(rows: list[tuple]) -> pd.DataFrame:
            spans: list[list] = [[] for _ in rows]
            for p, start, length, name, around in repeats([r[3] for r in rows], least):
                spans[p].append((start, length, *signed([name, around]).tolist()))
            for own, r in zip(spans, rows, strict=True):
                if r[2] > 1:
                    own.append((0, len(r[3]), *signed([xxh(r[3]), 0]).tolist()))
            kept = [(r[0], r[1], s) for r, s in zip(rows, spans, strict=True) if s]
            return pd.DataFrame(kept, columns=["core", "own", "spans"])

        held, size, last = [], 0, None
        for b in batches:
            for r in b.itertuples(index=False, name=None):
                if size >= BLOCK and r[0] != last:
                    yield work(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
                last = r[0]
        if held:
            yield work(held)

    lined = streamed_by(pieces.select("core", "own", "copies", "piece"), "core", "own")
    return lined.mapInPandas(run, f"core long, own long, spans array<{REPEAT}>")


PIECE = "core long, own long, copies long, back int, low int, high int, piece binary"


def halved(pieces: DataFrame, least: int) -> DataFrame:
    """Both halves of each piece's windows, those from ``low`` to ``high`` bytes before the anchor, with longer cores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest as xxh

        for b in batches:
            out = []
            for core, own, copies, back, low, high, piece in b.itertuples(index=False, name=None):
                middle = (low + high) // 2
                for x, y in ((low, middle), (middle + 1, high)):
                    a, z = max(0, back - y), min(len(piece) - least, back - x)
                    if a <= z:
                        part, shared = piece[a : z + least], piece[back - x : back - y + least]
                        new = signed([xxh(shared, seed=x) ^ (core & (1 << 64) - 1), xxh(part)]).tolist()
                        out.append((core, own, a, *new, copies, back - a, x, y, part))
            yield pd.DataFrame(out, columns=["of_core", "of_own", "shift", "core", "own", "copies", "back", "low", "high", "piece"])

    return pieces.select("core", "own", "copies", "back", "low", "high", "piece").mapInPandas(run, f"of_core long, of_own long, shift int, {PIECE}")


def resolved(pieces: DataFrame, least: int, most: int) -> DataFrame:
    """(core, own, spans) of the different pieces (see ``PIECE``) that hold repeats.

    Halving ends by itself: windows at one distance from the anchor have themselves as core, so equal cores are copies.
    """
    sizes = stored(pieces.groupBy(F.col("core").alias("of")).agg(F.count("*").alias("many")), "repeat-sizes")
    sized = pieces.join(sizes, F.col("core") == F.col("of")).drop("of")
    span = F.struct(F.lit(0).alias("start"), F.octet_length("piece").alias("length"), F.col("own").alias("repeat"), F.lit(0).cast("long").alias("around"))
    alone = sized.filter("many = 1 and copies > 1").select("core", "own", F.array(span).alias("spans"))
    found = alone.unionByName(scanned(sized.filter((F.col("many") > 1) & (F.col("many") <= most)), least))
    crowded = sized.filter(F.col("many") > most)
    if crowded.isEmpty():
        return found
    halves = stored(halved(crowded, least), "repeat-halves")
    # equal halves become one piece; the other columns follow from core and bytes
    inner = resolved(stored(halves.groupBy("core", "own", "back", "low", "high", "piece").agg(F.sum("copies").alias("copies")), "repeat-pieces"), least, most)
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("shift")).alias("start"), s["length"].alias("length"), s["repeat"].alias("repeat"), s["around"].alias("around")))
    back = halves.select("of_core", "of_own", "shift", "core", "own").join(inner, ["core", "own"]).select(F.col("of_core").alias("core"), F.col("of_own").alias("own"), moved.alias("spans"))
    return found.unionByName(back.groupBy("core", "own").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def cut_out(rows: DataFrame, wanted: DataFrame, core: int, least: int) -> DataFrame:
    """The pieces (see ``PIECE``) that ``wanted`` (row, row2, parts) names, from the texts of ``rows``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw, parts in zip(b["raw"], b["parts"], strict=True):
                out += [(p["core"], p["own"], p["copies"], p["back"], 0, least - core, raw[p["at"] : p["at"] + p["length"]]) for p in parts]
            yield pd.DataFrame(out, columns=["core", "own", "copies", "back", "low", "high", "piece"])

    return rows.join(wanted.hint("shuffle_hash"), ["row", "row2"]).select("raw", "parts").mapInPandas(run, PIECE)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, row2, raw): rows with one id and text share their 96-bit key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("row"), F.hash(text, F.col(id_col)).alias("row2"), text.cast("binary").alias("raw"))


def occurrences(rows: DataFrame, least: int, core: int, most: int) -> DataFrame:
    """(row, row2, start, length, repeat, around) of maximal repeats in ``rows`` (as of ``keyed``), starts in bytes."""
    rows = rows.filter(F.octet_length("raw") >= least).select("row", "row2", "raw")
    every = stored(anchors(rows, least, core), "repeat-anchors")
    shared = every.groupBy(F.col("core").alias("of")).agg(F.count("*").alias("n"), F.min("own").alias("a"), F.max("own").alias("z"))
    # stored: an aggregate by core within the join would keep a hot core from being split there
    shared = stored(shared.filter("n > 1").select("of", (F.col("a") == F.col("z")).alias("alike")), "repeat-cores")
    hits = stored(every.join(shared, F.col("core") == F.col("of")).drop("of"), "repeat-hits")
    whole = hits.filter("alike").select("row", "row2", F.col("at").alias("start"), "length", F.col("own").alias("repeat"), F.lit(0).cast("long").alias("around"))
    mixed = hits.filter("not alike")
    # one row of each different piece brings its bytes
    one = [F.first(c).alias(c) for c in ("row", "row2", "at")]
    different = mixed.groupBy("core", "own", "back", "length").agg(F.count("*").alias("copies"), *one)
    wanted = different.groupBy("row", "row2").agg(F.collect_list(F.struct("core", "own", "copies", "back", "at", "length")).alias("parts"))
    found = stored(resolved(stored(cut_out(rows, wanted, core, least), "repeat-pieces"), least, most), "repeat-spans")
    each = mixed.join(found, ["core", "own"]).select("row", "row2", "at", F.explode("spans").alias("s"))
    return whole.unionByName(each.select("row", "row2", (F.col("at") + F.col("s.start")).alias("start"), "s.length", "s.repeat", "s.around"))


def maximal_repeats(docs: DataFrame, id_col: str, text_col: str = "text", least: int = LEAST, core: int = CORE, most: int = MOST) -> DataFrame:
    """(id, start, length, repeat, around): every occurrence of every maximal repeat of ``least`` bytes or more.

    ``repeat`` names the repeat by the hash of its bytes, ``around`` the shorter one that it is an occurrence of, too
    (0: none).
    """
    rows = keyed(docs, id_col, text_col)
    return occurrences(rows, least, core, most).join(rows.drop("raw"), ["row", "row2"]).select(F.col("id").alias(id_col), "start", "length", "repeat", "around")


def runs(spans) -> list[tuple[int, int]]:
    """Maximal covered runs (start, end) of spans."""
    out: list[list[int]] = []
    for start, length in sorted((s["start"], s["length"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [tuple(r) for r in out]


def cleaned(docs: DataFrame, id_col: str, text_col: str, least: int, core: int, most: int, columns: str, finish) -> DataFrame:
    """Id, n_bytes, n_removed, n_spans and what ``finish`` gives for the remaining bytes."""
    rows = keyed(docs, id_col, text_col)
    spans = occurrences(rows, least, core, most).groupBy("row", "row2").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    out = f"id {dict(rows.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, {columns}"
    names = [c.strip().split()[0] for c in out.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for id_, raw, own in zip(b["id"], b["raw"], b["spans"], strict=True):
                gone = [] if own is None else runs(own)
                edges = [0, *[x for r in gone for x in r], len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                found.append((id_, len(raw), len(raw) - len(kept), len(gone), *finish(kept)))
            yield pd.DataFrame(found, columns=names)

    return rows.join(spans.hint("shuffle_hash"), ["row", "row2"], "left").select("id", "raw", "spans").mapInPandas(run, out).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str, text_col: str = "text", least: int = LEAST, core: int = CORE, most: int = MOST) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): the bytes that no repeat covers; a cut may fall inside a character."""
    return cleaned(docs, id_col, text_col, least, core, most, "kept binary", lambda kept: (kept,))


def op11_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 400 bytes or more leave of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return cleaned(docs, "doc_id", "text", LEAST, CORE, MOST, "kept_sha256 string", lambda kept: (hashlib.sha256(kept).hexdigest(),))
