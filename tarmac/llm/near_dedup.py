"""Near-duplicates by MinHash with an LSH forest; every link is confirmed on full shingle sets.

A document's set holds its distinct five-word shingles.  Equal sets are one node, named by a 128-bit hash, and only
one document of each goes on.  Its signature of ``trees * depth`` minima is sorted in ``trees`` orders, each starting
at another minimum.  A region of an order is a run of signatures that share at least ``depth`` leading minima.  Within
a region neighbours have the longest common prefixes, so sorting adapts the depth to how crowded the region is: each
document is compared with its ``NEIGHBOURS`` predecessors, whatever the region's size.

Links are confirmed in two rounds.  First each document's closest candidates; then all candidates that the first round
left in different components.  In regions with more members than neighbours were compared, each small component is also
compared with the whole region, in blocks of bounded size: a block's task counts the shared shingles of all its pairs
on their full sets and hands on a spanning forest of the links it finds, at most one link fewer than it has rows.
Regions above a block are first dealt anew by the rare shingles that their members share, where that moves fewer
shingles.  No link between components is lost; pairs within one component need no test, as their link would change nothing.

The forest misses a pair at the threshold with probability (1 - j**depth)**trees (for 0.85, about 4e-7), and a signature
estimate ``SLACK`` below the threshold rules a pair out (4.5 standard deviations).  Links themselves are exact up to
collisions of 64-bit shingle hashes.

Texts without words have an empty set and are linked with nothing; null texts count as empty.  Rows with the same id
and different texts are linked by their own texts each.  Rows without id are linked like others but never represent a
class; in a class without any id all rows are kept.  Other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import brought_back, discard, set_aside, shuffle_partitions, stored, table
from .components import components

WORDS, TREES, DEPTH, NEIGHBOURS, CLOSEST, SLACK = 5, 20, 4, 4, 4, 0.18
#: Of a crowded region's block: rows and shingles of a side, columns of a counting step.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 18, 4_096
#: Ids up to this number are broadcast to pick their texts (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words whose hashes a Python worker keeps.
MEMO = 500_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def shingle_set(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles (ASCII letters in lower case, words between ASCII space)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(w))
    acc = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - size + 1 + j]
    acc ^= acc >> np.uint64(32)
    return np.unique(acc * np.uint64(0xD6E8FEB86659FD93))


def factors(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray, a: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max)
    step = max(1, 160_000 // len(a))
    for i in range(0, len(shingles), step):
        least = np.minimum(least, np.multiply.outer(shingles[i : i + step], a).min(axis=0))
    return least


def signature(shingles: np.ndarray, a: np.ndarray) -> bytes:
    """The minima of the products with odd factors: their top 32 bits, big-endian, so that bytes sort like numbers."""
    return (minima(shingles, a) >> np.uint64(32)).astype(">u4").tobytes()


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, th): ``th`` is a hash of the text, which tells rows with the same id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))


def node_of(shingles: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(rows: DataFrame, words: int, size: int) -> DataFrame:
    """(id, th, n, node, sig) of rows (id, text, th); node and sig are null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, a = WordHashes(), factors(size)
        for b in batches:
            n, nodes, sigs = [], [], []
            for text in b["text"]:
                s = shingle_set(text, hashes, words)
                n.append(len(s))
                nodes.append(node_of(s))
                sigs.append(signature(s, a) if len(s) else None)
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "n": n, "node": nodes, "sig": sigs})

    id_type = dict(rows.dtypes)["id"]
    # as strings, so that null ids don't turn numbers into floating point
    texts = rows.withColumn("id", F.col("id").cast("string"))
    return texts.mapInPandas(run, "id string, th long, n long, node binary, sig binary").withColumn("id", F.col("id").cast(id_type))


def shingle_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles array<long>) of the nodes in ``wanted`` (node, rep): read again from the rows that represent them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes, words) for t in b["text"]]
            yield pd.DataFrame({"node": [node_of(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    small = wanted.count() <= BROADCAST_IDS
    reps = wanted.select(F.col("rep.id").alias("__id"), F.col("rep.th").alias("__th"))
    here = (F.col("th") == F.col("__th")) & F.col("id").eqNullSafe(F.col("__id"))
    picked = rows.join(F.broadcast(reps) if small else reps, here, "left_semi")
    # repeated rows give their set more than once
    return picked.select("text").mapInPandas(run, "node binary, shingles array<long>").dropDuplicates(["node"])


def candidates(rows: DataFrame, size: int, floor: float, ratio: float) -> DataFrame:
    """(a, b, est) of rows (t, turned, n, node) sorted by t and turned: each with its predecessors in the region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        first = None
        for b in batches:
            if not len(b):
                continue
            if first is None:
                first = b.iloc[:NEIGHBOURS]
                yield edge_rows(first)
            have = b if held is None else pd.concat([held, b], ignore_index=True)
            yield compared(have, 0 if held is None else len(held), size, floor, ratio)
            held = have.iloc[-NEIGHBOURS:]
        if held is not None:
            yield edge_rows(held)

    schema = "a binary, b binary, est double, t int, turned binary, n long"
    return rows.mapInPandas(run, schema)


def edge_rows(b: pd.DataFrame) -> pd.DataFrame:
    """Rows at a partition's ends, to be compared with the next partition's."""
    return pd.DataFrame({"a": b["node"], "b": b["node"], "est": -1.0, "t": b["t"], "turned": b["turned"], "n": b["n"]})


def compared(b: pd.DataFrame, old: int, size: int, floor: float, ratio: float) -> pd.DataFrame:
    sig = np.frombuffer(b"".join(b["turned"]), ">u4").reshape(len(b), size).astype(np.uint32)
    nodes, t, n = b["node"].to_numpy(), b["t"].to_numpy(), b["n"].to_numpy()
    out = []
    for lag in range(1, NEIGHBOURS + 1):
        i = np.arange(max(old, lag), len(b))
        j = i - lag
        same = (t[i] == t[j]) & (sig[i, :DEPTH] == sig[j, :DEPTH]).all(axis=1) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]))
        i, j = i[same], j[same]
        est = (sig[i] == sig[j]).mean(axis=1)
        near = est >= floor
        out.append(pd.DataFrame({"a": nodes[i][near], "b": nodes[j][near], "est": est[near]}))
    return pd.concat(out, ignore_index=True).assign(t=0, turned=None, n=0)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("r"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("s", "r"))
    return both.filter(100 * common >= percent * (F.size("s") + F.size("r") - common)).select("a", "b")


def labelled(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """``pairs`` with the components of both ends (an unlinked document is its own)."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"{c}_comp"))
    out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.withColumns({f"{c}_comp": F.coalesce(f"{c}_comp", c) for c in "ab"})


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each set of ``x`` shares with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(flat_x, flat_y)
    places = []
    for flat, sets in ((flat_x, x), (flat_y, y)):
        at = np.searchsorted(both, flat).clip(max=max(len(both) - 1, 0))
        known = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known], at[known]
        order = np.argsort(column, kind="stable")
        places.append((row[order], column[order], len(sets)))
    for i in range(0, len(both), COLUMNS):
        parts = []
        for row, column, n in places:
            here = slice(*np.searchsorted(column, [i, i + COLUMNS]))
            part = np.zeros((n, min(COLUMNS, len(both) - i)), np.float32)
            part[row[here], column[here] - i] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def forest(linked: np.ndarray, of_x: np.ndarray, of_y: np.ndarray) -> list[tuple[int, int]]:
    """Places (row, column) of ``linked`` that join components: at most one fewer than there are components."""
    _, label = np.unique(np.concatenate([of_x, of_y]), return_inverse=True)
    out = []
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        at = np.flatnonzero(linked[i])
        own, first = np.unique(label[len(of_x) + at], return_index=True)
        for other, k in zip(own.tolist(), first.tolist(), strict=True):
            if other != label[i]:
                out.append((i, int(at[k])))
                label[label == other] = label[i]
    return out


def mixed(region: DataFrame) -> DataFrame:
    """(bucket, largest, tiles, blocks, size, moved) of the regions with several components.

    All components but the largest make up the ``blocks``, all rows the ``tiles``; ``moved`` shingles reach their tasks.
    """
    of_component = region.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("weight"), F.max("size").alias("size"))
    biggest = F.max_by(F.struct("component", "k", "weight"), F.struct("k", "component")).alias("largest")
    of_region = of_component.groupBy("bucket").agg(biggest, F.sum("k").alias("rows"), F.sum("weight").alias("weight"), F.max("size").alias("size"))
    blocks = lambda rows, weight: F.ceil(F.greatest(rows / BLOCK, weight / BLOCK_SHINGLES))
    rest = F.col("weight") - F.col("largest.weight")
    out = of_region.filter("largest.k < rows").withColumns({"tiles": blocks(F.col("rows"), F.col("weight")), "blocks": blocks(F.col("rows") - F.col("largest.k"), rest)})
    moved = (rest * F.col("tiles") + F.col("weight") * F.col("blocks")).alias("moved")
    return out.select("bucket", F.col("largest.component").alias("largest"), "tiles", "blocks", "size", moved)


def of_regions(region: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``region`` with the columns of ``found`` for their bucket; a large region's rows meet its one row in several tasks."""
    salts = F.ceil(F.col("size") / BLOCK)
    dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("size")
    return region.withColumn("salt", F.pmod(F.xxhash64("node"), salts)).join(dealt, ["bucket", "salt"]).drop("salt")


def split(region: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, regions): regions above a block dealt anew by rare shingles that their members share, where that moves less.

    With all shingles in one order, rare ones first, linked sets share one of the first n - ceil(percent * n) + 1 of
    each.  So no link is lost, while a deeper prefix of minima would lose some.
    """
    large = found.filter("tiles > 1")
    if not large.head(1):
        return region, found
    rows = stored(of_regions(region, large).select("bucket", "node", "n", "size", "component"), "large")
    tokens = rows.select("node").distinct().join(sets, "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    times = stored(tokens.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1"), "times")
    own = F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "shingle")))
    length = F.first("n")
    first = tokens.join(times, "shingle", "left").groupBy("node").agg(F.slice(own, F.lit(1), length - F.expr(f"int((first(n) * {percent} + 99) div 100)") + 1).alias("rare"))
    first = first.withColumn("rare", F.filter("rare", lambda r: r["times"] > 1))
    # shingles that blocks of the new regions would read, at most
    tiles = F.expr(f"aggregate(rare, 0D, (s, r) -> s + ceil(least(size, r.times) * greatest(1 / {BLOCK}, n / {BLOCK_SHINGLES})))")
    both = stored(rows.join(first, "node"), "rare")
    anew = both.groupBy("bucket").agg(F.sum(2 * F.col("n") * tiles).alias("anew"))
    chosen = stored(large.join(anew, "bucket").filter("anew < moved").select("bucket", "size"), "chosen")
    if not chosen.head(1):
        discard(region.sparkSession, rows, times, both, chosen)
        return region, found
    dealt = of_regions(both, chosen).withColumn("r", F.explode("rare")).select(
        F.xxhash64("bucket", "r.shingle").alias("bucket"), "node", "n", F.least("size", "r.times").alias("size"), "component"
    )
    dealt = stored(dealt, "split")
    kept = stored(found.join(chosen, "bucket", "left_anti").unionByName(mixed(dealt)), "regions")
    discard(region.sparkSession, rows, times, both, chosen)
    return region.unionByName(dealt), kept


def crowded(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of crowded regions that join different components, confirmed on full sets.

    Every component of a region but the largest is compared with the whole region, in blocks of about ``BLOCK`` rows
    or ``BLOCK_SHINGLES`` shingles a side; regions above a block are dealt anew by ``split`` first.  Only a spanning
    forest of the links found leaves a block.
    """
    spark = members.sparkSession
    region = members.filter(F.col("size") > NEIGHBOURS + 1).select("bucket", "node", "n", "size").join(comps, "node", "left")
    region = region.select("bucket", "node", "n", "size", F.coalesce("component", "node").alias("component"))
    region = stored(region, "region")
    found = stored(mixed(region), "regions")
    rows, regions = split(region, found, sets, percent)
    marked = of_regions(rows, regions).withColumn("small", F.col("component") != F.col("largest"))
    marked = marked.select("bucket", "node", "n", "component", "small", "tiles", "blocks").join(sets, "node")
    marked = stored(marked, "marked")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n))
    cols = ["bucket", "node", "n", "component", "small", "shingles"]
    left = marked.filter("small").select(*cols, F.lit(True).alias("left"), own("block", "blocks").alias("block"), spread("tiles").alias("tile"))
    right = marked.select(*cols, F.lit(False).alias("left"), spread("blocks").alias("block"), own("tile", "tiles").alias("tile"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[rows["left"]], rows[~rows["left"]]
        found: list = []
        if len(x) and len(y):
            common = shared_counts(x["shingles"].tolist(), y["shingles"].tolist())
            both = x["n"].to_numpy()[:, None] + y["n"].to_numpy()[None, :]
            linked = 100 * common >= percent * (both - common)
            found = forest(linked, x["component"].to_numpy(), y["component"].to_numpy())
        a, b = x["node"].to_numpy(), y["node"].to_numpy()
        return pd.DataFrame({"a": [a[i] for i, _ in found], "b": [b[j] for _, j in found]})

    links = left.unionByName(right).groupBy("bucket", "block", "tile").applyInPandas(run, "a binary, b binary")
    out = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "crowded")
    discard(spark, rows, found, regions, marked)
    return out


def near_duplicates(docs: DataFrame, id_col: str, text_col: str = "text", percent: int = 85, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept, th) of every row: component_id is the smallest id reachable over links, th
    the hash of its text."""
    spark = docs.sparkSession
    size, ratio, floor = TREES * DEPTH, percent / 100, percent / 100 - SLACK
    texts = identified(docs, id_col, text_col)
    rows = stored(signatures(texts, words, size), "sigs")
    # one document for each distinct set; a group of copies is reduced before the shuffle
    reps = rows.filter("n > 0").groupBy("node").agg(
        F.min("id").alias("id"), F.max(F.struct("id", "th")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    reps = stored(reps, "reps")
    step = DEPTH * 4
    bucket = F.xxhash64("t", F.expr(f"substring(sig, t * {step} + 1, {step})"))
    trees = reps.select("node", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")).withColumn("bucket", bucket)
    # stored, so that the join may split a large region's rows
    shared = stored(trees.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    near = trees.select("node", "t", "bucket").join(shared, "bucket")
    turned = F.concat(F.expr(f"substring(sig, t * {step} + 1)"), F.expr(f"substring(sig, 1, t * {step})"))
    members = stored(near.join(reps.select("node", "n", "sig"), "node").select("t", turned.alias("turned"), "n", "node", "bucket", "size"), "members")
    order = members.select("t", "turned", "n", "node")
    dealt = order.repartitionByRange(shuffle_partitions(spark), "t", "turned").sortWithinPartitions("t", "turned")
    found = stored(candidates(dealt, size, floor, ratio), "candidates")
    # a few rows from each end of each partition: their number doesn't grow with the table
    # a partition of fewer rows than two ends hands some on twice
    ends = found.filter("est < 0").select("t", "turned", "n", F.col("a").alias("node")).distinct().coalesce(1).sortWithinPartitions("t", "turned")
    across = candidates(ends, size, floor, ratio).filter("est >= 0").select("a", "b", "est")
    pairs = found.filter("est >= 0").select("a", "b", "est").unionByName(across)
    pairs = stored(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("est").alias("est")).filter("a < b"), "pairs")
    large = members.filter(F.col("size") > NEIGHBOURS + 1).select("node")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large).distinct()
    wanted = stored(nodes.join(reps.select("node", "rep"), "node"), "wanted")
    sets = stored(shingle_sets(texts, wanted, words), "sets")
    # first round: for each document its closest candidates; every list is bounded by trees * neighbours * 2
    ends_of = pairs.select("a", "b", "est", F.explode(F.array("a", "b")).alias("of"))
    best = ends_of.groupBy("of").agg(F.slice(F.sort_array(F.collect_list(F.struct("est", "a", "b")), False), 1, CLOSEST).alias("best"))
    first = best.select(F.explode("best").alias("p")).select("p.a", "p.b").distinct()
    links = stored(confirmed(first, sets, percent), "links")
    comps = components(links)
    # second round: what's left between components, and crowded regions
    left = labelled(pairs, comps).filter("a_comp != b_comp").select("a", "b").join(first, ["a", "b"], "left_anti")
    more = stored(confirmed(left, sets, percent), "links")
    rest = crowded(members, comps, sets, percent)
    more_rest = more.unionByName(rest)
    if more_rest.head(1):
        comps = components(links.unionByName(more_rest))
    # the smallest id of each component's nodes
    of_node = reps.select("node", "id").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_node.groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = of_node.join(smallest, "component").select("node", "component_id")
    out = stored(rows.select("id", "th", "n", "node").join(of_node, "node", "left"), "near-dup")
    discard(spark, rows, reps, shared, members, found, pairs, wanted, sets, more, links, rest, comps)
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), "th",
    )


def representatives(docs: DataFrame, id_col: str, text_col: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest id; of rows alike in id and text, one.

    Rows without words and rows of classes without any id are kept all.
    """
    docs, names = set_aside(docs, id_col, text_col)
    found = near_duplicates(docs, id_col, text_col, percent).filter("kept")
    repeated = (F.count("*") > 1) & (F.max("n_shingles") > 0) & F.col("__id").isNotNull()
    kept = stored(found.groupBy(F.col(id_col).alias("__id"), F.col("th").alias("__th")).agg(repeated.alias("__repeated")), "kept")
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = lambda side: (F.col("__h") == side["__th"]) & F.col(id_col).eqNullSafe(side["__id"])
    again = kept.filter("__repeated")
    if not again.head(1):
        return brought_back(rows.join(kept, same(kept), "left_semi").select(*docs.columns), names)
    single = kept.filter("not __repeated")
    once = rows.join(again, same(again), "left_semi").dropDuplicates([id_col, "__h"])
    return brought_back(rows.join(single, same(single), "left_semi").unionByName(once).select(*docs.columns), names)


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all whole documents at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", percent=85).drop("th")
