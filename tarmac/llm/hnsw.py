"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one node of a graph, whatever their number; as ties go to smaller ids, a node keeps the ``k + 1``
smallest ids of its copies, which is all that any list of ``k`` neighbours can hold.  Nodes are dealt to shards by the
hash of the vector, and each task builds the graph of one shard: layers of neighbour lists in one flat array of
integers, -1 where a list ends.  Shards grow with the table, from ``SHARD_ROWS`` to what a task's memory holds, once
there are several for each shuffle partition: every query visits every shard, so fewer shards mean less work.  Queries
go to the shards in blocks of a size that a task holds; each shard gives its nearest nodes, with distances in double
precision on the original vectors, and the lists are merged by query.

Every row is indexed; nothing is fitted on a sample.  Rows whose vector is null, zero or holds a null or non-finite
component take no part, neither do rows without id.  Vectors of different lengths never meet.  Rows with the same id
are candidates each, except for queries of that id.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, table

#: Least rows of a shard, bytes of a large shard's vectors, shards for each shuffle partition, bytes of a block of queries, links of a node above layer 0 (twice as many there), widths of both searches.
SHARD_ROWS, SHARD_BYTES, SHARDS, BLOCK_BYTES, LINKS, BUILD_WIDTH, SEARCH_WIDTH = 4_096, 64 << 20, 4, 32 << 20, 12, 48, 128
#: Parts into which the copies of one vector are dealt before they are merged.
SALTS = 64


class Graph:
    """One shard's graph: vectors (node, component), level of each node, flat neighbour array."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        self.v, self.links = vectors, links
        n = len(vectors)
        # a level for each node by the geometric law that the number of links asks for
        draw = np.random.default_rng(11).random(n)
        self.level = np.minimum((-np.log(1 - draw) / np.log(links)).astype(np.int32), 12)
        # where each node's lists start: 2 * links places on layer 0, links on each layer above
        self.start = np.concatenate([[0], np.cumsum(2 * links + self.level * links)]).astype(np.int64)
        self.flat = np.full(self.start[-1], -1, np.int32)
        self.entry, self.top = -1, -1

    def place(self, node: int, layer: int) -> slice:
        at = self.start[node] + (0 if layer == 0 else 2 * self.links + (layer - 1) * self.links)
        return slice(at, at + (2 * self.links if layer == 0 else self.links))

    def neighbours(self, node: int, layer: int) -> np.ndarray:
        own = self.flat[self.place(node, layer)]
        return own[own >= 0]

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.v[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def search(self, q: np.ndarray, entry: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found on a layer from the entry points, nearest first."""
        seen = {node for _, node in entry}
        open_ = list(entry)
        heapq.heapify(open_)
        best = [(-d, node) for d, node in entry]
        heapq.heapify(best)
        while open_:
            d, node = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [x for x in self.neighbours(node, layer).tolist() if x not in seen]
            if not new:
                continue
            seen.update(new)
            for far, x in zip(self.distances(q, np.array(new)).tolist(), new, strict=True):
                if len(best) < width or far < -best[0][0]:
                    heapq.heappush(open_, (far, x))
                    heapq.heappush(best, (-far, x))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, node) for d, node in best)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        found = [(float(self.distances(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(self.top, to, -1):
            found = self.search(q, found[:1], 1, layer)
        return found

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: nearer to the node than to any neighbour chosen before; then the nearest."""
        nodes = np.array([x for _, x in found])
        if len(nodes) <= most:
            return nodes.tolist()
        far = np.array([d for d, _ in found])
        v = self.v[nodes]
        norms = np.einsum("ij,ij->i", v, v)
        between = norms[:, None] + norms - 2 * (v @ v.T)
        # distance to the nearest neighbour chosen so far; what was looked at or chosen is out
        open_ = np.full(len(nodes), np.inf)
        kept: list[int] = []
        i = 0
        while i < len(nodes) and len(kept) < most:
            kept.append(i)
            open_ = np.minimum(open_, between[i])
            later = np.flatnonzero(open_[i + 1 :] >= far[i + 1 :])
            if not len(later):
                break
            i += 1 + int(later[0])
        chosen = set(kept)
        rest = [i for i in range(len(nodes)) if i not in chosen]
        return nodes[(kept + rest)[:most]].tolist()

    def insert(self, node: int) -> None:
        q, level = self.v[node], int(self.level[node])
        if self.entry < 0:
            self.entry, self.top = node, level
            return
        found = self.descend(q, min(level, self.top))
        for layer in range(min(level, self.top), -1, -1):
            found = self.search(q, found, BUILD_WIDTH, layer)
            chosen = self.spread(found[: 4 * self.links], self.links)
            own = self.place(node, layer)
            self.flat[own.start : own.start + len(chosen)] = chosen
            for x in chosen:
                self.link(x, node, layer)
        if level > self.top:
            self.entry, self.top = node, level

    def link(self, node: int, new: int, layer: int) -> None:
        own = self.place(node, layer)
        free = np.flatnonzero(self.flat[own] < 0)
        if len(free):
            self.flat[own.start + free[0]] = new
            return
        all_ = np.append(self.flat[own], new)
        far = self.distances(self.v[node], all_)
        order = np.argsort(far, kind="stable")
        chosen = self.spread([(float(far[i]), int(all_[i])) for i in order], len(all_) - 1)
        self.flat[own] = chosen

    def nearest(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        return self.search(q, self.descend(q, 0)[:1], max(k, width), 0)[:k]


def usable(c: str) -> Column:
    """Whether a vector takes part: finite, not null, not zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(c).isNotNull() & ~F.exists(c, odd) & F.exists(c, lambda x: x != 0)


def nodes_of(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(vector, key, ids): distinct vectors with their k + 1 smallest ids; copies are merged in two steps."""
    rows = df.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    smallest = lambda ids: F.slice(F.sort_array(ids), 1, k + 1)
    rows = rows.withColumn("key", F.sha2(F.concat_ws(" ", F.col("vector").cast("array<string>")), 256))
    parts = rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.first("vector").alias("vector"), smallest(F.collect_list("id")).alias("ids"))
    return parts.groupBy("key").agg(F.first("vector").alias("vector"), smallest(F.flatten(F.collect_list("ids"))).alias("ids"))


def shard_size(rows: int, width: int, partitions: int) -> int:
    """Rows of a shard: enough shards to keep all tasks busy, none larger than a task's memory holds."""
    most = max(1, SHARD_BYTES // (8 * width + 12 * LINKS))
    return min(most, max(SHARD_ROWS, -(-rows // (SHARDS * partitions))))


INDEX = "shard string, width int, vectors binary, level binary, start binary, flat binary, entry int, top int, ids array<array<long>>"


def build(df: DataFrame, id_col: str, vec_col: str, k: int = 10, shard_rows: int | None = None) -> DataFrame:
    """The index: a stored row for each shard; it serves lists of up to ``k`` neighbours."""
    nodes = stored(nodes_of(df, id_col, vec_col, k), "hnsw-nodes")
    rows, widest = nodes.agg(F.count("*"), F.max(F.size("vector"))).head()
    if shard_rows is None:
        shard_rows = shard_size(rows, widest or 1, shuffle_partitions(df.sparkSession))
    shards = max(1, -(-rows // shard_rows))
    dealt = nodes.withColumn("shard", F.concat_ws("-", F.size("vector"), F.pmod(F.xxhash64("key"), F.lit(shards))))

    def graph(b: pd.DataFrame) -> pd.DataFrame:
        # by key, so that a repeated task builds the same graph
        b = b.sort_values("key")
        g = Graph(np.stack(b["vector"].to_numpy()).astype(np.float64))
        for node in range(len(b)):
            g.insert(node)
        row = (b["shard"].iloc[0], g.v.shape[1], g.v.tobytes(), g.level.tobytes(), g.start.tobytes(), g.flat.tobytes(), g.entry, g.top, [list(x) for x in b["ids"]])
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    return stored(dealt.groupBy("shard").applyInPandas(graph, INDEX), "hnsw-index")


def restored(row: pd.Series) -> Graph:
    g = Graph.__new__(Graph)
    g.v, g.links = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["width"]), LINKS
    g.level, g.start, g.flat = (np.frombuffer(row[c], t) for c, t in (("level", np.int32), ("start", np.int64), ("flat", np.int32)))
    g.entry, g.top = int(row["entry"]), int(row["top"])
    return g


def search(index: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows, its own id left out."""
    rows = queries.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("query_id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vector")
    )
    n, widest = rows.agg(F.count("*"), F.max(F.size("vector"))).head()
    blocks = max(1, -(-n * 8 * (widest or 1) // BLOCK_BYTES))
    rows = rows.withColumn("width", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    # shards and block numbers are few; every query goes to every shard of its width
    shards = index.select(F.col("shard").alias("at"), F.col("width"))
    asked = rows.join(F.broadcast(shards), "width")
    served = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            g, ids = restored(left.iloc[0]), left["ids"].iloc[0]
            for query, vector in zip(right["query_id"], right["vector"], strict=True):
                q = np.asarray(vector, np.float64)
                # one node may hold the query alone
                for _, node in g.nearest(q, k + 1, width):
                    score = float(np.sqrt(((g.v[node] - q) ** 2).sum()))
                    out += [(query, int(i), score) for i in ids[node] if i != query][: k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    near = served.groupBy("shard", "block").cogroup(asked.groupBy("at", F.col("block").alias("of"))).applyInPandas(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every embedding whose id is divisible by 100, among all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build(rows, "vec_id", "embedding"), rows.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding")
