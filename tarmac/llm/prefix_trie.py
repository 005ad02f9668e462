"""The trie of conversation prefixes: a node for every distinct sequence of first turns, with sums over its subtree.

Each conversation's turns are chained: the digest of depth d is the SHA-256 of that of depth d - 1 and of turn d, so
equal digests mean equal prefixes.  Every prefix is a row, and rows grouped by (depth, digest) are the nodes.  For sums
over subtrees each node is exploded to all its ancestors.  Nodes of an unbranched stretch hold the same conversations;
such a stretch is exploded as one, by its top, and its nodes take running sums within it.  A stretch below another one
has fewer conversations, so the exploded rows stay in proportion to the turns, however deep the trie.

Null roles and texts count as empty.  Rows without conversation are left out.  Turns of one place are taken by role,
then text; repeated rows are turns of their own.  A conversation without turns belongs to the root alone; an empty
table has no nodes.  Other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, streamed_by, table

#: Ids of a node's conversations are joined in blocks of so many neighbouring ids at most.
BLOCK = 4096
ROOT = hashlib.sha256(b"").digest()[:16]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, digest, chars): turns numbered from 1 (null ones first), each with its digest and length."""
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select("conv_id", place.cast("long").alias("place"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))


def grafted(rows: DataFrame, conversations: DataFrame, conv: str, group: int, most: int) -> DataFrame:
    """``rows`` of ``turns`` after each conversation took its first turns from the first one of its group.

    Conversation c begins with the first crc32(c) % ``most`` turns of conversation c - c % ``group``.
    """
    ids = conversations.select(F.col(conv).cast("long").alias("conv_id")).filter("conv_id is not null").distinct()
    head = lambda c: F.crc32(F.encode(F.col(c).cast("string"), "UTF-8")) % most
    own = rows.filter(F.col("place") > head("conv_id"))
    first = rows.filter((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    asking = ids.filter(head("conv_id") > 0).withColumn("of", F.col("conv_id") - F.col("conv_id") % group)
    taken = asking.join(first, (F.col("of") == F.col("base")) & (F.col("place") <= head("conv_id")))
    return own.unionByName(taken.select(*own.columns))


def prefixes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, chars, last) for every prefix of every conversation, the empty one included.

    Conversations stream through their tasks turn by turn; none is held as a whole.
    """

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            out = []
            for conv, place, digest, chars in b.itertuples(index=False, name=None):
                if place == 0:
                    now = (conv, 0, ROOT, None, 0)
                else:
                    now = (conv, held[1] + 1, hashlib.sha256(held[2] + digest).digest()[:16], held[2], chars)
                if held:
                    out.append((*held, conv != held[0]))
                held = now
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([(*held, True)], columns=names)

    names = ["conv_id", "depth", "digest", "parent", "chars", "last"]
    tops = ids.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    lined = streamed_by(rows.unionByName(tops), "conv_id", "place")
    return lined.mapInPandas(chain, "conv_id long, depth long, digest binary, parent binary, chars long, last boolean")


def ends(rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256): SHA-256 of the ids that end at a node, ascending, joined by commas.

    Ids are joined in blocks first, so a node with very many of them is hashed from few rows, block by block.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for b in batches:
            out = []
            for digest, text in zip(b["digest"], b["ids"], strict=True):
                if digest != key:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = digest, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pd.DataFrame(out, columns=["digest", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, sha.hexdigest())], columns=["digest", "ends_sha256"])

    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.filter("last").groupBy("digest", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("ids"))
    lined = streamed_by(blocks, "digest", "block")
    return lined.select("digest", "ids").mapInPandas(hashed, "digest binary, ends_sha256 string")


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of ``rows`` (as of ``turns``) and ``ids`` (conv_id, once each), with counts and sums.

    n_leaves and saved_tokens go over a node's subtree, itself included: childless nodes, and the characters of last
    turns that conversations share, once for each conversation but one.
    """
    lines = stored(prefixes(rows, ids), "trie-prefixes")
    # parent and chars follow from the digest
    nodes = stored(lines.groupBy("depth", "digest", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "trie-nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(kids, F.col("digest") == F.col("k"), "left").drop("k").na.fill(0, ["n_children"])
    # a conversation that is a node's smallest is the smallest of all nodes below on its path, so these are in a row
    own = Window.partitionBy("conv_id").orderBy("depth")
    top = F.coalesce(F.col("n_convs") != F.lag("n_convs").over(own), F.lit(True))
    marked = counted.withColumn("top", F.when(top, F.col("digest")))
    marked = marked.withColumns({"top": F.last("top", True).over(own), "saves": (F.col("n_convs") - 1) * F.col("chars")})
    before = F.coalesce(F.sum("saves").over(Window.partitionBy("conv_id", "top").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chained = stored(marked.withColumn("before", before), "trie-chained")
    tops = chained.groupBy("conv_id", "top").agg(F.min("depth").alias("depth"), F.sum("saves").alias("saves"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    # the tops on each conversation's path; those of a conversation that is the smallest of none aren't needed
    on_path = lines.filter("depth > 0").select(F.col("conv_id").alias("c"), F.col("depth").alias("at"), "digest").join(tops.select("top"), F.col("digest") == F.col("top"), "left_semi")
    above = tops.join(on_path, (F.col("conv_id") == F.col("c")) & (F.col("at") <= F.col("depth")))
    # the root is above all
    above = above.select("digest", "saves", "leaves").unionByName(tops.select(F.lit(ROOT).alias("digest"), "saves", "leaves"))
    sums = above.groupBy(F.col("digest").alias("s")).agg(F.sum("saves").alias("saved"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select(F.col("digest").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    out = chained.join(sums, F.col("top") == F.col("s")).join(parents, F.col("parent") == F.col("p"), "left")
    out = out.join(ends(lines).withColumnRenamed("digest", "e"), F.col("digest") == F.col("e"), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved") - F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its group's first one."""
    conversations = table(spark, sf_dir, "conversations")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).filter("conv_id is not null").distinct()
    return trie(grafted(turns(conversations), conversations, "conv_id", 100, 6), ids)


CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
 lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""
OP12_SQL = f"""WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
 h AS (SELECT c, c - c % 100 AS base, {CRC32} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
 b AS (SELECT h.c, o.n, struct_pack(r := o.r, t := o.t) AS u FROM h JOIN o ON o.c = h.base AND o.n <= h.h UNION ALL SELECT h.c, o.n, struct_pack(r := o.r, t := o.t) FROM h JOIN o ON o.c = h.c AND o.n > h.h),
 s AS (SELECT h.c, coalesce(list(b.u ORDER BY b.n) FILTER (b.n IS NOT NULL), []) AS q FROM h LEFT JOIN b ON b.c = h.c GROUP BY h.c),
 p AS (SELECT c, d, len(q) = d AS done, CASE WHEN d > 0 THEN length(q[d].t) ELSE 0 END AS chars, sha256(to_json(q[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(to_json(q[1:d - 1])::VARCHAR) END AS up
  FROM (SELECT c, q, unnest(range(len(q) + 1)) AS d FROM s)),
 nodes AS (SELECT k, d, up, chars, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (done), '') AS ends FROM p GROUP BY k, d, up, chars),
 kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
 full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.k),
 sums AS (SELECT p.k, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars)::BIGINT AS saved FROM full_ f JOIN p ON p.c = f.conv_id AND p.d <= f.d GROUP BY p.k)
 SELECT f.conv_id, f.d AS depth, x.conv_id AS parent_conv_id, f.n_convs, f.n_children, sums.n_leaves, sums.saved AS saved_tokens, sha256(f.ends) AS ends_sha256
 FROM full_ f JOIN sums ON sums.k = f.k LEFT JOIN nodes x ON x.k = f.up"""
