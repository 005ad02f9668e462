"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks of ``chunk_chars`` characters that overlap by ``overlap``.  Chunks are pre-tokenised
independently.  A chunk that starts inside a pre-token gives wrong pre-tokens at first, but from the first boundary
that it shares with its predecessor on, both continue alike, as the pattern never looks behind.  There the chunks are
stitched: each owns the characters from its own cut to the next one's.  The owned pieces are encoded, and a text's ids
are its pieces' ids in order.  Where a chunk shares no boundary within the overlap (one pre-token longer than that),
it's merged into the chunk before.  Decoding concatenates the raw bytes of the ids.

A text's chunks are worked off by the task that reads it, up to ``DEALT_CHARS``; those of longer texts are dealt out
to many tasks, by the same cuts.

Null texts count as empty: no ids.  Every row gives one row, repeated ones too.  Result columns replace those of the
same name; other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import brought_back, set_aside, table, text_or_empty

CHUNK_CHARS, OVERLAP = 4_096, 512
#: Texts beyond this are dealt out in chunks of their own size.
DEALT_CHARS, DEALT_CHUNK, DEALT_OVERLAP = 1 << 18, 1 << 16, 4_096
#: The pattern looks at most so many characters past the end of a pre-token ("'re" is split otherwise if cut).
LOOK_AHEAD = 4
#: Pre-tokens kept with their ids in each Python worker; beyond that the memory is cleared.
MEMO = 200_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def codec(path: str):
    """The encoding of a rank file, the bytes of each id, and the compiled pre-token pattern."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    raw = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        raw[rank] = token
    return encoding, raw, regex.compile(public_tokenizers.PATTERN)


class Encoder:
    """Encodes pre-token by pre-token, remembering the ids of pre-tokens already seen."""

    def __init__(self, path: str):
        self.encoding, self.raw, self.pattern = codec(path)
        self.memo: dict[str, list[int]] = {}

    def ids(self, text: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[int]:
        """Ids of a text by chunks that are pre-tokenised apart and stitched."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        out: list[int] = []
        for pieces in stitched(text, self.pattern, chunk_chars, overlap):
            self.encode(pieces, out)
        return out

    def encode(self, pieces: list[str], out: list[int]) -> None:
        memo, extend = self.memo, out.extend
        for piece in pieces:
            got = memo.get(piece)
            if got is None:
                got = self.encoding.encode_ordinary(piece)
                if len(piece) <= 64:
                    memo[piece] = got
            extend(got)

    def bytes(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def boundaries(text: str, pattern) -> np.ndarray:
    """Starts of the pre-tokens of ``text``."""
    return np.fromiter((m.start() for m in pattern.finditer(text)), np.int64)


def stitched(text: str, pattern, chunk_chars: int, overlap: int) -> Iterator[list[str]]:
    """The pre-tokens that each chunk of a text owns."""
    held = pattern.findall(text[: chunk_chars + overlap])
    begin = start = 0
    while start + chunk_chars < len(text):
        # the held pre-tokens begin at ``begin`` and reach past the next chunk's start
        following = start + chunk_chars
        part = text[following : following + chunk_chars + overlap]
        new = pattern.findall(part)
        ends, heads = np.cumsum([begin, *map(len, held)]), np.cumsum([following, *map(len, new)])
        reach = min(len(text), following + overlap)
        sure = ends[(ends >= following) & (ends <= reach - LOOK_AHEAD)]
        shared = np.intersect1d(sure, heads[heads < reach])
        if len(shared):
            cut = int(shared[0])
            yield held[: int(np.searchsorted(ends, cut))]
            held, begin = new[int(np.searchsorted(heads, cut)) :], cut
        else:
            # no shared boundary: the chunk is merged into the one before, read on from its last sure boundary
            last = int(np.searchsorted(ends, max(begin, min(reach - LOOK_AHEAD, int(ends[-2]))), side="right")) - 1
            kept, at = held[:last], int(ends[last])
            held = kept + pattern.findall(text[at : following + chunk_chars + overlap])
        start = following
    yield held


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_chars: int, overlap: int) -> DataFrame:
    """A row for each chunk of the texts: id, chunk number, start (code points from 0), text with the overlap."""
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(chunk_chars))
    out = docs.select(id_col, text_col, F.posexplode(starts).alias("chunk", "start"))
    return out.select(id_col, "chunk", "start", F.substring(text_col, F.col("start") + 1, F.lit(chunk_chars + overlap)).alias("part"))


def cuts(parts: DataFrame, id_col: str, chunk_chars: int, overlap: int, path: str) -> DataFrame:
    """(id, start, cut): where each chunk's own characters begin; chunks without a shared boundary have no row."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = codec(path)[2]
        for b in batches:
            heads, tails = [], []
            for start, part in zip(b["start"], b["part"], strict=True):
                at = boundaries(part, pattern)
                sure = at[at <= len(part) - LOOK_AHEAD]
                heads.append((at[at < overlap] + start).tolist())
                tails.append((sure[sure >= chunk_chars] + start).tolist())
            yield pd.DataFrame({id_col: b[id_col], "start": b["start"], "head": heads, "tail": tails})

    schema = f"{id_col} {dict(parts.dtypes)[id_col]}, start int, head array<long>, tail array<long>"
    found = parts.select(id_col, "start", "part").mapInPandas(scan, schema)
    before = F.lag("tail").over(Window.partitionBy(id_col).orderBy("start"))
    shared = F.array_min(F.array_intersect("head", before))
    cut = F.when(F.col("start") == 0, F.lit(0).cast("long")).otherwise(shared)
    return found.select(id_col, "start", cut.alias("cut")).filter(F.col("cut").isNotNull())


def encode(
    docs: DataFrame, id_col: str, text_col: str = "text", path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, dealt_chars: int = DEALT_CHARS
) -> DataFrame:
    """(id, ids array<int>): one row for each row of ``docs``."""
    return pieces_encoded(docs, id_col, text_col, path, chunk_chars, overlap, dealt_chars, "ids array<int>", lambda enc, ids: (ids,), join_ids)


def join_ids(df: DataFrame, id_col: str) -> DataFrame:
    in_order = F.array_sort(F.collect_list(F.struct("cut", "ids")))
    return df.groupBy(id_col).agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def pieces_encoded(docs, id_col, text_col, path, chunk_chars, overlap, dealt_chars, columns, finish, join):
    """Texts up to ``dealt_chars`` are stitched and finished where they're read; the chunks of longer ones are dealt out."""
    path = path or vocabulary_path()
    id_type = dict(docs.dtypes)[id_col]
    names = [c.split()[0] for c in columns.split(", ")]
    docs = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.length("text") > dealt_chars
    # chunks that are dealt out may be larger, up to a fourth of the text
    wide, wide_overlap = max(chunk_chars, min(DEALT_CHUNK, dealt_chars // 4)), max(overlap, min(DEALT_OVERLAP, dealt_chars // 16))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(path)
        for b in batches:
            rows = [finish(enc, enc.ids(t, max(chunk_chars, len(t) // 64), overlap)) for t in b["text"]]
            yield pd.DataFrame({id_col: b[id_col]} | dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in [id_col, *names]})

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(path)
        for b in batches:
            yield pd.DataFrame({"__key": b["__key"], "cut": b["cut"], "ids": [enc.ids(t, max(chunk_chars, len(t) // 64), overlap) for t in b["piece"]]})

    short_rows = docs.filter(~long).mapInPandas(whole, f"{id_col} {id_type}, {columns}")
    # repeated rows are encoded once, and count again at the end
    longer = docs.filter(long).groupBy(id_col, "text").agg(F.count("*").cast("int").alias("__n")).withColumn("__key", F.xxhash64(id_col, "text"))
    # the few long texts: their chunks are dealt out anew, so that one text's chunks are pre-tokenised by many tasks
    dealt = chunks(longer, "__key", "text", wide, wide_overlap).repartition(F.col("__key"), F.col("chunk"))
    cut = cuts(dealt, "__key", wide, wide_overlap, path)
    end = F.lead("cut").over(Window.partitionBy("__key").orderBy("cut"))
    spans = cut.withColumn("end", F.coalesce(end, F.lit((1 << 31) - 1).cast("long")))
    piece = F.substring("text", (F.col("cut") + 1).cast("int"), (F.col("end") - F.col("cut")).cast("int"))
    pieces = longer.join(spans, "__key").select("__key", "cut", piece.alias("piece"))
    encoded = pieces.repartition(F.col("__key"), F.col("cut")).mapInPandas(part, "__key long, cut long, ids array<int>")
    rows = longer.select("__key", id_col, F.explode(F.sequence(F.lit(1), "__n")))
    return short_rows.unionByName(rows.join(join(encoded, "__key"), "__key").select(id_col, *names))


def decode(encoded: DataFrame, id_col: str, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, raw binary): the bytes of the ids, concatenated; null ids give no bytes."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = codec(path)[1]
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "raw": [b"".join(raw[i] for i in ids) if ids is not None else b"" for ids in b[ids_col]]})

    return encoded.select(id_col, ids_col).mapInPandas(run, f"{id_col} {dict(encoded.dtypes)[id_col]}, raw binary")


def digest(enc: Encoder, ids: list[int]) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of their decimal list, SHA-256 of what they decode to."""
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.bytes(ids)).hexdigest()


def encode_digests(docs: DataFrame, id_col: str, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, without moving the ids of short texts to the JVM."""
    path = path or vocabulary_path()
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def join(encoded: DataFrame, key: str) -> DataFrame:
        whole = join_ids(encoded, key)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            enc = Encoder(path)
            for b in batches:
                rows = [digest(enc, list(ids)) for ids in b["ids"]] or []
                yield pd.DataFrame([(k, *r) for k, r in zip(b[key], rows, strict=True)], columns=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

        return whole.mapInPandas(run, f"{key} {dict(whole.dtypes)[key]}, {columns}")

    return pieces_encoded(docs, id_col, text_col, path, CHUNK_CHARS, OVERLAP, DEALT_CHARS, columns, digest, join)


def with_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256.

    Only the digests of texts that were dealt out are joined to their rows, by the text's hash.
    """
    path = path or vocabulary_path()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    docs, former = set_aside(docs, text_col)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def short(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = Encoder(path)
        for b in batches:
            yield pd.DataFrame([digest(enc, enc.ids(t)) for t in b], columns=names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    long = F.length(text) > DEALT_CHARS
    here = docs.filter(~long).withColumn("__d", short(text)).select(*kept, "__d.*")
    longer = docs.filter(long).withColumn("__sha", F.sha2(F.encode(F.col(text_col), "UTF-8"), 256))
    keys = longer.select("__sha", F.col(text_col).alias("text")).dropDuplicates(["__sha"])
    found = encode_digests(keys, "__sha", path=path).select("__sha", *[F.col(c).alias(f"__{c}") for c in names])
    there = longer.join(found, "__sha").select(*kept, *[F.col(f"__{c}").alias(c) for c in names])
    return brought_back(here.unionByName(there), former)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every whole document."""
    return encode_digests(table(spark, sf_dir, "documents"), "doc_id")
