"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts are cut into passages of at most ``PASSAGE`` words.  Their TF-IDF rows, with document frequencies
counted over all documents, go through a distributed randomised SVD, which gives the latent space.  Every document is
folded into it by overlapping windows, long enough that each passage lies inside one, whole texts included.  A space
holds at most as many passages as it has dimensions, so products with them are those of the TF-IDF rows; a window is a
passage's candidate if the product is what any leak has at least, whatever words surround it.  A candidate is a leak
if the longest common subsequence covers ``STRICT`` of the passage's words, or ``LOOSE`` and the passage's answer (its
last sentence) is there too; in both cases the shared words must carry ``CARRIED`` of their share of the passage's
inverse document frequency, so that frequent words in common don't make a leak.

Words of all documents are numbered once for each ``NUMBERED`` passages, by the words of these; blocks of ``BLOCK``
passages then search the stored numbers.  The latent space is that of the benchmark's passages, not of the corpus: leading components of the corpus follow
frequent words and lose the rare ones that tell a passage from others.  A block is split into spaces of ``RANK``
passages; only a block's passages, terms and components, and the distinct words of ``NUMBERED`` passages are broadcast,
which bounds them.

Null and empty texts match nothing.  A benchmark item of fewer than ``LEAST`` words leaks where all its words stand
in a row, an item of one word where it is the whole text, as such a word occurs by chance.  Rows with the same id are
one document that holds what any of them holds.  An
empty benchmark or corpus gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EDGES, discard, stored, table

PASSAGE, OVERLAP, LEAST, CELL = 48, 24, 6, 16
RANK, EXTRA, ROUNDS, BLOCK, NUMBERED = 128, 16, 2, 4_096, 131_072
LOOSE, STRICT, ANSWER = 0.6, 0.65, 0.7
#: Share of the passage's inverse document frequency in a leak, as a part of its share of words; room for rounding.
CARRIED, ROUNDING = 0.6, 0.99
#: Raw words remembered in a Python worker, and cells searched at once.
MEMO, AT_ONCE = 400_000, 512
SENTENCE = re.compile(r"[.!?:]\s+")
LEAK = "item_id long, cosine double, lcs_share double"
#: Ids up to this number are broadcast (8 MB), more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def words_of(text: str) -> list[str]:
    return [w.strip(EDGES) or w for w in text.lower().split()]


def passages(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, part, words, answer): overlapping passages; the last ``answer`` words are the answer."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"], b["text"], strict=True):
                words = words_of(text)
                last = len(words_of(SENTENCE.split(text.strip())[-1]))
                for part, i in enumerate(range(0, max(1, len(words) - OVERLAP), PASSAGE - OVERLAP)):
                    own = words[i : i + PASSAGE]
                    ends = i + PASSAGE >= len(words)
                    rows.append((item, part, own, min(last, len(own)) if ends else len(own) // 3))
            yield pd.DataFrame(rows, columns=["item_id", "part", "words", "answer"])

    rows = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "item_id long, part int, words array<string>, answer int").filter(F.size("words") > 0)


class Terms(dict):
    """Numbers of raw words; 0 for words that no passage has."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        if len(self) > MEMO:
            self.clear()
        at = self[raw] = self.vocabulary.get(raw.strip(EDGES) or raw, 0)
        return at


def numbered(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int]) -> tuple[DataFrame, np.ndarray]:
    """Stored (id string, numbers binary) of every document, and the documents with each term (at 0: with words).

    A task adds a row with its own counts, so one pass gives both.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = number_type(len(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(shared.value)
        n = np.zeros(len(shared.value) + 1, np.int64)
        for b in batches:
            out = []
            for text in b["text"]:
                raw = text.lower().split()
                own = np.fromiter(map(terms.__getitem__, raw), kind, len(raw))
                n[np.unique(own)] += 1
                if len(own) and own.all():
                    n[0] += 1
                out.append(own.tobytes())
            yield pd.DataFrame({"id": b["id"], "numbers": out, "counts": None})
        yield pd.DataFrame({"id": [None], "numbers": [None], "counts": [n.tobytes()]})

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = stored(texts.mapInPandas(run, "id string, numbers binary, counts binary"), "numbers")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = sum(np.frombuffer(x, np.int64) for b in batches for x in b["counts"])
        if not isinstance(n, int):
            yield pd.DataFrame({"term": np.flatnonzero(n), "n": n[np.flatnonzero(n)]})

    out = np.zeros(len(vocabulary) + 1, np.int64)
    sums = both.filter(F.col("counts").isNotNull()).select("counts").mapInPandas(add, "term long, n long").groupBy("term").agg(F.sum("n"))
    for term, n in sums.collect():
        out[term] = n
    return both.filter(F.col("counts").isNull()).select("id", "numbers"), out


def number_type(terms: int) -> type:
    return np.uint16 if terms < 65_536 else np.int32


def randomised_svd(rows: DataFrame, columns: int, rank: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, components (columns, rank)) of sparse rows (terms array<int>, weights array<double>)."""
    return randomised_svds(rows, [columns], rank, rounds)[0]


def randomised_svds(rows: DataFrame, columns: list[int], rank: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same of several matrices side by side, whose rows have terms in their own columns only.

    The sketch A'(A X) is summed by column over the cluster; only (columns, rank) numbers reach the driver.
    """
    spark = rows.sparkSession
    ends = np.cumsum(columns)
    parts = [(slice(end - n, end), min(rank + EXTRA, n)) for end, n in zip(ends.tolist(), columns, strict=True)]
    size = max(n for _, n in parts)
    x = np.random.default_rng(5).standard_normal((int(ends[-1]), size))

    def sketched(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for terms, weights in zip(b["terms"], b["weights"], strict=True):
                    y = weights @ shared.value[terms]
                    for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                        sums[t] = sums[t] + w * y if t in sums else w * y
            if sums:
                yield pd.DataFrame({"term": list(sums), "y": list(sums.values())})

        def total(b: pd.DataFrame) -> pd.DataFrame:
            b = b.groupby("term")["y"].apply(lambda s: np.sum(np.stack(s.to_numpy()), axis=0)).reset_index()
            return b[["term", "y"]]

        got = rows.mapInPandas(part, "term long, y array<double>").groupBy("term").applyInPandas(total, "term long, y array<double>")
        out = np.zeros(x.shape)
        for term, y in got.collect():
            out[term] = y
        return out

    for _ in range(rounds):
        y = sketched(x)
        x = np.zeros(y.shape)
        for at, n in parts:
            x[at, :n], _ = np.linalg.qr(y[at, :n])
    last = sketched(x)
    out = []
    for at, n in parts:
        # x'A'Ax of the subspace found
        values, turn = np.linalg.eigh(x[at, :n].T @ last[at, :n])
        best = np.argsort(-values)[: min(rank, n)]
        best = best[values[best] > 1e-9]
        out.append((np.sqrt(values[best]), x[at, :n] @ turn[:, best]))
    return out


@dataclass
class Space:
    """What a task needs to search the passages of one latent space."""

    #: The space's terms, sorted; their places from 1 up are its own numbers, 0 for terms of other spaces.
    own: np.ndarray
    #: Latent vector of each term times its inverse document frequency; row 0 is zero.
    terms: np.ndarray
    idf: np.ndarray
    items: list[int]
    #: Term numbers and answer length of each passage, and unit latent vectors.
    words: list[np.ndarray]
    answers: list[int]
    units: np.ndarray
    #: Least product of a leak with each unit vector.
    floors: np.ndarray

    def __post_init__(self):
        lengths = np.array([len(w) for w in self.words])
        # a window of so many cells holds any such passage, wherever it begins
        self.cells = [(n, np.flatnonzero((lengths > low) & (lengths <= high))) for n, low, high in ((2, 0, CELL + 1), (4, CELL + 1, 3 * CELL + 1))]
        self.masks = [bit_masks(w) for w in self.words]
        self.sets = [set(w.tolist()) for w in self.words]

    @cached_property
    def products(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(cells of a window, passages, product of each term's latent vector with each of these passages' unit vectors).

        A window's product with a passage is the sum of its terms' products, so windows need no latent vectors.
        """
        return [(n, which, self.terms @ self.units[which].T) for n, which in self.cells if len(which)]


def bit_masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    full = state = (1 << n) - 1
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return n - state.bit_count()


@dataclass
class Short:
    """Items of fewer than ``LEAST`` words, by the hash of their term numbers."""

    items: dict[int, dict[int, list[tuple[tuple[int, ...], int]]]]

    @staticmethod
    def of(rows: list, vocabulary: dict[str, int]) -> Short:
        items: dict = {}
        for r in rows:
            words = np.array([vocabulary[w] for w in r["words"]], np.int64)
            at = int(run_hashes(words, len(words))[0])
            items.setdefault(len(words), {}).setdefault(at, []).append((tuple(words.tolist()), r["item_id"]))
        return Short(items)

    def within(self, ids: np.ndarray) -> list[tuple[int, float, float]]:
        found = set()
        for n, by_hash in self.items.items():
            if len(ids) < n or (n == 1 and len(ids) > 1):
                continue
            hashes = run_hashes(ids.astype(np.int64), n)
            for i in np.flatnonzero(np.isin(hashes, np.fromiter(by_hash, np.int64, len(by_hash)))).tolist():
                run = tuple(ids[i : i + n].tolist())
                found.update(item for words, item in by_hash[int(hashes[i])] if words == run)
        return [(item, 1.0, 1.0) for item in sorted(found)]


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` numbers in a row."""
    out = np.zeros(len(ids) - n + 1, np.int64)
    for k in range(n):
        out = out * 1_000_003 + ids[k : k + len(out)]
    return out


def spaces(spark: SparkSession, block: list, frequency: np.ndarray, vocabulary: dict[str, int], rank: int) -> list[Space]:
    """The latent spaces of a block of passages, each of at most ``rank`` passages."""
    n = -(-len(block) // rank)
    groups = [block[k::n] for k in range(n)]
    idf = np.log((frequency[0] + 1) / (frequency + 0.5)).clip(min=0)
    of_group, sparse, first = [], [], 0
    for group in groups:
        words = [np.array([vocabulary[w] for w in r["words"]], np.int32) for r in group]
        terms = np.unique(np.concatenate(words))
        words, weights = [np.searchsorted(terms, w) + 1 for w in words], np.concatenate([[0], idf[terms]])
        of_group.append((terms, words, weights))
        for w in words:
            at, times = np.unique(w, return_counts=True)
            weight = times * weights[at]
            sparse.append(((first + at).tolist(), (weight / max(np.linalg.norm(weight), 1e-12)).tolist()))
        first += len(weights)
    rows = spark.createDataFrame(pd.DataFrame(sparse, columns=["terms", "weights"]), "terms array<int>, weights array<double>")
    svds = randomised_svds(rows, [len(weights) for _, _, weights in of_group], rank)
    out = []
    for group, (own, words, weights), (_, components) in zip(groups, of_group, svds, strict=True):
        terms = (components * weights[:, None]).astype(np.float32)
        latent = np.stack([terms[w].sum(0) for w in words])
        norms = np.linalg.norm(latent, axis=1).clip(min=1e-9)
        units = (latent / norms[:, None]).astype(np.float32)
        floors = (ROUNDING * np.array([least_product(weights[w]) for w in words]) / norms).astype(np.float32)
        out.append(Space(own, terms, weights, [r["item_id"] for r in group], words, [r["answer"] for r in group], units, floors))
    return out


def least_product(idf: np.ndarray) -> float:
    """Least sum of squares of those of a passage's ``idf`` that carry what a leak must: the smallest come first."""
    idf = np.sort(idf)
    need = CARRIED * LOOSE * idf.sum()
    before = np.concatenate([[0], np.cumsum(idf)[:-1]])
    return float((idf * (need - before).clip(0, idf)).sum())


def leaks_of(s: Space, ids: list[np.ndarray]) -> list[list[tuple[int, float, float]]]:
    """(item, cosine, share) of the leaks of each text, one for each item."""
    out: list[list] = [[] for _ in ids]
    at = 0
    while at < len(ids):
        held, n = [], 0
        while at < len(ids) and (not held or n + len(ids[at]) < AT_ONCE * CELL):
            held.append(at)
            n += len(ids[at])
            at += 1
        for row, found in zip(held, searched(s, [ids[i] for i in held]), strict=True):
            out[row] = found
    return out


def searched(s: Space, ids: list[np.ndarray]) -> list[list[tuple[int, float, float]]]:
    # each text fills whole cells, with three empty ones behind; windows begin in cells with words, so none spans two texts
    full = np.array([-(-len(x) // CELL) for x in ids])
    cells = full + 3
    first = np.concatenate([[0], np.cumsum(cells)])
    text_of = np.repeat(np.arange(len(ids)), cells)
    starts = (np.arange(first[-1]) - first[text_of] < full[text_of])[:, None]
    flat = np.zeros(first[-1] * CELL, np.int32)
    for x, c in zip(ids, first[:-1], strict=True):
        flat[c * CELL : c * CELL + len(x)] = x
    by_place = np.ascontiguousarray(flat.reshape(-1, CELL).T)
    best: list[dict] = [{} for _ in ids]
    for width, which, products in s.products:
        sums = np.zeros((first[-1] + 3, len(which)), np.float32)
        term = np.empty((first[-1], len(which)), np.float32)
        for here in by_place:
            sums[:-3] += np.take(products, here, axis=0, out=term, mode="clip")
        near = sums[: first[-1]]
        for k in range(1, width):
            near = near + sums[k : k + first[-1]]
        close = starts & (near >= s.floors[which])
        for w, p in zip(*np.divmod(np.flatnonzero(close), len(which)), strict=True):
            judged(s, int(which[p]), flat[w * CELL : (w + width) * CELL], float(near[w, p]), best[text_of[w]])
    return [[(item, *found) for item, found in sorted(own.items())] for own in best]


def judged(s: Space, passage: int, window: np.ndarray, product: float, best: dict[int, tuple[float, float]]) -> None:
    """Adds the passage's item to ``best`` if the window, which has this product with it, holds it."""
    words, n = s.words[passage], len(s.words[passage])
    here = window.tolist()
    if len(s.sets[passage].intersection(here)) < 0.8 * LOOSE * len(s.sets[passage]):
        return
    length = common_subsequence(s.masks[passage], n, here)
    share = length / n
    present = np.isin(words, window)
    if share < LOOSE or s.idf[words[present]].sum() < share * s.idf[words].sum() * CARRIED:
        return
    if share < STRICT:
        answer = words[n - s.answers[passage] :]
        got = common_subsequence(bit_masks(answer), len(answer), here)
        if got < ANSWER * len(answer):
            return
    item = s.items[passage]
    cosine = product / max(float(np.linalg.norm(s.terms[window].sum(0))), 1e-9)
    if item not in best or (share, cosine) > best[item][::-1]:
        best[item] = (cosine, share)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    rank: int = RANK, block: int = BLOCK, numbered_at_once: int = NUMBERED,
) -> DataFrame:
    """(id, item_id, cosine, lcs_share): a row for each document and benchmark item that it holds."""
    spark = docs.sparkSession
    parts = stored(passages(benchmark, item_col, item_text), "passages")
    id_type = dict(docs.dtypes)[id_col]
    out = spark.createDataFrame([], f"id string, {LEAK}")
    for some in dealt(parts, numbered_at_once):
        # at most the distinct words of about ``numbered_at_once`` passages of PASSAGE words
        words = [r[0] for r in some.select(F.explode("words")).distinct().collect()]
        vocabulary = {w: i + 1 for i, w in enumerate(sorted(words))}
        numbers, frequency = numbered(docs, id_col, text_col, vocabulary)
        for own in dealt(some, block):
            # about ``block`` passages of at most PASSAGE words
            rows = own.orderBy("item_id", "part").collect()
            long = [r for r in rows if len(r["words"]) >= LEAST]
            short = Short.of([r for r in rows if len(r["words"]) < LEAST], vocabulary)
            searches = spaces(spark, long, frequency, vocabulary, rank) if long else []
            out = out.unionByName(found_in(numbers, searches, short, len(vocabulary)))
        discard(spark, numbers)
    best = out.groupBy("id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"))
    return best.select(F.col("id").cast(id_type).alias(id_col), "item_id", "cosine", "lcs_share")


def dealt(parts: DataFrame, size: int) -> Iterator[DataFrame]:
    """Passages in portions of about ``size``; none without passages."""
    n = -(-parts.count() // size)
    for k in range(n):
        own = parts.filter(F.pmod(F.xxhash64(F.lit(size), "item_id", "part"), F.lit(n)) == k) if n > 1 else parts
        if own.head(1):
            yield own


def found_in(numbers: DataFrame, searches: list[Space], short: Short, terms: int) -> DataFrame:
    """Leaks of the documents (stored), whose words have numbers up to ``terms``."""
    kind = number_type(terms)
    shared = numbers.sparkSession.sparkContext.broadcast((searches, short))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches, short = shared.value
        own = np.zeros(terms + 1, np.int32)
        for b in batches:
            ids = [np.frombuffer(x, kind) for x in b["numbers"]]
            rows = [(i, *leak) for i, x in zip(b["id"], ids, strict=True) for leak in short.within(x)] if short.items else []
            for s in searches:
                own[s.own] = np.arange(1, len(s.own) + 1)
                found = leaks_of(s, [own[x] for x in ids])
                own[s.own] = 0
                rows += [(i, *leak) for i, own in zip(b["id"], found, strict=True) for leak in own]
            yield pd.DataFrame(rows, columns=["id", "item_id", "cosine", "lcs_share"])

    return stored(numbers.mapInPandas(run, f"id string, {LEAK}"), "leaks")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id leaks."""
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__bad")).distinct()
    small = bad.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if small else bad, docs[id_col].eqNullSafe(bad["__bad"]), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
