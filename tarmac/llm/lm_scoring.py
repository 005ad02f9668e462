"""Stupid-backoff language-model scores, computed relationally.

Words are what white space separates, in lower case; every word of the documents is one of the model's.  The count
tables of all n-grams up to ``order`` cover all documents and are partitioned by the n-gram's hash; documents' exploded
n-grams are joined to them and their scores are summed per document.  A task hands on an n-gram once for about ``HELD``
words, with the documents that it stands in, dealt out by the n-gram; the count table is aggregated where these rows
lie and joined to them there, so that n-grams move once:

    score(u v w) = ln(c(u v w) / c(u v))       if c(u v w) >= min_count
                 = ln(backoff) + score(v w)    otherwise, down to
    score(v w)   = ln(c(v w) / c(v))           if c(v w) >= min_count
                 = ln(backoff * c(w) / words)  otherwise

``min_count`` is 2, as every n-gram that is scored has been counted itself; one is seen if it stands elsewhere too.
The first word follows the start mark, whose count is the number of documents with words; n-grams don't reach past it.
Scores are integers of a millionth, so sums don't depend on their order.  An order above 2 adds, for each order, what
its n-grams that are seen change: score less the score that backing off gives; only these meet the orders below.

The most frequent words, at most ``CODED``, have short codes and counts that are sent to the tasks; the others go by a
hash of the word, and their counts by a join with the bigrams that need them.  That only shortens keys.  A bigram needs
one count only: its first word's if it is seen, else its second word's.  An n-gram occurs no more often than its rarest
word; where that may be more than ``SALTED`` times, its rows are dealt out to several tasks, whose counts are added up.

Null and empty texts have no words: score 0.  Rows with the same id are one document; rows without id, too.  An empty
table gives no rows.  Other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

ORDER, BACKOFF, MIN_COUNT = 2, 0.4, 2
#: Code of the start mark; the key of a bigram of short codes holds both, and below them the salt.
START, SHIFT, SALT_BITS = 1, 20, 23
#: Words with short codes, steps for each doubling of the counts among which they're chosen, hashes remembered in a Python worker.
CODED, STEPS, MEMO = 500_000, 16, 200_000
#: An n-gram and the row that it stands in, side by side in 64 bits.
ROW_BITS = 20
#: Columns that name an n-gram.
GRAM = ["a", "b", "salt"]
#: Distinct words counted in a Python worker before they're handed on, words whose bigrams it holds, rows of a batch.
COUNTED, HELD, BATCH = 300_000, 500_000, 250_000
#: Occurrences of an n-gram that a task takes, about.
SALTED = 1 << 22


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents, words as their hashes; words are counted within tasks first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([hashed(w) for w in held], "int64"), "n": pa.array(list(held.values()), "int64")})

        for b in batches:
            for text in b["text"]:
                held.update(text.as_py().split())
            if len(held) > COUNTED:
                yield out()
                held.clear()
        if held:
            yield out()

    return lowered(docs, text_col).mapInArrow(tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lowered(docs: DataFrame, text_col: str, *ids) -> DataFrame:
    """Lower-case texts that have words, as bytes: ``bytes.split`` parts them at the model's white space."""
    text = F.col(text_col)
    return docs.filter(text.rlike(r"[^\x20\x09-\x0D]")).select(*ids, F.lower(text).cast("binary").alias("text"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """The most frequent words and their counts, all words down to some count; at most ``most``."""
    step = F.floor(F.log2("n") * STEPS)
    # a row for each step: a few hundred, whatever the table
    sizes = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, words = None, 0
    for at, n in sizes:
        words += n
        if words > most:
            break
        least = at
    if least is None:
        return []
    return sorted(((r["word"], r["n"]) for r in counts.filter(step >= least).collect()), key=lambda x: (-x[1], x[0]))


Shared = tuple[np.ndarray, np.ndarray, np.ndarray]


def shared_codes(words: list[int], counts: list[int], begun: int) -> Shared:
    """(hashes of words with short codes, sorted; their codes; counts by code): 20 bytes a word in each Python worker."""
    words = np.array(words, np.int64)
    order = np.argsort(words)
    return words[order], (order + 2).astype(np.int32), np.array([0, begun, *counts], np.int64)


class Codes(dict):
    """Codes of words: short ones from 2 up, else the word's hash, below 0."""

    def __init__(self, words: np.ndarray, codes: np.ndarray):
        # views: bisect gets plain numbers from them
        self.words, self.codes = memoryview(words), memoryview(codes)

    def __missing__(self, word: bytes) -> int:
        at = hashed(word)
        place = bisect_left(self.words, at)
        if place < len(self.words) and self.words[place] == at:
            at = self.codes[place]
        if len(self) > MEMO:
            self.clear()
        self[word] = at
        return at


def hashed(word: bytes) -> int:
    digest = hashlib.blake2b(word, digest_size=8).digest()
    return int.from_bytes(digest, "little") % (1 << 63) - (1 << 63)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of each pair of numbers, below 0."""
    x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) + second.astype(np.uint64)
    for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    x = (x ^ x >> np.uint64(31)) | np.uint64(1 << 63)
    return x.view(np.int64)


def keys_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of bigrams: both short codes side by side, else a hash of both codes, below 0."""
    return np.where((first >= 0) & (second >= 0), first << SHIFT | second, mixed(first, second))


def higher(first: np.ndarray, second: np.ndarray, rows: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """(which bigrams end one, key, prefix's key, suffix's key, row) of the n-grams of an order above 2 that don't reach
    past a text's start mark."""
    begins = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
    keys = prefix = suffix = keys_of(first, second)
    for _ in range(3, order + 1):
        prefix, suffix = np.concatenate([keys[:1], keys[:-1]]), keys
        keys = mixed(prefix, second)
    whole = place >= order - 2
    return whole, keys[whole], prefix[whole], suffix[whole], rows[whole]


Held = tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]


def held_bigrams(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[Held]:
    """(first and second code of each bigram, row of each, ids of the rows) for about ``HELD`` words at a time; a text
    is never parted."""
    held, row_of, of_rows, n, row = [], [], [], 0, 0

    def block() -> Held:
        # the parts are freed as soon as they're joined
        parts, of = held[:], row_of[:]
        held.clear(), row_of.clear()
        second, rows = np.concatenate([p[1:] for p in parts]), np.concatenate(of)
        del of
        return np.concatenate([p[:-1] for p in parts]), second, rows, pa.concat_arrays(of_rows)

    for b in batches:
        of_batch = b.column("id") if "id" in b.schema.names else pa.nulls(len(b))
        begin = 0
        for i, text in enumerate(b.column("text")):
            words = text.as_py().split()
            own = np.empty(len(words) + 1, np.int64)
            own[0] = START
            own[1:] = list(map(codes.__getitem__, words))
            held.append(own)
            row_of.append(np.full(len(words), row, np.int32))
            n, row = n + len(words), row + 1
            if n >= HELD or row == 1 << ROW_BITS:
                of_rows.append(of_batch.slice(begin, i + 1 - begin))
                yield block()
                of_rows, n, row, begin = [], 0, 0, i + 1
        of_rows.append(of_batch.slice(begin))
    if held:
        yield block()


def in_parts(n: int) -> list[slice]:
    return [slice(i, i + BATCH) for i in range(0, n, BATCH)]


def block_rows(batches: Iterator[pa.RecordBatch], codes: Codes, counts: np.ndarray, order: int, named: bool, task: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``posted`` for the texts of a task; besides a block and its sorted keys only slices are held."""
    blocks = held_bigrams(batches, codes)
    for number in count():
        block = next(blocks, None)
        if block is None:
            return
        yield from of_block(*block, counts, mixed(np.array([task]), np.array([number])).view(np.uint64)[0], order, named)
        del block  # before the next one is gathered


def of_block(first, second, rows, of_rows, counts, salted, order: int, named: bool) -> Iterator[pa.RecordBatch]:
    a, b = first, second
    if order > 2:
        whole, keys, a, b, rows = higher(first, second, rows, order)
        first, second = first[whole], second[whole]
    else:
        keys = np.concatenate([keys_of(first[p], second[p]) for p in in_parts(len(first))])
    # ordered by key, which leaves less to shuffle, then by row, as the rows are in order
    at = np.argsort(keys, kind="stable")
    keys, rows = keys[at], rows[at]
    lead = np.flatnonzero(np.concatenate([np.ones(1, bool), (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])[: len(keys)])
    n = np.diff(np.append(lead, len(keys))).astype(np.int32)
    keys, rows, at = keys[lead], rows[lead], at[lead]
    for p in in_parts(len(at)):
        one, key, own = at[p], keys[p], rows[p]
        often = np.minimum(*(np.where(codes >= 0, counts[np.maximum(codes, 0)], 0) for codes in (first[one], second[one])))
        parts = np.minimum(often // SALTED, 1 << 20)
        # one salt for a task's rows of an n-gram, the same when the task is repeated
        salt = np.where(parts > 0, 1 + (salted % (parts + 1).astype(np.uint64)).astype(np.int64), 0)
        a_, b_ = a[one], b[one]
        if order == 2:
            packed = key >= 0
            joint = (second[one] << SHIFT | first[one]) << SALT_BITS | salt
            a_, b_, salt = np.where(packed, joint, a_), np.where(packed, 0, b_), np.zeros(len(key), np.int64)
        columns = {"b": b_, "a": a_, "id": of_rows.take(pa.array(own)), "n": n[p], "salt": salt.astype(np.int32)} | ({"key": key} if named else {})
        yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def posted(texts: DataFrame, shared, order: int, named: bool = False) -> DataFrame:
    """(b, a, id, n, salt), dealt out by a, b and salt: an n-gram, and how often a text has it; ``named``: its key, too.

    Bigrams of short codes have a, both codes with a salt below them, and b = 0; others have the words' codes; longer
    n-grams have the keys of prefix and suffix.  A salt tells parts of an n-gram that may be too much for one task.
    Rows come by first word, so the second word's code stands high in a and beside the id: what differs from row to row
    lies together, which leaves a seventh less to shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes, counts = shared.value
        yield from block_rows(batches, Codes(words, codes), counts, order, named, TaskContext.get().partitionId())

    columns = f"b long, a long, id {dict(texts.dtypes)['id']}, n int, salt int{', key long' if named else ''}"
    return texts.mapInArrow(run, columns).repartition(*GRAM)


def counted(grams: DataFrame, salted: bool) -> DataFrame:
    """(a, b, salt, c): the count table, partitioned like ``grams``; with the key where ``grams`` has one."""
    # an n-gram's count is no less than its rows; reading the ids too, both sides of the later join share one exchange
    count = F.greatest(F.sum("n"), F.count("id")).alias("c")
    named = [F.min("key").alias("key")] if "key" in grams.columns else []
    own = grams.groupBy(*GRAM).agg(count, *named)
    if not salted:
        return own
    low = (1 << SALT_BITS) - 1
    packed = (F.col("b") == 0) & (F.col("a").bitwiseAND(low) > 0)
    split = own.filter((F.col("salt") > 0) | packed).withColumn("gram", F.when(packed, F.col("a").bitwiseAND(~low)).otherwise(F.col("a")))
    totals = split.groupBy("gram", "b").agg(F.sum("c").alias("total"), F.collect_list(F.struct("a", "salt")).alias("parts"))
    totals = totals.select("b", "total", F.explode("parts").alias("part")).select("part.a", "b", "part.salt", "total")
    return own.join(totals, GRAM, "left").select(*GRAM, F.coalesce("total", "c").alias("c"), *(["key"] if named else []))


def score(docs: DataFrame, id_col: str, text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """(id, n_tokens, n_seen, score_micro): ``n_seen`` bigrams of a document were found in the count table."""
    spark = docs.sparkSession
    words = stored(word_counts(docs, text_col), "lm-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    top = most_frequent(words, CODED)
    texts = lowered(docs, text_col, F.col(id_col).alias("id"))
    begun = texts.count()
    shared = spark.sparkContext.broadcast(shared_codes([w for w, _ in top], [n for _, n in top], begun))
    salted = max([begun, *(n for _, n in top[:1])]) >= SALTED

    # bounded by the short codes
    of_word = F.broadcast(spark.createDataFrame([(START, begun), *((i + 2, n) for i, (_, n) in enumerate(top))], "word long, of long"))
    # words with short codes, all down to some count, aren't asked for by their hash
    rest = words.filter(F.col("n") < top[-1][1]) if top else words
    rest = rest.select("word", F.col("n").alias("of"))
    grams = posted(texts, shared, 2, order > 2)
    seen = F.col("c") >= min_count
    packed = F.col("b") == 0
    low = (1 << SHIFT) - 1
    first = F.when(packed, F.shiftright("a", SALT_BITS).bitwiseAND(low)).otherwise(F.col("a"))
    second = F.when(packed, F.shiftright("a", SALT_BITS + SHIFT)).otherwise(F.col("b"))
    named = ["key"] if order > 2 else []
    parts = counted(grams, salted).select(*GRAM, *named, "c", seen.cast("int").alias("seen"), F.when(seen, first).otherwise(second).alias("word"))

    def micro_of(c):
        ratio = F.when(c >= min_count, c / F.col("of")).otherwise(F.lit(backoff) * F.col("of") / F.lit(float(total)))
        return F.round(F.log(ratio) * 1e6).cast("long").alias("micro")

    micro = micro_of(F.col("c"))
    coded = parts.join(of_word, "word", "left").withColumn("micro", micro)
    scored = coded.filter("word >= 0").select(*GRAM, *named, "c", "seen", "micro")
    # a partition of the count table is a hash table: the many bigrams of documents need no sort, and are read once;
    # only what needs the count of a word without a short code is dealt out by word
    open_word, open_c = (F.when(F.col("word") < 0, F.col(x)).alias(f"open_{x}") for x in ("word", "c"))
    found = grams.join(coded.select(*GRAM, "seen", "micro", open_word, open_c).hint("shuffle_hash"), GRAM)
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("seen")).alias("seen"), F.sum(F.col("n") * F.col("micro")).alias("micro")]
    found = found.groupBy("id", "open_word", "open_c").agg(*sums)
    # rows that need no word are dealt out by their id, whatever they meet
    rest = rest.select(F.col("word").alias("asked"), "of")
    found = found.join(rest, F.coalesce("open_word", F.xxhash64("id")) == F.col("asked"), "left")
    late = F.col("n") * micro_of(F.col("open_c"))
    found = found.select("id", "n", "seen", F.when(F.col("open_word").isNull(), F.col("micro")).otherwise(late).alias("micro"))
    if order > 2:
        known = scored.unionByName(parts.filter("word < 0").join(rest, F.col("word") == F.col("asked")).select(*GRAM, *named, "c", "seen", micro))
        known = known.filter("seen = 1").select("key", "c", "micro")
        found = found.unionByName(of_higher_orders(texts, shared, known, order, backoff, min_count, salted))
    sums = found.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum("seen").alias("n_seen"), F.sum("micro").alias("score_micro"))
    every = docs.select(F.col(id_col).alias(id_col)).distinct()
    zero = F.lit(0).cast("long")
    return every.join(sums, every[id_col].eqNullSafe(sums["id"]), "left").select(
        id_col, *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("n_tokens", "n_seen", "score_micro")]
    )


def of_higher_orders(texts: DataFrame, shared, known: DataFrame, order: int, backoff: float, min_count: int, salted: bool) -> DataFrame:
    """(id, n, seen, micro) rows that orders above 2 add to the bigrams' sums; ``known`` (key, c, micro) has the seen bigrams."""
    back = round(float(np.log(backoff)) * 1e6)
    zero = F.lit(0).cast("long")
    # backing off counts wherever there's history enough, unless the n-gram is seen
    words = F.size(F.split(F.trim(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", " ")), " "))
    tries = sum((F.greatest(words - (k - 2), F.lit(0)) for k in range(3, order + 1)), F.lit(0))
    out = texts.select("id", zero.alias("n"), zero.alias("seen"), (tries * F.lit(back)).cast("long").alias("micro"))
    for k in range(3, order + 1):
        grams = posted(texts, shared, k, True)
        # n-grams that were split have a row for each part
        known = known.select("key", "c", "micro").dropDuplicates(["key"])
        # a seen n-gram's prefix and suffix are seen, too
        prefix = known.select(F.col("key").alias("a"), F.col("c").alias("of"))
        suffix = known.select(F.col("key").alias("b"), F.col("micro").alias("less"))
        micro = F.round(F.log(F.col("c") / F.col("of")) * 1e6).cast("long")
        scored = counted(grams, salted).filter(F.col("c") >= min_count).join(prefix, "a").join(suffix, "b")
        known = stored(scored.select(*GRAM, "key", "c", micro.alias("micro"), (micro - back - F.col("less")).alias("more")), "lm-grams")
        found = grams.join(known.select(*GRAM, "more").hint("shuffle_hash"), GRAM)
        out = out.unionByName(found.select("id", zero.alias("n"), zero.alias("seen"), (F.col("n") * F.col("more")).alias("micro")))
    return out


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every whole document under the bigram model of all documents and all their words."""
    out = score(table(spark, sf_dir, "documents"), "doc_id")
    mean = F.when(F.col("n_tokens") > 0, F.col("score_micro") / F.col("n_tokens") / 1e6)
    return out.withColumn("mean_log_score", mean)


OP1_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), tokens AS (
  SELECT doc_id, unnest(ws) AS w, unnest(list_prepend('', ws[:len(ws) - 1])) AS v FROM words WHERE len(ws) > 0
), singles AS (
  SELECT w, count(*)::DOUBLE AS n FROM tokens GROUP BY w
  UNION ALL SELECT '', (SELECT count(*) FROM tokens WHERE v = '')
), pairs AS (SELECT v, w, count(*) AS n FROM tokens GROUP BY v, w),
scored AS (
  SELECT pairs.v, pairs.w, (pairs.n >= {MIN_COUNT})::INT AS seen,
    round(ln(CASE WHEN pairs.n >= {MIN_COUNT} THEN pairs.n / a.n ELSE {BACKOFF} * b.n / (SELECT count(*) FROM tokens)::DOUBLE END) * 1e6)::BIGINT AS micro
  FROM pairs JOIN singles a ON a.w = pairs.v JOIN singles b ON b.w = pairs.w
), sums AS (
  SELECT doc_id, count(*) AS n_tokens, sum(seen)::BIGINT AS n_seen, sum(micro)::BIGINT AS score_micro
  FROM tokens JOIN scored USING (v, w) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_seen, 0) AS n_seen, coalesce(score_micro, 0) AS score_micro,
  score_micro / n_tokens / 1e6 AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN sums USING (doc_id)
"""
