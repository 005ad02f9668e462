"""Secret scan with corpus-wide ownership frequency, by DataFrame functions only.

Candidates come from three kinds of pattern, and from suspects: other runs of 20 characters or more that mix digits
with letters of both cases and carry ``ENTROPY`` bits a character.  Every candidate's hash is counted over the corpus:
the distinct repositories and the distinct owners that hold it.  A value that several owners hold is a widely copied
example (documentation, test fixtures), for which copies of one text may count for one owner only; every other value
that isn't a proven placeholder is taken for a live credential, short passwords included.  A suspect adds a span of the
kind ``random`` only where a single owner holds its value; suspects that overlap a span of the three kinds add none.

Positions come from the pieces between matches: a match starts after all pieces and matches before it.  They count
code points.  Null texts count as empty and have no candidates.  Rows with the same id are told apart by the hash of
their text; rows alike in both have the same spans.  Rows without id are scanned and masked like others.  Columns that
aren't named in the call aren't looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import brought_back, set_aside, stored, table, text_or_empty

#: Kind, pattern, group holding the value, least characters of the value.  For hex and access the least
#: length is part of the pattern: runs are maximal, so this finds the same spans as dropping short runs afterwards.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Suspects: least entropy in bits a character.
ENTROPY = 3.5
RANDOM = ("random", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
NAMES = [k[0] for k in (*KINDS, RANDOM)]
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans_of(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind: array of (start, kind number, end, value), leftmost, non-overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["piece"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["value"].alias("value"))
        spans = F.coalesce(state["spans"], F.expr(f"cast(array() as {SPAN})"))
        return F.struct(end.alias("at"), F.concat(spans, F.array(span)).alias("spans"))

    zipped = F.transform(
        F.sequence(F.lit(1), F.size(found)),
        lambda i: F.struct(F.element_at(pieces, i).alias("piece"), F.element_at(found, i).alias("found"), F.element_at(values, i).alias("value")),
    )
    spans = F.aggregate(zipped, start, add)["spans"]
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: F.length(s["value"]) >= least)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def entropy(value: Column) -> Column:
    """Bits a character of a text that isn't empty."""
    signs = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(signs)
    share = lambda c: F.size(F.filter(signs, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(signs), F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))


def looks_random(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return mixed & (entropy(value) >= ENTROPY)


def none_if_null(spans: Column) -> Column:
    return F.coalesce(spans, F.expr(f"cast(array() as {SPAN})"))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``, all kinds' spans by start, then kind as listed (overlapping kinds are all kept), and
    ``suspects``, spans that ownership may add."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [none_if_null(spans_of(text, i, p, g, least)) for i, (_, p, g, least) in enumerate(KINDS)]
    runs = none_if_null(spans_of(text, len(KINDS), *RANDOM[1:]))
    apart = lambda s: ~F.exists("spans", lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))
    suspects = F.filter(runs, lambda s: looks_random(s["value"]) & apart(s))
    return docs.withColumn("spans", F.array_sort(F.concat(*kinds))).withColumn("suspects", suspects)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in NAMES])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


#: Values that stand for a secret, in lower case: telling words, literals and types of code, one character repeated.
PLACEHOLDER = (
    r"example|placeholder|change_?me|redacted|x{6,}|(?:^|[^a-z0-9])(?:your|dummy)"
    r"|^(?:none|null|nil|true|false|undefined|string|required|optional|process\.env\..*|os\.environ.*|getenv)$"
    r"|^(.)\1+$|^[^a-z0-9]*$"
)


def is_placeholder(value: Column) -> Column:
    return F.lower(value).rlike(PLACEHOLDER)


def same_text(text: Column) -> Column:
    """A hash that copies of a text share, white space and case aside."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def ownership(found: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """(hash, repositories, owners) of every candidate value; pre-aggregated by owner, so a hot value stays small.

    With a column ``__same``, all rows of one text count for its smallest owner.
    """
    same = "__same" in found.columns
    values = found.select(
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.explode(F.array_distinct(F.transform(F.concat("spans", "suspects"), lambda s: F.xxhash64(s["value"])))).alias("hash"),
        *([F.col("__same").alias("same")] if same else []),
    )
    if same:
        of_text = values.groupBy("hash", "same", "repo").agg(F.min("owner").alias("owner"))
        repositories = of_text.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
        first = of_text.groupBy("hash", "same").agg(F.min("owner").alias("owner"))
        owners = first.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("owners"))
        return repositories.join(owners, "hash")
    by_owner = values.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, id_col: str, text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", copied_owners: int = 3, by_text: bool = False) -> DataFrame:
    """A row for each candidate: id, th (hash of its text), kind, start, end, value, repositories, owners, verdict.

    Verdict: ``copied`` if ``copied_owners`` owners or more hold the value (for suspects: more than one), else ``weak``
    if it is a placeholder, else ``live``.  With ``by_text``, the copies of one text count for one owner.
    """
    repo_col = repo_col or id_col
    kept = list(dict.fromkeys([id_col, repo_col, owner_col]))
    rows = docs.select(*kept, F.col(text_col).alias("__text"))
    found = candidates(rows, "__text").filter((F.size("spans") > 0) | (F.size("suspects") > 0))
    same = [same_text(F.col("__text")).alias("__same")] if by_text else []
    found = stored(found.select(*kept, text_hash("__text").alias("th"), "spans", "suspects", *same), "secrets")
    return judged(found, id_col, repo_col, owner_col, copied_owners)


def judged(found: DataFrame, id_col: str, repo_col: str, owner_col: str, copied_owners: int) -> DataFrame:
    rows = found.select(id_col, "th", F.explode(F.concat("spans", "suspects")).alias("s")).select(id_col, "th", "s.*", F.xxhash64("s.value").alias("hash"))
    # a value held by most documents is one hot key of this join, which adaptive execution splits
    out = rows.join(ownership(found, repo_col, owner_col), "hash")
    most = F.when(F.col("kind") == len(KINDS), 2).otherwise(copied_owners)
    verdict = F.when(F.col("owners") >= most, "copied").when(is_placeholder(F.col("value")), "weak").otherwise("live")
    names = F.array(*[F.lit(k) for k in NAMES])
    return out.select(id_col, "th", F.get(names, F.col("kind")).alias("kind"), "start", "end", "value", "repositories", "owners", verdict.alias("verdict"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span counts and digests of every document, with its numbers of live and widely copied candidates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    some = (F.size("spans") > 0) | (F.size("suspects") > 0)
    same = F.when(some, same_text(F.col("text"))).alias("__same")
    every = stored(candidates(docs).select("doc_id", "source", text_hash("text").alias("th"), "spans", "suspects", same), "secret-spans")
    rows = judged(every.filter(some), "doc_id", "doc_id", "source", 3)
    # rows alike in id and text have the same spans: the set holds each once
    verdicts = rows.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set(F.struct("start", "kind", "end", "verdict")).alias("found"))
    count = lambda verdict: F.coalesce(F.size(F.filter("found", lambda s: s["verdict"] == verdict)), F.lit(0)).cast("long")
    n = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    added = F.filter("found", lambda s: (s["kind"] == RANDOM[0]) & (s["verdict"] == "live"))
    added = F.transform(added, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end"), F.lit("").alias("value")))
    here = (F.col("th") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return every.join(verdicts, here, "left").select(
        "doc_id",
        *[n(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col("spans")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("spans", none_if_null(added)))).alias("spans"),
        count("live").alias("n_live"),
        count("copied").alias("n_copied"),
    )


def redacted(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live candidate's span replaced by ``mark``; overlapping spans are one.

    ``verdicts`` of the same documents and texts; a row's text is cut by its own spans only.
    """
    live = verdicts.filter(F.col("verdict") == "live").groupBy(F.col(id_col).alias("__id"), F.col("th").alias("__th"))
    live = live.agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__cut"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        new = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        apart = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, new).otherwise(state["out"]).alias("out"))

    done = F.aggregate("__cut", zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    docs, names = set_aside(docs, id_col, text_col)
    rows = docs.withColumn("__h", text_hash(text_col))
    out = rows.join(live, (F.col("__h") == F.col("__th")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    out = out.withColumn(text_col, F.when(F.col("__cut").isNotNull(), done).otherwise(F.col(text_col))).select(*docs.columns)
    return brought_back(out, names)
