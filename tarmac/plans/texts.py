"""Queries on text search, with SQL that stems words by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_index as I
from ..sources import files
from . import roles as R
from .queries import query

C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M1, M2, EXACT, VOWEL, CVC = f"^({C})?{V}{C}", f"^({C})?{V}{C}{V}{C}", f"^({C})?{V}{C}({V})?$", f"^({C})?[aeiouy]", f"^{C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx") + ")$"


def rules(w: str, endings: dict[str, str]) -> str:
    """One CASE of Porter's steps 2 and 3: the longest ending decides, even where its condition fails."""
    cases = [f"WHEN length({w}) > {len(e)} AND ends_with({w}, '{e}') THEN CASE WHEN regexp_matches(left({w}, length({w}) - {len(e)}), '{M1}') THEN left({w}, length({w}) - {len(e)}) || '{r}' ELSE {w} END" for e, r in sorted(endings.items(), key=lambda x: -len(x[0]))]
    return f"CASE WHEN length(word) < 3 THEN {w} {' '.join(cases)} ELSE {w} END"


def step_4(w: str) -> str:
    cases = [
        f"WHEN length({w}) > {len(e)} AND ends_with({w}, '{e}') THEN CASE WHEN regexp_matches(left({w}, length({w}) - {len(e)}), '{M2}')" + (f" AND regexp_matches({w}, '[st]ion$')" if e == "ion" else "") + f" THEN left({w}, length({w}) - {len(e)}) ELSE {w} END"
        for e in sorted(I.STEP_4, key=lambda e: -len(e))
    ]
    return f"CASE WHEN length(word) < 3 THEN {w} {' '.join(cases)} ELSE {w} END"


def stems_sql(words: str) -> str:
    """(word, term) for a relation with a column ``word``, by Porter's steps one after another."""
    return f"""(SELECT word, CASE WHEN length(word) > 2 AND regexp_matches(g, 'll$') AND regexp_matches(g, '{M2}') THEN left(g, length(g) - 1) ELSE g END AS term FROM
 (SELECT word, CASE WHEN length(word) > 2 AND regexp_matches(f, '^.+e$') AND (regexp_matches(left(f, length(f) - 1), '{M2}') OR (regexp_matches(left(f, length(f) - 1), '{EXACT}') AND NOT regexp_matches(left(f, length(f) - 1), '{CVC}'))) THEN left(f, length(f) - 1) ELSE f END AS g FROM
 (SELECT word, {step_4("e")} AS f FROM (SELECT word, {rules("d", I.STEP_3)} AS e FROM (SELECT word, {rules("c", I.STEP_2)} AS d FROM
 (SELECT word, CASE WHEN length(word) > 2 AND regexp_matches(b, '^.+y$') AND regexp_matches(left(b, length(b) - 1), '{VOWEL}') THEN left(b, length(b) - 1) || 'i' ELSE b END AS c FROM
 (SELECT word, CASE WHEN NOT cut THEN a WHEN regexp_matches(a, '(at|bl|iz)$') THEN a || 'e' WHEN regexp_matches(a, '{DOUBLE}') THEN left(a, length(a) - 1)
   WHEN regexp_matches(a, '{EXACT}') AND regexp_matches(a, '{CVC}') THEN a || 'e' ELSE a END AS b FROM
 (SELECT word, cut, CASE WHEN length(word) < 3 THEN p WHEN cut THEN regexp_replace(p, '(ed|ing)$', '') WHEN regexp_matches(p, '^.+eed$') AND regexp_matches(left(p, length(p) - 3), '{M1}') THEN left(p, length(p) - 1) ELSE p END AS a FROM
 (SELECT word, p, length(word) > 2 AND regexp_matches(p, '^.+(ed|ing)$') AND NOT regexp_matches(p, '^.+eed$') AND regexp_matches(regexp_replace(p, '(ed|ing)$', ''), '{VOWEL}') AS cut FROM
 (SELECT word, CASE WHEN length(word) < 3 THEN word WHEN regexp_matches(word, '^.+sses$') OR regexp_matches(word, '^.+ies$') THEN left(word, length(word) - 2) WHEN regexp_matches(word, '[^s]s$') THEN left(word, length(word) - 1) ELSE word END AS p FROM {words}))))))))))"""


STOPPED = ", ".join(f"'{w}'" for w in I.STOP)


def words_sql(table: str, key: str, text: str) -> str:
    return f"(SELECT {key} AS key, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM {table})"


def found_sql(table: str, key: str, text: str, asked: str) -> str:
    return f"""WITH w AS (SELECT key, word, count(*) AS n FROM {words_sql(table, key, text)} WHERE word <> '' AND word NOT IN ({STOPPED}) GROUP BY ALL),
 p AS (SELECT term, key, sum(n) AS n FROM w JOIN {stems_sql("(SELECT DISTINCT word FROM w)")} USING (word) GROUP BY ALL),
 q AS (SELECT DISTINCT term FROM {stems_sql(f"(SELECT * FROM {words_sql('(SELECT 1 AS one)', 'one', f"'{asked}'")} WHERE word <> '' AND word NOT IN ({STOPPED}))")}),
 d AS (SELECT term, ln(1 + (SELECT count(*) FROM {table}) / count(*)) AS weight FROM p JOIN q USING (term) GROUP BY term)"""


@query(found_sql("part", "p_partkey", "p_name", "the Widgets of a red ring") + " SELECT DISTINCT key AS p_partkey FROM p JOIN q USING (term)")
def full_text(spark, d):
    return I.full_text(R.table(spark, d, "part"), "p_partkey", "the Widgets of a red ring", "p_name").select("p_partkey")


ASKED = "Connected things, running and relational waters of the tions!"


@query(found_sql("documents", "doc_id", "text", ASKED) + " SELECT key AS doc_id, count(*) AS terms, round(sum(n * weight), 4) AS score FROM p JOIN d USING (term) GROUP BY key")
def text_index(spark, d):
    """An index of all documents, written and searched."""
    path = files.scratch(spark, "text-index")
    I.write_index(R.table(spark, d, "documents"), "doc_id", ["text"], path)
    return I.search(spark, path, ASKED).select(F.col("key").alias("doc_id"), "terms", F.round("score", 4).alias("score"))


@query(f"WITH w AS (SELECT DISTINCT word FROM {words_sql('documents', 'doc_id', 'text')} WHERE word <> '' AND word NOT IN ({STOPPED})) SELECT word, term FROM {stems_sql('w')}")
def stems(spark, d):
    """All different words of the documents and their stems."""
    words = R.table(spark, d, "documents").select(F.explode(I.words_of("text")).alias("word")).distinct()
    return words.withColumn("term", I.stem(F.col("word")))
