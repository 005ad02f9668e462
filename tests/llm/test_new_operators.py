"""Repeats, prefix tries and rearranged texts against brute force and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tarmac.llm import fill_in_middle, prefix_trie, suffix_repeats
from tarmac.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, row long, core long, at int, id string, n long, key long, form string, raw string"


def docs_of(spark, texts, ids=None):
    """Documents with columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, 5, "psm", "r") for i, t in zip(ids, texts, strict=True)], DOCS)


# --- repeats --------------------------------------------------------------------------------------------------------


def kept_by_hand(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + least] for b in raw for s in range(len(b) - least + 1))
    out = []
    for b in raw:
        cover = [False] * len(b)
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                cover[s : s + least] = [True] * least
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), len(b) - len(kept), sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover)), kept))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß🙂") for _ in range(rng.randint(2, 7))) for _ in range(n))


def shared_texts(rng):
    passage, line = prose(rng, 60), prose(rng, 12)
    texts = [None, "", "short", "a" * 3000, "ab" * 500, passage, passage + passage]
    texts += [f"{prose(rng, rng.randint(0, 40))} {passage} {prose(rng, rng.randint(0, 40))}" for _ in range(40)]
    texts += [f"{prose(rng, 30)}\n{line}\n{prose(rng, 30)}" for _ in range(40)]
    base = prose(rng, 200).split()
    for _ in range(20):
        own = list(base)
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    return texts + [" ".join(base)] * 3


@pytest.mark.parametrize("most", [2048, 3])
def test_repeats_equal_brute_force(spark, most, monkeypatch):
    """With few pieces allowed in a task, cores are split again and again."""
    monkeypatch.setattr(suffix_repeats, "BLOCK", 3000)
    texts = shared_texts(random.Random(5))
    rows = suffix_repeats.without_repeats(docs_of(spark, texts), "doc_id", least=80, core=24, most=most).collect()
    want = kept_by_hand(texts, 80)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]


def test_repeats_of_passages_below_and_above_400_bytes(spark):
    """A passage of over 50 words is removed from 400 bytes on, whatever its words."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    texts = []
    for length in (5, 6, 7, 8, 9):
        passage = " ".join(word(length) for _ in range(55))
        texts += [f"{' '.join(word(6) for _ in range(40))} {passage} {' '.join(word(6) for _ in range(40))}" for _ in range(2)]
    rows = {r["doc_id"]: r for r in suffix_repeats.without_repeats(docs_of(spark, texts), "doc_id").collect()}
    want = kept_by_hand(texts, 400)
    assert [(rows[i]["n_removed"], rows[i]["n_spans"]) for i in range(len(texts))] == [w[1:3] for w in want]
    assert [rows[i]["n_removed"] > 0 for i in range(len(texts))] == [False] * 4 + [True] * 6


def test_repeats_of_repeated_rows_and_null_ids(spark):
    text = prose(random.Random(1), 100)
    docs = docs_of(spark, [text, text, "other", None], [None, None, None, 3])
    rows = suffix_repeats.without_repeats(docs, "doc_id", least=80, core=24).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0), (5, 0), (len(text.encode()),) * 2, (len(text.encode()),) * 2]
    assert suffix_repeats.without_repeats(docs.limit(0), "doc_id").count() == 0


def test_intervals_have_all_occurrences():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        prefixes = [suffix_repeats.common(text[a:].encode(), text[b:].encode()) for a, b in zip(order, order[1:])]
        found, of = suffix_repeats.intervals(prefixes, [ord(text[i - 1]) if i else -1 for i in order], 2)
        got = defaultdict(set)
        for i, k in zip(order, of, strict=True):
            while k >= 0:
                length, one, around = found[k]
                assert text[order[one] :][:length] == text[i : i + length]
                got[text[i : i + length]].add(i)
                k = around
        want = {}
        for s in {text[i:j] for i in range(len(text)) for j in range(i + 2, len(text) + 1)}:
            at = {i for i in range(len(text)) if text.startswith(s, i)}
            before, after = {text[i - 1] if i else f"start{i}" for i in at}, {text[i + len(s)] if i + len(s) < len(text) else f"end{i}" for i in at}
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                want[s] = at
        assert got == want


def test_occurrences_are_equal_texts(spark):
    texts = shared_texts(random.Random(9))
    rows = suffix_repeats.maximal_repeats(docs_of(spark, texts), "doc_id", least=80, core=24, most=4).collect()
    by_name = defaultdict(set)
    for r in rows:
        by_name[r["repeat"]].add((texts[r["doc_id"]] or "").encode()[r["start"] : r["start"] + r["length"]])
    assert by_name and all(len(x) == 1 for x in by_name.values())


# --- prefix trie ----------------------------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        kids = [x for x in below if len(x) == len(k) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(c, rng.choice([None, *range(4)]), rng.choice(["user", "bot", None, ""]), rng.choice(["hi", "ho", "", None, "é🙂"])) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(100 + i, j, "user", "same") for i in range(30) for j in range(i % 12)] + [(300, j, "u", "x") for j in range(40)] + [(305, j, "u", "x") for j in range(60)]
    rows += [(None, 1, "user", "lost"), (250, 0, "a", "alone"), (250, 0, "a", "alone"), (7, 1, "user", "x" * 100_000)]
    spark.createDataFrame([(*r, 9, "d") for r in rows], "conv_id long, turn long, role string, text string, place long, digest string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op12_prefix_trie(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_by_hand(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(ORACLE_SQL["op12_prefix_trie"]).fetchall(), key=str) == trie_by_hand(rows)


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op12_prefix_trie"](spark, str(tmp_path)).count() == 0


# --- fill in the middle ---------------------------------------------------------------------------------------------


def by_hand(id_, text):
    digest = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    text = text or ""
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (id_, len(text), "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return (id_, len(text), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("chunk", "dealt"), [(1 << 14, 1 << 18), (7, 1 << 18), (64, 50)])
def test_fill_in_middle(spark, chunk, dealt):
    rng = random.Random(4)
    texts = [None, "", "a", "<P>", "x <S> y", "<", "<S", "é🙂" * 3000, "z" * 100_000] + [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    docs = docs_of(spark, [*texts, texts[-1]], [*range(len(texts) - 1), None, None])
    got = [tuple(r) for r in fill_in_middle.transform(docs, "doc_id", chunk_chars=chunk, dealt_chars=dealt).collect()]
    want = [by_hand(i, t) for i, t in zip([*range(len(texts) - 1), None, None], [*texts, texts[-1]], strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    restored = {r["doc_id"]: r["restored_sha256"] for r in fill_in_middle.digests(docs, "doc_id", chunk_chars=chunk, dealt_chars=dealt).collect()}
    assert all(restored[i] == sha(t) for i, t in enumerate(texts[:-1]))
    assert fill_in_middle.transform(docs.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("dealt", [1 << 18, 40])
def test_fill_in_middle_by_words(spark, dealt):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 5, 30, 200)]
    for r in fill_in_middle.transform(docs_of(spark, texts), "doc_id", unit=fill_in_middle.every_word, chunk_chars=8, dealt_chars=dealt).collect():
        text = texts[r["doc_id"]]
        assert r["n"] == len(text.split())
        if r["form"] != "plain":
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            assert fill_in_middle.restored(r["output"], r["form"]) == text
            assert all(at in (0, len(text)) or (text[at - 1] == " " and text[at] != " ") for at in (a, b))


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    rel, df = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, d)
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(rel.fetchall(), key=str) == sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=str)


def test_op11_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()
    want = {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(docs, kept_by_hand([t for _, t in docs], 400), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_suffix_repeats"](spark, d).collect()} == want
