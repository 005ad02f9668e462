"""The training-data operators against brute force, round trips and held-out rows, and on odd tables."""

import base64
import hashlib
import html as entities
import io
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarmac.llm import bpe, decontamination, hnsw, html_text, lm_scoring, near_dedup, secrets, sharding, toxicity, warc
from tarmac.llm.components import components
from tarmac.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, hash string, t int, kept string, n int"


def docs_of(spark, texts):
    """Documents with columns whose names operators use inside."""
    rows = [(i, t, "en", f"s{i % 4}", None if t is None else len(t), 5, "h", 1, "k", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "one", "x" * 200_000, "same text here " * 3, "same text here " * 3]


# --- language model -------------------------------------------------------------------------------------------------


def test_lm_scores_odd_rows(spark):
    got = {r["doc_id"]: r for r in lm_scoring.score(docs_of(spark, ODD), "doc_id").collect()}
    assert len(got) == 7 and got[0]["n_tokens"] == got[1]["n_tokens"] == got[2]["n_tokens"] == 0
    assert got[5]["score_micro"] == got[6]["score_micro"] and got[5]["n_seen"] == 9
    assert lm_scoring.score(docs_of(spark, []), "doc_id").count() == 0


def test_lm_scores_all_words(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [*ODD, *(" ".join(f"w{i}" for i in rng.zipf(1.3, 80)) for _ in range(60))]
    docs = docs_of(spark, texts)
    frame = docs.select("doc_id", "text").toPandas()  # noqa: F841
    want = {r[0]: r[1:4] for r in duckdb.sql(lm_scoring.OP1_SQL.replace("FROM documents", "FROM frame")).fetchall()}
    for coded, salted in ((lm_scoring.CODED, lm_scoring.SALTED), (50, 3), (0, 3)):
        monkeypatch.setattr(lm_scoring, "CODED", coded)
        monkeypatch.setattr(lm_scoring, "SALTED", salted)
        got = {r["doc_id"]: (r["n_tokens"], r["n_seen"], r["score_micro"]) for r in lm_scoring.score(docs, "doc_id").collect()}
        assert got == want


def test_lm_higher_orders(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [*ODD, *(" ".join(f"w{i}" for i in rng.zipf(1.5, 60)) for _ in range(40))]
    words = [(t or "").split() for t in texts]
    grams = Counter(tuple((["^", *w])[i : i + k]) for w in words if w for k in (1, 2, 3, 4) for i in range(len(w) + 2 - k))
    total = sum(map(len, words))

    def plain(history, w):
        if not history:
            return round(float(np.log(0.4 * grams[(w,)] / total)) * 1e6)
        if grams[(*history, w)] >= 2:
            return round(float(np.log(grams[(*history, w)] / grams[tuple(history)])) * 1e6)
        return plain(history[1:], w) + (round(float(np.log(0.4)) * 1e6) if len(history) > 1 else 0)

    monkeypatch.setattr(lm_scoring, "CODED", 5)
    monkeypatch.setattr(lm_scoring, "SALTED", 20)
    for order in (3, 4):
        got = {r["doc_id"]: r["score_micro"] for r in lm_scoring.score(docs_of(spark, texts), "doc_id", order=order).collect()}
        want = {i: sum(plain((["^", *own])[max(0, j + 2 - order) : j + 1], w) for j, w in enumerate(own)) for i, own in enumerate(words)}
        assert got == want


def test_bigram_tasks_hold_a_block_once():
    """Numpy's memory above the texts while a block of bigrams is made, in bytes a word; the codes of words take 20 bytes each."""
    rng, held = np.random.default_rng(0), 100_000
    texts = [b" ".join(b"w%d" % x for x in rng.integers(0, 3000, 200)) for _ in range(held // 200 * 3)]
    words = [lm_scoring.hashed(b"w%d" % x) for x in range(2000)]
    shared = lm_scoring.shared_codes(words, [9] * 2000, 5)
    assert sum(x.nbytes for x in shared) <= 20 * (len(words) + 1)
    codes = lm_scoring.Codes(*shared[:2])
    assert [codes[b"w7"], codes[b"w1999"], codes[b"w2500"]] == [9, 2001, lm_scoring.hashed(b"w2500")]
    codes.update({w: codes[w] for w in (b"w%d" % x for x in range(3000))})
    batch = pa.RecordBatch.from_pydict({"id": range(len(texts)), "text": texts})
    tracemalloc.start()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm_scoring, "HELD", held)
        m.setattr(lm_scoring, "BATCH", 10_000)
        n = sum(b.num_rows for b in lm_scoring.block_rows(iter([batch]), codes, shared[2], 2, False, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0.9 * 3 * held and peak < 80 * held


def test_bigram_rows_differ_side_by_side():
    """At the production block size: numpy's memory, and bytes a row that LZ4 leaves in Spark's row layout."""
    rng = np.random.default_rng(0)
    common = [b"w%d" % x for x in range(50_000)]
    # the n-th word stands as often as 1 / n
    texts = [b" ".join(common[int(x) - 1] for x in np.exp(rng.random(300) * np.log(len(common)))) for _ in range(5000)]
    shared = lm_scoring.shared_codes([lm_scoring.hashed(w) for w in common], [9] * len(common), 5)
    batch = pa.RecordBatch.from_pydict({"id": range(len(texts)), "text": texts})
    codes = lm_scoring.Codes(*shared[:2])
    codes.update({w: codes[w] for w in common})
    tracemalloc.start()
    rows = list(lm_scoring.block_rows(iter([batch]), codes, shared[2], 2, False, 0))
    peak = tracemalloc.get_traced_memory()[1] - sum(c.nbytes for b in rows for c in b.columns)
    tracemalloc.stop()
    names = rows[0].schema.names
    columns = [np.asarray(c).astype("<i8") for c in pa.Table.from_batches(rows).columns]
    part = lm_scoring.mixed(columns[names.index("b")], columns[names.index("a")]).view(np.uint64) % np.uint64(50) == 0
    laid = np.stack([np.zeros(int(part.sum()), "<i8"), *[c[part] for c in columns]], axis=1).tobytes()
    packed = sum(len(pa.Codec("lz4_raw").compress(laid[i : i + 32768])) for i in range(0, len(laid), 32768))
    # 10.5 bytes and 71 MB with blocks of two million words and the first word's code high in a
    assert packed < 9.8 * part.sum() and peak < 48e6



# --- toxicity -------------------------------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.fresh_network(rng).items()}
    toxicity_f32, toxicity.F32 = toxicity.F32, np.float64
    try:
        words, ids = ["bad", "good", "so"], np.array([1, 2, 0])
        rows, labels = np.array([[1, 2, 3, 0], [2, 3, 0, 0]]), np.array([1.0, 0.0])

        def loss():
            v = toxicity.word_vectors(net, words, ids)
            tables = [np.concatenate([np.zeros((1, 3 * toxicity.HIDDEN)), v @ net[f"w{w}W"] + net[f"w{w}B"]]) for w in "fb"]
            t = rows.T
            p = toxicity.sigmoid(toxicity.encoded(net, "w", tables[0][t], tables[1][t], (t > 0)[:, :, None].astype(float), None) @ net["out"] + net["bias"])
            return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

        grads = toxicity.step_gradients(net, words, ids, rows, labels)
        for name in ("out", "wfU", "wbW", "wA", "cfU", "cbW", "cA", "words", "chars"):
            at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
            net[name][at] += 1e-5
            up = loss()
            net[name][at] -= 2e-5
            down = loss()
            net[name][at] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(grads[name][at], rel=1e-3), name
    finally:
        toxicity.F32 = toxicity_f32


def test_windows_cover_everything():
    for n in (1, 31, 32, 33, 100, 1000):
        w = toxicity.windows(np.arange(1, n + 1, dtype=np.int32))
        assert set(w.ravel()) - {0} == set(range(1, n + 1))


def test_toxicity_learns_held_out(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(500):
        own = list(rng.choice(words, 60))
        if i % 4 == 0:
            for at in rng.integers(0, 60, 3):
                own[at] = "zonk" + "".join(rng.choice(list("abc"), 2))
        texts.append(" ".join(own))
        labels.append((i, int(i % 4 == 0)))
    docs = docs_of(spark, texts + ODD)
    known = spark.createDataFrame(labels + [(3, None), (9999, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, known).collect()}
    out = [(y, got[i]) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    hits = sum((s >= 0.7) == bool(y) for y, s in out) / len(out)
    assert hits >= 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == 507
    assert got[500] == got[501] == got[502]
    assert {r["toxicity"] for r in toxicity.score(docs, known.filter("toxic = 0")).collect()} == {0.0}
    odd = docs.withColumn("y", F.lit("a")).withColumn("toxicity", F.lit("b")).withColumn("toxic", F.lit(1))
    rows = toxicity.score(odd.unionByName(odd.filter("doc_id < 9")), known).collect()
    assert len(rows) == 516 and {r["doc_id"]: r["toxicity"] for r in rows} == got and {r["y"] for r in rows} == {"a"}


# --- secrets --------------------------------------------------------------------------------------------------------

BASE = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain_spans(text):
    order = list(BASE)
    found = [(m.start(), order.index(k), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{order[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_spans(spark):
    got = QUERIES["op3_secrets"](spark, SF)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert "Python" not in got._jdf.queryExecution().toString()


def test_secrets_odd_rows_and_masking(spark):
    live = "password = 'q8Zr1LmX0pTv9KdW'"
    texts = [*ODD, f"ä😀 {live} end", "api_key: abc", f"{live} x", "AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2]
    docs = docs_of(spark, texts)
    spans = {r["doc_id"]: r["s"] for r in secrets.candidates(docs).select("doc_id", secrets.listed(F.col("spans")).alias("s")).collect()}
    assert spans == {i: plain_spans(t) for i, t in enumerate(texts)}
    verdicts = secrets.scan(docs, "doc_id")
    assert {(r["doc_id"], r["verdict"], r["owners"]) for r in verdicts.filter("kind = 'assign'").collect()} == {(7, "live", 2), (9, "live", 2)}
    masked = {r["doc_id"]: r["text"] for r in secrets.redacted(docs, verdicts, "doc_id").collect()}
    assert masked[7] == "ä😀 [SECRET]' end" and masked[3] == "one" and masked[0] is None
    everywhere = docs_of(spark, [live] * 4)
    assert {r["verdict"] for r in secrets.scan(everywhere, "doc_id").collect()} == {"copied"}
    assert secrets.scan(docs_of(spark, []), "doc_id").count() == 0


def test_secrets_short_and_copied_texts(spark):
    import corpus_pipeline

    hexa = "3f9a1c7e5b2d8f604a9c1e7b3d5f8a2c6e0b4d71"
    values = ["hunter2", "sunshine", "aB3$", "Tr0ub4dor", "q8Zr1LmX0pTv9Kd"]
    shown = ["changeme", "your_token_here", "xxxxxxxx", "undefined", "00000000"]
    texts = [f"password = {v} end" for v in [*values, *shown]] + [f"key {hexa}  end", f"key {hexa} end", f"Key {hexa} end "]
    texts += [f"token: Zk93mdPq81 text {i}" for i in range(3)]
    docs = docs_of(spark, texts)
    masked = [r["text"] for r in corpus_pipeline.secrets_stage(spark, docs, SF).orderBy("doc_id").collect()]
    assert masked[:5] == ["[SECRET] end", "[SECRET] end", texts[2], "[SECRET] end", "[SECRET] end"]
    assert masked[5:10] == texts[5:10]
    # copies of one text make no example, different texts of three sources do
    assert all(hexa not in t for t in masked[10:13]) and masked[13:] == texts[13:]
    got = {(r["kind"], r["repositories"], r["owners"]) for r in secrets.scan(docs, "doc_id", by_text=True).filter("owners > 1 or kind = 'hex'").collect()}
    assert got == {("hex", 3, 1), ("assign", 3, 3)}


def test_secrets_suspects_and_repeated_ids(spark):
    value = "q8Zr1LmX0pTv9KdWs3Ye7"
    rows = [(1, f"see {value} there", "a", 5), (1, "a harmless text that is long enough to be cut by positions", "a", 5)]
    rows += [(1, "password = hunter22", "b", 5), (1, "password = hunter22", "b", 5), (None, "token: Zk93mdPq81", "c", 5)]
    rows += [(2, "in two x8Zr1LmX0pTv9KdWs3Ye7 owners", "a", 5), (3, "in two x8Zr1LmX0pTv9KdWs3Ye7 again", "b", 5), (4, "Aa1" * 9, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, spans int")
    verdicts = secrets.scan(docs, "doc_id")
    assert {(r["value"], r["verdict"]) for r in verdicts.filter("kind = 'random'").collect()} == {(value, "live"), ("x8Zr1LmX0pTv9KdWs3Ye7", "copied")}
    masked = Counter((r["doc_id"], r["text"]) for r in secrets.redacted(docs, verdicts, "doc_id").collect())
    want = [(1, "see [SECRET] there"), rows[1][:2], (1, "[SECRET]"), (1, "[SECRET]"), (None, "[SECRET]"), *(r[:2] for r in rows[5:])]
    assert masked == Counter(want)


# --- decontamination ------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    item = lambda n: " ".join(rng.choice(words, n))
    items = [item(30), item(60), item(12)]
    changed = items[0].split()
    for at in (3, 9, 15):
        changed[at] = "new"
    noise = lambda: item(200)
    texts = [*ODD, noise(), f"{noise()} {items[0]} {noise()}", f"{noise()} {' '.join(changed)} {noise()}", items[2], f"{noise()} {items[1]}", noise()]
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (9, "too short")], "item_id long, text string")
    docs = docs_of(spark, texts)
    for block, at_once in ((4096, 131_072), (2, 3)):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench, block=block, numbered_at_once=at_once).collect()}
        assert got == {(8, 0), (9, 0), (10, 2), (11, 1)}
    assert decontamination.contaminated(docs_of(spark, []), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.without_leaks(docs, bench).count() == len(texts) - 4


def test_decontamination_of_many_passages(spark):
    rng = np.random.default_rng(12)
    share = 1 / np.arange(1, 4001)
    usual = lambda n: [f"w{i}" for i in rng.choice(4000, n, p=share / share.sum())]
    items = [usual(n) for n in rng.integers(15, 49, 600)]
    exact = [" ".join([*usual(60), *item, *usual(60)]) for item in items]
    altered = []
    for item in items[:60]:
        # words that no other text has, for 15 of 100 words
        own = list(item)
        for at in rng.choice(len(own), int(0.15 * len(own)), replace=False):
            own[at] = f"new{at}"
        altered.append(" ".join([*usual(60), *own, *usual(60)]))
    texts = [*exact, *altered, "say quite a short thing", "quite short", "yes", "yes sir"]
    short = [(1000, "Quite a short, thing"), (1001, "yes"), (1002, "a quite")]
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), *short], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    missed = [i for i in range(600) if (i, i) not in got]
    print("missed", len(missed), "of 600 exact copies; altered copies found:", len({(600 + i, i) for i in range(60)} & got), "of 60")
    assert not missed
    assert {x for x in got if x[1] >= 1000} == {(660, 1000), (662, 1001)}


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
def test_decontamination_of_altered_items(spark, share):
    """Items with changed words in surroundings of their own; all are found, and nothing else."""
    rng = np.random.default_rng(7)
    common, rare = [f"w{i}" for i in range(200)], [f"r{i}" for i in range(4000)]
    draw = lambda n: [str(rng.choice(common if rng.random() < 0.5 else rare)) for _ in range(n)]
    items = [draw(40) for _ in range(150)]
    rows = []
    for item in items[:60]:
        own = list(item)
        for k in rng.choice(40, int(share * 40), replace=False):
            own[k] = draw(1)[0]
        rows.append(" ".join(draw(60) + own + draw(60)))
    rows += [" ".join(draw(160)) for _ in range(100)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs_of(spark, rows), bench).collect()}
    assert got == {(i, i) for i in range(60)}


def test_no_leak_is_below_the_least_product():
    rng = np.random.default_rng(13)
    for _ in range(300):
        idf = rng.exponential(2, rng.integers(6, 49))
        least = decontamination.least_product(idf)
        for order in (rng.permutation(len(idf)), np.argsort(idf)):
            n = 1 + int(np.argmax(np.cumsum(idf[order]) >= decontamination.CARRIED * decontamination.LOOSE * idf.sum()))
            assert (idf[order[:n]] ** 2).sum() >= least * 0.999999


def test_common_subsequence():
    def slow(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(1, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))
        assert decontamination.common_subsequence(decontamination.bit_masks(a), len(a), b.tolist()) == slow(a, b)


def test_svd(spark):
    a = np.random.default_rng(4).random((30, 12))
    rows = spark.createDataFrame([(list(range(12)), r.tolist()) for r in a], "terms array<int>, weights array<double>")
    values, components = decontamination.randomised_svd(rows, 12, 12)
    assert np.allclose(values, np.linalg.svd(a)[1], atol=1e-6)
    assert np.allclose(a @ components @ components.T, a, atol=1e-6)


# --- nearest neighbours ---------------------------------------------------------------------------------------------


def test_hnsw(spark):
    rng = np.random.default_rng(5)
    v = rng.random((1200, 16))
    v[500:520] = v[0]
    rows = [(i, x.tolist(), "q", 1) for i, x in enumerate(v)]
    rows += [(2000, None, "q", 1), (2100, [0.0] * 16, "q", 1), (2200, [float("nan")] * 16, "q", 1), (2300, [None] * 16, "q", 1), (2400, [1.0] * 3, "q", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string, key int")
    out = hnsw.search(hnsw.build(df, "vec_id", "embedding", shard_rows=400), df.filter("vec_id % 100 = 0"), "vec_id", "embedding")
    got: dict = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1200, 100))
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((v - v[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1200), far)) if i != q][:10]
        hits += len(set(order) & {i for _, i, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(s == pytest.approx(far[i]) for _, i, s in found)
    assert hits >= 0.9 * 120 and [i for _, i, _ in got[0]] == list(range(500, 510))
    assert hnsw.search(hnsw.build(df.limit(0), "vec_id", "embedding"), df, "vec_id", "embedding").count() == 0


def test_shard_size():
    assert hnsw.shard_size(50_000, 64, 200) == hnsw.SHARD_ROWS
    assert hnsw.shard_size(10**7, 64, 200) == 12_500
    assert hnsw.shard_size(10**10, 64, 200) == hnsw.SHARD_BYTES // (8 * 64 + 12 * hnsw.LINKS)


# --- WARC -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "ü" * 300_000), (6, "u", "\x1f\x8b\x08" * 50)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, path string").repartition(2)
    manifest = warc.write(df, str(tmp_path / "w"))
    for size in (64, 1000, 1 << 25):
        got = {r["record_id"]: r for r in warc.read(manifest, size).collect()}
        assert len(got) == 6
        for i, _, html in pages:
            r, payload = got[f"<urn:page:{i}>"], (html or "").encode()
            assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            last = max(j for j, _, h in pages if (h or "") == (html or ""))
            assert (r["record_type"], r["refers_to"]) == (("response", None) if i == last else ("revisit", f"<urn:page:{last}>"))
            assert r["payload"] is None if i != last else bytes(r["payload"]) == payload
    assert warc.read(warc.write(df.limit(0), str(tmp_path / "e"))).count() == 0


def test_warc_members_of_any_length_are_read_once(monkeypatch):
    """Stored blocks hold the gzip magic many times; the bytes read stay in proportion to the file."""
    draw = random.Random(3)
    noise = [draw.randbytes(n) for n in (0, 10, 3_000, 700_000, 5_000_000, 40)]
    payloads = [warc.MAGIC.join(x[i : i + 50_000] for i in range(0, max(1, len(x)), 50_000)) + warc.MAGIC for x in noise]
    made = [warc.member(warc.record("response", i, "u", x, warc.base32_sha1(x), None)) for i, x in enumerate(payloads)]
    data = b"".join(made)
    starts = [sum(map(len, made[:i])) for i in range(len(made))]

    class Counted(io.BytesIO):
        taken = 0

        def read(self, *n):
            got = super().read(*n)
            self.taken += len(got)
            return got

    for read_bytes, size in ((1 << 20, 32 << 20), (100_000, 1_000_000), (1_000, 1_000_000)):
        monkeypatch.setattr(warc, "READ_BYTES", read_bytes)
        files = [(Counted(data), i) for i in range(0, len(data), size)]
        got = [m for file, i in files for m in warc.members(file, len(data), i, min(len(data), i + size))]
        assert [at for at, _ in got] == starts
        assert [warc.parsed(m)["payload"] for _, m in got] == payloads
        # a member is read once more by the task that owns it, a false magic by a read at most
        if size > len(data):
            assert files[0][0].taken < 4 * len(data)
    monkeypatch.setattr(warc, "READ_BYTES", 5)
    cut = data[: starts[4] + 1_000]
    assert [at for at, _ in warc.members(io.BytesIO(cut), len(cut), 0, len(cut))] == starts[:4]


# --- BPE ------------------------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark):
    enc, raw, _ = bpe.codec(bpe.vocabulary_path())
    rng = np.random.default_rng(6)
    mixed = "".join(rng.choice(list("ab  \n'sdé漢😀12,."), 9000))
    texts = [*ODD, mixed, "a" * 5000, " " * 3000 + "b", "don't " * 900]
    for chunk, overlap, dealt in ((1000, 200, 4_000), (64, 16, 200), (4_096, 512, 1 << 30)):
        got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs_of(spark, texts), "doc_id", chunk_chars=chunk, overlap=overlap, dealt_chars=dealt).collect()}
        assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    pairs = bpe.encode(docs_of(spark, texts), "doc_id")
    assert {r["doc_id"]: bytes(r["raw"]).decode() for r in bpe.decode(pairs, "doc_id").collect()} == {i: t or "" for i, t in enumerate(texts)}
    for rows in (bpe.encode_digests(docs_of(spark, texts), "doc_id"), bpe.with_digests(docs_of(spark, texts))):
        for r in rows.collect():
            t = texts[r["doc_id"]] or ""
            ids = enc.encode_ordinary(t)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_digests(docs_of(spark, []), "doc_id").count() == 0


def test_bpe_stitches_like_whole_texts():
    enc, _, pattern = bpe.codec(bpe.vocabulary_path())
    rng = np.random.default_rng(16)
    for k in range(400):
        signs = list(("ab \n'sdé漢😀12,.", "a ", "ab'llre ", " \n\t x")[k % 4])
        text = "".join(rng.choice(signs, rng.integers(0, 300)))
        if k % 5 == 0:
            text += "z" * int(rng.integers(0, 200)) + " " * int(rng.integers(0, 90)) + text
        chunk, overlap = int(rng.integers(8, 60)), int(rng.integers(5, 20))
        got = [x for pieces in bpe.stitched(text, pattern, chunk, overlap) for x in pieces]
        assert got == pattern.findall(text), (text, chunk, overlap)
    text = "some words of a long text, don't stop " * 30_000
    assert bpe.Encoder(bpe.vocabulary_path()).ids(text) == enc.encode_ordinary(text)


def test_bpe_replaces_columns_of_its_names(spark):
    docs = docs_of(spark, ["one", None]).withColumn("n_tokens", F.lit("x")).withColumn("text2", F.col("text"))
    rows = bpe.with_digests(docs).collect()
    assert [r["n_tokens"] for r in rows] == [1, 0] and "text2" in rows[0].asDict()


# --- HTML -----------------------------------------------------------------------------------------------------------


def test_html():
    body = "<p>First paragraph of the &amp; story, long enough to count as text.</p><p>Second   one\nwith <a href=x>a link</a> inside it, also long.</p>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><article><h1>Head</h1>{body}<div class='ad'>Buy</div></article><footer>c</footer><script>x</script></body></html>"
    want = "Head First paragraph of the & story, long enough to count as text. Second one with a link inside it, also long."
    assert html_text.main_text(page) == want
    assert html_text.main_text("") == "" and html_text.main_text("<script>a</script>") == ""
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert html_text.main_text(deep) == "text"


STORY = "<h1>Head line</h1><p>First long paragraph of the story, with enough words to count.</p><p>Short.</p><p>By Ann, with a <a href=x>link</a> inside and more words after it.</p>"
TOLD = "Head line First long paragraph of the story, with enough words to count. Short. By Ann, with a link inside and more words after it."
MENU = "<div><a href=/>Home</a> <a href=/a>About us</a> <a href=/c>Contact</a></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='post has-sidebar'>{STORY}</div><div class=sidebar><p>Other things to read</p></div>",
        f"<div class='entry share-enabled'>{STORY}</div><div class='share-bar'>Share this</div>",
        f"<form><input name=q>{MENU}<div>{STORY}</div></form>",
        f"<div class='layout-sidebar-right'><div>{STORY}</div><div class=sidebar-right>Popular now, and some more words</div></div>",
        f"{MENU}<div>{STORY}</div><div>Copyright Foo</div>",
        f"<main>{STORY}<ul><li><a>Other story one</a></li><li><a>Other story two</a></li><li><a>Other story three</a></li></ul></main>",
        f"<header><h1>Site</h1></header>{MENU}<article><header>{STORY[:18]}</header>{STORY[18:]}<div class=ad>Buy now</div></article><div id=comments><p>{'So true, I say. ' * 40}</p></div>",
        f"<div id=page>{MENU}<div id=content>{STORY}<div class=comment-list><p>Nice</p></div></div><footer>{'Legal words. ' * 60}</footer></div>",
        f"<body>{MENU}<section>{STORY}</section><div class=cookie-notice>We use cookies</div></body>",
    ],
)
def test_html_density_decides(page):
    assert html_text.main_text(page) == TOLD


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"{MENU}<article>{STORY}<ul><li><a>Source one</a></li><li><a>Source two</a></li></ul></article>", f"{TOLD} Source one Source two"),
        (f"{MENU}<article>{STORY}<nav><a>Next</a> <a>Last</a></nav><ul class=related><li><a>Other</a></li><li><a>More</a></li></ul></article>", TOLD),
        (f"<article>{STORY}<p>Enter <label>the word</label> here.</p></article>", f"{TOLD} Enter the word here."),
        (f"<article>{STORY}</article><form><p><label for=q>Search</label><input id=q></p></form>", TOLD),
        (f"{MENU}<div><article>{STORY}</article><article>{STORY}</article></div><footer>legal</footer>", f"{TOLD} {TOLD}"),
        (f"<div><article>{STORY}</article><div><p>Read on, there is so much more to see on other pages here.</p></div></div>", TOLD),
    ],
)
def test_html_keeps_what_articles_say(page, want):
    assert html_text.main_text(page) == want


def test_html_long_page():
    words = "many words of a long page "
    assert html_text.main_text(f"<div>{f'<p>{words * 40}</p>' * 500}</div>" + MENU) == " ".join([(words * 40).strip()] * 500)


def test_html_given_pages():
    rows = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    for (page,) in rows:
        story = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = re.split(r"</?(?:h1|p|ul|li|div|blockquote)[^>]*>", story)
        clean = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b))).strip() for b in blocks)
        got = html_text.main_text(page)
        assert re.sub(r"\s+", "", got) == re.sub(r"\s+", "", " ".join(b for b in clean if b))


def test_html_frame(spark):
    odd = spark.createDataFrame([(1, "old", "<p>a</p>", 3)], "page_id long, text string, html string, __x int")
    assert html_text.extract(odd).collect()[0].asDict() == {"page_id": 1, "__x": 3, "text": "a"}
    rows = [(1, "u", "<p>a</p>", "x"), (2, None, None, "y"), (2, None, None, "y")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, extra string")).collect()
    assert sorted((r["page_id"], r["text"], r["extra"]) for r in got) == [(1, "a", "x"), (2, "", "y"), (2, "", "y")]


# --- near duplicates ------------------------------------------------------------------------------------------------


def sets_of(texts):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(texts, percent=85):
    sets = sets_of(texts)
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_dup_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = [*ODD, "ONE", "two words"]
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(20, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 25)):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, max(1, len(own) // 25) + 1)):
                own[at] = f"v{rng.integers(0, 99)}"
            texts.append(" ".join(own))
    want, sizes = brute_components(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs_of(spark, texts), "doc_id").collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert near_dedup.near_duplicates(docs_of(spark, []), "doc_id").count() == 0


def test_near_dup_crowded_regions_in_blocks(spark, monkeypatch):
    """One crowd of texts alike but mostly not linked, dealt to many blocks; links inside it must not be lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in range(150)]
    texts = []
    for i in range(160):
        own = list(base)
        for at in rng.choice(150, rng.integers(2, 6), replace=False):
            own[at] = f"v{i}x{at}"
        texts.append(" ".join(own))
    want, _ = brute_components(texts)
    assert 3 < len(set(want)) < 157
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs_of(spark, texts), "doc_id").collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_near_dup_short_texts_of_one_template(spark, monkeypatch):
    """Texts of a template that differ in their last words: what reaches the blocks grows in proportion to them."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    moved, stored = [], near_dedup.stored

    def noted(df, name):
        out = stored(df, name)
        if name == "regions":
            moved.append(out.agg(F.sum("moved")).head()[0] or 0)
        return out

    monkeypatch.setattr(near_dedup, "stored", noted)
    sums = []
    for n in (1_000, 4_000):
        own = [f"alpha beta gamma delta epsilon zeta eta theta iota x{i} y{i}" for i in range(n)]
        longer = " ".join(f"z{j}" for j in range(40))
        texts = own + [f"{longer} tail{i}" for i in range(n // 10)]
        moved.clear()
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, texts), "doc_id").collect()}
        assert [got[i] for i in range(n)] == list(range(n))
        assert {got[i] for i in range(n, len(texts))} == {n}
        sums.append((moved[0], moved[-1]))
    assert sums[1][0] > 8 * sums[0][0] > 0  # whole regions: with the square
    assert sums[1][1] <= 5 * max(sums[0][1], 1)


def test_near_dup_repeated_and_null_ids(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(500)]
    a, b, c = (" ".join(rng.choice(words, 60)) for _ in range(3))
    near = lambda t: t + " more"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (1, a), (None, near(c)), (None, c), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, "doc_id").collect() if r["n_shingles"])
    assert got == [(0, None, True), (0, None, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.representatives(docs, "doc_id").collect())
    assert kept == {(1, a): 1, (1, b): 1, (None, near(c)): 1, (None, c): 1, (9, None): 2, (None, ""): 1}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- sharding -------------------------------------------------------------------------------------------------------


def test_ring(spark):
    docs = docs_of(spark, [f"t{i}" for i in range(1000)] + ODD)
    got = sharding.shard_ring(docs, "doc_id").collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 1007 and len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    same = spark.createDataFrame([(None, 1)] * 50 + [(7, 1)] * 50, "doc_id long, shard_ int")
    assert max(Counter(r["shard"] for r in sharding.shard_ring(same, "doc_id", 4).collect()).values()) == 25
    assert sharding.shard_ring(docs.limit(0), "doc_id").count() == 0


def test_columns_named_like_inner_ones_come_back_unchanged(spark):
    inner = ["__h", "__id", "__th", "__repeated", "__cut", "__cell", "__rank", "__part", "__shard", "__sha", "__d", "x__h"]
    texts = ["", None, "token = abcdefgh12 and more words", "one two three four five six", "one two three four five six"]
    rows = [(i, t, *(f"{c}{i}" for c in inner)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in inner)])).withColumn("source", F.lit("s"))
    verdicts = secrets.scan(df, "doc_id", by_text=True)
    outs = {
        "near": near_dedup.representatives(df, "doc_id"),
        "secrets": secrets.redacted(df, verdicts, "doc_id"),
        "bpe": bpe.with_digests(df),
        "ring": sharding.shard_ring(df, "doc_id", 4, most=1),
    }
    for name, out in outs.items():
        assert out.columns[: len(df.columns)] == df.columns, name
        got = {r["doc_id"]: tuple(r[c] for c in inner) for r in out.collect()}
        assert got == {r[0]: r[2:] for r in rows if name != "near" or r[0] != 4}, name


def test_ring_splits_hot_keys_and_replaces_columns(spark):
    rows = [(None, i, "q") for i in range(300)] + [(i, i, "q") for i in range(300)]
    df = spark.createDataFrame(rows, "shard long, slot long, __n string")
    got = sharding.shard_ring(df, "shard", 4, most=40)
    assert got.columns == ["__n", "shard", "slot"]
    by_shard: dict = {}
    for r in got.collect():
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert {s: sorted(x) for s, x in by_shard.items()} == {s: list(range(150)) for s in range(4)}


def test_ring_moves_little(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard_ring(docs, "doc_id", n).collect()} for n in (16, 17))
    assert sum(a[i] != b[i] for i in a) < 0.3 * len(a)


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(2000)]
    text = lambda n=80: " ".join(rng.choice(words, n))
    item = text(30)
    clean = [text() for _ in range(150)]
    texts = [None, "", *clean, clean[0], f"{text()} {item} {text()}", f"{text()} password = 'q8Zr1LmX0pTv9KdW' {text()}"]
    texts += [f"{text(30)} zonk {text(20)} zonk {text(20)}" for _ in range(60)]
    rows = [(i, t, "en", f"s{i}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("zonk" in (t or "")), 1) for i, t in enumerate(texts)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    gone = {i for i, t in enumerate(texts) if "zonk" in (t or "")} | {152, 153}
    # the trained network may miss a few of its held-out texts; everything else is exact
    assert set(got) >= set(range(len(texts))) - gone and len(set(got) & gone) <= 6 and not {152, 153} & set(got)
    assert "[SECRET]" in got[154]["text"] and got[154]["n_chars"] == len(got[154]["text"])
    assert all(got[i]["text"] == t for i, t in enumerate(texts) if i in got and i != 154)
    enc = bpe.codec(bpe.vocabulary_path())[0]
    assert all(r["n_tokens"] == len(enc.encode_ordinary(r["text"] or "")) for r in got.values())
