"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

Every word gets a vector from its characters (a small recurrent network with attention pooling) and one from a word
table.  A second recurrent network with attention pooling reads windows of ``WINDOW`` words, one every ``STEP`` words:
all overlapping windows at a stride of half a window, so that each passage of up to half a window lies whole in one.
A text's score is its highest window probability.  The networks are plain numpy.

The fit takes at most ``SAMPLE`` texts of label 1 and twice as many of label 0, picked by the hash of their ids, none longer than
``SAMPLE_CHARS``; this bounds what the one task that fits reads, and only the weights reach the driver.  A fit that is
repeated after a lost executor gives the same weights.  At first a toxic text's label goes to the window
with the word that most tells toxic from other texts, later to the window that the network itself scores highest; for
label 0 also to further windows.

Null and empty texts and texts of white space only are one window without words.  Repeated rows get equal scores.
Null labels, and labels without text, don't count; of several labels for an id the highest counts, of several texts the
smallest.  Without texts of both labels nothing can be learnt, and every score is 0.  A column ``toxicity`` is
replaced; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EDGES, table

SAMPLE, SAMPLE_CHARS = 1_000, 20_000
WINDOW, STEP, PIECE = 32, 16, 24
#: Rows of the character table, width of its vectors, hidden width of the character and of the word network.
CHARS, CHAR_WIDTH, CHAR_HIDDEN, WORD_WIDTH, HIDDEN = 512, 8, 8, 8, 8
VOCABULARY, EPOCHS, BATCH, RATE = 20_000, 6, 64, 0.01
THRESHOLD = 0.7
#: Raw words remembered with their vectors in a Python worker, and windows scored at once.
MEMO, AT_ONCE = 250_000, 2_048
F32 = np.float32


def fresh_network(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights of both networks: gates are ordered update, reset, candidate."""
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)
    net = {"chars": (rng.standard_normal((CHARS, CHAR_WIDTH)) * 0.3).astype(F32), "words": np.zeros((VOCABULARY + 1, WORD_WIDTH), F32)}
    net["words"][1:] = rng.standard_normal((VOCABULARY, WORD_WIDTH)) * 0.1
    for name, width, hidden in (("c", CHAR_WIDTH, CHAR_HIDDEN), ("w", 2 * CHAR_HIDDEN + WORD_WIDTH, HIDDEN)):
        for way in "fb":
            net[f"{name}{way}W"], net[f"{name}{way}U"] = normal(width, 3 * hidden), normal(hidden, 3 * hidden)
            net[f"{name}{way}B"] = np.zeros(3 * hidden, F32)
        net[f"{name}A"] = normal(2 * hidden)
    net["out"], net["bias"] = normal(2 * HIDDEN), np.full(1, -1, F32)
    return net


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def forward_gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list | None) -> np.ndarray:
    """States (time, batch, hidden) of projected inputs x; mask (time, batch, 1) is 0 where a sequence has ended."""
    hidden = u.shape[0]
    h = np.zeros((x.shape[1], hidden), F32)
    out = np.empty((x.shape[0], x.shape[1], hidden), F32)
    for t in range(x.shape[0]):
        g = h @ u
        zr = sigmoid(x[t, :, : 2 * hidden] + g[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.tanh(x[t, :, 2 * hidden :] + r * g[:, 2 * hidden :])
        if kept is not None:
            kept.append((h, z, r, n, g[:, 2 * hidden :]))
        h = h + mask[t] * ((1 - z) * (n - h))
        out[t] = h
    return out


def backward_gru(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    dx, du = np.empty((*d_out.shape[:2], u.shape[1]), F32), np.zeros_like(u)
    dh = np.zeros(d_out.shape[1:], F32)
    for t in range(len(d_out) - 1, -1, -1):
        h, z, r, n, gn = kept[t]
        dh = dh + d_out[t]
        d_new = mask[t] * dh
        dh = dh - d_new + d_new * z
        dn = d_new * (1 - z) * (1 - n * n)
        dz, dr = d_new * (h - n) * z * (1 - z), dn * gn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        dg = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dg
        dh = dh + dg @ u.T
    return dx, du


def encoded(net: dict, name: str, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, kept: dict | None) -> np.ndarray:
    """Attention-pooled states of both directions (batch, 2 * hidden)."""
    kf, kb = ([], []) if kept is not None else (None, None)
    both = np.concatenate([forward_gru(xf, mask, net[f"{name}fU"], kf), forward_gru(xb[::-1], mask[::-1], net[f"{name}bU"], kb)[::-1]], 2)
    e = np.where(mask[:, :, 0] > 0, both @ net[f"{name}A"], F32(-30))
    e = np.exp(e - e.max(0))
    share = e / e.sum(0)
    pooled = np.einsum("tb,tbh->bh", share, both)
    if kept is not None:
        kept |= {"f": kf, "b": kb, "both": both, "share": share, "mask": mask}
    return pooled


def unencoded(net: dict, name: str, d: np.ndarray, kept: dict, grads: dict) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs of both directions."""
    both, share, mask = kept["both"], kept["share"], kept["mask"]
    ds = np.einsum("bh,tbh->tb", d, both)
    de = share * (ds - (share * ds).sum(0)) * mask[:, :, 0]
    grads[f"{name}A"] = np.einsum("tb,tbh->h", de, both)
    d_both = share[:, :, None] * d + de[:, :, None] * net[f"{name}A"]
    half = both.shape[2] // 2
    dxf, grads[f"{name}fU"] = backward_gru(d_both[:, :, :half], mask, net[f"{name}fU"], kept["f"])
    dxb, grads[f"{name}bU"] = backward_gru(d_both[::-1, :, half:], mask[::-1], net[f"{name}bU"], kept["b"])
    return dxf, dxb[::-1]


def summed(rows: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows with the same index."""
    out = np.zeros((size, rows.shape[1]), F32)
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    out[index[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes (time, batch) and their mask."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # one row for each word; filled row by row from all words' characters in order
    inside = np.arange(lengths.max()) < lengths[:, None]
    own = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.zeros(inside.shape, np.int64)
    codes[inside] = np.where(own < CHARS // 2, own, CHARS // 2 + own % (CHARS // 2))
    codes, mask = np.ascontiguousarray(codes.T), np.ascontiguousarray(inside.T)[:, :, None].astype(F32)
    return codes, mask


def word_vectors(net: dict, words: list[str], ids: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Character and word inputs of each word, side by side."""
    codes, mask = letters(words)
    xf, xb = (net["chars"] @ net[f"c{w}W"] + net[f"c{w}B"] for w in "fb")
    own = encoded(net, "c", xf[codes], xb[codes], mask, kept)
    if kept is not None:
        kept["codes"] = codes
    return np.concatenate([own, net["words"][ids]], 1)


class Reader:
    """Splits texts into known words and holds the projections of each word for both directions."""

    def __init__(self, net: dict, vocabulary: dict[str, int]):
        self.net, self.vocabulary = net, vocabulary
        self.clear()

    def clear(self) -> None:
        # row 0 stands where a window has no word
        self.of: dict[str, int] = {}
        self.split: dict[int, list[int]] = {}
        self.waiting: list[str] = []
        self.size, self.tables = 1, {w: np.zeros((1, 3 * HIDDEN), F32) for w in "fb"}

    def place(self, raw: str) -> int:
        if len(raw) > PIECE:
            # a long string is read piece by piece
            self.of[raw] = key = -1 - len(self.split)
            self.split[key] = [self.number(raw[i : i + PIECE]) for i in range(0, len(raw), PIECE)]
            return key
        word = raw.strip(EDGES) or raw
        at = self.of.get(word)
        if at is None or at < 0:
            at = self.of[word] = self.size
            self.size += 1
            self.waiting.append(word)
        self.of[raw] = at
        return at

    def number(self, raw: str) -> int:
        at = self.of.get(raw)
        return self.place(raw) if at is None else at

    def numbers(self, text: str) -> np.ndarray:
        get, place = self.of.get, self.place
        out = [place(w) if (at := get(w)) is None else at for w in text.lower().split()]
        own = np.array(out or [0], np.int32)
        if own.min() < 0:
            own = np.array([x for at in out for x in (self.split[at] if at < 0 else (at,))], np.int32)
        return own

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables of both directions after the waiting words have got their rows."""
        if self.size > len(self.tables["f"]):
            self.tables = {w: np.concatenate([t, np.zeros((max(len(self.waiting), 65_536), 3 * HIDDEN), F32)]) for w, t in self.tables.items()}
        base = self.size - len(self.waiting)
        order = sorted(range(len(self.waiting)), key=lambda i: len(self.waiting[i]))
        for i in range(0, len(order), AT_ONCE):
            part = order[i : i + AT_ONCE]
            words = [self.waiting[j] for j in part]
            ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
            vectors = word_vectors(self.net, words, ids)
            for w in "fb":
                self.tables[w][base + np.array(part)] = vectors @ self.net[f"w{w}W"] + self.net[f"w{w}B"]
        self.waiting = []
        return self.tables["f"], self.tables["b"]


def windows(numbers: np.ndarray) -> np.ndarray:
    """All overlapping windows (window, word); 0 behind the text's end."""
    n = max(1, -(-(len(numbers) - WINDOW) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + WINDOW, np.int32)
    padded[: len(numbers)] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def probabilities(net: dict, tables: tuple[np.ndarray, np.ndarray], all_windows: np.ndarray) -> np.ndarray:
    out = np.empty(len(all_windows), F32)
    for i in range(0, len(all_windows), AT_ONCE):
        w = np.ascontiguousarray(all_windows[i : i + AT_ONCE].T)
        pooled = encoded(net, "w", tables[0][w], tables[1][w], (w > 0)[:, :, None].astype(F32), None)
        out[i : i + AT_ONCE] = sigmoid(pooled @ net["out"] + net["bias"])
    return out


def text_scores(net: dict, reader: Reader, texts: list[str]) -> np.ndarray:
    """The highest window probability of each text."""
    out = np.empty(len(texts))
    at = 0
    while at < len(texts):
        if reader.size > MEMO:
            reader.clear()
        held, firsts, n, start = [], [], 0, at
        while at < len(texts) and n < 4 * AT_ONCE and len(reader.waiting) < MEMO:
            own = windows(reader.numbers(texts[at]))
            held.append(own)
            firsts.append(n)
            n += len(own)
            at += 1
        p = probabilities(net, reader.projections(), np.concatenate(held))
        out[start:at] = np.maximum.reduceat(p, firsts)
    return out


def step_gradients(net: dict, words: list[str], ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the cross-entropy of windows ``rows`` (indexes of ``words``, from 1; 0: none)."""
    kept_c: dict = {}
    kept_w: dict = {}
    vectors = word_vectors(net, words, ids, kept_c)
    tables = [np.concatenate([np.zeros((1, 3 * HIDDEN), F32), vectors @ net[f"w{w}W"] + net[f"w{w}B"]]) for w in "fb"]
    t = np.ascontiguousarray(rows.T)
    pooled = encoded(net, "w", tables[0][t], tables[1][t], (t > 0)[:, :, None].astype(F32), kept_w)
    d = (sigmoid(pooled @ net["out"] + net["bias"]) - labels) / len(labels)
    grads = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
    dx = unencoded(net, "w", d[:, None] * net["out"], kept_w, grads)
    dv = np.zeros_like(vectors)
    for w, own in zip("fb", dx, strict=True):
        own = summed(own.reshape(-1, own.shape[2]), t.ravel(), len(words) + 1)[1:]
        grads[f"w{w}W"], grads[f"w{w}B"] = vectors.T @ own, own.sum(0)
        dv += own @ net[f"w{w}W"].T
    grads["words"] = summed(dv[:, 2 * CHAR_HIDDEN :], ids, len(net["words"]))
    grads["words"][0] = 0
    dc = unencoded(net, "c", np.ascontiguousarray(dv[:, : 2 * CHAR_HIDDEN]), kept_c, grads)
    grads["chars"] = np.zeros_like(net["chars"])
    for w, own in zip("fb", dc, strict=True):
        own = summed(own.reshape(-1, own.shape[2]), kept_c["codes"].ravel(), CHARS)
        grads[f"c{w}W"], grads[f"c{w}B"] = net["chars"].T @ own, own.sum(0)
        grads["chars"] += own @ net[f"c{w}W"].T
    return grads


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> tuple[dict, dict[str, int]]:
    """(network, vocabulary) learnt from labelled texts, by Adam; small samples get more epochs."""
    rng = np.random.default_rng(seed)
    net = fresh_network(rng)
    split = [[p for raw in t.lower().split() for p in pieces(raw)] for t in texts]
    in_texts = Counter(w for words in split for w in set(words))
    vocabulary = {w: i + 1 for i, (w, n) in enumerate(sorted(in_texts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n > 2}
    numbers = {w: i + 1 for i, w in enumerate(in_texts)}
    names = [""] + list(numbers)
    rows = [windows(np.array([numbers[w] for w in words] or [0], np.int32)) for words in split]
    toxic = np.array(labels, bool)
    odds = np.zeros(len(names))
    with_bad = Counter(w for words, bad in zip(split, toxic, strict=True) if bad for w in set(words))
    for w, n in with_bad.items():
        if n > 1:
            odds[numbers[w]] = np.log((n + 0.5) / (toxic.sum() + 1) * ((~toxic).sum() + 1) / (in_texts[w] - n + 0.5))
    telling = [odds[own].max(1) + odds[own].sum(1) / 1e3 for own in rows]
    pool = np.concatenate([own[own > 0] for own, bad in zip(rows, toxic, strict=True) if not bad] + [np.zeros(1, np.int32)])
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    steps = 0
    epochs = max(epochs, min(30, 10_000 // max(1, len(texts))))
    for epoch in range(epochs):
        reader = Reader(net, vocabulary)
        scores = training_scores(net, reader, names, rows)
        picked, marks = [], []
        for own, p, told, bad in zip(rows, scores, telling, toxic, strict=True):
            order = np.argsort(-(told if bad and epoch < epochs // 2 else p), kind="stable")
            chosen = list(order[:1] if bad else order[:2])
            if not bad:
                chosen.append(rng.integers(len(own)))
            picked += [own[i] for i in dict.fromkeys(chosen)]
            marks += [bad] * len(dict.fromkeys(chosen))
        order = rng.permutation(len(picked))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            batch = np.array([picked[j] for j in part])
            # other words than telling ones change places with words of label 0, so that no window is learnt by heart
            plain = (batch > 0) & (odds[batch] < 1) & (rng.random(batch.shape) < 0.5)
            batch[plain] = rng.choice(pool, plain.sum())
            used, inverse = np.unique(np.r_[0, batch.ravel()], return_inverse=True)
            words = [names[j] for j in used[1:]] or ["?"]
            ids = np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words))
            ids[rng.random(len(ids)) < 0.3] = 0  # so that characters alone must do, too
            grads = step_gradients(net, words, ids, inverse[1:].reshape(batch.shape), np.array([marks[j] for j in part], F32))
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            steps += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, g in grads.items():
                g = g * F32(min(1.0, 5 / (size + 1e-9)))
                first[k] += F32(0.1) * (g - first[k])
                second[k] += F32(0.01) * (g * g - second[k])
                net[k] -= F32(rate / (1 - 0.9**steps)) * first[k] / (np.sqrt(second[k] / F32(1 - 0.99**steps)) + F32(1e-7))
    # the threshold goes midway between the sample's highest texts of label 0 and its lowest of label 1
    p = np.array([x.max() for x in training_scores(net, Reader(net, vocabulary), names, rows)]).clip(1e-6, 1 - 1e-6)
    logits = np.log(p / (1 - p))
    low, high = np.quantile(logits[~toxic], 0.999), np.quantile(logits[toxic], 0.01)
    if low < high:
        net["bias"] -= F32((low + high) / 2 - np.log(THRESHOLD / (1 - THRESHOLD)))
    return net, vocabulary


def pieces(raw: str) -> list[str]:
    return [raw.strip(EDGES) or raw] if len(raw) <= PIECE else [x for i in range(0, len(raw), PIECE) for x in pieces(raw[i : i + PIECE])]


def training_scores(net: dict, reader: Reader, names: list[str], rows: list[np.ndarray]) -> list[np.ndarray]:
    """Window probabilities of the sample's texts under the present network."""
    reader.waiting, reader.size = names[1:], len(names)
    p = probabilities(net, reader.projections(), np.concatenate(rows))
    return np.split(p, np.cumsum([len(r) for r in rows])[:-1])


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> DataFrame:
    """(id string, text, y) to learn from: those with the smallest id hashes of each label, one text for each id."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter(~held_out("__id")).groupBy("__id").agg(F.max("y").alias("y"))
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit("toxic"), "__id"), "__id").limit((2 - y) * per_label) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    # at most 3 * per_label ids and marks
    picked = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "__id")
    return picked.groupBy("__id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select(F.col("__id").cast("string").alias("id"), "text", "y")


def fitted(chosen: DataFrame) -> tuple[dict, dict[str, int]] | None:
    """What one task learns from the sample, or nothing where a label is missing."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(b["id"], b["text"], b["y"], strict=True))
        if len({y for _, _, y in rows}) == 2:
            net, vocabulary = fit([t for _, t, _ in rows], [y for _, _, y in rows])
            yield pd.DataFrame({"learnt": [pickle.dumps((net, list(vocabulary)))]})

    got = chosen.coalesce(1).mapInPandas(learn, "learnt binary").head()
    if got is None:
        return None
    net, words = pickle.loads(bytes(got[0]))
    return net, {w: i + 1 for i, w in enumerate(words)}


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) of each whole text."""
    found = fitted(sample(docs, labels, id_col, text_col, label_col, per_label))
    if found is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    learnt = docs.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, vocabulary = learnt.value
        reader = Reader(net, vocabulary)
        for b in batches:
            yield pd.Series(text_scores(net, reader, b.tolist()))

    return docs.withColumn("toxicity", scored(F.coalesce(F.col(text_col), F.lit(""))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learnt from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
