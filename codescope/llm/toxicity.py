"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as its hashed word embedding beside the mean of its hashed
character gram embeddings, over all its bytes; a long run of letters
enters as overlapping pieces, each a word. Gated recurrent units read a window of ``STEPS``
words in both directions, attention pools their states, and a logistic unit
scores the window. Windows overlap by a third and cover the whole text; a document's
score is its highest window, calibrated on training documents.

Labels are per document, so training picks windows itself: first the windows
holding the words most typical of toxic documents, then, in later rounds, those
the network ranks highest (in clean documents too: the hardest negatives).
Training uses at most ``PER_CLASS`` labelled documents of each class, chosen by a
hash of the id. Their whole texts are read: a text of more than ``MOST`` windows is
ranked inside a task, and its ``BEST`` windows most typical of toxic documents and
seeded others, ``MOST`` in all, are what the driver trains on.

Defined results: null, empty and wordless texts score 0; without any positive
training document all scores are 0; ties keep the first window; repeated label
rows count once, toxic if any says so; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import (WordRows, byte_hash, byte_matrix, gram_buckets, kept, keyed_texts, map_batches,
                                  materialise, table, words_of)

STEPS = 24
STRIDE = 16
WORD_BUCKETS, CHAR_BUCKETS, DIM = 1 << 14, 1 << 12, 12
HIDDEN = 8
PER_CLASS = 1500
#: Windows of a training document, and how many of them are its most typical ones; buckets of words that rank them.
MOST, BEST = 192, 96
RANK_BUCKETS = 1 << 16
ROUNDS, EPOCHS, BATCH, RATE = 3, 3, 128, 0.01
#: Share of toxic training documents without evidence (likely mislabelled) left out, and of words hidden in training.
TRIM, HIDE = 0.1, 0.25
CACHE = 200_000
THRESHOLD = 0.3
WIDTH = 24


def word_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word bucket, and buckets of the 3- and 4-byte grams (-1: none) of each word with edge marks."""
    m = byte_matrix([w.lower() for w in words], WIDTH)
    return ((byte_hash(m, WIDTH) % np.uint32(WORD_BUCKETS)).astype(np.int64),
            np.concatenate([gram_buckets(m, k, CHAR_BUCKETS).astype(np.int16) for k in (3, 4)], 1))


def spellings(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_ids` of many words, some at a time; rows of grams are as wide as the longest word needs."""
    parts = [word_ids(words[k:k + 50_000]) for k in range(0, len(words), 50_000)] or [word_ids([])]
    wide = max(c.shape[1] for _, c in parts)
    return (np.concatenate([w for w, _ in parts]),
            np.concatenate([np.pad(c, ((0, 0), (0, wide - c.shape[1])), constant_values=-1) for _, c in parts]))


def sigmoid(x):
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def init(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"word": (rng.standard_normal((WORD_BUCKETS + 1, DIM)) * 0.1).astype(np.float32),
         "char": (rng.standard_normal((CHAR_BUCKETS, DIM)) * 0.1).astype(np.float32),
         "v": f(2 * HIDDEN), "w": f(2 * HIDDEN), "b": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"W{d}": f(2 * DIM, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN),
              f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def inputs(p, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Word beside mean character embedding."""
    there = (c >= 0)[:, :, None]
    n = np.maximum(there.sum(1), 1)
    return np.concatenate([p["word"][w], (p["char"][np.maximum(c, 0)] * there).sum(1) / n], 1).astype(np.float32)


def gru(gx: np.ndarray, u: np.ndarray, keep: bool = False):
    """States of one direction. ``gx``: (steps, windows, 3 * HIDDEN), the inputs' part of the gates."""
    steps, n, _ = gx.shape
    h, hs, saved, k = np.zeros((n, HIDDEN), np.float32), [], [], 2 * HIDDEN
    for t in range(steps):
        gh = h @ u
        zr = sigmoid(gx[t, :, :k] + gh[:, :k])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        m = np.tanh(gx[t, :, k:] + r * gh[:, k:])
        if keep:
            saved.append((h, z, r, m, gh[:, k:]))
        h = m + z * (h - m)
        hs.append(h)
    return np.stack(hs), saved


def gru_back(dhs: np.ndarray, saved, u: np.ndarray):
    """Gradients of the inputs' part of the gates and of ``u``."""
    du, dgx, dh = np.zeros_like(u), [None] * len(saved), 0
    for t in reversed(range(len(saved))):
        h, z, r, m, um = saved[t]
        d = dhs[t] + dh
        dm = d * (1 - z) * (1 - m * m)
        dz = d * (h - m) * z * (1 - z)
        dr = dm * um * r * (1 - r)
        dgx[t] = np.concatenate([dz, dr, dm], 1)
        dgh = np.concatenate([dz, dr, dm * r], 1)
        du += h.T @ dgh
        dh = d * z + dgh @ u.T
    return np.stack(dgx), du


def pooled(p, hs: np.ndarray, mask: np.ndarray):
    """Attention over the steps: ``(logits, weights, pooled states)``."""
    e = np.where(mask, hs @ p["v"], -1e9)
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    c = (a[:, :, None] * hs).sum(0)
    return c @ p["w"] + p["b"][0], a, c


def states(p, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """States of both directions for windows ``at`` (steps, n) of rows of ``table`` (gates of both directions)."""
    steps, n = at.shape
    out = np.empty((steps, n, 2 * HIDDEN), np.float32)
    k, j = 2 * HIDDEN, 3 * HIDDEN
    for d, order, half in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), 1)):
        h = np.zeros((n, HIDDEN), np.float32)
        gates = np.ascontiguousarray(table[:, half * j:(half + 1) * j])
        for t in order:
            gx, gh = gates[at[t]], h @ p["U" + d]
            zr = sigmoid(gx[:, :k] + gh[:, :k])
            m = np.tanh(gx[:, k:] + zr[:, HIDDEN:] * gh[:, k:])
            h = m + zr[:, :HIDDEN] * (h - m)
            out[t, :, half * HIDDEN:(half + 1) * HIDDEN] = h
    return out


def step(p, w, c, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients for windows ``at`` (steps, n) of distinct words (-1: padding)."""
    mask, idx = at >= 0, np.maximum(at, 0)
    x = inputs(p, w, c)
    xs = x[idx] * mask[:, :, None]
    gf, gb = xs @ p["Wf"] + p["cf"], xs @ p["Wb"] + p["cb"]
    hf, sf = gru(gf, p["Uf"], True)
    hb, sb = gru(gb[::-1], p["Ub"], True)
    hs = np.concatenate([hf, hb[::-1]], 2)
    logit, a, ctx = pooled(p, hs, mask)
    prob = sigmoid(logit)
    loss = -(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean()
    dl = ((prob - y) * weight / len(y)).astype(np.float32)
    g = {"w": ctx.T @ dl, "b": np.array([dl.sum()], np.float32)}
    dc = dl[:, None] * p["w"]
    da = (hs * dc).sum(2)
    de = a * (da - (a * da).sum(0))
    g["v"] = (hs * de[:, :, None]).sum((0, 1))
    dhs = a[:, :, None] * dc + de[:, :, None] * p["v"]
    dgf, g["Uf"] = gru_back(dhs[:, :, :HIDDEN], sf, p["Uf"])
    dgb, g["Ub"] = gru_back(dhs[::-1, :, HIDDEN:], sb, p["Ub"])
    dgb = dgb[::-1]
    flat = xs.reshape(-1, 2 * DIM)
    g["Wf"], g["Wb"] = flat.T @ dgf.reshape(-1, 3 * HIDDEN), flat.T @ dgb.reshape(-1, 3 * HIDDEN)
    g["cf"], g["cb"] = dgf.sum((0, 1)), dgb.sum((0, 1))
    dx = np.zeros_like(x)
    np.add.at(dx, idx[mask], (dgf @ p["Wf"].T + dgb @ p["Wb"].T)[mask])
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], w, dx[:, :DIM])
    there = c >= 0
    share = dx[:, DIM:] / np.maximum(there.sum(1, keepdims=True), 1)
    np.add.at(g["char"], c[there], np.broadcast_to(share[:, None], (*c.shape, DIM))[there])
    return float(loss), g


def windows(n: int) -> np.ndarray:
    """Word numbers of all overlapping windows of a text of ``n`` words, (windows, STEPS), -1 beyond its end."""
    starts = np.arange(0, max(1, n - STEPS + STRIDE), STRIDE)
    at = starts[:, None] + np.arange(STEPS)
    return np.where(at < n, at, -1)


class Network:
    """Trained parameters with a calibration of a document's highest window logit."""

    def __init__(self, p: dict | None, scale: float = 1.0, shift: float = 0.0):
        self.p, self.scale, self.shift = p, scale, shift
        self.words = WordRows(6 * HIDDEN, self._rows, CACHE)

    def _rows(self, words: list[str]) -> np.ndarray:
        x = inputs(self.p, *word_ids(words))
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], 1)

    def window_logits(self, texts: list[str]) -> list[np.ndarray]:
        """Logits of all windows of each text; whole texts, about ``GROUP`` windows at a time."""
        out = [[] for _ in texts]
        todo, words, size = [], [], 0
        pad = np.concatenate([self.p["cf"], self.p["cb"]])[None]

        def flush():
            nonlocal todo, words, size
            if todo:
                used, local = np.unique(self.words.index(words), return_inverse=True)
                at = np.concatenate([x[1] for x in todo])
                at = np.where(at >= 0, local[np.maximum(at, 0)], len(used)).T
                gates = np.concatenate([self.words.rows[used], pad])
                logits = pooled(self.p, states(self.p, gates, at), at < len(used))[0]
                for (i, _), part in zip(todo, np.split(logits, np.cumsum([len(x[1]) for x in todo])[:-1])):
                    out[i].append(part)
            todo, words, size = [], [], 0

        for i, text in enumerate(texts):
            found = words_of(text)
            # long texts in slices that overlap by a window, so that no window is lost
            for k in range(0, len(found), SLICE_WORDS):
                part = found[k:k + SLICE_WORDS + STEPS]
                at = windows(len(part))
                todo.append((i, np.where(at >= 0, at + len(words), -1)))
                words += part
                size += len(at)
                if size >= GROUP:
                    flush()
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.float32) for x in out]

    def scores(self, texts: list[str]) -> list[float]:
        if self.p is None:
            return [0.0] * len(texts)
        return [float(sigmoid(self.scale * float(x.max()) + self.shift)) if len(x) else 0.0
                for x in self.window_logits(texts)]


GROUP = 2048
SLICE_WORDS = 256 * STRIDE


def typical_words(toxic: np.ndarray, clean: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """How much more often words are in toxic documents, from the numbers of documents that hold them."""
    return (toxic / n1 - clean / n0) / np.sqrt(toxic / n1 + clean / n0 + 2 / n1)


def rank_bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % RANK_BUCKETS


def excerpt(text: str, typical: np.ndarray) -> list[str]:
    """The whole text as one run of words, or, beyond ``MOST`` windows, windows of it: the most typical and seeded others."""
    words = words_of(text)
    at = windows(len(words))
    if len(at) <= MOST:
        return [" ".join(words)] if words else []
    value = np.append(np.array([typical[rank_bucket(x)] for x in words], np.float32), np.float32(-np.inf))
    best = np.argsort(-value[at].max(1), kind="stable")
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    chosen = np.sort(np.r_[best[:BEST], rng.choice(best[BEST:], MOST - BEST, replace=False)])
    return [" ".join(words[k] for k in at[i] if k >= 0) for i in chosen]


def train(texts: list, labels: list[int], prior: float, seed: int = 11) -> Network:
    """Fit the network on whole-document labels; ``prior`` is the share of toxic documents among all labelled.

    A document is a text of at most ``MOST`` windows, or a list of runs of words as :func:`excerpt` gives.
    """
    labels = np.array(labels)
    if not len(labels) or not labels.any() or labels.all():
        return Network(None)
    rng = np.random.default_rng(seed)
    docs = [[t] if isinstance(t, str) else t for t in texts]
    vocab: dict[str, int] = {}
    ids, at = [], []
    for runs in docs:  # words become numbers text by text: word lists of all texts would crowd the driver
        found = [np.array([vocab.setdefault(x.lower(), len(vocab)) for x in words_of(t)], np.int32) for t in runs]
        ids.append(np.concatenate([*found, np.zeros(0, np.int32)]))
        at.append(np.concatenate([np.zeros((0, STEPS), np.int32)] + [
            np.where((k := windows(len(d))) >= 0, d[np.maximum(k, 0)], -1).astype(np.int32) for d in found if len(d)]))
    spelled = list(vocab)
    w, c = spellings(spelled)
    # first ranking of windows: how much more often their most typical word is in toxic documents
    toxic, clean = Counter(), Counter()
    for d, y in zip(ids, labels):
        (toxic if y else clean).update(set(d.tolist()))
    n1, n0 = labels.sum(), (1 - labels).sum()
    typical = np.zeros(len(vocab) + 1)
    del vocab, spelled
    seen = np.array(list(toxic), np.int64)
    typical[seen] = typical_words(np.array(list(toxic.values())), np.array([clean[x] for x in toxic]), n1, n0)
    rank = [typical[a].max(1) if len(a) else np.zeros(0) for a in at]
    p = init(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    t = 0
    for _ in range(ROUNDS):
        pick, y = [], []
        floor = np.quantile([r.max() for r, label in zip(rank, labels) if label and len(r)] or [0.0], TRIM)
        for a, r, label in zip(at, rank, labels):
            if not len(a):
                continue
            if label and r.max() < floor:
                continue
            order = np.argsort(-r, kind="stable")
            rows = order[:1] if label else np.unique(np.r_[order[:2], rng.integers(0, len(a), 2)])
            pick.append(a[rows])
            y += [int(label)] * len(rows)
        pick, y = np.concatenate(pick), np.array(y, np.float32)
        weight = np.where(y > 0, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, (1 - y).sum())).astype(np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(pick))
            for k in range(0, len(order), BATCH):
                rows = order[k:k + BATCH]
                used, back = np.unique(np.r_[0, pick[rows].ravel()], return_inverse=True)
                used = used[used >= 0]
                local = (back[1:].reshape(len(rows), STEPS) - int((pick[rows] < 0).any()))
                shown = np.where(rng.random(len(used)) < HIDE, WORD_BUCKETS, w[used])  # hidden: spelling only
                _, g = step(p, shown, c[used], local.T, y[rows], weight[rows])
                t += 1
                for name in p:  # Adam
                    m[name] += 0.1 * (g[name] - m[name])
                    s[name] += 0.01 * (g[name] * g[name] - s[name])
                    p[name] -= (RATE * (m[name] / (1 - 0.9 ** t)) / (np.sqrt(s[name] / (1 - 0.99 ** t)) + 1e-6)
                                ).astype(np.float32)
        net = Network(p)
        flat = net.window_logits([t for runs in docs for t in runs])
        ends = np.cumsum([0] + [len(runs) for runs in docs])
        rank = [np.concatenate([np.zeros(0, np.float32), *flat[i:j]]) for i, j in zip(ends, ends[1:])]
    top = np.array([r.max() if len(r) else -20.0 for r in rank])
    sure = (labels == 0) | (top >= np.quantile(top[labels == 1], TRIM))
    scale, shift = calibrate(top[sure], labels[sure], prior)
    return Network(p, scale, shift)


def calibrate(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic fit of labels on logits (short Newton steps, slightly ridged); ``prior``: share of toxic documents."""
    w = np.where(y > 0, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum())) * len(y)
    x = np.column_stack([z, np.ones_like(z)])
    b = np.array([1.0, 0.0])
    for _ in range(60):
        q = sigmoid(x @ b)
        h = (x * (w * q * (1 - q))[:, None]).T @ x + np.diag([1.0, 0.1])
        b = b - np.clip(np.linalg.solve(h, x.T @ (w * (q - y)) + np.array([1.0, 0.1]) * (b - [1.0, 0.0])), -0.2, 0.2)
    return float(max(b[0], 0.05)), float(b[1])


def training_rows(docs: DataFrame, labels: DataFrame,
                  per_class: int = PER_CLASS) -> tuple[list[list[str]], list[int], float]:
    """Excerpts of at most ``per_class`` labelled documents of each class, by a hash of the id, and the share of toxic labels.

    Of rows that share an id the smallest text counts.
    """
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the ids first, so that only chosen texts are shuffled: each class a top-k, kept small in every task
    ids = [r for label in (0, 1) for r in y.where(F.col("toxic") == label).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id bigint, toxic int")
    rows = materialise(keyed_texts(docs).where("text <> ''").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min("text").alias("text")), "training")

    def holders(batches):
        for b in batches:
            for toxic, text in zip(b.column(1).to_pylist(), b.column(2)):
                found = list({rank_bucket(x) for x in words_of(text.as_py())})
                yield {"bucket": found, "toxic": [toxic] * len(found)}

    held = map_batches(rows, holders, "bucket int, toxic int").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()  # at most RANK_BUCKETS rows
    count = np.zeros((2, RANK_BUCKETS))
    for r in held:
        count[:, r.bucket] = r.n - r.toxic, r.toxic
    n = [max(1, sum(r.toxic == label for r in ids)) for label in (0, 1)]
    typical = typical_words(count[1], count[0], n[1], n[0]).astype(np.float32)

    def cut(batches):
        for b in batches:
            for k in range(b.num_rows):  # one text at a time: texts may be very long
                yield {"doc_id": b.column(0).slice(k, 1), "toxic": b.column(1).slice(k, 1),
                       "runs": [excerpt(b.column(2)[k].as_py(), typical)]}

    out = map_batches(rows, cut, "doc_id bigint, toxic int, runs array<string>").collect()
    out.sort(key=lambda r: (r.toxic, r.doc_id))
    share = y.agg(F.avg("toxic")).first()[0]
    return [r.runs for r in out], [r.toxic for r in out], share or 0.0


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score`` of every whole text; the parameters travel as a broadcast of fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast((net.p, net.scale, net.shift))
    key = uuid.uuid4().hex

    def run(batches):
        model = kept(key, lambda: Network(*sent.value))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield {"doc_id": part.column(0), "score": model.scores(part.column(1).to_pylist())}

    return map_batches(keyed_texts(docs), run, "doc_id bigint, score double", keeps=True)


def held_out() -> F.Column:
    """Rows kept from training; a row without id is not one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(spark: SparkSession, sf_dir: str) -> Network:
    """The production network: fitted on labelled documents of the data set that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return train(*training_rows(docs.where(~held_out()), labels.where(~held_out())))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; learned from labels of documents whose crc32(doc_id) mod 4 is not 2."""
    scored = score_documents(table(spark, sf_dir, "documents"), learn(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose whole text scores under ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast((net.p, net.scale, net.shift))
    key, at = uuid.uuid4().hex, docs.columns.index("text")

    def run(batches):
        model = kept(key, lambda: Network(*sent.value))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                scores = model.scores([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([s < threshold for s in scores]))

    return docs.mapInArrow(run, docs.schema)
