"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A word's features are the word itself and its character 2- to 4-grams with edge
marks, hashed into ``DIM``-wide embeddings. A text is the mean over all features of
all its words; a linear softmax gives the languages. Training is plain
stochastic gradient descent on a bounded sample of labelled rows (at most
``PER_LANG`` documents of each language, chosen by a hash of the id): of each, three runs of words
that lie anywhere in the whole text, cut out inside the tasks. Because the
softmax input is a mean, each word contributes a fixed row of language scores, which
workers keep per distinct word, so a text costs one lookup and one sum per word. All bytes of a
word count; a long run of letters enters as overlapping pieces.

Rejection is calibrated: a temperature is fitted on documents held back from
training, and the threshold is the largest that still accepts ``ACCEPT`` of them.

Defined results: null text or no letter: ``und`` with score 0; ties go to the
language that sorts first; an empty table gives an empty frame, a training set
without rows predicts ``und``; repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import WordRows, byte_hash, byte_matrix, gram_buckets, kept, map_batches, table, words_of

BUCKETS = 1 << 16
DIM = 16
PER_LANG = 400
#: Words of the runs that training takes from a document: short ones as well, so that short texts are seen.
RUNS = (60, 12, 3)
EPOCHS = 6
RATE = 0.5
ACCEPT = 0.98
CACHE = 600_000
WIDTH = 24


def features(words: list[str]) -> np.ndarray:
    """Buckets of each word and of its 2- to 4-byte grams with edge marks; -1: none."""
    m = byte_matrix([w.lower() for w in words], WIDTH)
    return np.concatenate([(byte_hash(m, WIDTH) % np.uint32(BUCKETS)).astype(np.int32)[:, None],
                           *(gram_buckets(m, k, BUCKETS) for k in (2, 3, 4))], 1)


class Model:
    def __init__(self, langs: list[str], scores: np.ndarray, temperature: float, threshold: float):
        self.langs, self.scores, self.temperature, self.threshold = langs, scores, temperature, threshold
        self.words = WordRows(len(langs) + 1, self._rows, CACHE)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Summed language scores of each word's features, and their number."""
        f = features(words)
        padded = np.concatenate([self.scores, np.zeros((1, len(self.langs)), np.float32)])  # -1: the zero row
        return np.column_stack([padded[f].sum(1), (f >= 0).sum(1)])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """``(language, calibrated probability, accepted)``; the whole text counts."""
        words = words_of(text) if text and self.langs else []
        if not words:
            return "und", 0.0, False
        total = np.zeros(len(self.langs) + 1)
        for k in range(0, len(words), 1 << 16):
            at = self.words.index(words[k:k + (1 << 16)])
            total += self.words.rows[at].sum(0, dtype=np.float64)
        p = softmax(total[:-1] / total[-1] / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best])), bool(p[best] >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def excerpts(text: str) -> tuple[list[str], bool]:
    """Runs of ``RUNS`` words from anywhere in the whole text, and whether the text is held back; both follow from it."""
    crc = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    words, rng = words_of(text), np.random.default_rng(crc)
    starts = [int(rng.integers(0, max(1, len(words) - n + 1))) for n in RUNS]
    return [" ".join(words[k:k + n]) for k, n in zip(starts, RUNS)] if words else [], crc % 5 == 0


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """:func:`fit` on excerpts of texts that are at hand."""
    got = [excerpts(t) for t in texts]
    return fit([g[0] for g in got], [g[1] for g in got], labels, seed)


def fit(runs: list[list[str]], held_back: list[bool], labels: list[str], seed: int = 7) -> Model:
    """Fit embeddings and softmax on runs of words of each document, then temperature and threshold on those held back."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    samples = []
    for parts, held, lang in zip(runs, held_back, labels):
        for part in parts:
            f = features(words_of(part))
            samples.append((f[f >= 0], langs.index(lang), held))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    used = [s for s in samples if not s[2]] or samples
    weight = Counter(y for _, y, _ in used)
    steps, done = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(used)):
            f, y, _ = used[i]
            rate = RATE * (1 - done / steps) * min(4.0, len(used) / (len(weight) * weight[y]))
            h = emb[f].mean(0)
            g = softmax(h @ out)
            g[y] -= 1
            back = (out @ g) * (rate / len(f))
            out -= rate * np.outer(h, g)
            np.subtract.at(emb, f, back.astype(np.float32))
            done += 1
    kept = [s for s in samples if s[2]] or samples
    z = np.array([emb[f].mean(0) @ out for f, _, _ in kept])
    y = np.array([s[1] for s in kept])
    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = grid[int(np.argmin(loss))]
    top = softmax(z / temperature).max(1)
    return Model(langs, (emb @ out).astype(np.float32), temperature, float(np.quantile(top, 1 - ACCEPT)))


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[list[str]], list[bool], list[str]]:
    """What :func:`fit` takes, of at most ``per_lang`` documents of each language by a hash of the id.

    Whole texts are read and cut inside the tasks; what is collected is bounded by the parameter. Of rows that share
    an id the first by language and excerpts counts.
    """
    lettered = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # one partial aggregate keeps the smallest hashes of each language
    picked = (lettered.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(512)).alias("slot"))
              .agg(F.min("doc_id").alias("doc_id")).orderBy("lang", "slot"))
    ids: dict[str, list[int]] = {}
    for r in picked.collect():  # at most 512 rows a language
        ids.setdefault(r.lang, []).append(r.doc_id)
    want = [i for v in ids.values() for i in v[:per_lang]]
    if not want:
        return [], [], []

    def run(batches):
        for b in batches:
            got = [excerpts(t.as_py()) for t in b.column(2)]
            yield {"doc_id": b.column(0), "lang": b.column(1), "runs": [g[0] for g in got], "held": [g[1] for g in got]}

    cut = map_batches(lettered.where(F.col("doc_id").isin(want)).select("doc_id", "lang", "text"), run,
                      "doc_id bigint, lang string, runs array<string>, held boolean")
    rows = cut.groupBy("doc_id").agg(F.min(F.struct("lang", "runs", "held")).alias("r")).orderBy("doc_id").collect()
    rows = [r.r for r in rows if r.r.runs]
    return [r.runs for r in rows], [r.held for r in rows], [r.lang for r in rows]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for every whole text; the model travels as a broadcast of fixed size."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.langs, model.scores, model.temperature, model.threshold))
    key = uuid.uuid4().hex

    def run(batches):
        m = kept(key, lambda: Model(*sent.value))
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(1)]
            yield {"doc_id": b.column(0), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got],
                   "accepted": [g[2] for g in got]}

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id bigint, lang_pred string, score double, accepted boolean", keeps=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from documents whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(*training_rows(docs.where(~held & F.col("doc_id").isNotNull())))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
