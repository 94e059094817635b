"""Toxicity scores from subword bags: hashed word and character n-gram vectors, averaged over a
window of words, then a linear softmax, all trained jointly in numpy.

A window is averaged over its distinct words, over ``PLACES`` at least (the others count as
empty), so that neither a short text nor a repeated word has too much weight. A word's vector is the mean over its buckets (the word itself and its 3- to 5-grams with
boundary marks), so an unseen misspelling shares the vectors of the n-grams it keeps. A text
is scored in windows of ``WINDOW`` words and has its highest window's score: a few toxic
words in a long text count as much as in a short one. Windows inherit the label of their
document in training.

Training sees a bounded sample of labelled rows: ``DOCS`` documents per label at most (least
hash of the id). One in five of them, by another hash of the id, sets the bias; of the distinct
windows of the others ``CLEAN_WINDOWS`` and ``TOXIC_WINDOWS`` at most train the vectors. The
bias puts the threshold where it separates best the whole documents left out, each counting as
many times as its label has training documents for one in the sample. Ids of the sample are
broadcast (2 * ``DOCS`` rows at most); windows of ``WINDOW`` words and one score a document
come to the driver. Scoring covers all rows and whole texts.

Null and empty texts score as the bias alone. A document labelled twice counts as toxic if
any label says so; null labels and ids are ignored. Without a label of either kind all scores
are 0. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernloom.llm.common import crc_mod, staged

WINDOW, PLACES = 200, 40
DOCS = 5000
CLEAN_WINDOWS, TOXIC_WINDOWS = 5_000, 2_500
BUCKETS, DIM, ROUNDS, RATE, DECAY = 1 << 17, 4, 55, 0.2, 4e-6
RARE = 375  # a bucket must occur in one of so many windows, and in two, to get a vector
THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def buckets_of(word: str) -> list[int]:
    """Hashed buckets of a word: itself, then its n-grams."""
    marked = f"<{word}>"
    grams = [marked]
    for n in (3, 4, 5):
        grams += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in grams]


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: its vector times the softmax's difference
    bias: float


class Scorer:
    """Scores whole texts; a word's weight is computed once and kept in a bounded table."""

    def __init__(self, model: Model, most: int = 400_000) -> None:
        self.model, self.most, self.known = model, most, {}

    def __call__(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-min(max(self.logit(text), -500.0), 500.0))))

    def logit(self, text: str | None) -> float:
        found, known = words_of(text), self.known
        if len(known) > self.most:
            known.clear()
        for w in {w for w in found if w not in known}:
            known[w] = float(self.model.weight[buckets_of(w)].mean())
        weight, best = known.__getitem__, 0.0
        for i, at in enumerate(range(0, len(found), WINDOW)):
            own = set(found[at : at + WINDOW])
            mean = sum(map(weight, own)) / max(len(own), PLACES)
            best = max(best, mean) if i else mean
        return self.model.bias + best


def centred(model: Model, scored: list[tuple[float, int, float]]) -> Model:
    """The model with the bias at which the threshold separates best (by F1) documents given as
    (logit, label, weight); unchanged without documents of either label."""
    scored = sorted(scored)
    logits, toxic, weight = (np.array([x[i] for x in scored], float) for i in range(3))
    hits, all_toxic = toxic * weight, float((toxic * weight).sum())
    if not 0 < toxic.sum() < len(toxic):
        return model
    hit = all_toxic - np.cumsum(hits)  # of a cut after each place
    wrong = ((1 - toxic) * weight).sum() - np.cumsum((1 - toxic) * weight)
    f1 = 2 * hit / np.maximum(hit + wrong + all_toxic, 1e-9)
    good = logits[:-1][f1[:-1] >= f1[:-1].max() - 0.003]
    cut = (good[0] + good[-1]) / 2
    return Model(model.weight, model.bias + float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut))


def train(windows: list[list[str]], labels: list[int]) -> Model:
    """Full-batch Adam on bucket vectors and softmax together."""
    windows = [list(dict.fromkeys(x)) for x in windows]
    count = np.array([len(x) for x in windows])  # distinct words
    often = Counter(w for x in windows for w in x)
    windows = [[w for w in x if often[w] > 1] or x[:1] for x in windows]  # words seen once teach nothing
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in windows for w in x))}
    if not vocabulary or len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), -500.0)
    subs = [buckets_of(w) for w in vocabulary]
    size = np.array([len(s) for s in subs])
    flat = np.concatenate([np.array(s, np.int64) for s in subs])
    token = np.array([vocabulary[w] for x in windows for w in x])
    held = np.array([len(x) for x in windows])
    of_word = np.repeat(np.arange(len(size)), size)
    # buckets of too few windows get no vector, and words without any stand for nothing
    seen = np.bincount(flat, weights=np.bincount(token, minlength=len(size))[of_word], minlength=BUCKETS) >= max(2, len(windows) // RARE)
    kept = seen[flat]
    kept[np.cumsum(size) - size] |= ~np.logical_or.reduceat(kept, np.cumsum(size) - size)
    flat, of_word = flat[kept], of_word[kept]
    used, flat = np.unique(flat, return_inverse=True)
    word_start = np.flatnonzero(np.concatenate([[True], of_word[1:] != of_word[:-1]]))
    win_start = np.concatenate([[0], np.cumsum(held)[:-1]])
    of_window = np.repeat(np.arange(len(windows)), held)
    # orders that turn scatters into sums of runs
    by_token, by_sub = np.argsort(token, kind="stable"), np.argsort(flat, kind="stable")
    token_start = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(size)))[:-1]])
    sub_start = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(used)))[:-1]])
    rng = np.random.default_rng(7)
    params = [
        rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32),
        rng.normal(0, 1.0, (DIM, 2)).astype(np.float32),
        np.zeros(2, np.float32),
    ]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.eye(2, dtype=np.float32)[np.array(labels)]
    inverse_count = (1.0 / np.maximum(count, PLACES))[:, None].astype(np.float32)
    inverse_size = (1.0 / size)[:, None].astype(np.float32)
    for step in range(1, ROUNDS + 1):
        emb, out, bias = params
        word = np.add.reduceat(emb[flat], word_start) * inverse_size
        bag = np.add.reduceat(word[token], win_start) * inverse_count
        logits = bag @ out + bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(windows)
        g_bag = (g @ out.T) * inverse_count
        g_word = np.add.reduceat(g_bag[of_window[by_token]], token_start) * inverse_size
        g_emb = np.add.reduceat(g_word[of_word[by_sub]], sub_start) + DECAY * emb * seen[used][:, None]
        for i, grad in enumerate((g_emb, bag.T @ g, g.sum(0))):
            first[i] += 0.1 * (grad - first[i])
            second[i] += 0.01 * (grad * grad - second[i])
            rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            params[i] -= rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    weight = np.zeros(BUCKETS)
    weight[used] = (params[0] @ (params[1][:, 1] - params[1][:, 0])) * seen[used]
    return Model(weight, float(params[2][1] - params[2][0]))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", docs_per_label: int = DOCS) -> Model:
    """The model of the labelled rows among ``docs`` (doc_id, text)."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    marks = marks.select("doc_id", (F.col("y") > 0).cast("int").alias("y"), F.xxhash64("doc_id", F.lit("sample")).alias("h"))
    ids = [(r[0], y) for y in (0, 1) for r in marks.where(F.col("y") == y).orderBy("h", "doc_id").limit(docs_per_label).select("doc_id").collect()]
    all_of = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = {y: n / min(n, docs_per_label) for y, n in all_of.items()}
    spark = docs.sparkSession
    fold = F.pmod(F.xxhash64("doc_id", F.lit("left out")), F.lit(5)) == 0
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, y int"))  # at most 2 * docs_per_label rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = words_of(text)
                for at in range(0, len(found), WINDOW):
                    out.append((y, zlib.crc32(f"{doc_id}:{at}".encode()), " ".join(found[at : at + WINDOW])))
            y, h, part = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(h, pa.int64()), pa.array(part, pa.string())], ["y", "h", "part"])

    windows = rows.where(~fold).select("doc_id", "text", "y").mapInArrow(cut, "y int, h long, part string").distinct()
    windows = staged(windows, "toxicity-windows")
    found, marks_of = [], []
    for y, most in ((0, CLEAN_WINDOWS), (1, TOXIC_WINDOWS)):
        for r in windows.where(F.col("y") == y).orderBy("h", "part").limit(most).select("part").collect():
            found.append(r[0].split(" "))
            marks_of.append(y)
    model = train(found, marks_of)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in batches:
            found = pa.array([score.logit(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2)], ["doc_id", "logit", "y"])

    scored = rows.where(fold).select("doc_id", "text", "y").mapInArrow(logits, "doc_id long, logit double, y int")
    scored = scored.groupBy("doc_id", "y").agg(F.max("logit").alias("logit")).collect()  # a row for each id of the sample at most
    return centred(model, [(r["logit"], r["y"], weight[r["y"]]) for r in scored])


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = crc_mod("doc_id", 3) == 1
    model = learn(docs.where(~held), labels.where(~held))
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column(2)]
            predicted = [int(s >= THRESHOLD) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
