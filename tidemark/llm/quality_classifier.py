"""A quality score learnt from preference pairs.

Bradley-Terry: a document of label 1 is preferred to one of label 0, and the
probability of that is the logistic function of the difference of their scores,
which are linear in text features. Pairs are drawn from the labelled rows with a
fixed seed, and Newton steps minimise the logistic loss of feature differences.
The decision threshold is a quantile of the training scores, the share of label
0 among them; scores are shifted so that it falls on ``THRESHOLD`` and squashed
to 0..1.

Training takes at most ``TRAIN_ROWS`` labelled rows (least hash of the id first)
whose fold isn't held out; only their features reach the driver. Labels, source,
language and id are no features.

Edge cases: a null or empty text is scored like a text without words; a null id
belongs to no fold and is never trained on; several labels of one id count as
the worst of them, and of several rows of one id the least by features is
trained on; without rows of both labels all scores are ``THRESHOLD``.
Repeated rows give repeated results, empty tables an empty result, other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_rows

TRAIN_ROWS = 10_000
PAIRS = 200_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
SEED = 7
N_FEATURES = 14

UPPER = np.zeros(256)
UPPER[65:91] = 1
DIGIT = np.zeros(256)
DIGIT[48:58] = 1
LOWER = np.zeros(256)
LOWER[97:123] = 1
LOWER[128:] = 0.5  # a letter outside ASCII has two bytes mostly
MARKS = np.zeros(256)
MARKS[[ord(c) for c in "#*$%&|<>"]] = 1


def features(text: str) -> list[float]:
    """Length, variety, repetition and character-class shares of a whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    hist = np.bincount(raw, minlength=256).astype(float)
    size = hist.sum()
    counts = Counter(words)
    top = counts.most_common(1)[0][1] / n
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    adjacent = sum(map(str.__eq__, words, words[1:])) / n
    ends = hist[ord(".")] / n
    return [
        min(np.log1p(n), 6.0),
        len(counts) / n**0.9,
        top,
        adjacent,
        1 - len(set(lines)) / len(lines),
        hist @ UPPER / size,
        hist @ LOWER / size,
        hist @ DIGIT / size,
        min(hist @ MARKS / n, 4.0),
        min(hist[ord("!")] / n, 4.0),
        min(hist[ord("|")] / n, 4.0),
        min(size / n, 30.0) / 10,
        min(ends, 1.0),
        float(n < 20),
    ]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights, scaling and threshold from feature rows and 0/1 labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "w": np.zeros(N_FEATURES), "cut": 0.0}
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    rng = np.random.default_rng(SEED)
    n = min(PAIRS, 40 * max(len(good), len(bad)))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(N_FEATURES)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / n - 1e-3 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + 1e-3 * np.eye(N_FEATURES)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = np.sort(z @ w)
    k = len(bad)
    return {"mean": mean, "scale": scale, "w": w, "cut": float((s[k - 1] + s[k]) / 2)}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    raw = ((x - model["mean"]) / model["scale"]) @ model["w"] - model["cut"] + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> dict:
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold(F.col("_id")) != HELD_OUT))
    chosen = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    joined = text_rows(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    schema = T.StructType([T.StructField("id", joined.schema["doc_id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    # one row of each id, so that repeated ids don't add to what reaches the driver
    once = joined.mapInArrow(run, schema).groupBy("id").agg(F.min(F.struct("y", "x")).alias("one")).select("id", "one.*")
    got = sorted((str(r.id), r.y, r.x) for r in once.collect())
    return fit(np.array([r[2] for r in got]).reshape(-1, N_FEATURES), np.array([r[1] for r in got]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = train(docs, labels, id_col, text_col)
    rows = text_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(x, model))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
