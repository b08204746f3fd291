"""Toxicity: a linear classifier on the presence of character n-grams, each feature scaled by its
naive Bayes log-count ratio, fitted on a bounded sample of labelled text.

Null and empty texts have no n-grams and are scored by the bias alone. Rows that repeat are scored each for
itself; columns other than id and text are ignored. Ids are integers. No rows give no rows; without labelled rows
every score is one half.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import batch, crc_mod, documents, slices, small_batches

#: Lengths of the n-grams, in code points of the lower-cased text.
ORDERS = (4, 5, 6)
#: Hash buckets of n-grams.
BITS = 22
#: Features that the model keeps, by strength of association with the label.
FEATURES = 4096
#: Labelled rows that a fit reads at most, of each class.
SAMPLE = {1: 2500, 0: 3500}
THRESHOLD = 0.7


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by as many zeros as the longest n-gram; and where each begins."""
    gap = "\0" * ORDERS[-1]
    lowered = [t.lower() for t in texts]
    starts = np.cumsum([0] + [len(t) + len(gap) for t in lowered])[:-1]
    return np.frombuffer((gap.join(lowered) + gap).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _buckets(codes: np.ndarray):
    """For each order, the bucket of the n-gram that begins at each place."""
    h = codes * np.uint32(0x9E3779B1)
    for n in range(2, ORDERS[-1] + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :]
        if n in ORDERS:
            yield (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def _present(texts: list[str], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; of buckets marked in `chosen` only, if given."""
    codes, starts = _codes(texts)
    keys = []
    for b in _buckets(codes):
        at = np.flatnonzero(chosen[b]) if chosen is not None else np.arange(len(b))
        doc = np.searchsorted(starts, at, "right") - 1
        keys.append((doc.astype(np.int64) << BITS) | b[at])
    found = np.unique(np.concatenate(keys))
    return found >> BITS, found & ((1 << BITS) - 1)


def fit_texts(texts: list[str], y: np.ndarray, alpha: float = 0.5, l2: float = 1e-4, steps: int = 300) -> dict:
    """Fit on texts with labels 0 and 1. With one class alone, every score is that class's share."""
    y = np.asarray(y, np.float64)
    n1, n0 = y.sum(), (1 - y).sum()
    prior = (n1 + alpha) / (n1 + n0 + 2 * alpha)
    if not n1 or not n0:
        return {"chosen": np.zeros(0, np.int64), "weights": np.zeros(0, np.float32), "bias": float(np.log(prior / (1 - prior)))}
    pairs = []
    df1, df0 = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    for a, b in slices(np.array([len(t) for t in texts]), 400_000):
        doc, bucket = _present(texts[a:b])
        pos = y[a:b][doc] > 0
        df1 += np.bincount(bucket[pos], minlength=1 << BITS)
        df0 += np.bincount(bucket[~pos], minlength=1 << BITS)
    ratio = np.log((df1 + alpha) / (n1 + 2 * alpha)) - np.log((df0 + alpha) / (n0 + 2 * alpha))
    # Strength: the ratio against its standard error; n-grams of one or two texts say nothing.
    strength = np.abs(ratio) / np.sqrt(1 / (df1 + alpha) + 1 / (df0 + alpha)) * (df1 + df0 >= 3)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    chosen = chosen[strength[chosen] > 0]
    mark = np.zeros(1 << BITS, bool)
    mark[chosen] = True
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for a, b in slices(np.array([len(t) for t in texts]), 400_000):
        doc, bucket = _present(texts[a:b], mark)
        x[a + doc, np.searchsorted(chosen, bucket)] = 1
    r = ratio[chosen].astype(np.float32)
    x *= r
    # Logistic loss with an L2 penalty, by Nesterov's accelerated gradient; both classes weigh the same.
    cost = np.where(y > 0, 0.5 / n1, 0.5 / n0).astype(np.float32)
    v = np.ones(len(chosen), np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        v = x.T @ (cost * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(v @ (x.T @ (cost * (x @ v)))) + 0.25 + l2)
    w = prev = np.zeros(len(chosen), np.float32)
    b = b_prev = 0.0
    for t in range(steps):
        m = t / (t + 3)
        u, c = w + m * (w - prev), b + m * (b - b_prev)
        g = cost * (1 / (1 + np.exp(-(x @ u + c))) - y).astype(np.float32)
        prev, b_prev = w, b
        w, b = u - step * (x.T @ g + np.float32(l2) * u), c - step * float(g.sum())
    return {"chosen": chosen, "weights": (w * r).astype(np.float32), "bias": float(b)}


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    out = np.full(len(texts), model["bias"])
    if len(model["chosen"]):
        mark = np.zeros(1 << BITS, bool)
        mark[model["chosen"]] = True
        for a, b in slices(np.array([len(t) for t in texts]), 1_000_000):
            doc, bucket = _present(texts[a:b], mark)
            out[a:b] += np.bincount(doc, model["weights"][np.searchsorted(model["chosen"], bucket)], minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fit on at most `SAMPLE` rows of each class, chosen by a hash of their id; labels other than 0 and 1 are ignored."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id is not null and _y in (0, 1)")
    picked = None
    for y, most in SAMPLE.items():
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.dropDuplicates(["_id"])
    # At most sum(SAMPLE) narrow rows: small enough to broadcast whatever the corpus is.
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(picked), "_id").select("_t", "_y").orderBy("_t", "_y").toLocalIterator()
    texts, y = [], []
    # Rows may repeat an id: no more are read than twice the bound.
    for t, v in itertools.islice(rows, 2 * sum(SAMPLE.values())):
        texts.append(t)
        y.append(v)
    return fit_texts(texts, np.array(y, np.int64))


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, score and predicted, a row for each row of `docs`."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for rows in batches:
            s = score_texts([t or "" for t in rows.column(1).to_pylist()], model)
            yield batch(schema, id=rows.column(0), score=s, predicted=(s >= THRESHOLD).astype(np.int32))

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(crc_mod(F.col("doc_id"), 3) != 1)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
