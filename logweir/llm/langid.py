"""Language ID: presence kernels over blended n-grams of code points, Nystroem features on landmark
texts, one-versus-rest kernel ridge regression, scored by products of whole batches.

k(x, z) = |X & Z| / sqrt(|X| |Z|), X and Z being the sets of hashed 1- to 3-grams of the lower-cased
texts. A text that is null or has no letter is `und` with score 0. Texts are read whole; repeated rows
are scored each for itself; equal scores go to the language that sorts first. Ids are integers; columns that clash
with no column named here are left alone. No rows give no rows, and a fit without labelled rows predicts `und`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import batch, crc_mod, documents, slices, small_batches

ORDERS = (1, 2, 3)
BITS = 15
#: About so many labelled texts of each language are read by a fit, and so many in all serve as landmarks.
SAMPLE = 1000
LANDMARKS = 256
#: Words in a part of a text, and the margin of a whole text below which its parts are looked at.
PART, DOUBTFUL = 60, 0.65
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def presence(texts: list[str]) -> np.ndarray:
    """A row of zeros and ones for each text: which hashed n-grams it has."""
    gap = "\0" * (ORDERS[-1] - 1)
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((gap.join(lowered) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + len(gap) for t in lowered])
    rows = np.repeat(np.arange(len(texts), dtype=np.uint32) << np.uint32(BITS), lengths)
    x = np.zeros(len(texts) << BITS, np.uint8)
    h = codes * np.uint32(0x9E3779B1)
    for n in range(1, ORDERS[-1] + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :]
        if n in ORDERS:
            inside = codes[: len(h)] > 0
            for k in range(1, n):
                inside &= codes[k : len(h) + k] > 0
            b = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
            x[(rows[: len(h)] | b)[inside]] = 1
    return x.reshape(len(texts), 1 << BITS)


def _kernel(texts: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of texts against landmark presence rows (float32), in blocks."""
    norm = np.sqrt(np.maximum(landmarks.sum(1), 1))
    out = np.zeros((len(texts), len(landmarks)), np.float32)
    for a, b in _blocks(texts):
        x = presence(texts[a:b]).astype(np.float32)
        out[a:b] = x @ landmarks.T / norm / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    return out


def _blocks(texts: list[str], rows: int = 256):
    for a in range(0, len(texts), rows):
        part = texts[a : a + rows]
        for s, e in slices(np.array([len(t) for t in part]), 1_000_000):
            yield a + s, a + e


def fit_texts(texts: list[str], langs: list[str], ridge: float = 1e-2) -> dict:
    """Landmarks are spread evenly over the languages; rows are taken in the order given."""
    names = sorted(set(langs))
    if not names:
        return {"names": [], "landmarks": np.zeros((0, 1 << BITS), np.uint8), "alpha": np.zeros((0, 0))}
    number = {x: k for k, x in enumerate(names)}
    y = np.array([number[x] for x in langs])
    each = max(2, LANDMARKS // len(names))
    at = np.concatenate([np.flatnonzero(y == c)[:each] for c in range(len(names))])
    marks = np.concatenate([presence([texts[i]]) for i in at])
    f = marks.astype(np.float32)
    w = _kernel([texts[i] for i in at], f).astype(np.float64)
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = _kernel(texts, f) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (1 / np.bincount(y))[y][:, None]  # each language counts the same
    gram = (phi * weight).T @ phi
    beta = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), (phi * weight).T @ target)
    return {"names": names, "landmarks": marks, "alpha": root @ beta}


def predict_texts(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    return judge_texts(texts, model)[:2]


def judge_texts(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages and scores, and what tells a text of a learned language from others: the margin of its class value over
    the second (of one language alone: over the value's negative) and the greatest kernel value to a landmark. Where the
    whole is in doubt, as of a text in two languages, the margin is that of its median part if that is greater."""
    langs, scores, margins, nearest = _judged(texts, model)
    for i in np.flatnonzero((margins < DOUBTFUL) & (nearest > 0)):
        words = texts[i].split()
        if len(words) > PART:
            parts = [" ".join(words[a : a + PART]) for a in range(0, len(words), PART)]
            margins[i] = max(margins[i], float(np.median(_judged(parts, model)[2])))
    return langs, scores, margins, nearest


def _judged(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    langs, scores, margins, nearest = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model["names"] else []
    if at:
        if "floats" not in model:  # once a process, not once a batch
            model["floats"] = model["landmarks"].astype(np.float32)
        kernel = _kernel([texts[i] for i in at], model["floats"])
        value = kernel @ model["alpha"]
        best = value.argmax(1)
        for i, k in zip(at, best):
            langs[i] = model["names"][k]
        scores[at] = np.clip((value[np.arange(len(at)), best] + 1) / 2, 0, 1)
        top = np.sort(value if value.shape[1] > 1 else np.hstack([value, -value]), 1)
        margins[at], nearest[at] = top[:, -1] - top[:, -2], kernel.max(1)
    return langs, scores, margins, nearest


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Fit on about `SAMPLE` rows of each language (all languages that occur), chosen by a hash of id and text; null texts or
    languages are skipped. The model's size is bounded by landmarks: `LANDMARKS` in all, two a language at least."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).where("_t is not null and _l is not null")
    counts = rows.groupBy("_l").count()
    # Rows of a language, by the least hashes of id and text: about SAMPLE lie below its share of the range, and never more than
    # twice as many are taken, whatever rows repeat.
    draw = F.pmod(F.xxhash64("_id", "_t", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("_d", draw).join(F.broadcast(counts), "_l").where(F.col("_d") < SAMPLE / F.col("count"))  # a row a language
    nth = F.row_number().over(Window.partitionBy("_l").orderBy("_d", "_t"))
    chosen = drawn.withColumn("_n", nth).where(F.col("_n") <= 2 * SAMPLE).select("_t", "_l", F.xxhash64("_id", "_t").alias("_h"))
    got = sorted(chosen.toLocalIterator(), key=lambda r: (r["_h"], r["_l"], r["_t"]))
    return fit_texts([r["_t"] for r in got], [r["_l"] for r in got])


def predict(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns id, lang_pred, score, margin and kernel (see `judge_texts`), a row for each row of `docs`; `keep` names columns of `docs` to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: landmarks times 2**BITS bytes
    small_batches(docs.sparkSession)
    kept = keep or []
    source = docs.select(F.col(text_col).alias("_t"), F.col(id_col).cast("long").alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)])
    types = [source.schema[f"_k{i}"].dataType.simpleString() for i in range(len(kept))]

    def run(batches):
        for rows in batches:
            langs, *numbers = judge_texts(rows.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(langs, pa.string()), *[pa.array(x, pa.float64()) for x in numbers]], names=[*rows.schema.names[1:], "lang_pred", "score", "margin", "kernel"])

    out = source.mapInArrow(run, ", ".join(["_id long", *[f"_k{i} {t}" for i, t in enumerate(types)], "lang_pred string", "score double", "margin double", "kernel double"]))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score", "margin", "kernel")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0)))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
