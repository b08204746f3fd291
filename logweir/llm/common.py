"""Helpers shared by the operators: reading, hashing, packing, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import logweir

# Functions shipped to executors travel by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(logweir)

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Java pattern of one word.
WORD = "[^\\x20\\x09-\\x0D]+"
#: And of one character between words.
SPACE = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches handed to Python workers: rows of text are wide."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is set and driver and executors
    are one process. On a cluster without a setting it raises: executors would not share a folder of one machine."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        set_ = tempfile.mkdtemp(prefix="logweir-checkpoint-")
        spark.sparkContext.setCheckpointDir(set_)
    return set_


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/logweir-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a `stored` frame once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if path.getName().startswith("logweir-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(lengths: np.ndarray, most: int):
    """Cut consecutive items into (start, end) runs of at most `most` total length, one item at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
