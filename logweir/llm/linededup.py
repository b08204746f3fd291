"""Line dedup on DataFrame functions alone: lines found in many documents stay in one of them.

Hashes of line keys are written once, then dealt out by range of (hash, salt) and sorted by document and position
within a task: the first occurrence of a hash in each document streams by, the last document first, and tells
how many documents hold it and which one keeps it. Hashes that a sample of the rows shows to be hot (more than one
row in `HOT_SHARE`, so fewer than `HOT_SHARE` of them) are salted by document; their totals are added up over the
salts and broadcast. The sample only places rows: every count is of all rows. The result is a compressed bitmap for
each document instead of its text: `keep` holds the runs of zeros in it, as first and last line. Documents that
keep all their lines have none.

A text that is null or empty is one empty line. Ties do not arise: of the documents that hold a key, the one
with the largest id keeps it. Rows that share an id are one document each in the output, but count as one
document where documents are counted. Ids are integers; a null id counts as the least of 64 bits. Lines to drop are
carried with a digest of their row's text, as positions in one text say nothing about another text of the same id.
Columns of the input come back within `row`, so that no name can clash. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import documents, parallelism, stored

#: Code points of a key and documents that hold it, from which on its lines are dropped.
MIN_LENGTH, MIN_DOCS = 40, 5
#: A hash is hot with more than one in so many rows; one row in so many is looked at to find such hashes.
HOT_SHARE, SAMPLED = 1000, 64
_LEAST_ID = -(2**63)
_CUT = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _id(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(_LEAST_ID))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    """id, digest (of the text), line (position), h1, h2 of the lines that are long enough to count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(_id(F.col(id_col)).alias("id"), F.xxhash64(text).alias("digest"), text.alias("t"))
    # The outer form of explode: the inner one splits each text a second time, to filter out empty arrays.
    lines = texts.select("id", "digest", F.posexplode_outer(F.split("t", "\n")).alias("line", "raw")).where(F.char_length("raw") >= min_length)
    # Most lines begin and end with letters, and many are ASCII: the dear functions see the others alone.
    bare = F.when((F.col("raw") < "!") | (F.substring("raw", -1, 1) < "!"), F.btrim("raw", F.lit(_CUT))).otherwise(F.col("raw"))
    lines = lines.withColumn("bare", bare).where(F.char_length("bare") >= min_length)
    key = F.when(F.octet_length("bare") == F.char_length("bare"), F.lower("bare")).otherwise(F.translate("bare", _UPPER, _LOWER))
    lines = lines.select("id", "digest", "line", key.alias("key"))
    # 128 bits of hash, under two seeds, stand for a key.
    return lines.select("id", "digest", "line", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, digest and line of each line to drop."""
    rows = stored(_lines(docs, id_col, text_col, min_length))
    tasks = parallelism(docs.sparkSession)
    sampled = F.pmod(F.xxhash64("id", "digest", "line"), F.lit(SAMPLED)) == 0
    seen = max(1, rows.where(sampled).count())
    hot = rows.where(sampled).groupBy("h1").agg(F.count("*").alias("m")).where((F.col("m") >= 8) & (F.col("m") > seen / HOT_SHARE))
    # Fewer than HOT_SHARE rows. A salt's share is an eighth of a task's, about.
    salts = F.broadcast(hot.select("h1", F.ceil(F.col("m") * (8 * tasks / seen)).alias("salts")))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.col("salts")))
    salted = rows.join(salts, "h1", "left").select("id", "digest", "line", "h1", "h2", salt.alias("salt"))
    dealt = salted.repartitionByRange(tasks, "h1", "h2", "salt")
    group = Window.partitionBy("h1", "h2", "salt")
    # The stream: documents from the largest id on, positions within them; the rank grows at each first occurrence.
    nth = F.dense_rank().over(group.orderBy(F.desc("id")))
    met = dealt.sortWithinPartitions("h1", "h2", "salt", F.desc("id"), "digest", "line").withColumn("nth", nth)
    met = met.withColumns({"n_docs": F.max("nth").over(group), "keeper": F.max("id").over(group)})
    # A document has one salt: the documents of all salts add up. As many rows as there are hot hashes.
    in_doc = salted.where("salt > 0").groupBy("h1", "h2", "salt", "id").agg(F.count("*").alias("n"))
    total = in_doc.groupBy("h1", "h2").agg(F.count("*").alias("all_docs"), F.max("id").alias("all_keeper"))
    met = met.join(F.broadcast(total), ["h1", "h2"], "left")
    gone = (F.coalesce("all_docs", "n_docs") >= min_docs) & (F.col("id") < F.coalesce("all_keeper", "keeper"))
    return met.where(gone).select("id", "digest", "line")


def bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, digest, n (lines dropped) and `keep`, the compressed bitmap, of each text that loses lines."""
    lost = dropped_lines(docs, id_col=id_col, text_col=text_col, min_length=min_length, min_docs=min_docs)
    sets = lost.groupBy("id", "digest").agg(F.sort_array(F.collect_set("line")).alias("at"))
    at = F.col("at")
    firsts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) < x - 1))
    lasts = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + 1))
    return sets.select("id", "digest", F.size(at).cast("long").alias("n"), F.arrays_zip(firsts.alias("first"), lasts.alias("last")).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the runs of lines that a bitmap drops, in one walk over the runs."""

    def joined(lines: Column) -> Column:
        n = F.size(keep)
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(keep, i - 1)["last"] + 1)
        end = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(keep, i)["first"])
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i)))), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n")), joined), F.lit(0))


def apply(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """row (all columns of `docs`), n_lines (before dropping), n_dropped and kept (the text that stays), for each row of `docs`."""
    lost = bitmaps(docs, id_col=id_col, text_col=text_col, min_length=min_length, min_docs=min_docs)
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    rows = rows.select("row", _id(F.col("row").getField(id_col)).alias("id"), F.xxhash64(text).alias("digest"))
    joined = rows.join(lost, ["id", "digest"], "left")
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = F.when(F.col("keep").isNull(), text).otherwise(kept_text(text, F.col("keep")))
    return joined.select("row", n_lines.alias("n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, rowid_ AS r, i, string_split(t, chr(10))[i] AS raw
  FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i
        FROM (SELECT doc_id, row_number() OVER () AS rowid_, coalesce(text, '') AS t FROM documents))),
keys AS (
  SELECT *, translate(trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keys.*, shared.k IS NOT NULL AND doc_id < keeper AS gone FROM keys LEFT JOIN shared USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
