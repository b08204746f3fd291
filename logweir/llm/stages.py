"""Stages of the corpus pipeline: each takes and (but for the last) returns rows with the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm import langid, linededup, minhash, mixing, pieces
from logweir.llm.common import SPACE, WORD, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Score below which a language is not accepted: far below that of any text in one language.
LEAST_SCORE = 0.25
#: Margin over the second language (of the whole or of its median part) and kernel value to the nearest landmark, below
#: which a text is in no learned language. Of the labelled rows of check_s 0.3 % have a margin below 0.62 and none of the
#: held-out rows of sf0.1 a kernel value below 0.17; the margin of random letters and symbols is 0.2 at most.
LEAST_MARGIN, LEAST_KERNEL = 0.62, 0.15


def _shaped(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognized language; those that are undetermined, fall short of `LEAST_MARGIN` or `LEAST_KERNEL`, or score below `LEAST_SCORE`, go. The language found replaces the stated one.
    Null texts and texts without a letter go; equal rows stay or go alike."""
    found = langid.predict(docs, langid.fit(docs), keep=["text", "source"])
    sure = (F.col("margin") >= LEAST_MARGIN) & (F.col("kernel") >= LEAST_KERNEL) & (F.col("score") >= LEAST_SCORE)
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & sure)
    return _shaped(kept.withColumn("lang", F.col("lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; all documents stay, null texts as empty ones."""
    return _shaped(linededup.apply(docs.select(*COLUMNS)).select("row.*", "kept").withColumn("text", F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more. Texts that are null or
    without words are in no group and stay, as do rows with a null id. Of rows with the kept id, each different text stays
    once: different texts of one id are that document's parts."""
    kept = minhash.near_duplicates(docs, shingle=5, percent=80, bands=32).where("kept").select(F.col("doc_id").alias("_kept"))
    rows = docs.select(*COLUMNS).join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    digest = F.xxhash64("text")
    # Ids with equal rows are few, and their rows alone are shuffled: numbers first.
    twice = docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("_id"), digest.alias("_digest")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id", "_digest")
    twice = stored(twice)
    if twice.isEmpty():
        return _shaped(rows)
    again = (F.col("doc_id") == F.col("_id")) & (digest == F.col("_digest"))
    return _shaped(rows.join(twice, again, "left_anti").unionByName(rows.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"])))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, with the white space between them: a row for each round in which it takes any of a
    document's blocks. Neighbouring blocks read on as in the text. Texts that are null or without words are not taken;
    of equal rows (id, text) each is laid out and taken for itself."""
    order = F.xxhash64("doc_id", "text", F.lit(mixing._SEED))
    rows = docs.select(*COLUMNS).withColumn("_order", order)
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_order").orderBy("_order")))
    plan = mixing.mix(docs).where("taken > 0").select(F.col("_id").alias("_m"), F.col("_order").alias("_o"), "_begins", "times")
    plan = stored(plan.withColumn("_c", F.row_number().over(Window.partitionBy("_m", "_o").orderBy("_begins"))))
    both = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_m")) & (F.col("_order") == F.col("_o")) & (F.col("_copy") == F.col("_c")))
    # Each word with what follows it up to the next, the first also with what stands before: joined, they are the text.
    words = F.regexp_extract_all("text", F.lit(f"(?:^{SPACE}+)?{WORD}{SPACE}*"), F.lit(0))
    each = both.withColumn("_words", words).withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.map_values("times")))))
    blocks = F.map_keys(F.map_filter("times", lambda b, n: n >= F.col("round")))
    block = mixing.BLOCK
    # A block's words within the document, in the order of the blocks.
    piece = lambda b: F.array_join(F.slice(F.col("_words"), F.greatest(b * block - F.col("_begins"), F.lit(0)).cast("int") + 1, (F.least((b + 1) * block - F.col("_begins"), F.array_size("_words")) - F.greatest(b * block - F.col("_begins"), F.lit(0))).cast("int")), "")
    return _shaped(each.withColumn("text", F.array_join(F.transform(F.array_sort(blocks), piece), "")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each text: their number and digest, and the digest of the text that they give back. Null texts have none;
    each row is encoded for itself."""
    out = pieces.tokens(docs)
    return out.select("doc_id", "n_tokens", "ids_sha256", "n_chars", "decoded_sha256")
