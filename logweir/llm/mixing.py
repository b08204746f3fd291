"""Mixing sources to target weights on DataFrame functions alone.

The documents of a source, laid end to end in an order drawn by hash, are packed into blocks of `BLOCK` words.
The slots of every output shard are drawn from the sources, slot by slot, so that a shard's counts are multinomial;
the last few shards make up what the draws left, so that each source comes to its target. A source's slots, numbered
through the shards, run through its blocks in the order of a pseudorandom permutation of their indexes (a Feistel
network over the residues of two factors, its keys new in every round), and slots and blocks are joined by index.
All draws are hashes of stated seeds, so reruns agree.

Null texts have size 0 and are taken 0 times; a null source is a source of its own; rows that share an id are
documents of their own as long as their text or source differs, and are else told apart by a running number.
Where all sizes are 0 all targets are 0. Each step's numbers are written, so that no query holds the plans of all of
them: the driver plans a query anew after each of its stages. The table of sources is held by the driver and broadcast: a row a source,
never one a document. Columns other than id, text and source are ignored. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import WORD, discard, documents, n_words, parallelism, stored

#: Words in a block; slots in a shard.
BLOCK, SLOTS = 32, 2048
#: Times that a source's words may be taken.
REPEATS = 3
#: Documents of a source in a bundle, about, and shards in one: a running sum goes through a bundle within one task.
BUNDLE = 2000
#: Weights of the sources in order of their names, repeated.
WEIGHTS = (1, 2, 3)
#: Standard deviations of a source's drawn count that the closing shards can make up.
SPARE = 4.0
#: Rounds of the Feistel network; steps by which an index outside a source's blocks is led back.
ROUNDS, STEPS = 4, 32
_SEED = 7


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS) -> dict[str | None, float]:
    """Words to take from each source: shares by weight of all words, none above `repeats` times its size,
    the excess shared again by weight among the others."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    open_ = {s: (weights[i % len(weights)], n) for i, (s, n) in enumerate(ordered)}
    left, out = float(sum(n for _, n in sizes)), {}
    while open_:
        unit = left / sum(w for w, _ in open_.values())
        full = [s for s, (w, n) in open_.items() if w * unit > repeats * n]
        if not full:
            return out | {s: w * unit for s, (w, _) in open_.items()}
        for s in full:
            out[s] = float(repeats * open_.pop(s)[1])
            left -= out[s]
    return out


def _unit(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts, F.lit(_SEED)), F.lit(1 << 40)) / float(1 << 40)


def alias_table(weights: list[float]) -> list[tuple[int, float, int]]:
    """(cell, cut, other) for each of as many cells as there are weights: a draw of a uniform cell takes the cell's own
    number below its cut and the other above, which gives each number by its weight (Walker's method)."""
    n, total = len(weights), sum(weights)
    share = [w * n / total for w in weights]
    low, high = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
    out = {}
    while low and high:
        i, j = low.pop(), high.pop()
        out[i] = (i, share[i], j)
        share[j] -= 1 - share[i]
        (low if share[j] < 1 else high).append(j)
    return [out.get(i, (i, 1.0, i)) for i in range(n)]


def factors(n: int) -> tuple[int, int]:
    """Two factors near the root of n whose product is n or little more."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: Column, n: Column, a: Column, b: Column, *keys: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0 to n - 1, drawn by the keys. a, b: `factors` of n."""

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).alias("l"), F.pmod(x, b).alias("r"))
        # Sides change places; the side that is new belongs to a in even rounds and to b in odd ones.
        step = lambda s, k: F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, *keys, F.lit(_SEED)), F.when(k % 2 == 0, a).otherwise(b)), F.when(k % 2 == 0, a).otherwise(b)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])

    # Fewer than a indexes lie outside; a walk that meets one goes on until it is inside again.
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), once(x), lambda y, _: F.when(y < n, y).otherwise(once(y)))


def laid_out(docs: DataFrame, *, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size and `begins`, the place of a document's first word in its source, and `_row` to tell equal rows apart."""
    # Words are counted once: what follows reads numbers.
    rows = stored(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), n_words(F.col(text_col)).alias("_size"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(_SEED)).alias("_order")))
    n = max(1, math.ceil(rows.count() / BUNDLE))
    rows = rows.withColumn("_bundle", F.pmod("_order", F.lit(n)))
    sums = rows.groupBy("_source", "_bundle").agg(F.sum("_size").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bundle").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("_source").alias("_s"), F.col("_bundle").alias("_b"), F.coalesce("_before", F.lit(0)).alias("_before"))
    within = Window.partitionBy("_source", "_bundle").orderBy("_order", "_id")
    out = stored(
        rows.withColumn("_within", F.coalesce(F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_nth", F.row_number().over(within))
        .join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bundle") == F.col("_b")))
        .select("_id", "_source", "_size", "_order", "_bundle", "_nth", (F.col("_before") + F.col("_within")).alias("_begins"))
    )
    discard(rows)
    return out


def running(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows (of a number each of `order`, from 0) and `before`, the sum of `value` over smaller numbers of the same key, bundle by bundle."""
    rows = rows.withColumn("_u", F.floor(F.col(order) / BUNDLE))
    sums = rows.groupBy(key, "_u").agg(F.sum(value).alias("_sum"))
    before = sums.select(key, "_u", F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy(key, "_u").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(before, [key, "_u"]).withColumn("before", F.col("_before") + F.col("_within")).drop("_u", "_before", "_within")


def slots(spark: SparkSession, sizes: list[tuple[str | None, int]], wanted: dict[str | None, float], block: int = BLOCK) -> DataFrame:
    """shard, s (number of the source in order), t (the slot's number in its source), block: what fills the slots of each shard."""
    order = sorted(wanted, key=lambda s: (s is None, s or ""))
    have = dict(sizes)
    # A source's last block is short: its share of slots is raised so that its words come to the target.
    table = []
    for i, s in enumerate(order):
        n = math.ceil(have[s] / block)
        due = min(REPEATS * n, round(wanted[s] / have[s] * n)) if have[s] else 0
        if due:
            table.append((i, n, due, *factors(n)))
    if not table:
        return spark.range(0).selectExpr("id AS shard", "int(id) AS s", "id AS t", "id AS block")
    total = sum(x[2] for x in table)
    # A count drawn with probability p has a deviation below the root of (total * p); closing slots hold p times their number.
    closing = min(total, math.ceil(SPARE * math.sqrt(total * total / min(x[2] for x in table))))
    cells = alias_table([x[2] for x in table])
    drawn_from = spark.createDataFrame([(c, cut, table[c][0], table[other][0]) for c, cut, other in cells], "cell long, cut double, own int, other int")
    sources = F.broadcast(spark.createDataFrame(table, "s int, n long, due long, a long, b long"))  # a row a source
    draws = spark.range(total - closing).select("id", F.floor(F.col("id") / SLOTS).alias("shard"), F.pmod(F.xxhash64("id", F.lit("cell"), F.lit(_SEED)), F.lit(len(cells))).alias("cell"))
    draws = draws.join(F.broadcast(drawn_from), "cell").select("shard", F.when(_unit("id") < F.col("cut"), F.col("own")).otherwise(F.col("other")).alias("s"))
    drawn = stored(draws.groupBy("shard", "s").agg(F.count("*").alias("m")))
    counts = stored(running(drawn, "s", "shard", "m").where("m > 0"))
    discard(drawn)
    got = counts.groupBy("s").agg(F.sum("m").alias("got"))
    first = math.ceil((total - closing) / SLOTS)
    left = sources.join(got, "s", "left").select("s", F.coalesce("got", F.lit(0)).alias("got"), (F.col("due") - F.coalesce("got", F.lit(0))).alias("left")).where("left > 0")
    rest = left.select("s", "got", "left", F.explode(F.sequence(F.lit(0), F.floor((F.col("left") - 1) / SLOTS))).alias("k"))
    rest = rest.select((F.col("k") + first).alias("shard"), "s", F.least(F.lit(SLOTS), F.col("left") - F.col("k") * SLOTS).alias("m"), (F.col("got") + F.col("k") * SLOTS).alias("before"))
    # A row here is up to SLOTS rows below: dealt to all tasks, as so few rows would else be put into one.
    every = counts.select("shard", "s", "m", "before").unionByName(rest).repartition(parallelism(spark), "shard", "s")
    one = every.join(sources, "s").select("shard", "s", "n", "a", "b", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("m") - 1)).alias("t"))
    # No slot beyond `REPEATS` rounds: a draw may pass what a source has.
    one = one.where(F.col("t") < REPEATS * F.col("n"))
    index = permuted(F.pmod("t", F.col("n")), F.col("n"), F.col("a"), F.col("b"), F.col("s"), F.floor(F.col("t") / F.col("n")))
    return one.select("shard", "s", "t", index.alias("block"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS, block: int = BLOCK) -> DataFrame:
    """_id, _source, _size, _order, _begins, source_size, target, taken and `times` (how often each block that the
    document touches is drawn, in order) for each row of `docs`."""
    spark = docs.sparkSession
    placed = laid_out(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    # One row a source: names of sources are few beside documents.
    sizes = [(r["_source"], int(r["n"])) for r in placed.groupBy("_source").agg(F.sum("_size").alias("n")).collect()]
    wanted = targets(sizes, weights, repeats)
    order = sorted(wanted, key=lambda s: (s is None, s or ""))
    have = dict(sizes)
    table = spark.createDataFrame([(s, i, have[s], float(wanted[s])) for i, s in enumerate(order)], "_s string, s int, source_size long, target double")
    placed = placed.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    drawn = stored(slots(spark, sizes, wanted, block).groupBy("s", "block").agg(F.count("*").alias("times")))
    key = ["_id", "_order", "_bundle", "_nth", "s"]
    ends = F.col("_begins") + F.col("_size")
    touched = placed.where("_size > 0").select(*key, "_begins", ends.alias("_ends"), F.explode(F.sequence(F.floor(F.col("_begins") / block), F.floor((ends - 1) / block))).alias("block"))
    overlap = F.least("_ends", (F.col("block") + 1) * block) - F.greatest("_begins", F.col("block") * block)
    taken = stored(touched.join(drawn, ["s", "block"]).groupBy("_order", "_bundle", "_nth", "s").agg(F.sum(overlap * F.col("times")).alias("taken"), F.map_from_entries(F.collect_list(F.struct("block", "times"))).alias("times")))
    discard(drawn)
    back = placed.join(taken, ["_order", "_bundle", "_nth", "s"], "left")
    return back.select("_id", "_source", "_size", "_order", "_begins", "_bundle", "_nth", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "times")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken")
