"""Near-duplicates by b-bit MinHash.

Documents with equal sets of shingles form a class, and one member stands for it. Minima of `SKETCH` hash
functions give `BANDS` band keys; of each minimum `BITS` low bits are kept and packed. Documents that share a
band key are candidates; the packed signatures' equal groups of bits, less those equal by chance, estimate the
similarity, and pairs that can still reach the threshold are confirmed on their full sets.

Candidates come in rounds, so that a large bucket never turns into all its pairs: first each document meets one
member of another component in a bucket of its own, three times over, and confirmed links are joined to components;
then only members of one bucket that still lie in different components meet, tile by tile. In buckets of more than
`FEW` members a tile also holds the `LEAST` smallest shingle hashes of each: where that is the whole of both sets, a
pair is confirmed within its tile, so that only links leave it; larger sets are estimated from the common part, and
those pairs that can still reach the threshold are confirmed like all others. No link between components is left out. A pair at the threshold
shares no band with a probability of (1 - 0.85**4)**24, about 2e-8 (similarity 0.8: (1 - 0.8**4)**24, 3e-6, for
which the pipeline takes 32 bands: 5e-8).

Texts that are null or without words have empty sets and are linked with nothing. Fewer words than a shingle has
form one shingle. Rows that share an id, or have a null id, are returned each; links of an id count for all its rows.
Until the links are found, a text goes by w, 64 bits of hash, so that each text of a repeated id is compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import discard, documents, slices, small_batches, stored
from logweir.llm.words import hashed_words, mix, shingle_hashes

ROWS, BANDS, BITS = 4, 24, 4
#: Minima whose low bits are kept; the bands use the first of them.
SKETCH = 256
#: Members of a bucket in a tile.
TILE = 256
#: Members of a bucket up to which its pairs leave the tile unconfirmed: at most (FEW - 1) / 2 for each row.
FEW = 16
#: Smallest shingle hashes of a set that a tile holds.
LEAST = 512
#: Ids up to which a semi join broadcasts them, about 32 MB; beyond, both sides are shuffled.
SENT = 1_000_000
#: A class is hot with more than one in so many rows: fewer than so many are, and those are broadcast.
HOT_SHARE = 1000
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 5.0


def _sets(texts: list[str | None], size: int):
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    for a, b in slices(np.array([len(t) for t in raw]), 1_000_000):
        _, _, _, hashes, first = hashed_words(raw[a:b])
        for i in range(b - a):
            yield np.unique(shingle_hashes(hashes[first[i] : first[i + 1]], size))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return a | np.uint64(1), mix(a)


def _minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(items), 1024):
        h = np.multiply.outer(a, items[s : s + 1024])
        h += b[:, None]
        np.minimum(out, h.min(1), out=out)
    return out


def _packed_bits(minima: np.ndarray) -> bytes:
    """The low bits of each minimum (after mixing), two minima to a byte."""
    low = (mix(minima) & np.uint64(15)).astype(np.uint8)
    return (low[::2] | (low[1::2] << 4)).tobytes()


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities of packed signatures, row by row, corrected for equality by chance."""
    d = x ^ y
    same = ((d & 15) == 0).sum(-1) + ((d >> 4) == 0).sum(-1)
    chance = 2.0**-BITS
    return (same / (2 * x.shape[-1]) - chance) / (1 - chance)


def _least(threshold: float, n: int) -> float:
    p = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - SLACK * (p * (1 - p) / n) ** 0.5 / (1 - 2.0**-BITS)


def signatures(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, bands: int) -> DataFrame:
    """id, w (hash of the text), n (set size), same (digest of the set), sig and bands (keys), a row for each row of `docs`."""

    def run(batches):
        a, b = _functions(max(SKETCH, ROWS * bands))
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for rows in batches:
            n, same, sig, keys = [], [], [], []
            for items in _sets(rows.column(2).to_pylist(), shingle):
                n.append(len(items))
                if not len(items):
                    same.append(None), sig.append(None), keys.append(None)
                    continue
                same.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                m = _minima(items, a, b)
                sig.append(_packed_bits(m[:SKETCH]))
                k = salt.copy()
                for c in m[: ROWS * bands].reshape(bands, ROWS).T:
                    k = mix(k * np.uint64(0xD6E8FEB86659FD93) + c)
                keys.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "w", "n", "same", "sig", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("w"), F.col(text_col).alias("t")).mapInArrow(run, "id long, w long, n long, same binary, sig binary, bands array<long>")


def _among(rows: DataFrame, wanted: DataFrame, key: str = "w") -> DataFrame:
    """Those rows whose key is in `wanted`, without shuffling the rows where few enough are wanted."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, key, "left_semi")


def _by_class(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """rows (which have `same`) with the columns of their class. classes: same, copies and more. Hot classes are broadcast, as
    all their rows would meet in one task; the rows of the others are shuffled."""
    hot = F.col("copies") > max(1, total / HOT_SHARE)
    few = F.broadcast(classes.where(hot).drop("copies"))
    rest = rows.join(few.select("same"), "same", "left_anti").join(classes.where(~hot).drop("copies"), "same")
    return rows.join(few, "same").unionByName(rest)


def _sets_of(wanted: DataFrame, pool: DataFrame, *, shingle: int, most: int | None = None) -> DataFrame:
    """w and s (the sorted hashes of its set, or the `most` smallest of them) of each w in `wanted`. pool: w, t (text)."""
    chosen = _among(pool, wanted).dropDuplicates(["w"])

    def run(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s[:most].tobytes() for s in _sets(rows.column(1).to_pylist(), shingle)], pa.binary())], names=["w", "s"])

    return stored(chosen.mapInArrow(run, "w long, s binary"))


def _reach(k: int, others: np.ndarray, flat: np.ndarray, ends: np.ndarray, mark: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of `others` can be linked with k, and for which of those that is certain. flat: each member's smallest
    hashes as ranks, in order, up to its place in `ends`; mark: zeros, as many as there are ranks."""
    mine = flat[ends[k] : ends[k + 1]]
    have = np.diff(ends)
    lengths = have[others]
    first = np.cumsum(lengths) - lengths
    theirs = flat[np.repeat(ends[others] - first, lengths) + np.arange(lengths.sum())]
    mark[mine] = 1
    common = np.add.reduceat(mark[theirs], first)
    mark[mine] = 0
    # Of a pair, all is known up to the last hash that each has, or to the end where a set is whole.
    known = np.where(have < n, flat[ends[1:] - 1], len(mark))
    upto = np.minimum(known[others], known[k])
    union = np.add.reduceat((theirs <= np.repeat(upto, lengths)).astype(np.int64), first) + np.searchsorted(mine, upto, "right") - common
    whole = upto == len(mark)
    p = percent / 100
    return np.where(whole, 100 * common >= percent * union, common >= (p - SLACK * (p * (1 - p) / union) ** 0.5) * union), whole


def _confirmed(pairs: DataFrame, pool: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()

    def check(batches):
        for rows in batches:
            x, y = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            keep = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = _sets_of(wanted, pool, shingle=shingle)
    both = pairs.join(sets.select(F.col("w").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("w").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")
    out = stored(both.mapInArrow(check, "a long, b long"))
    discard(sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """id and root (the smallest id reachable) of each id in `edges` (a, b), by hooking to the smallest neighbour,
    jumping pointers and contracting; each step is a written table."""
    left = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("u", "v"))
    total = None
    while not left.isEmpty():
        p = stored(left.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")))
        while True:
            q = p.select(F.col("u").alias("p"), F.col("p").alias("next"))
            jumped = stored(p.join(q, "p").select("u", F.col("next").alias("p"), (F.col("next") != F.col("p")).alias("moved")))
            done = jumped.where("moved").isEmpty()
            discard(p)
            p = jumped.select("u", "p")
            if done:
                break
        before = total
        if before is None:
            total = stored(p.select(F.col("u").alias("id"), F.col("p").alias("root")))
        else:
            total = stored(before.join(p.select(F.col("u").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root")))
            discard(before)
        x, y = p.select("u", F.col("p").alias("pu")), p.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        rest = stored(left.join(x, "u").join(y, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
        discard(left)
        discard(p)
        left = rest
    return total if total is not None else left.select(F.col("u").alias("id"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32) -> DataFrame:
    """id, n_shingles, component_id and kept (whether the id is its component's smallest), a row for each row of `docs`."""
    small_batches(docs.sparkSession, 256)
    table = stored(signatures(docs, id_col=id_col, text_col=text_col, shingle=shingle, bands=bands))
    known = table.where("n > 0 and id is not null")
    # A third of all rows may be copies of one text: they are brought together before they are shuffled. One text stands for
    # a class until its links are found; `rep`, the smallest id, leads back from it to the ids.
    one = F.min_by(F.struct("w", "n", "sig", "bands"), "w")
    classes = stored(known.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), one.alias("one")).select("same", "rep", "copies", "one.*"))
    total = classes.agg(F.sum("copies").alias("n")).first()["n"] or 0
    rep_of = classes.select("w", "rep")
    keys = stored(classes.select(F.col("w").alias("id"), F.explode("bands").alias("key")))
    large = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = stored(keys.join(large, "key"))
    discard(keys)
    # The texts that any later step can ask for.
    pool = stored(_among(docs.select(F.xxhash64(text_col).alias("w"), F.col(text_col).alias("t")), shared.select(F.col("id").alias("w")).distinct()))
    sig = classes.select(F.col("w").alias("id"), "n", "sig")
    least, width = _least(percent / 100, SKETCH), SKETCH * BITS // 8

    def near(batches):
        for rows in batches:
            x = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(-1, width)
            y = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"]).filter(pa.array(estimate(x, y) >= least))

    how = {"shingle": shingle, "percent": percent}
    links, tested, placed, spent = None, None, shared.withColumn("root", F.col("id")), [shared, pool]
    for pick in (F.min, F.max, lambda x: F.min_by(x, F.xxhash64(x))):
        # Each document that shares a bucket with another component meets one member of one such.
        pivot = placed.groupBy("key").agg(pick(F.struct("id", "root")).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "p")
        # Written, so that the join below reads plain shuffles, whose skewed parts the engine can split at a hot key.
        pivot = stored(pivot)
        spent.append(pivot)
        pairs = placed.join(pivot, "key").where(F.col("root") != F.col("p.root")).groupBy("id").agg(F.min("p.id").alias("p"))
        pairs = pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
        pairs = pairs.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        pairs = stored(pairs.select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long"))
        found = _confirmed(pairs, pool, **how)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        joined = components(links)
        spent.append(joined)
        placed = shared.join(joined, "id", "left").withColumn("root", F.coalesce("root", "id")).select("key", "id", "m", "root")
    # Last, all members of one bucket that are still apart.
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    apart = stored(apart)
    spent.append(apart)
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    open_ = stored(placed.join(apart, "key").withColumn("t", F.pmod(F.xxhash64("id"), tiles).cast("int")))
    low = _sets_of(open_.where(F.col("m") > FEW).select(F.col("id").alias("w")).distinct(), pool, shingle=shingle, most=LEAST)
    held = open_.join(sig, "id").join(low.select(F.col("w").alias("id"), "s"), "id", "left").withColumn("s", F.when(F.col("m") > FEW, F.col("s")))
    met = held.select("key", "id", "root", "n", "sig", "s", "t", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("o"))
    met = met.groupBy("key", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y")).agg(F.collect_list(F.struct("id", "root", "n", "sig", "s")).alias("g"))

    def across(batches):
        for rows in batches:
            first, second, certain = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            column = rows.column(0)
            flat, ends = column.flatten(), column.offsets.to_numpy()
            ids, roots, sizes = (flat.field(i).to_numpy() for i in (0, 1, 2))
            sigs, lows = flat.field(3).to_pylist(), flat.field(4).to_pylist()
            ends = ends - ends[0]
            for s, e in zip(ends[:-1], ends[1:]):
                i, r, n = ids[s:e], roots[s:e].copy(), sizes[s:e]
                g = np.frombuffer(b"".join(sigs[s:e]), np.uint8).reshape(e - s, -1)
                small = [np.frombuffer(x, np.uint64) for x in lows[s:e] if x]
                has = len(small) == e - s
                if has:
                    values, ranks = np.unique(np.concatenate(small), return_inverse=True)
                    mark, bounds = np.zeros(len(values), np.int64), np.cumsum([0] + [len(x) for x in small])
                for k in range(e - s - 1):
                    fits = 100 * np.minimum(n[k + 1 :], n[k]) >= percent * np.maximum(n[k + 1 :], n[k])
                    other = np.flatnonzero((r[k + 1 :] != r[k]) & fits) + k + 1
                    other = other[estimate(g[other], g[k]) >= least]
                    if not len(other):
                        continue
                    sure = np.zeros(len(other), bool)
                    if has:
                        may, whole = _reach(k, other, ranks, bounds, mark, n, percent)
                        other, sure = other[may], whole[may]
                        # Those that a certain link joins need no other link in this tile.
                        own, at = r[k], np.flatnonzero(sure)
                        at = at[np.unique(r[other[at]], return_index=True)[1]]
                        keep = ~np.isin(r[other], r[other[at]])
                        keep[at] = True
                        r[np.isin(r, r[other[at]])] = own
                        other, sure = other[keep], sure[keep]
                    first.append(np.minimum(i[other], i[k]))
                    second.append(np.maximum(i[other], i[k]))
                    certain.append(sure)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second)), pa.array(np.concatenate(certain))], names=["a", "b", "sure"])

    more = stored(met.select("g").mapInArrow(across, "a long, b long, sure boolean").distinct())
    rest = stored(more.where("not sure").select("a", "b").join(tested, ["a", "b"], "left_anti"))
    last = _confirmed(rest, pool, **how)
    linked = links.union(more.where("sure").select("a", "b")).union(last)
    linked = linked.join(rep_of.toDF("a", "ra"), "a").join(rep_of.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # Ids with texts of several classes link these; all others go by their class.
    digest = F.xxhash64("same")
    several = known.groupBy("id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("id")
    bridges = _by_class(_among(known.select("id", "same"), several, "id").distinct(), classes.select("same", "copies", "rep"), total)
    roots = components(linked.union(bridges.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    homes = stored(classes.select("same", "copies", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("same", "copies", F.coalesce("root", "rep").alias("root")))
    for frame in (*spent, links, tested, open_, low, more, rest, last, roots):
        discard(frame)
    found = _by_class(known.select("id", "n", "same"), homes, total).select("id", "n", "root")
    # Rows without words go with the other texts of their id, if it has any.
    bare = table.where("n = 0 and id is not null").select("id", "n")
    others = _by_class(_among(known.select("id", "same"), bare.select("id").distinct(), "id"), homes, total).groupBy("id").agg(F.min("root").alias("root"))
    out = found.unionByName(bare.join(others, "id", "left")).unionByName(table.where("id is null").select("id", "n", F.lit(None).cast("long").alias("root")))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=3, percent=85, bands=BANDS)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(x) >= 3 THEN list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2])
                               WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least_ AS component_id, doc_id = least_ AS kept
FROM (SELECT a AS doc_id, min(b) AS least_ FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
"""
