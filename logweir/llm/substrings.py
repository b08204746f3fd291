"""Substring dedup by anchors and ranks of fixed depth, in place of prefix-partitioned suffix trees (README).

A repeat of `WINDOW` words holds, at the same place in each copy, the run of `GRAM` words whose hash is least: its
anchor. So suffixes that begin elsewhere need no tree of their own, and anchors that occur in one document only need
none at all. What is left is split by variable-length prefixes: an anchor's words where few occurrences share them,
a whole window's words where many do; prefixes are dealt into groups that fit into memory. In each group the
suffixes are ranked word by word, doubling the length (two ranks make the next level's), which gives the subtree's
nodes level by level; the nodes at depth `WINDOW` that gather suffixes of several documents are the deep internal
nodes, and their leaves are the maximal repeats' places. Each such leaf but those of the node's smallest document
is covered.

Documents are dealt into blocks of about `BLOCK_CHARS` characters; a block sends each context once with the places
that hold it, so that a hot passage costs a row a block and not a row a document.

Null texts have no words. Texts of fewer words than a window lose none. Rows that share an id count as one document
where documents are compared, and are returned each. Ids are integers; a null id counts as smaller than any other. Columns
other than id and text are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import documents, slices, small_batches
from logweir.llm.words import hashed_words, shingle_hashes

WINDOW, GRAM = 13, 6
BLOCK_CHARS = 4_000_000
#: Bits of an anchor's hash that a block sends; blocks that share a prefix from which on it is lengthened.
BITS, HOT = 40, 64
_LOW = -(2**63)


def _least(x: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours, by doubling."""
    step = 1
    while step * 2 <= wide:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (wide - step)], x[wide - step :]) if step < wide else x


class _Anchored:
    """Words of several texts at once, and the runs of windows with the same anchor: key, first and last window (as words
    of all texts), and text of each."""

    def __init__(self, texts: list[bytes]) -> None:
        self.joined, self.starts, self.ends, hashes, self.first = hashed_words(texts)
        none = np.zeros(0, np.int64)
        self.key, self.low, self.high, self.doc = none.astype(np.uint64), none, none, none
        if len(hashes) < WINDOW:
            return
        doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        least = _least(shingle_hashes(hashes, GRAM), WINDOW - GRAM + 1)
        at = np.flatnonzero(doc[: len(least)] == doc[WINDOW - 1 :])
        if not len(at):
            return
        # Windows of one text follow each other; between texts some are missing.
        new = np.concatenate([[True], (np.diff(at) != 1) | (least[at][1:] != least[at][:-1])])
        runs = np.flatnonzero(new)
        self.low, self.high = at[runs], at[np.concatenate([runs[1:], [len(at)]]) - 1]
        self.key, self.doc = least[self.low] >> np.uint64(64 - BITS), doc[self.low]


def _anchored(texts: list[bytes]):
    """(number of the first text, _Anchored) for texts in batches of bounded size, or of one text."""
    for a, b in slices(np.array([len(t) for t in texts]), 1_000_000):
        yield a, _Anchored(texts[a:b])


def _covered(pieces: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subtree of one group. pieces: words of each context; low, high: the least and greatest document that holds it.
    Returns the windows whose node is deep and holds a document smaller than one of the context's: context, place in it,
    the node's smallest document."""
    flat, lengths = [], []
    for a, b in slices(np.array([len(p) for p in pieces]), 1_000_000):  # hashing takes some 50 bytes a byte
        _, _, _, hashes, begins = hashed_words(pieces[a:b])
        flat.append(hashes)
        lengths.append(np.diff(begins))
    flat, lengths = np.concatenate(flat), np.concatenate(lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])
    # Ranks of prefixes of 1, 2, 4, 8 and WINDOW words, level by level; a run's last places reach past its end and are not asked for.
    def level(x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        n = min(len(x), len(y) - step)
        pair = x[:n] * np.int64(int(y.max(initial=0)) + 1) + y[step : step + n]
        return np.unique(pair, return_inverse=True)[1]

    rank = np.unique(flat, return_inverse=True)[1]
    ranks, depth = {1: rank}, 1
    while depth * 2 <= WINDOW:
        rank = level(rank, rank, depth)
        depth *= 2
        ranks[depth] = rank
    # Of two prefixes that overlap, the longest is known already: one level more for all depths in between.
    if depth < WINDOW:
        rank = level(rank, rank, WINDOW - depth)
    n = lengths - WINDOW + 1
    run = np.repeat(np.arange(len(pieces)), n)
    shift = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    node = rank[first[:-1][run] + shift]
    least = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, low[run])
    some = np.flatnonzero(least[node] < high[run])
    return run[some], shift[some], least[node[some]]


def covered_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, spans (first word and word after the last of each run of covered words, which are the union
    of the document's repeats) and kept_sha256 (of the kept words joined by a blank), a row for each row of `docs`."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n_blocks = max(1, math.ceil(total / BLOCK_CHARS))
    n_groups = max(1, n_blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "t", F.lit("block")), F.lit(n_blocks)).cast("int"))

    def in_order(table: pa.Table) -> tuple[np.ndarray, list[bytes], pa.Table]:
        ids = np.array([_LOW if x is None else x for x in table.column("id").to_pylist()], np.int64)
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in table.column("t").to_pylist()]
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), np.int64)
        return ids[order], [texts[i] for i in order], table.take(pa.array(order))

    def keys_of(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor keys of a block, sorted, and whether several of its documents hold each."""
        keys, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for begin, x in _anchored(texts):
            keys.append(x.key)
            doc.append(ids[begin + x.doc])
        keys, doc = np.concatenate(keys), np.concatenate(doc)
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], doc[order]
        if not len(keys):
            return keys, np.zeros(0, bool)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.flatnonzero(new)
        return keys[at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)

    def send(table: pa.Table) -> pa.Table:
        """A block's keys, cut by range into the groups, five bytes each, with a bit for those it already shares."""
        ids, texts, _ = in_order(table)
        keys, inner = keys_of(ids, texts)
        group = (keys.astype(object) * n_groups >> BITS).astype(np.int64) if len(keys) and n_groups > 1 << 20 else ((keys >> np.uint64(BITS - 32)) * np.uint64(n_groups) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(group)) + 1
        parts = np.split(np.arange(len(keys)), cuts) if len(keys) else []
        packed = [np.ascontiguousarray(keys[p].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for p in parts]
        return pa.table({"group": pa.array([int(group[p[0]]) for p in parts], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int32()), "keys": pa.array(packed, pa.binary()), "inner": pa.array([np.packbits(inner[p]).tobytes() for p in parts], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        """Of each block's keys in a group: 0 in one document, 1 in several, 2 in so many blocks that its prefix is lengthened."""
        blocks = []
        for x, y in zip(table.column("keys").to_pylist(), table.column("inner").to_pylist()):
            raw = np.zeros((len(x) // 5, 8), np.uint8)
            raw[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
            blocks.append((raw.view("<u8").ravel(), np.unpackbits(np.frombuffer(y, np.uint8))[: len(raw)]))
        keys = np.concatenate([k for k, _ in blocks])
        uniq, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        inner = np.zeros(len(uniq), bool)
        np.logical_or.at(inner, inverse, np.concatenate([i for _, i in blocks]).astype(bool))
        state = np.where(count >= HOT, 2, np.where((count > 1) | inner, 1, 0)).astype(np.uint8)[inverse]
        ends = np.cumsum([0] + [len(k) for k, _ in blocks])
        return pa.table({"block": table.column("block"), "group": table.column("group"), "state": pa.array([np.packbits(np.stack([state[a:b] >> 1, state[a:b] & 1], 1)).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()), "n": pa.array(np.diff(ends), pa.int32())})

    def contexts(table: pa.Table, replies: pa.Table) -> pa.Table:
        """What a block's shared anchors stand in: words, and the places (document, first word) of each distinct context."""
        number: dict[bytes, int] = {}
        group: list[int] = []
        held = [np.zeros((0, 4), np.int64)]  # context, position of the document, document, first word
        ids, texts, _ = in_order(table)
        if len(ids) and replies.num_rows:
            keys, _ = keys_of(ids, texts)
            order = np.argsort(replies.column("group").to_numpy())
            bits, n = replies.column("state").to_pylist(), replies.column("n").to_pylist()
            state = np.concatenate([np.unpackbits(np.frombuffer(bits[i], np.uint8))[: 2 * n[i]].reshape(-1, 2) @ np.array([2, 1], np.uint8) for i in order])
            for begin, x in _anchored(texts):
                if not len(x.key):
                    continue
                st = state[np.searchsorted(keys, x.key)]
                for kind in (1, 2):
                    at = np.flatnonzero(st == kind)
                    low, high, key, doc = x.low[at], x.high[at], x.key[at], x.doc[at]
                    if kind == 2:  # a longer prefix: each window by itself, dealt by all its words
                        many = high - low + 1
                        low = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        high, key, doc = low, np.repeat(key, many), np.repeat(doc, many)
                    pieces = [x.joined[i:j] for i, j in zip(x.starts[low].tolist(), x.ends[high + WINDOW - 1].tolist())]
                    which = [number.setdefault(p, len(number)) for p in pieces]
                    for c, p, k in zip(which, pieces, key.tolist()):
                        if c == len(group):
                            group.append(k * n_groups >> BITS if kind == 1 else int.from_bytes(hashlib.blake2b(b" ".join(p.split()), digest_size=8).digest(), "big") * n_groups >> 64)
                    held.append(np.stack([np.array(which, np.int64), begin + doc, ids[begin + doc], low - x.first[doc]], 1))
        block = table.column("block")[0].as_py() if table.num_rows else 0
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        places, groups, pieces = np.concatenate(held), np.array(group, np.int64), list(number)
        by_group = np.argsort(groups, kind="stable")
        rank = np.empty(len(groups), np.int64)
        rank[by_group] = np.arange(len(groups))
        places = places[np.argsort(rank[places[:, 0]], kind="stable")]
        counts = np.bincount(rank[places[:, 0]], minlength=len(groups))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(groups[by_group])) + 1, [len(groups)]]) if len(groups) else np.zeros(1, np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)])
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            mine = [pieces[i] for i in by_group[a:b].tolist()]
            text = b"\0".join(mine)
            framed = text.count(b"\0") != len(mine) - 1
            rows.append((int(groups[by_group[a]]), block, z.compress(_framed(mine) if framed else text), framed, counts[a:b].astype(np.int32), z.compress(np.ascontiguousarray(places[upto[a] : upto[b], 1:]).tobytes())))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.binary())
        names = ["group", "block", "text", "framed", "counts", "places"]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

    def grow(table: pa.Table) -> pa.Table:
        """A group's subtree; returns to each block the covered windows: position of the document in the block, first word."""
        import zstandard

        z = zstandard.ZstdDecompressor()
        pieces, count, owner, where = [], [], [], []
        for b, t, framed, counts, places in zip(*(table.column(c).to_pylist() for c in ("block", "text", "framed", "counts", "places"))):
            pieces += _unframed(z.decompress(t)) if framed else z.decompress(t).split(b"\0")
            count += counts
            where.append(np.frombuffer(z.decompress(places), np.int64).reshape(-1, 3))
            owner.append(np.full(len(where[-1]), b))
        count = np.array(count)
        places, owner = np.concatenate(where), np.concatenate(owner)
        begins = np.cumsum(count) - count
        run, shift, least = _covered(pieces, np.minimum.reduceat(places[:, 1], begins), np.maximum.reduceat(places[:, 1], begins))
        # Each window found, for each occurrence of its run.
        n = count[run]
        occurrence = np.repeat(begins[run], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        later = np.repeat(least, n) < places[occurrence, 1]
        occurrence, first = occurrence[later], np.repeat(shift, n)[later]
        hit = np.stack([places[occurrence, 0], places[occurrence, 2] + first], 1)
        of = owner[occurrence]
        out: dict[int, list[np.ndarray]] = {int(b): [hit[of == b]] for b in np.unique(of)}
        zc = zstandard.ZstdCompressor(level=1)
        return pa.table({"block": pa.array(list(out), pa.int32()), "hits": pa.array([zc.compress(np.concatenate(x).astype(np.int32).tobytes()) for x in out.values()], pa.binary())})

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        """A block's documents without the words that covered windows hold."""
        import zstandard

        z = zstandard.ZstdDecompressor()
        ids, texts, ordered = in_order(table)
        hits = np.concatenate([np.zeros((0, 2), np.int32), *[np.frombuffer(z.decompress(x), np.int32).reshape(-1, 2) for x in replies.column("hits").to_pylist()]])
        hits = hits[np.argsort(hits[:, 0], kind="stable")]
        first = np.searchsorted(hits[:, 0], np.arange(len(texts) + 1))
        n, gone, sha, spans = [], [], [], []
        for i, t in enumerate(texts):
            words = t.split()
            n.append(len(words))
            h = hits[first[i] : first[i + 1], 1]
            if not len(h):
                gone.append(0)
                spans.append([])
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                continue
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, h, 1)
            np.add.at(edge, h + WINDOW, -1)
            stays = np.cumsum(edge[:-1]) == 0
            gone.append(int((~stays).sum()))
            turns = np.flatnonzero(np.diff(np.concatenate([[True], stays, [True]])))
            spans.append(turns.reshape(-1, 2).tolist())
            sha.append(hashlib.sha256(b" ".join([words[j] for j in np.flatnonzero(stays)])).hexdigest())
        return pa.table({"id": ordered.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "kept_sha256": pa.array(sha, pa.string())})

    by_block = rows.groupBy("block")
    sent = by_block.applyInArrow(send, "group int, block int, keys binary, inner binary")
    states = sent.groupBy("group").applyInArrow(shared, "block int, group int, state binary, n int")
    context = by_block.cogroup(states.groupBy("block")).applyInArrow(contexts, "group int, block int, text binary, framed boolean, counts array<int>, places binary")
    hits = context.groupBy("group").applyInArrow(grow, "block int, hits binary")
    out = by_block.cogroup(hits.groupBy("block")).applyInArrow(cut, "id long, n_words long, n_removed long, spans array<array<int>>, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _framed(pieces: list[bytes]) -> bytes:
    """Pieces that hold zero bytes, each after its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in pieces)


def _unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered_words(documents(spark, sf_dir)).drop("spans")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
wins AS (
  SELECT r, doc_id, i, words[i:i + 12] AS g FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
firsts AS (SELECT g, min(doc_id) AS low FROM wins GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM wins JOIN firsts USING (g) WHERE doc_id > low)),
flat AS (SELECT r, doc_id, p, words[p] AS x FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM w)),
kept AS (
  SELECT flat.r, count(*) AS n_kept, string_agg(x, ' ' ORDER BY p) AS t FROM flat ANTI JOIN gone USING (r, p) GROUP BY flat.r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
