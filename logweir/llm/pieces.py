"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's best path of pieces is the one of highest total score. A giant text is cut into chunks. Between chunks the
state is the overhang: by how many code points the piece that crosses the border passes it. Each chunk yields the
matrix of best scores from every overhang at its begin to every overhang at its end. Matrices combine associatively
under (max, +), here in a tree: products of `FAN` neighbours level by level up to one matrix a text, then down again,
where each node's two ends are known and fix the borders within it. From its two ends every chunk traces its own
pieces back. No task holds more than `FAN` matrices or one chunk.

Scores: models of the unigram kind are taken at their word. A model of the BPE kind has only ranks of merges, which add
up to nothing; a piece of rank r scores -log(r + `OFFSET`), its log-probability under the Zipf-Mandelbrot law, with
nothing trained. The path does not replay merges: README says how often it agrees with them. Scores are integers in
units of 2**-28; each piece adds a hash of 20 bits of where it begins, which parts ties alike for every choice of chunks.
A code point outside the vocabulary costs the least score less ten and becomes its bytes.

No path crosses two characters that stand side by side in no piece. There a text falls into atoms, whose best paths are
found once and remembered; in matrices such places are states with no overhang.

Null texts count as empty and have no pieces. Texts are read whole; decoding gives back every text exactly, also
one that holds U+2581, which is written as bytes. Repeated rows are encoded each for itself. Ids are integers; columns
other than id and text are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
import sys
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import documents, small_batches, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points from which on a text is encoded chunk by chunk, and in a chunk; neighbours that a node of the tree combines.
GIANT, CHUNK, FAN = 65536, 16384, 64
#: Added to a merge's rank under the Zipf-Mandelbrot law.
OFFSET = 100
#: Bytes of atoms and their ids that a worker remembers, about; code points of an atom that it remembers.
REMEMBERED, SHORT = 100_000_000, 64
_UNIT = 1 << 28
_BLANK = "▁"
#: Stands for U+2581 in a text; no text from Spark can hold a lone surrogate.
_LITERAL = "\udc81"
_NONE = -(1 << 61)


def load(model_file: str = MODEL) -> dict:
    """Vocabulary of a model file: weights and ids by piece, bytes of each id, the longest piece, pairs of characters within pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    score, ids, raw, byte_ids = {}, {}, [], {}
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            raw.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            raw.append(b"")
        else:
            score[p], ids[p] = m.get_score(i), i
            raw.append(p.replace(_BLANK, " ").encode())
    if len(byte_ids) < 256:
        raise ValueError("the model has no pieces for bytes")
    # Models of the BPE kind number their merges: 0, -1, -2 and so on; pieces that take part last share one low number.
    if all(x <= 0 and x == int(x) for x in score.values()):
        order = sorted(score, key=lambda p: (-score[p], ids[p]))
        score = {p: -math.log(OFFSET + r) for r, p in enumerate(order)}
    weight = {p: round(s * _UNIT) for p, s in score.items()}
    pairs = sorted({p[k : k + 2] for p in weight for k in range(len(p) - 1)})
    return {"weight": weight, "ids": ids, "raw": raw, "byte_ids": byte_ids, "longest": max(map(len, weight)), "unknown": min(weight.values()) - 10 * _UNIT, "pairs": pairs}


def marked(text: str) -> str:
    """The text as pieces write it: a blank before it, blanks as U+2581."""
    return _BLANK + text.replace(_BLANK, _LITERAL).replace(" ", _BLANK) if text else ""


def tie(place: int) -> int:
    """What a piece that begins so many code points into its atom adds to parts ties."""
    return crc32(place.to_bytes(8, "little")) & 0xFFFFF if place else 0


def decode_bytes(ids: bytes, raw: list[bytes]) -> str:
    """The text of ids: their bytes in a row, without the blank that stands before every text."""
    return b"".join([raw[i] for i in np.frombuffer(ids, np.uint32).tolist()])[1:].decode("utf-8", "replace")


class Encoder:
    """A vocabulary made ready, and what a worker process remembers of it; Spark uses a process again, so that outlives a task."""

    def __init__(self, v: dict) -> None:
        import ahocorasick

        self.v, self.n = v, v["longest"]
        self.finder = ahocorasick.Automaton()
        for p, w in v["weight"].items():
            self.finder.add_word(p, (len(p), w))
        self.finder.make_automaton()
        letters = sorted({c for pair in v["pairs"] for c in pair})
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.wide = len(letters) + 1
        self.apart = np.ones(self.wide**2, bool)
        self.apart[[number[a] * self.wide + number[b] for a, b in v["pairs"]]] = False
        self.singles = frozenset(p for p in v["weight"] if len(p) == 1)
        self.ties = [tie(k) for k in range(SHORT + 1)]
        self.known: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, v: dict) -> Encoder:
        kept = sys.__dict__.setdefault("_logweir_encoders", {})
        key = (len(v["ids"]), sum(v["weight"].values()))
        if key not in kept:
            kept[key] = cls(v)
        return kept[key]

    def cuts(self, s: str) -> np.ndarray:
        """The places within a marked text that every path passes."""
        k = self.number.take(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32))
        return np.flatnonzero(self.apart.take(k[:-1] * np.int32(self.wide) + k[1:])) + 1

    def forward(self, s: str, begin: int, stop: int, limit: int, ties: list[int]) -> tuple[list[int], list[int]]:
        """Best scores of the places from `begin` to `limit`, pieces beginning before `stop` only, and where each one's
        last piece begins. ties: of each place of s."""
        part = s[begin:limit]
        best, back = [_NONE] * (len(part) + 1), [-1] * (len(part) + 1)
        best[0] = 0
        weight, unknown = self.v["weight"], self.v["unknown"]
        arcs = [(end + 1, end + 1 - n, w) for end, (n, w) in self.finder.iter(part)]
        strange = [k for k, c in enumerate(part) if c not in weight]
        if strange:
            arcs = sorted(arcs + [(k + 1, k, unknown) for k in strange])
        stop -= begin
        for j, i, w in arcs:
            if i < stop and best[i] > _NONE:
                one = best[i] + w + ties[begin + i]
                if one > best[j]:
                    best[j], back[j] = one, i
        return best, back

    def trace(self, part: str, back: list[int], end: int) -> list[int]:
        out, j, ids = [], end, self.v["ids"]
        while j > 0:
            i = back[j]
            p = part[i:j]
            n = ids.get(p)
            if n is None:
                raw = b"\xe2\x96\x81" if p == _LITERAL else p.encode("utf-8", "surrogatepass")
                out += [self.v["byte_ids"][x] for x in reversed(raw)]
            else:
                out.append(n)
            j = i
        return out[::-1]

    def _short(self, atom: str) -> list[int]:
        """What `forward` does, for an atom whose characters are all pieces."""
        best, back, ties = [0] + [_NONE] * len(atom), [-1] * (len(atom) + 1), self.ties
        for end, (n, w) in self.finder.iter(atom):
            i = end + 1 - n
            one = best[i] + w + ties[i]
            if one > best[end + 1]:
                best[end + 1], back[end + 1] = one, i
        return back

    def _ties(self, n: int) -> list[int]:
        return self.ties if n <= SHORT else [tie(k) for k in range(n)]

    def score(self, atom: str) -> int:
        return self.forward(atom, 0, len(atom), len(atom), self._ties(len(atom)))[0][-1]

    def atom(self, atom: str) -> bytes:
        """Ids of an atom's best path, four bytes each."""
        got = self.known.get(atom)
        if got is None:
            back = self._short(atom) if len(atom) <= SHORT and self.singles.issuperset(atom) else self.forward(atom, 0, len(atom), len(atom), self._ties(len(atom)))[1]
            got = np.array(self.trace(atom, back, len(atom)), np.uint32).tobytes()
            if len(atom) <= SHORT:
                self.held += 250 + 2 * len(atom) + len(got)  # an entry, a string and a value take about 250 bytes themselves
                if self.held > REMEMBERED:
                    self.known.clear()
                    self.held = 0
                self.known[atom] = got
        return got

    def encode(self, s: str) -> bytes:
        """Ids of a marked text."""
        if not s:
            return b""
        at = self.cuts(s).tolist()
        known, atom = self.known, self.atom
        return b"".join([known.get(u) or atom(u) for u in [s[i:j] for i, j in zip([0, *at], [*at, len(s)])]])


class Chunk:
    """A stretch [begin, end) of a marked text, cut out with the place before it and as many after as a piece may reach;
    `lead` is how far into its atom the cut-out begins."""

    def __init__(self, e: Encoder, s: str, lead: int, begin: int, end: int) -> None:
        self.e, self.s, self.begin, self.end = e, s, begin, end
        self.cuts = e.cuts(s) if len(s) > 1 else np.zeros(0, np.int64)
        starts = np.full(len(s) + 1, -lead)
        starts[self.cuts] = self.cuts
        into = np.arange(len(s) + 1) - np.maximum.accumulate(starts)
        self.ties = [tie(k) for k in into.tolist()]

    def matrix(self) -> np.ndarray:
        """Best scores from each overhang at the begin to each at the end."""
        e, s, begin, end, n = self.e, self.s, self.begin, self.end, self.e.n
        out = np.full((n, n), _NONE, np.int64)
        inner = self.cuts[(self.cuts >= begin + n - 1) & (self.cuts <= end)]
        if not len(inner):
            for k in range(min(n, len(s) - begin + 1)):
                if begin + k >= end:
                    out[k, k - (end - begin)] = 0  # the piece that enters covers the chunk
                else:
                    best, _ = e.forward(s, begin + k, end, min(len(s), end + n - 1), self.ties)
                    reached = best[end - begin - k : end - begin - k + n]
                    out[k, : len(reached)] = reached
            return out
        first, last = int(inner[0]), int(inner[-1])
        bounds = inner.tolist()
        middle = sum(e.score(s[i:j]) for i, j in zip(bounds, bounds[1:]))
        tail = e.forward(s, last, end, min(len(s), end + n - 1), self.ties)[0][end - last : end - last + n] if last < end else [0]
        for k in range(n):
            head = e.forward(s, begin + k, first, first, self.ties)[0][-1] if begin + k < first else 0
            if head > _NONE:
                for o, t in enumerate(tail):
                    if t > _NONE:
                        out[k, o] = head + middle + t
        return out

    def ids(self, enters: int, leaves: int) -> bytes:
        """Ids of the path from one overhang to the other; the piece that enters belongs to the chunk before."""
        a, b = self.begin + enters, self.end + leaves
        if a >= b:
            return b""
        at = [a, *self.cuts[(self.cuts > a) & (self.cuts < b)].tolist(), b]
        out = []
        for k, (i, j) in enumerate(zip(at, at[1:])):
            if 0 < k < len(at) - 2:
                out.append(self.e.atom(self.s[i:j]))
            else:
                _, back = self.e.forward(self.s, i, j, j, self.ties)
                out.append(np.array(self.e.trace(self.s[i:j], back, j - i), np.uint32).tobytes())
        return b"".join(out)


def chunks(e: Encoder, s: str, size: int):
    """(cut-out, lead, begin, end) of each chunk of a marked text, in order."""
    cuts = e.cuts(s)
    for begin in range(0, len(s), size):
        end, low = min(len(s), begin + size), max(0, begin - 1)
        k = int(np.searchsorted(cuts, low, "right"))
        yield s[low : min(len(s), end + e.n)], low - (int(cuts[k - 1]) if k else 0), begin - low, end - low


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product under (max, +): associative, so that chunks may be combined in any grouping."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), _NONE)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    while len(matrices) > 1:
        matrices = [combine(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def ends(matrices: list[np.ndarray], enters: int, leaves: int) -> list[int]:
    """The overhangs at all borders of neighbours, from the first to the last, given these two."""
    reach = [np.where(np.arange(len(matrices[0])) == enters, 0, _NONE)]
    for m in matrices:
        reach.append(np.maximum((reach[-1][:, None] + m).max(0), _NONE))
    out = [leaves]
    for r, m in zip(reach[-2::-1], matrices[::-1]):
        out.append(int((r + m[:, out[-1]]).argmax()))
    return out[::-1]


def encode(docs: DataFrame, model_file: str = MODEL, *, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """id and ids (array<int>), a row for each row of `docs`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(model_file))  # the vocabulary: a few MB, whatever the corpus
    small_batches(spark, 256)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def usual(batches):
        e = Encoder.of(shared.value)
        for b in batches:
            yield _id_batch(b.column(0), [e.encode(marked(t)) for t in b.column(1).to_pylist()])

    out = rows.where(F.char_length("t") < giant).mapInArrow(usual, "id long, ids array<int>")
    return out.unionByName(_giants(rows.where(F.char_length("t") >= giant), shared, chunk, fan)).withColumnRenamed("id", id_col)


def _id_batch(ids, encoded: list[bytes]) -> pa.RecordBatch:
    ends_ = np.cumsum([0] + [len(x) // 4 for x in encoded]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(encoded), np.int32))
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), values)], names=["id", "ids"])


def _giants(rows: DataFrame, shared, chunk: int, fan: int) -> DataFrame:
    """Chunks are rows of their own, matrices nodes of a tree over each text's chunks."""
    n = shared.value["longest"]
    g = rows.withColumn("g", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.col("t")), 256)).groupBy("g", "id").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    kind = "g string, id long, copies long, k long, p binary, lead int, begin int, stop int"
    names = [x.split()[0] for x in kind.split(", ")]

    def part_batch(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*held), kinds)], names=names)

    def cut(batches):
        e = Encoder.of(shared.value)
        for b in batches:
            for key, i, t, copies in zip(*(c.to_pylist() for c in b.columns)):
                held = []
                for k, (p, lead, begin, stop) in enumerate(chunks(e, marked(t), chunk)):
                    held.append((key, i, copies, k, p.encode("utf-8", "surrogatepass"), lead, begin, stop))
                    if len(held) == 64:
                        yield part_batch(held)
                        held = []
                if held:
                    yield part_batch(held)

    def of(b, r: int, e: Encoder) -> Chunk:
        p, lead, begin, stop = (b.column(names.index(c))[r].as_py() for c in ("p", "lead", "begin", "stop"))
        return Chunk(e, p.decode("utf-8", "surrogatepass"), lead, begin, stop)

    def matrices(batches):
        e = Encoder.of(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([of(b, r, e).matrix().tobytes() for r in range(b.num_rows)], pa.binary())], names=["g", "k", "m"])

    def read(column) -> list[np.ndarray]:
        return [np.frombuffer(x, np.int64).reshape(n, n) for x in column.to_pylist()]

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        return pa.table({"g": table.column("g")[:1], "k": pa.array([table.column("k")[0].as_py() // fan], pa.int64()), "m": pa.array([product(read(table.column("m"))).tobytes()], pa.binary())})

    def down(children: pa.Table, parent: pa.Table) -> pa.Table:
        children = children.sort_by("k")
        at = ends(read(children.column("m")), parent.column("a")[0].as_py(), parent.column("b")[0].as_py())
        return pa.table({"g": children.column("g"), "k": children.column("k"), "a": pa.array(at[:-1], pa.int32()), "b": pa.array(at[1:], pa.int32())})

    def traced(batches):
        e = Encoder.of(shared.value)
        for b in batches:
            ids = [np.frombuffer(of(b, r, e).ids(b.column(8)[r].as_py(), b.column(9)[r].as_py()), np.int32) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.list_(pa.int32()))], names=[*names[:4], "ids"])

    parts = stored(g.mapInArrow(cut, kind).repartition("g", "k"))
    last = parts.agg(F.max("k").alias("k")).first()["k"]
    if last is None:
        return rows.sparkSession.createDataFrame([], "id long, ids array<int>")
    levels = [stored(parts.mapInArrow(matrices, "g string, k long, m binary"))]
    node = F.floor(F.col("k") / fan).alias("node")
    while last:
        levels.append(levels[-1].groupBy("g", node).applyInArrow(up, "g string, k long, m binary"))
        last //= fan
    found = levels.pop().select("g", "k", F.lit(0).alias("a"), F.lit(0).alias("b"))
    while levels:
        parents = found.withColumnRenamed("k", "node")
        found = levels.pop().groupBy("g", node).cogroup(parents.groupBy("g", "node")).applyInArrow(down, "g string, k long, a int, b int")
    ids = parts.join(found, ["g", "k"]).select(*names, "a", "b").mapInArrow(traced, "g string, id long, copies long, k long, ids array<int>")
    whole = ids.groupBy("g", "id", "copies").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x"))
    one = whole.select("id", F.flatten(F.transform("x", lambda y: y["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_"))
    return one.select("id", "ids")


def decode(encoded: DataFrame, model_file: str = MODEL, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text, a row for each row of ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_file)["raw"])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decode_bytes(np.asarray(x, np.uint32).tobytes(), shared.value) for x in _lists(b.column(1))], pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("i")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def _lists(column):
    """Values of a list column as arrays, None for nulls."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[ends[i] : ends[i + 1]] if column[i].is_valid else None for i in range(len(column))]


def tokens(docs: DataFrame, model_file: str = MODEL, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the ids, little-endian 32 bits each), n_chars and decoded_sha256 (of the text that the ids give back)."""
    encoded = encode(docs, model_file, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file)["raw"])

    def run(batches):
        for b in batches:
            out = []
            for x in _lists(b.column(1)):
                ids = x.astype(np.uint32).tobytes()
                t = decode_bytes(ids, shared.value)
                out.append((len(x), hashlib.sha256(ids).hexdigest(), len(t), hashlib.sha256(t.encode()).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)]], names=["id", "n_tokens", "ids_sha256", "n_chars", "decoded_sha256"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, "id long, n_tokens long, ids_sha256 string, n_chars long, decoded_sha256 string").withColumnRenamed("id", id_col)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(documents(spark, sf_dir))
