"""Media columns: Matroska files in a binary column, written and parsed element by element.

`mux` stores 8-bit PCM in laced blocks of clusters with cues. `demux` walks the variable-length EBML
elements of any Matroska file and returns its tracks, cues and a packet table: track, timestamp in
nanoseconds, cluster, keyframe flag and byte range of every frame, whatever the lacing. `packet_table`
is the same over a column. Damaged files give the packets before the damage and an error message; null
or empty media give no packets.

Element ids and block flags below are fixed values of the Matroska format (RFC 8794, RFC 9559).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import documents, small_batches

# Fixed values of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH, FRAME_NS = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
XIPH, FIXED, EBML_LACING = 0x02, 0x04, 0x06

#: Samples in a frame, samples a second, frames in a block and blocks in a cluster as `mux` writes them.
FRAME, HZ, FRAMES, BLOCKS = 576, 8000, 32, 8
_MS = 1_000_000


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for sizes unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(n: int, body: bytes) -> bytes:
    return _id(n) + vint(len(body)) + body


def _uint(n: int, value: int) -> bytes:
    return element(n, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _header(samples: int) -> bytes:
    info = _uint(TIMESTAMP_SCALE, _MS) + element(DURATION, struct.pack(">d", samples * 1000 / HZ)) + element(MUXER, b"logweir") + element(WRITER, b"logweir")
    audio = element(RATE, struct.pack(">d", HZ)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8)
    track = _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + _uint(FRAME_NS, FRAME * 1_000_000_000 // HZ) + element(AUDIO, audio)
    return element(INFO, info) + element(TRACKS, element(TRACK, track))


_DOCTYPE = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))


def mux(payload: bytes) -> bytes:
    """8-bit samples, a positive multiple of `FRAME`, as a Matroska file."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"payload must be a positive multiple of {FRAME} bytes")
    parts, cues = [_header(len(payload))], []
    at = len(parts[0])
    ms = FRAME * 1000 // HZ
    for c in range(0, len(payload), FRAME * FRAMES * BLOCKS):
        body = [_uint(TIMESTAMP, c // FRAME * ms)]
        for b in range(c, min(len(payload), c + FRAME * FRAMES * BLOCKS), FRAME * FRAMES):
            data = payload[b : b + FRAME * FRAMES]
            head = b"\x81" + struct.pack(">hBB", (b - c) // FRAME * ms, 0x80 | FIXED, len(data) // FRAME - 1)
            body.append(_id(SIMPLE_BLOCK) + vint(len(head) + len(data)) + head + data)
        cues.append(element(CUE_POINT, _uint(CUE_TIME, c // FRAME * ms) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return _DOCTYPE + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def _read_id(data, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _read_vint(data, at: int) -> tuple[int, int]:
    """Value and the place after it; -1 for all ones."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no size at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def _elements(data, at: int, end: int):
    """(id, start of body, end of body) of the elements between two places; unknown sizes reach to the end."""
    while at < end:
        kind, at = _read_id(data, at)
        size, at = _read_vint(data, at)
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {kind:#x} at byte {at} passes its parent's end")
        yield kind, at, stop
        at = stop


def _frames(data, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the frames' byte ranges of a block's body."""
    track, at = _read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags & 0x06
    if not lacing:
        return track, relative, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError(f"fixed lacing of {end - at} bytes in {n} frames")
        sizes = [(end - at) // n] * n
    elif lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = _read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            first = at
            delta, at = _read_vint(data, at)
            width = at - first
            if delta < 0:
                delta = (1 << 7 * width) - 1
            sizes.append(sizes[-1] + delta - ((1 << 7 * width - 1) - 1))
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing passes the end of its block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, relative, flags, out


def demux(data: bytes | None) -> dict:
    """tracks: dicts by number; cues: (timestamp, track, place); packets: tuples of (track, timestamp_ns,
    offset, size, keyframe, cluster); error: None or what ended the walk."""
    out: dict = {"tracks": {}, "cues": [], "packets": [], "error": None, "clusters": 0}
    scale = _MS
    try:
        for kind, at, end in _elements(data or b"", 0, len(data or b"")):
            if kind != SEGMENT:
                continue
            base, queue = at, [(at, end)]
            while queue:
                a, stop = queue.pop()
                for k, s, e in _elements(data, a, stop):
                    if k == INFO:
                        for k2, s2, e2 in _elements(data, s, e):
                            if k2 == TIMESTAMP_SCALE:
                                scale = int.from_bytes(data[s2:e2], "big")
                    elif k == TRACKS:
                        for _, s2, e2 in _elements(data, s, e):
                            t = _track(data, s2, e2)
                            out["tracks"][t.get("number", 0)] = t
                    elif k == CUES:
                        _read_cues(data, s, e, base, scale, out["cues"])
                    elif k == CLUSTER:
                        rest = _cluster(data, s, e, scale, out)
                        if rest:  # a cluster of unknown size ended where an element of the segment began
                            queue.append((rest, stop))
                            break
    except (ValueError, IndexError, struct.error) as wrong:
        out["error"] = str(wrong)
    return out


def _track(data, at: int, end: int) -> dict:
    t: dict = {"lacing": True, "frame_ns": 0}
    for k, s, e in _elements(data, at, end):
        if k in (NUMBER, KIND, FRAME_NS):
            t[{NUMBER: "number", KIND: "kind", FRAME_NS: "frame_ns"}[k]] = int.from_bytes(data[s:e], "big")
        elif k == CODEC:
            t["codec"] = bytes(data[s:e]).decode("ascii", "replace")
        elif k == AUDIO:
            for k2, s2, e2 in _elements(data, s, e):
                if k2 == RATE:
                    t["hz"] = struct.unpack(">d" if e2 - s2 == 8 else ">f", data[s2:e2])[0]
                elif k2 in (CHANNELS, DEPTH):
                    t["channels" if k2 == CHANNELS else "bits"] = int.from_bytes(data[s2:e2], "big")
    return t


def _read_cues(data, at: int, end: int, base: int, scale: int, out: list) -> None:
    for _, s, e in _elements(data, at, end):
        time, found = 0, []
        for k, s2, e2 in _elements(data, s, e):
            if k == CUE_TIME:
                time = int.from_bytes(data[s2:e2], "big") * scale
            elif k == CUE_POSITIONS:
                where = {k3: int.from_bytes(data[s3:e3], "big") for k3, s3, e3 in _elements(data, s2, e2)}
                found.append((where.get(CUE_TRACK, 0), base + where.get(CUE_CLUSTER, 0)))
        out += [(time, track, place) for track, place in found]


def _cluster(data, at: int, end: int, scale: int, out: dict) -> int:
    """Adds a cluster's packets; returns where the next element of the segment begins if none was to be expected, else 0."""
    time, n = 0, out["clusters"]
    out["clusters"] += 1
    while at < end:
        first = at
        kind, at = _read_id(data, at)
        if kind in (CLUSTER, CUES, TRACKS, INFO):
            return first
        size, at = _read_vint(data, at)
        stop = at + size
        if size < 0 or stop > end:
            raise ValueError(f"element {kind:#x} at byte {first} passes its cluster's end")
        if kind == TIMESTAMP:
            time = int.from_bytes(data[at:stop], "big")
        elif kind == SIMPLE_BLOCK:
            _packets(data, at, stop, time, scale, None, n, out)
        elif kind == BLOCK_GROUP:
            parts = {k: (s, e) for k, s, e in _elements(data, at, stop)}
            if BLOCK in parts:
                _packets(data, *parts[BLOCK], time, scale, REFERENCE not in parts, n, out)
        at = stop
    return 0


def _packets(data, at: int, end: int, time: int, scale: int, key: bool | None, cluster: int, out: dict) -> None:
    track, relative, flags, frames = _frames(data, at, end)
    step = out["tracks"].get(track, {}).get("frame_ns", 0)
    began, key = (time + relative) * scale, bool(flags & 0x80) if key is None else key
    out["packets"] += [(track, began + i * step, s, n, key, cluster) for i, (s, n) in enumerate(frames)]


def padded(text: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of `FRAME`."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def read_back(data: bytes, found: dict) -> bytes:
    return b"".join([data[s : s + n] for _, _, s, n, _, _ in found["packets"]])


def features(found: dict, payload: bytes) -> str:
    """Counts, duration and moments of the samples of one file, as text."""
    x = np.frombuffer(payload, np.uint8)
    step = found["tracks"].get(1, {}).get("frame_ns", 0)
    last = max((p[1] + step for p in found["packets"]), default=0)
    mean = float(x.mean(dtype=np.float64)) if len(x) else 0.0
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float64) if len(x) < 1 << 20 else np.square(x.astype(np.float64))))) if len(x) else 0.0
    return f"packets={len(found['packets'])};clusters={found['clusters']};cues={len(found['cues'])};ms={last // _MS};mean={mean:.6f};rms={rms:.6f};peak={int(x.max()) if len(x) else 0}"


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_bytes and media: each text's UTF-8 bytes (null: none), padded, as a Matroska file."""
    small_batches(docs.sparkSession, 256)

    def run(batches):
        for rows in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def packet_table(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: id, track, packet, timestamp_ns, cluster, keyframe, offset, size; errors are null but
    for files that end in damage, which get a last row of nulls with the message."""
    names = ["id", "track", "packet", "timestamp_ns", "cluster", "keyframe", "offset", "size", "error"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for rows in batches:
            for i, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                found = demux(data)
                table = [(i, t, k, ns, c, key, s, n, None) for k, (t, ns, s, n, key, c) in enumerate(found["packets"])]
                if found["error"]:
                    table.append((i, *[None] * 7, found["error"]))
                if table:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), types)], names=names)

    out = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("m")).mapInArrow(run, "id long, track int, packet long, timestamp_ns long, cluster int, keyframe boolean, offset long, size long, error string")
    return out.withColumnRenamed("id", id_col)


def describe(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """Reads files back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, a row for each file."""

    def run(batches):
        for rows in batches:
            out = []
            for data in rows.column(2).to_pylist():
                data = data or b""
                found = demux(data)
                payload = read_back(data, found)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(found, payload)))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    out = media.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).alias("n_bytes"), F.col(media_col).alias("m")).mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(documents(spark, sf_dir)))
