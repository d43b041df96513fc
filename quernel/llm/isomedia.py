"""Media columns: ISO base media containers.

``mux`` stores bytes losslessly as one track of uncompressed 8-bit samples; ``probe`` walks the nested boxes of any such
file, decodes the sample tables and gives each track's codec, duration and key frames' byte ranges.
It reads box headers and tables alone, never the media data.

Our files: ``ftyp, moov (mvhd, trak (tkhd, mdia (mdhd, hdlr, minf (vmhd, dinf, stbl)))), mdat``; a sample is a frame of
32 x 18 grey pixels, 576 bytes; 25 frames a second; each run of 12 frames is a chunk and begins with a
sync sample. Nothing depends on the clock, so equal payloads give equal files.

Defined cases: null is stored as empty; an empty payload still gets one frame of fill; a null or broken file is
probed to no tracks and an ``error``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import batches_of, task, written

FRAME = 576
WIDTH, HEIGHT, RATE, GROUP = 32, 18, 25, 12
FILL = b"\xff"
#: The boxes that hold boxes, by ISO/IEC 14496-12.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"mvex", b"moof", b"traf", b"udta"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
TRACKS = "array<struct<codec:string,handler:string,timescale:long,duration:long,n_samples:long,n_bytes:long,keyframes:array<struct<time:long,offset:long,size:long>>>>"
LONGS = ("timescale", "duration", "n_samples", "n_bytes")
KEYFRAME = pa.struct([(n, pa.int64()) for n in ("time", "offset", "size")])
ARROW_TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), *((n, pa.int64()) for n in LONGS), ("keyframes", pa.list_(KEYFRAME))]))


# ---- Writing


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def counted(values: np.ndarray, kind: str) -> bytes:
    return struct.pack(">I", len(values)) + np.asarray(values).astype(kind).tobytes()


def header(n_frames: int, first: int) -> bytes:
    """The moov box for so many frames whose data begin at ``first``."""
    chunks = -(-n_frames // GROUP)
    offsets = first + np.arange(chunks, dtype=np.int64) * GROUP * FRAME
    runs = [(1, GROUP, 1)] if n_frames >= GROUP else []
    if n_frames % GROUP:
        runs.append((chunks, n_frames % GROUP, 1))
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1, b"\0" * 32, 40, -1)
    far = first + n_frames * FRAME >= 2**32
    tables = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
        full(b"stts", struct.pack(">III", 1, n_frames, 1)),
        full(b"stss", counted(np.arange(chunks) * GROUP + 1, ">u4")),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n_frames)),
        full(b"co64" if far else b"stco", counted(offsets, ">u8" if far else ">u4")),
    )
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n_frames, 0x55C4, 0)),
        full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"),
        box(b"minf", full(b"vmhd", struct.pack(">4H", 0, 0, 0, 0), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
    )
    movie = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n_frames, 0x10000, 0x100), MATRIX, b"\0" * 24, struct.pack(">I", 2))
    track = full(b"tkhd", struct.pack(">IIIIIIIhhhH", 0, 0, 1, 0, n_frames, 0, 0, 0, 0, 0, 0), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
    return box(b"moov", movie, box(b"trak", track, media))


def padded(data: bytes) -> bytes:
    """The payload: the bytes, filled up to whole frames, one at least."""
    return data + FILL * (-len(data) % FRAME if data else FRAME)


def mux(data: bytes) -> bytes:
    """A file that holds the bytes, filled up."""
    payload = padded(data)
    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    n_frames = len(payload) // FRAME
    data_head = 8 if len(payload) + 8 < 2**32 else 16
    # a header's length does not depend on where the data begin, but for files near 4 GB
    first = len(brand) + len(header(n_frames, 0)) + data_head
    head = header(n_frames, first)
    if len(brand) + len(head) + data_head != first:
        first = len(brand) + len(head) + data_head
        head = header(n_frames, first)
    return brand + head + box(b"mdat", payload)


# ---- Reading


def boxes(data: memoryview, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The kind, begin and end of the content of each box; raises if one leaves its parent."""
    while begin < end:
        if begin + 8 > end:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - begin
        if kind == b"uuid":
            body += 16
        if body > begin + size or begin + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, body, begin + size
        begin += size


def walk(data: memoryview, begin: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes in order, each with the kinds around it."""
    for kind, a, b in boxes(data, begin, end):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from walk(data, a, b, (*path, kind))


def table(data: memoryview, at: int, kind: str, width: int = 1) -> np.ndarray:
    """A table behind a version word: a count, then rows."""
    (count,) = struct.unpack_from(">I", data, at + 4)
    return np.frombuffer(data, kind, count * width, at + 8).reshape(-1, width).astype(np.int64)


class Track:
    """A track's tables, as they are found while walking."""

    def __init__(self) -> None:
        self.codec = self.handler = ""
        self.timescale = self.duration = 0
        self.found: dict[bytes, np.ndarray] = {}

    def take(self, kind: bytes, data: memoryview, a: int, b: int) -> None:
        if kind == b"mdhd":
            shape, at = (">IQ", a + 20) if data[a] == 1 else (">II", a + 12)
            self.timescale, self.duration = struct.unpack_from(shape, data, at)
        elif kind == b"hdlr":
            self.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            self.codec = next((k.decode("latin-1") for k, _, _ in boxes(data, a + 8, b)), "")
        elif kind == b"stsz":
            size, count = struct.unpack_from(">II", data, a + 4)
            self.found[kind] = np.full(count, size, np.int64) if size else np.frombuffer(data, ">u4", count, a + 12).astype(np.int64)
        elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
            width = {b"stts": 2, b"stsc": 3}.get(kind, 1)
            self.found[kind] = table(data, a, ">u8" if kind == b"co64" else ">u4", width)

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each sample's time, offset and size, from the run-length tables."""
        sizes = self.found.get(b"stsz", np.zeros(0, np.int64))
        chunks = self.found.get(b"co64", self.found.get(b"stco", np.zeros((0, 1), np.int64)))[:, 0]
        steps = self.found.get(b"stts", np.zeros((0, 2), np.int64))
        runs = self.found.get(b"stsc", np.zeros((0, 3), np.int64))
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        delta = np.repeat(steps[:, 1], steps[:, 0])
        if per.sum() != len(sizes) or len(delta) != len(sizes):
            raise ValueError("the sample tables disagree")
        before = np.cumsum(sizes) - sizes
        firsts = (np.cumsum(per) - per)[per > 0]
        offsets = np.repeat(chunks[per > 0] - before[firsts], per[per > 0]) + before
        return np.cumsum(delta) - delta, offsets, sizes

    def keyframes(self) -> list[tuple[int, int, int]]:
        times, offsets, sizes = self.samples()
        which = self.found[b"stss"][:, 0] - 1 if b"stss" in self.found else np.arange(len(sizes))
        return list(zip(times[which].tolist(), offsets[which].tolist(), sizes[which].tolist()))

    def row(self) -> dict:
        times, offsets, sizes = self.samples()
        return {
            "codec": self.codec, "handler": self.handler, "timescale": self.timescale, "duration": self.duration, "n_samples": len(sizes), "n_bytes": int(sizes.sum()),
            "keyframes": [{"time": t, "offset": o, "size": s} for t, o, s in self.keyframes()],
        }


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file."""
    view, out = memoryview(data), []
    for path, a, b in walk(view, 0, len(view)):
        if path == (b"moov", b"trak"):
            out.append(Track())
        elif path[:2] == (b"moov", b"trak"):
            out[-1].take(path[-1], view, a, b)
    return out


def demux(data: bytes) -> bytes:
    """The samples of the first track in a row, found by the sample tables."""
    _, offsets, sizes = tracks(data)[0].samples()
    if len(sizes) and (offsets[1:] == offsets[:-1] + sizes[:-1]).all():
        return data[int(offsets[0]) : int(offsets[-1] + sizes[-1])]
    return b"".join(data[o : o + s] for o, s in zip(offsets.tolist(), sizes.tolist()))


# ---- Columns


def probe_one(data: bytes | None) -> tuple[list[dict], str | None]:
    if data is None:
        return [], "no data"
    try:
        return [t.row() for t in tracks(data)], None
    except (ValueError, struct.error, IndexError, KeyError) as error:
        return [], str(error)


def probe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [probe_one(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], ARROW_TRACKS), pa.array([e for _, e in found], pa.string())], ["id", "tracks", "error"])


def probe(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, tracks and error of a column of files."""
    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(task(probe_batches), f"id {kind}, tracks {TRACKS}, error string")


def mux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in batches_of(whole, "text", 4_000_000)):
        data = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array([mux(x) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a media column in the shared folder: doc_id, n_bytes and media, read back."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return written(source.mapInArrow(task(mux_batches), f"doc_id {kind}, n_bytes long, media binary"), "media")


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest columns of the stored files, from their own bytes."""
    for whole in batches:
        rows: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in whole.column("media"):
            data = media.as_py()
            payload, track = demux(data), tracks(data)[0]
            times, _, _ = track.samples()
            rows["payload_bytes"].append(len(payload))
            rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(payload[-32:]))
            rows["media_bytes"].append(len(data))
            rows["media_sha256"].append(hashlib.sha256(data).hexdigest())
            keys = ",".join(f"{o}+{s}@{t}" for t, o, s in track.keyframes())
            rows["feature"].append(f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(times)};keyframes={keys}")
        arrays = [pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in rows.items()]
        yield pa.RecordBatch.from_arrays([whole.column("doc_id"), whole.column("n_bytes"), *arrays], ["doc_id", "n_bytes", *rows])


def digests(stored: DataFrame) -> DataFrame:
    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(task(digest_batches), schema)
