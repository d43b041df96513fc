"""Token ids in length-delimited binary records with masked checksums and a separate offset index.

File format (all integers little-endian). A shard ``*.rec`` is a run of frames::

    u64 length | u32 masked CRC-32C of those 8 bytes | payload | u32 masked CRC-32C of the payload

and a payload is ``u8 flags (1: has a doc_id) | u8 width of an id (2 or 4) | i64 doc_id | ids``. The shard's
``*.idx`` holds one entry of 24 bytes for each frame (``u64 offset, u64 ids, i64 doc_id``), so a reader
can fetch frames in any order without scanning the shard. Masking is ``rotr(crc, 15) + 0xA282EAD8``.

Shards are in ascending doc_id order, and so are the frames in a shard. A shard is written under a name
of its own attempt and counts only once the manifest, a table, lists it; a lost or repeated task leaves a
file that nothing refers to.

Defined cases: a null or empty text has the end id alone; a null doc_id comes first; rows that repeat a
doc_id each get a frame, ordered by their ids; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm._shared import BLANKS, batches_of, holds, scratch, task, utf8

INDEX = np.dtype([("offset", "<u8"), ("n_tokens", "<u8"), ("doc_id", "<i8")])
HEAD = struct.Struct("<BBq")
MANIFEST = "part int, path string, n_records long, n_tokens long, n_bytes long"
BLOCK = 512
MASK = 0xA282EAD8
#: Distinct pieces that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 300_000
#: Bytes of text that are encoded at a time.
BATCH = 1_000_000


# ---- CRC-32C of many buffers at once


def _crc_tables():
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1)
    two = np.arange(65536, dtype=np.uint32)
    low = one[two & 255]
    pairs = (low >> 8) ^ one[(low ^ (two >> 8)) & 255]
    state = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    for _ in range(BLOCK):
        state = (state >> 8) ^ one[state & 255]
    shift = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            shift[k] ^= np.where((np.arange(256) >> bit) & 1, state[8 * k + bit], 0).astype(np.uint32)
    return pairs.astype(np.uint32), shift


_TABLES: list = []


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of each buffer (4 bytes long at least).

    The buffers are padded in front to whole blocks (zeros don't change an empty register), all blocks are
    run side by side two bytes at a step, and each buffer's blocks are then chained by a linear map.
    """
    if not _TABLES:
        _TABLES.extend(_crc_tables())
    pairs, shift = _TABLES
    if not buffers:
        return np.zeros(0, np.uint32)
    sizes = np.fromiter(map(len, buffers), np.int64, len(buffers))
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    padded = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    view = memoryview(padded)
    for end, data in zip((ends * BLOCK).tolist(), buffers):
        view[end - len(data) : end] = data
    first = (ends * BLOCK - sizes)[:, None] + np.arange(4)
    padded[first] ^= 255
    lanes = np.ascontiguousarray(padded.view("<u2").reshape(-1, BLOCK // 2).T)
    state = np.zeros(lanes.shape[1], np.uint32)
    for row in lanes:
        state = (state >> 16) ^ pairs[(state & 0xFFFF) ^ row]
    out = np.zeros(len(buffers), np.uint32)
    order = np.argsort(-blocks, kind="stable")
    counts, begins = blocks[order], (ends - blocks)[order]
    for k in range(int(counts[0])):
        live = order[: int(np.searchsorted(-counts, -k, side="left"))]
        s = out[live]
        s = shift[0][s & 255] ^ shift[1][(s >> 8) & 255] ^ shift[2][(s >> 16) & 255] ^ shift[3][s >> 24]
        out[live] = s ^ state[begins[: len(live)] + k]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotate and add, so that a checksum of data that hold checksums stays useful."""
    crc = crc.astype(np.uint64)
    return ((((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(MASK)) & np.uint64(0xFFFFFFFF)).astype("<u4")


# ---- Tokens


class Encoder:
    """The ids of whole texts, by the tokenizers library.

    For a tokenizer that lower-cases, drops white space and never lets a token cross it (see ``splits_at_blanks``),
    the ids of a text are those of its pieces in a row. Texts are cut at blanks and between an ASCII letter
    and an ASCII sign after it, where no token of such a tokenizer can stand across; equal pieces
    of a batch are found by hashing all of them side by side, and the library encodes each distinct piece. Bytes of pieces
    with one hash are compared; should any differ, each piece of the batch is looked up by its bytes.
    Texts that may hold a special token, and all texts of other tokenizers, go to the library uncut.
    """

    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    LETTER = np.isin(np.arange(256), list(range(ord("a"), ord("z") + 1)))
    BLANK = np.isin(np.arange(256), BLANKS)
    SIGN = (np.arange(256) < 128) & ~LETTER & ~BLANK
    ODD = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.splits = splits_at_blanks(spec)
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self.pieces: dict[bytes, bytes] = {}
        self.powers = np.ones(1, np.uint64)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, text: str) -> bytes:
        """A run of letters is one input of the model, as the steps before it only map its bytes."""
        symbols = text if text.isascii() else text.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def piece(self, data: bytes) -> bytes:
        """The ids of a piece without blanks whose ASCII letters are small."""
        if data.isalpha():
            return self.word(data.decode("ascii"))
        letters = data.rstrip(self.MARKS)
        text = letters.decode("utf-8", "replace")
        word = unicodedata.normalize("NFC", text).lower()
        if word.isalpha() and max(word) < "\u0250":
            return self.word(word) + (self.known(data[len(letters) :]) if len(letters) < len(data) else b"")
        return self.whole(data.decode("utf-8", "replace"))

    def known(self, data: bytes) -> bytes:
        ids = self.pieces.get(data)
        if ids is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            ids = self.pieces[data] = self.piece(data)
        return ids

    def cut(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of some texts begin and end; texts never share a piece."""
        solid = ~self.BLANK[raw]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | (self.LETTER[raw[:-1]] & self.SIGN[raw[1:]])
        edges = ends[(ends > 0) & (ends < len(raw))]
        begins[edges] = solid[edges]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:] | begins[1:]
        return np.flatnonzero(begins), np.flatnonzero(stops) + 1

    def distinct(self, raw: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """For each piece the number of its kind, and the first piece of each kind; None if pieces of one hash differ."""
        sizes = stops - begins
        longest = int(sizes.max())
        if longest > len(self.powers):
            self.powers = np.cumprod(np.full(longest + 64, self.STEP, np.uint64))
        firsts = np.cumsum(sizes) - sizes
        solid = raw[~self.BLANK[raw]]
        places = np.arange(len(solid)) - np.repeat(firsts, sizes)
        hashes = np.add.reduceat(self.ODD[solid] * self.powers[places], firsts) ^ (sizes.astype(np.uint64) * self.STEP)
        codes, kinds = pd.factorize(hashes)
        first = np.empty(len(kinds), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        model = first[codes]
        places += np.repeat(begins[model], sizes)
        if (sizes != sizes[model]).any() or (raw[places] != solid).any():
            return None
        return codes, first

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts in a row, and where each text's ids begin and end.

        ``raw``: the texts' UTF-8 bytes in a row; ``ends``: where each text begins, and the last one ends.
        """
        data = raw.tobytes()
        if not self.splits or any(s in data for s in self.specials):
            return self.uncut(data, ends)
        raw = self.LOWER[raw]
        data = raw.tobytes()
        begins, stops = self.cut(raw, ends)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        codes, first = self.distinct(raw, begins, stops) or (np.arange(len(begins)), np.arange(len(begins)))
        table = [self.known(data[i:j]) for i, j in zip(begins[first].tolist(), stops[first].tolist())]
        counts = np.fromiter(map(len, table), np.int64, len(table)) // 4
        pool = np.frombuffer(b"".join(table), "<u4")
        sizes = counts[codes]
        after = np.cumsum(sizes)
        ids = pool[np.repeat((np.cumsum(counts) - counts)[codes] - (after - sizes), sizes) + np.arange(int(after[-1]))]
        return ids, np.append(0, after)[np.searchsorted(begins, ends)]

    def uncut(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = [self.one(data[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        counts = np.fromiter(map(len, table), np.int64, len(table)) // 4
        return np.frombuffer(b"".join(table), "<u4"), np.append(0, np.cumsum(counts))

    def one(self, data: bytes) -> bytes:
        if not self.splits or any(s in data for s in self.specials):
            return self.whole(data.decode("utf-8", "replace"))
        raw = np.frombuffer(data, np.uint8)
        return self.encode(raw, np.array([0, len(raw)]))[0].astype("<u4").tobytes()

    def text(self, text: str | None) -> bytes:
        return self.texts(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string column's rows; null has none."""
        if not self.splits:
            table = [self.whole(t.as_py() or "") for t in column]
            counts = np.fromiter(map(len, table), np.int64, len(table)) // 4
            return np.frombuffer(b"".join(table), "<u4"), np.append(0, np.cumsum(counts))
        return self.encode(*utf8(column))


def byte_symbols() -> dict[int, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space and cuts at it before anything else."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    kinds = [s["type"] for s in steps]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = ((cuts[0].get("pattern") or {}).get("Regex")) or ""
    return kinds == ["NFC", "Replace", "Lowercase"] and cuts[0].get("behavior") == "Removed" and bool(cuts[0].get("invert")) and bool(re.search(r"\[\^\\s\\p\{L\}\\p\{N\}\]\+$", pattern)) and r"|[\p{L}]+|" in pattern


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- Shards


def frames(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The frames of some payloads and the length of each frame."""
    lengths = np.fromiter(map(len, payloads), "<u8", len(payloads))
    heads = [x.tobytes() for x in lengths]
    of_heads, of_payloads = masked(crc32c(heads)), masked(crc32c(payloads))
    parts: list[bytes] = []
    for head, a, payload, b in zip(heads, of_heads, payloads, of_payloads):
        parts += (head, a.tobytes(), payload, b.tobytes())
    return b"".join(parts), lengths.astype(np.int64) + 16


def unframe(data: bytes, starts: Iterable[int]) -> list[bytes]:
    """The payloads of the frames that begin at some places; raises if a checksum or length is wrong."""
    heads, payloads, sums = [], [], []
    for at in starts:
        heads.append(data[at : at + 8])
        (size,) = struct.unpack("<Q", heads[-1])
        payload = data[at + 12 : at + 12 + size]
        if len(data) < at + 16 + size:
            raise ValueError("a record is cut short")
        payloads.append(payload)
        sums.append(struct.unpack("<II", data[at + 8 : at + 12] + data[at + 12 + size : at + 16 + size]))
    if payloads and not (np.stack([masked(crc32c(heads)), masked(crc32c(payloads))], 1) == np.asarray(sums, np.uint32)).all():
        raise ValueError("a record's checksum is wrong")
    return payloads


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    """The doc_id and ids of a payload."""
    flags, width, doc_id = HEAD.unpack_from(payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload, f"<u{width}", offset=HEAD.size)


def write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer_path: str, end_id: int | None, width: int) -> Iterator[pa.RecordBatch]:
    """Write a partition's sorted rows to one shard and give its row of the manifest."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    holds("records", _ENCODERS)
    codes, end = encoder(tokenizer_path), b"" if end_id is None else end_id.to_bytes(width, "little")
    name = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}"
    store = base = file = None
    index: list[np.ndarray] = []
    at = tokens = 0
    try:
        for batch in (part for whole in batches for part in batches_of(whole, "text", BATCH)):
            if file is None:
                store, base = pafs.FileSystem.from_uri(name)
                store.create_dir(os.path.dirname(base), recursive=True)
                file = store.open_output_stream(base + ".rec")
            ids = batch.column(0).to_pylist()
            values, cuts = codes.texts(batch.column(1))
            if len(values) and int(values.max()) >> (8 * width):
                raise ValueError(f"an id does not fit in {width} bytes")
            values = values.astype(f"<u{width}")
            payloads = [HEAD.pack(d is not None, width, d or 0) + values[i:j].tobytes() + end for d, i, j in zip(ids, cuts.tolist(), cuts[1:].tolist())]
            counts = np.diff(cuts) + len(end) // width
            data, sizes = frames(payloads)
            entry = np.zeros(len(ids), INDEX)
            entry["offset"] = at + np.cumsum(sizes) - sizes
            entry["n_tokens"] = counts
            entry["doc_id"] = [x or 0 for x in ids]
            index.append(entry)
            file.write(data)
            at += len(data)
            tokens += int(counts.sum())
    finally:
        if file is not None:
            file.close()
    if file is not None:
        with store.open_output_stream(base + ".idx") as out:
            out.write(np.concatenate(index).tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_records": [sum(map(len, index))], "n_tokens": [tokens], "n_bytes": [at]})


def id_width(tokenizer_path: str, end_id: int | None) -> int:
    """The bytes that an id takes."""
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(largest, end_id or 0) < 1 << 16 else 4


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, write shards in ascending order of the id, and return the manifest.

    Rows go to ranges of the id (large ids' ties are cut by a hash of the text), are sorted there and
    streamed into one shard each, so a task holds a batch at a time. Ids take 2 bytes where the tokenizer's largest id and
    ``end_id`` allow, else 4.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "records")
    width = id_width(tokenizer_path, end_id)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    manifest = ordered.mapInArrow(task(write_shard, folder, tokenizer_path, end_id, width), MANIFEST)
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def starts(manifest: DataFrame) -> DataFrame:
    """Add to each shard the count of ids before it. The manifest has a row for each shard, so it is small."""
    spark = manifest.sparkSession
    shards = sorted(manifest.collect(), key=lambda r: r.part)
    before = np.cumsum([0, *(r.n_tokens for r in shards)]).tolist()
    rows = [(r.part, r.path, r.n_records, r.n_tokens, r.n_bytes, first) for r, first in zip(shards, before)]
    return spark.createDataFrame(rows, MANIFEST + ", start long")


def read_shard(path: str, batch: int = 2048) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The index entries and checked payloads of a shard, a run of frames at a time."""
    store, base = pafs.FileSystem.from_uri(path)
    with store.open_input_file(base + ".idx") as file:
        index = np.frombuffer(file.read(), INDEX)
    with store.open_input_file(base + ".rec") as file:
        size = file.size()
        for first in range(0, len(index), batch):
            part = index[first : first + batch]
            begin = int(part["offset"][0])
            end = int(index["offset"][first + batch]) if first + batch < len(index) else size
            file.seek(begin)
            yield part, unframe(file.read(end - begin), (part["offset"] - begin).tolist())


def read_at(path: str, numbers: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a shard by number, in any order, through the offset index: for shuffled reads."""
    store, base = pafs.FileSystem.from_uri(path)
    with store.open_input_file(base + ".idx") as file:
        index = np.frombuffer(file.read(), INDEX)
    with store.open_input_file(base + ".rec") as file:
        ends = np.append(index["offset"][1:], file.size()).astype(np.int64)
        for k in numbers:
            begin = int(index["offset"][k])
            file.seek(begin)
            yield parse(unframe(file.read(int(ends[k]) - begin), [0])[0])


def shuffled(index: np.ndarray, seed: int) -> np.ndarray:
    """A seeded order of a shard's record numbers."""
    return np.random.default_rng(seed).permutation(len(index))


def read_shards(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """What the query returns for each record of the shards of a part of the manifest."""
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            for index, payloads in read_shard(path):
                docs, crcs, ids, counts = [], [], [], index["n_tokens"].astype(np.int64)
                for payload, count in zip(payloads, counts):
                    doc_id, values = parse(payload)
                    if len(values) != count:
                        raise ValueError("the index disagrees with a record")
                    docs.append(doc_id)
                    crcs.append(zlib.crc32(values.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(values.astype(np.int64))
                columns = {"doc_id": pa.array(docs, pa.int64()), "start": start + np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)
                start += int(counts.sum())


def read_records(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit), and the ids if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    spark = manifest.sparkSession
    shards = starts(manifest)
    return shards.repartition(max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism)), "part").mapInArrow(task(read_shards, with_ids), schema)
