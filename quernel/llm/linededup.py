"""Line dedup by sharded minimal perfect hashes.

A line's key is the line without blanks at its ends, ASCII letters small; keys shorter than ``shortest`` code
points don't count. Two passes read the texts:

1. Each document sends two hashes of 64 bits for each distinct key. They are counted (partial sums first), with the
   largest doc_id that holds the key. All of them are stored.
2. The stored hashes are dealt into shards by their top bits. A shard is a minimal perfect hash (levels of bit
   arrays: at each level the hashes that are alone on their bit stay, the others go on) which
   gives each hash a slot in arrays of fingerprints (the second hash), counts and keeping doc_ids.
3. Each document probes the arrays for all its lines, with no join and no shuffle of lines. Lines whose key
   has a count of at least ``least`` are dropped unless the document is the keeper.

A worker loads shards as its batches need them and holds at most ``CACHE`` bytes of them. Where all shards fit, texts are probed in
windows of ``BATCH`` bytes; where they don't, in windows of ``WINDOW`` bytes, shard after shard, so that a shard is read once a window.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id count as documents of their own and
keep or drop alike; a row whose doc_id is null never keeps a line that another document holds (if all holders
are null, all keep it); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import batches_of, holds, scratch, task, written

BLANK_BYTES = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 500_000
CACHE = 256_000_000
BATCH = 16_000_000
WINDOW = 128_000_000
#: Bytes of a shard's arrays for each key, about: fingerprint, count, keeper and the table.
KEY_BYTES = 21
#: Bits of a level for each hash that is left.
ROOM = 1.5
NOBODY = -(2**63)


def keys_of(text: str | None, shortest: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and each line's key or None if it is too short."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(BLANK_BYTES)
        long = len(key) >= shortest and (len(key) >= 4 * shortest or len(key.decode("utf-8", "replace")) >= shortest)
        keys.append(key.lower() if long else None)
    return lines, keys


def halves(key: bytes) -> tuple[int, int]:
    """Two hashes of 64 bits, as unsigned integers."""
    whole = xxhash.xxh3_128_intdigest(key)
    return whole >> 64, whole & (2**64 - 1)


def hash_batches(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """doc_id and the two hashes of each distinct key of each document."""
    for batch in (part for whole in batches for part in batches_of(whole, "text", BATCH)):
        docs: list = []
        found: list[tuple[int, int]] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = {k for k in keys_of(text.as_py(), shortest)[1] if k is not None}
            docs += [doc_id] * len(own)
            found += map(halves, own)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["doc_id", "h1", "h2"])


# ---- The minimal perfect hash


def spread(h: np.ndarray, level: int) -> np.ndarray:
    """Another hash of 64 bits for each level."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: about 3 bits a key.

    Each level has a bit array; a hash's slot is the number of bits set before its bit, over all levels.
    """

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        self.before = []
        total = 0
        for bits in levels:
            counts = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.before.append(total + counts - np.bitwise_count(bits))
            total += int(counts[-1]) if len(counts) else 0
        self.keys = total

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], hashes
        while len(left):
            size = max(64, int(len(left) * ROOM))
            at = (spread(left, len(levels)) % np.uint64(size)).astype(np.int64)
            counts = np.bincount(at, minlength=size)
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[: len(counts)] = counts == 1
            levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[counts[at] > 1]
        return cls(levels, sizes)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1 for hashes that no level takes (these were surely not built in)."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (bits, size, before) in enumerate(zip(self.levels, self.sizes, self.before)):
            at = (spread(hashes[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = rank[hit]
            left = left[~hit]
        return out


class Shard:
    """A perfect hash with its arrays."""

    def __init__(self, table: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.table, self.fingerprints, self.counts, self.keepers = table, fingerprints, counts, keepers
        self.size = sum(x.nbytes for x in (fingerprints, counts, keepers, *table.levels, *table.before))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        """Rows that share h1 (one in 2**64 pairs of keys) go to slots after the table's, and are looked up by both hashes."""
        table = PerfectHash.build(np.unique(h1))
        order = np.argsort(table.slots(h1), kind="stable")
        slots = table.slots(h1)[order]
        alone = np.append(True, slots[1:] != slots[:-1]) if len(slots) else np.zeros(0, bool)
        order = np.concatenate([order[alone], order[~alone]])
        return cls(table, h2[order], np.minimum(counts[order], 2**32 - 1).astype(np.uint32), keepers[order])

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether it is there, its count and its keeper."""
        slots = self.table.slots(h1)
        there = slots >= 0
        there[there] = self.fingerprints[slots[there]] == h2[there]
        for extra in range(self.table.keys, len(self.fingerprints)):
            same = ~there & (h2 == self.fingerprints[extra])
            slots[same], there[same] = extra, True
        safe = np.where(there, slots, 0)
        return there, np.where(there, self.counts[safe], 0), self.keepers[safe]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, fingerprints=self.fingerprints, counts=self.counts, keepers=self.keepers, sizes=np.array(self.table.sizes, np.int64), **{f"level{k}": x for k, x in enumerate(self.table.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as x:
            sizes = x["sizes"].tolist()
            return cls(PerfectHash([x[f"level{k}"] for k in range(len(sizes))], sizes), x["fingerprints"], x["counts"], x["keepers"])


def build_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write the shards whose rows come in this partition (sorted by shard), one at a time."""
    import uuid

    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)

    def flush(number: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        shard = Shard.build(rows[:, 0].view(np.uint64).copy(), rows[:, 1].view(np.uint64).copy(), rows[:, 2], rows[:, 3].copy())
        name = f"shard-{number:08d}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{base}/{name}") as file:
            file.write(shard.dump())
        return pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "name": [name], "keys": pa.array([len(rows)], pa.int64())})

    now, parts = None, []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        rows = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2", "n_docs", "keeper")], 1)
        for number in np.unique(shards).tolist():
            if now is not None and number != now:
                yield flush(now, parts)
                parts = []
            now = number
            parts.append(rows[shards == number])
    if now is not None:
        yield flush(now, parts)


_SHARDS: OrderedDict[str, Shard] = OrderedDict()


def shard_at(path: str) -> Shard:
    """A shard from the shared folder; the worker keeps the last used ones within CACHE bytes."""
    if path in _SHARDS:
        _SHARDS.move_to_end(path)
        return _SHARDS[path]
    store, base = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(base) as file:
        shard = _SHARDS[path] = Shard.load(file.read())
    while len(_SHARDS) > 1 and sum(x.size for x in _SHARDS.values()) > CACHE:
        _SHARDS.popitem(last=False)
    return shard


def windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches whose texts have about ``size`` bytes: large ones are cut, small ones put together."""
    held, total = [], 0
    for part in (x for whole in batches for x in batches_of(whole, "text", size)):
        held.append(part)
        total += part.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def probe_batches(batches: Iterator[pa.RecordBatch], folder: str, names: dict[int, str], bits: int, least: int, shortest: int, with_text: bool, window: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Probe each document's keys and drop the lines that another document keeps."""
    holds("linededup", _SHARDS)
    for batch in windows(batches, window):
        ids = batch.column("doc_id").to_pylist()
        lines, places, pairs = [], [], []
        for row, text in enumerate(batch.column("text")):
            own, keys = keys_of(text.as_py(), shortest)
            lines.append(own)
            for number, key in enumerate(keys):
                if key is not None:
                    places.append((row, number))
                    pairs.append(halves(key))
        h = np.array(pairs, np.uint64).reshape(-1, 2)
        shards = (h[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        drop: list[set[int]] = [set() for _ in lines]
        for number in np.unique(shards).tolist():
            if number not in names:
                continue
            mine = np.flatnonzero(shards == number)
            there, counts, keepers = shard_at(f"{folder}/{names[number]}").probe(h[mine, 0], h[mine, 1])
            there &= counts >= least
            for k, keeper in zip(mine[there].tolist(), keepers[there].tolist()):
                row, line = places[k]
                if (NOBODY if ids[row] is None else ids[row]) != keeper:
                    drop[row].add(line)
        kept = [b"\n".join(x for k, x in enumerate(own) if k not in gone) for own, gone in zip(lines, drop)]
        columns = {
            "doc_id": pa.array(ids, pa.int64()), "n_lines": pa.array(map(len, lines), pa.int64()), "n_dropped": pa.array(map(len, drop), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
        }
        if with_text:
            columns["text"] = pa.array([x.decode("utf-8", "replace") for x in kept])
        yield pa.RecordBatch.from_pydict(columns)


def dedup_lines(docs: DataFrame, least: int = 5, shortest: int = 40, shard_keys: int = SHARD_KEYS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and the text that is left."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashes = source.mapInArrow(task(hash_batches, shortest), "doc_id long, h1 long, h2 long")
    counted = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.coalesce(F.max("doc_id"), F.lit(NOBODY)).alias("keeper"))
    lines = written(counted, "lines")
    total = lines.count()
    bits = max(0, (-(-total // shard_keys) - 1).bit_length())
    folder = scratch(spark, "line-shards")
    number = F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = lines.withColumn("shard", number).repartition(max(1, 1 << bits), "shard").sortWithinPartitions("shard")
    manifest = written(dealt.mapInArrow(task(build_shards, folder), "shard long, name string, keys long"), "line-manifest")
    # one short row for each SHARD_KEYS keys
    names = {r.shard: r.name for r in manifest.collect()}
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
    window = BATCH if total * KEY_BYTES <= CACHE else WINDOW
    return source.mapInArrow(task(probe_batches, folder, names, bits, least, shortest, with_text, window), schema)
