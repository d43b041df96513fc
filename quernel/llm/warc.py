"""WARC archives with an external merge of their capture indexes.

1. Payload digests are summed to the smallest page_id of each digest, so that of records with equal payloads of
   at least ``least`` bytes one is a response and the others revisit it.
2. Each task writes its pages to archives (one gzip member for each WARC record) and, beside each archive, a run: its
   captures in order of URL key, timestamp and page_id, with a sparse index of every ``SPARSE``-th key.
3. The runs are merged outside memory by a loser tree. A first kind of pass merges groups of ``FAN_IN`` runs to
   longer runs until at most ``OPEN_RUNS`` are left; the last pass gives each task a range of the key space, in which it
   merges the slices of all runs (found by their sparse indexes). Ranges are cut by whole keys (URL,
   timestamp, page), so one host or URL with very many captures spreads over many tasks.
4. The merged captures, in global order, lead to the records: each is read back from its archive by offset and checked.

An archive or run counts only once the manifest, a table, lists it. Defined cases: a null html is an empty payload;
a null url has an empty key and the target ``urn:page``; a null page_id comes last among equal captures and is never
revisited; rows that repeat a page are records of their own; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm._shared import scratch, task, written

LEAST = 100
FAN_IN = 64
#: Runs that a task of the last pass has open.
OPEN_RUNS = 512
SPARSE = 256
ARCHIVE_BYTES = 256_000_000
RANGE_CAPTURES = 200_000
SAMPLES = 64
BROADCAST_ROWS = 1_000_000
LAST_ID = 2**63 - 1
FIRST_DATE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
MANIFEST = "archive string, run string, n_captures long, samples array<string>"
CAPTURES = "urlkey string, captured string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"


# ---- Records


def url_key(url: str | None) -> str:
    """The sortable form of a URL: host labels from the last to the first, then path and query, all small."""
    if not url:
        return ""
    match = re.match(r"(?is)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)", url)
    if not match:
        return clean_url(url).lower()
    host, port, rest = match.groups()
    key = ",".join(reversed(host.strip(".").split("."))) + (f":{port}" if port not in (None, "", "80", "443") else "")
    return clean_url(f"{key}){rest or '/'}").lower()


def clean_url(url: str) -> str:
    """No blanks and control characters: these would break a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def captured_at(page_id: int | None) -> str:
    """The tables hold no time of capture; each page gets a second of its own."""
    seconds = 0 if page_id is None else page_id % 3_000_000_000
    return (FIRST_DATE + datetime.timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")


def record(page_id: int | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, which tells the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    date = datetime.datetime.strptime(captured, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean_url(url) if url else 'urn:page'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*lines, "", ""]).encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, wbits=31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """Headers, payload (None for a revisit) and the payload's length of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record has a wrong length")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    if fields["WARC-Type"] == "revisit":
        return fields, None, length
    if len(payload) != length or "sha256:" + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError("a payload differs from its digest")
    return fields, payload, length


# ---- Runs


def order_of(capture: list) -> tuple:
    """URL key (by code points), timestamp, page (null last), and then the place, so that the order is total."""
    return capture[0].encode("utf-8", "surrogatepass"), capture[1], LAST_ID if capture[2] is None else capture[2], capture[7], capture[8]


def write_run(path: str, captures: Iterator[list]) -> tuple[int, list[str]]:
    """Write sorted captures, one JSON line each, and the sparse index; give their number and some of the keys."""
    store, base = pafs.FileSystem.from_uri(path)
    sparse, at, count = [], 0, 0
    with store.open_output_stream(base + ".run") as out:
        for capture in captures:
            if count % SPARSE == 0:
                sparse.append([capture, at])
            line = json.dumps(capture).encode() + b"\n"
            out.write(line)
            at += len(line)
            count += 1
    with store.open_output_stream(base + ".sparse") as out:
        keys = [json.dumps(capture).encode() for capture, _ in sparse]
        places = np.stack([np.cumsum([0, *map(len, keys)]), [at_ for _, at_ in sparse] + [at]], 1)
        out.write(b"".join(keys) + places.astype("<i8").tobytes() + np.array([len(keys)], "<i8").tobytes())
    picked = [sparse[k][0] for k in np.linspace(0, len(sparse) - 1, min(SAMPLES, len(sparse))).astype(int)] if sparse else []
    return count, [json.dumps(x) for x in picked]


def first_place(path: str, low: list) -> int:
    """The place in a run of the last sparse key before ``low``, or 0. A binary search: few keys are read of an index of any length.

    The index holds the keys, then for each where it begins and its place in the run, in 8 bytes each, and last their number.
    """
    store, base = pafs.FileSystem.from_uri(path)
    with store.open_input_file(base + ".sparse") as file:
        size = file.size()
        count = int(np.frombuffer(file.read_at(8, size - 8), "<i8")[0])
        table = size - 8 - 16 * (count + 1)
        least, most, found = 0, count, 0
        while least < most:
            middle = (least + most) // 2
            begin, place, end, _ = np.frombuffer(file.read_at(32, table + 16 * middle), "<i8").tolist()
            if order_of(json.loads(file.read_at(end - begin, begin))) < order_of(low):
                least, found = middle + 1, place
            else:
                most = middle
    return found


def read_run(path: str, low: list | None, high: list | None) -> Iterator[list]:
    """The captures of a run from ``low`` on and before ``high``, from the last sparse key before ``low``."""
    store, base = pafs.FileSystem.from_uri(path)
    first = 0 if low is None else first_place(path, low)
    with store.open_input_file(base + ".run") as file:
        size, rest = file.size(), b""
        file.seek(first)
        while first < size:
            data = file.read(min(1 << 18, size - first))
            first += len(data)
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                capture = json.loads(line)
                if low is not None and order_of(capture) < order_of(low):
                    continue
                if high is not None and order_of(capture) >= order_of(high):
                    return
                yield capture


class LoserTree:
    """Merges sorted streams. Each inner node keeps the loser of its match; the winner of all stands at the top.

    Taking the winner lets its stream's next item play only the matches on its way up: one comparison a level.
    """

    def __init__(self, streams: list[Iterator], key: Callable):
        self.streams, self.key = [iter(s) for s in streams], key
        self.count = len(self.streams)
        self.items = [next(s, None) for s in self.streams]
        self.keys = [None if x is None else key(x) for x in self.items]
        self.losers = [0] * max(1, self.count)
        self.losers[0] = self.play(1) if self.count > 1 else 0

    def beats(self, a: int, b: int) -> bool:
        """Whether stream a's item comes before b's. Ended streams lose; equal items keep the streams' order."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def play(self, node: int) -> int:
        """The winner under a node; leaves are numbered from ``count`` on."""
        if node >= self.count:
            return node - self.count
        left, right = self.play(2 * node), self.play(2 * node + 1)
        winner, loser = (left, right) if self.beats(left, right) else (right, left)
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator:
        while self.count and self.keys[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.items[winner]
            item = self.items[winner] = next(self.streams[winner], None)
            self.keys[winner] = None if item is None else self.key(item)
            node = (winner + self.count) // 2
            while node >= 1:
                if self.beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.losers[0] = winner


def merged(runs: list[str], low: list | None = None, high: list | None = None) -> Iterator[list]:
    return iter(LoserTree([read_run(r, low, high) for r in runs], order_of))


# ---- Jobs


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each payload's length and digest to page_id."""
    for batch in batches:
        data = [(x.as_py() or "").encode("utf-8", "replace") for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(map(len, data), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data])], ["page_id", "n_bytes", "digest"])


def add_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256((x.as_py() or "").encode("utf-8", "replace")).hexdigest() for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "digest"])


def archive_batches(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Write archives and their runs; one row of the manifest for each."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    out, name, at, captures = None, "", 0, []

    def close() -> pa.RecordBatch:
        out.close()
        count, samples = write_run(f"{folder}/{name}", sorted(captures, key=order_of))
        return pa.RecordBatch.from_pydict({"archive": [name], "run": [f"{folder}/{name}"], "n_captures": pa.array([count], pa.int64()), "samples": pa.array([samples], pa.list_(pa.string()))})

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "original")]
        for page_id, url, digest, original, html in zip(*columns, batch.column("html")):
            payload = (html.as_py() or "").encode("utf-8", "replace")
            refers_to = None if original is None or original == page_id else original
            captured = captured_at(page_id)
            data = member(record(page_id, url, captured, payload, digest, refers_to))
            if out is None:
                name, at, captures = f"archive-{uuid.uuid4().hex}", 0, []
                out = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
            out.write(data)
            captures.append([url_key(url), captured, page_id, "response" if refers_to is None else "revisit", digest, len(payload), refers_to, name, at, len(data)])
            at += len(data)
            if at >= limit:
                yield close()
                out = None
    if out is not None:
        yield close()


def write_archives(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write all pages; the folder and the manifest of archives and runs."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    sums = source.select("page_id", "html").mapInArrow(task(digest_batches), "page_id long, n_bytes long, digest string")
    firsts = sums.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = written(firsts, "originals")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    marked = source.mapInArrow(task(add_digest), "page_id long, url string, html string, digest string").join(firsts, "digest", "left")
    return folder, written(marked.select("page_id", "url", "html", "digest", "original").mapInArrow(task(archive_batches, folder, archive_bytes), MANIFEST), "warc-manifest")


def merge_group(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Merge each group of runs to one longer run."""
    for batch in batches:
        for runs in batch.column("runs").to_pylist():
            path = f"{folder}/run-{uuid.uuid4().hex}"
            count, samples = write_run(path, merged(sorted(runs)))
            yield pa.RecordBatch.from_pydict({"archive": pa.array([None], pa.string()), "run": [path], "n_captures": pa.array([count], pa.int64()), "samples": pa.array([samples], pa.list_(pa.string()))})


def captures_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in CAPTURES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def merge_range(batches: Iterator[pa.RecordBatch], runs: list[str], cuts: list[list]) -> Iterator[pa.RecordBatch]:
    """The captures of a range of keys, merged from all runs."""
    for batch in batches:
        for number in batch.column("id").to_pylist():
            rows: list[list] = []
            for capture in merged(runs, cuts[number - 1] if number else None, cuts[number] if number < len(cuts) else None):
                rows.append(capture)
                if len(rows) == 4096:
                    yield captures_batch(rows)
                    rows = []
            if rows:
                yield captures_batch(rows)


def merge_index(spark: SparkSession, folder: str, manifest: DataFrame, fan_in: int = FAN_IN, open_runs: int = OPEN_RUNS, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """All captures; partition after partition, they are in order of URL key, timestamp and page.

    Groups of about ``fan_in`` runs are merged by tasks of their own until at most ``open_runs`` are left; then each task merges a
    range of keys of all of them. The driver holds a short row for each run that is left: its path, its count and at most SAMPLES keys.
    """
    runs = manifest.select("run", "n_captures", "samples")
    while (count := runs.count()) > open_runs:
        number = -(-count // fan_in)
        group = F.pmod(F.xxhash64("run"), F.lit(number)).alias("group")
        dealt = runs.groupBy(group).agg(F.collect_list("run").alias("runs")).select("runs").repartition(number)
        runs = written(dealt.mapInArrow(task(merge_group, folder), MANIFEST), "merge-pass").select("run", "n_captures", "samples")
    runs = runs.collect()
    total = sum(r.n_captures for r in runs)
    ranges = max(1, min(total, max(-(-total // range_captures), 2 * spark.sparkContext.defaultParallelism)))
    keys = sorted((json.loads(s) for r in runs for s in r.samples), key=order_of)
    cuts = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []
    return spark.range(0, ranges if keys else 0, 1, ranges).mapInArrow(task(merge_range, sorted(r.run for r in runs), cuts), CAPTURES)


def fetch_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Read each capture's record from its archive and take all values from the record itself."""
    store, base = pafs.FileSystem.from_uri(folder)
    files: dict[str, pa.NativeFile] = {}
    try:
        for batch in batches:
            names, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            found: list = [None] * len(names)
            for k in sorted(range(len(names)), key=lambda k: (names[k], offsets[k])):
                if names[k] not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[names[k]] = store.open_input_file(f"{base}/{names[k]}.warc.gz")
                files[names[k]].seek(offsets[k])
                fields, _, length = parse(zlib.decompress(files[names[k]].read(lengths[k]), 31))
                page, to = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
                found[k] = (None if page is None else int(page), length, fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"], None if to is None else int(to))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("urlkey"), batch.column("captured")], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured"])
    finally:
        for file in files.values():
            file.close()


def read_archives(folder: str, captures: DataFrame) -> DataFrame:
    """The records of the captures, read back in the order of the index."""
    return captures.mapInArrow(task(fetch_batches, folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, captured string")
