"""Benchmark decontamination by one Aho-Corasick automaton over normalised test texts.

Texts are normalised to their words (ASCII letters small; everything in ASCII but letters and digits separates)
with one blank before, between and after them. Each benchmark item gives its windows of ``width``
consecutive words, or one window of all its words if it has fewer. The automaton holds all windows and scans
each document once; a match's place in the normalised text leads to word numbers, and these to
offsets in the original text.

The benchmark is read in blocks of at most ``BLOCK_WINDOWS`` windows, each written to the shared folder. A worker
holds one block's automaton at a time; with one block, as usual, it is built once for each worker.

Defined cases: a null or empty text has no words and no hits; an item without words has no windows; items that
repeat an id are one item; an item whose id is null hits words but is not listed; an empty benchmark hits nothing.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm._shared import batches_of, holds, scratch, task

WIDTH = 10
BLOCK_WINDOWS = 50_000
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
SPANS = "array<struct<begin:int,end:int>>"
#: Bytes of text that are scanned before the next block of windows is loaded.
BATCH = 16_000_000


def normalised(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def windows(words: list[bytes], width: int) -> list[list[bytes]]:
    """All runs of ``width`` words, or all words if there are fewer but some."""
    return [words[k : k + width] for k in range(max(1, len(words) - width + 1))] if words else []


def write_blocks(benchmark: DataFrame, width: int, item_col: str, text_col: str, limit: int = BLOCK_WINDOWS) -> list[str]:
    """Write the benchmark's windows with their items, ``limit`` windows a block. The driver streams them, a block at a time."""
    folder = scratch(benchmark.sparkSession, "windows")
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    block: dict[bytes, set[str]] = {}
    paths: list[str] = []

    def flush() -> None:
        if block:
            with store.open_output_stream(f"{base}/block-{len(paths):05d}") as file:
                file.write(pickle.dumps({k: sorted(v) for k, v in block.items()}))
            paths.append(f"{folder}/block-{len(paths):05d}")
            block.clear()

    for row in benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        for window in windows(normalised(row.text), width):
            block.setdefault(b" " + b" ".join(window) + b" ", set()).update([] if row.item is None else [row.item])
        if len(block) >= limit:
            flush()
    flush()
    return paths


_BLOCK: dict[str, object] = {}


def automaton(path: str):
    """A block's automaton; a worker keeps the last one."""
    if path not in _BLOCK:
        import ahocorasick

        store, base = pafs.FileSystem.from_uri(path)
        with store.open_input_stream(base) as file:
            block = pickle.loads(file.read())
        found = ahocorasick.Automaton()
        for window, items in block.items():
            found.add_word(window.decode("latin-1"), (len(window), window.count(b" ") - 1, items))
        found.make_automaton()
        _BLOCK.clear()
        _BLOCK[path] = found
    return _BLOCK[path]


def scan_batches(batches: Iterator[pa.RecordBatch], paths: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Scan the column ``text`` and add the columns of the result; the other columns pass."""
    holds("decontam", _BLOCK)
    for batch in (part for whole in batches for part in batches_of(whole, "text", BATCH)):
        texts = batch.column("text").to_pylist()
        lines = [b" ".join([b"", *normalised(t), b""]).decode("latin-1") for t in texts]
        hits: list[set[int]] = [set() for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for path in paths:
            found = automaton(path)
            for k, line in enumerate(lines):
                starts = None
                for at, (size, count, names) in found.iter(line):
                    if starts is None:
                        starts = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
                    first = int(np.searchsorted(starts, at - size + 1))
                    hits[k].update(range(first, first + count))
                    items[k].update(names)
        spans = []
        for text, hit in zip(texts, hits):
            found_spans: list[dict] = []
            if hit:
                for number, match in enumerate(WORD.finditer(text)):
                    if number in hit:
                        if number - 1 in hit:
                            found_spans[-1]["end"] = match.end()
                        else:
                            found_spans.append({"begin": match.start(), "end": match.end()})
            spans.append(found_spans)
        counts = [max(0, line.count(" ") - 1) for line in lines]
        added = {"n_words": counts, "n_hit": list(map(len, hits)), "items": [sorted(x) for x in items], "spans": spans}
        columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, schema.field(k).type) for k, v in added.items())], schema=schema)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) and spans (hit code points of the original text)."""
    paths = write_blocks(benchmark, width, item_col, item_text_col, block_windows)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType)]).add("n_words", T.LongType()).add("n_hit", T.LongType()).add("items", T.ArrayType(T.StringType()))
    schema = T.StructType(schema.fields + T._parse_datatype_string(f"spans {SPANS}").fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    return source.mapInArrow(task(scan_batches, paths, to_arrow_schema(schema)), schema)


def clean_batches(batches: Iterator[pa.RecordBatch], paths: list[str], text_col: str) -> Iterator[pa.RecordBatch]:
    """The rows whose text has no window of the benchmark."""
    holds("decontam", _BLOCK)
    for batch in (part for whole in batches for part in batches_of(whole, text_col, BATCH)):
        lines = [b" ".join([b"", *normalised(t), b""]).decode("latin-1") for t in batch.column(text_col).to_pylist()]
        keep = np.ones(len(lines), bool)
        for path in paths:
            found = automaton(path)
            for k in np.flatnonzero(keep).tolist():
                keep[k] = next(found.iter(lines[k]), None) is None
        yield batch.filter(pa.array(keep))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark."""
    paths = write_blocks(benchmark, width, item_col, item_text_col, block_windows)
    return docs.mapInArrow(task(clean_batches, paths, text_col), docs.schema)
