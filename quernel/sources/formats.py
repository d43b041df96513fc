"""Formats that Spark does not know, as data sources by name: ``quernel_frames`` (HDF5) and ``quernel_sheet`` (XLSX).

    formats.register(spark)
    spark.read.format("quernel_frames").load(folder)
    spark.read.format("quernel_sheet").option("header", "true").load(folder)
    formats.frames(spark, folder, "frame_index = 7")

Files are read where the tasks are, by ranged reads. Frames are planned by ranges of bytes: a file above ``splitBytes`` is several partitions, each with
the chunks that begin in its range. ``frames`` pushes its condition on ``frame_index`` and ``path``: files that can't match are not planned, chunks
and frames that can't are not read. Spark keeps pushed filters with the loaded table, so two scans of one table would share
them; a table loaded by name therefore takes none, and ``frames`` loads one of its own each time.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType, StringType, StructField, StructType

#: Bytes of a file that one partition reads.
SPLIT_BYTES = 128_000_000
#: Bytes of frames, or rows of a sheet, in a batch.
BATCH_BYTES, BATCH_ROWS = 8_000_000, 5_000


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to a session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FrameSource, SheetSource):
        spark.dataSource.register(source)
    return spark


def files_at(path: str, pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes of a file, or of all files below a folder whose names match."""
    store, base = pafs.FileSystem.from_uri(path if ":" in path.partition("/")[0] else f"file://{path}")
    prefix = f"{path.partition('://')[0]}://{path.partition('://')[2].partition(base)[0]}" if "://" in path and not path.startswith("file:") else "file://"
    found = store.get_file_info(base)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [found] if found.is_file else store.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted((prefix + i.path, i.size) for i in infos if i.is_file and re.search(pattern, i.path))


def opened(path: str):
    """A file for ranged reads."""
    store, base = pafs.FileSystem.from_uri(path)
    return store.open_input_file(base)


# ---- Frames


def frames(spark: SparkSession, path: str, condition: str | None = None, **options: str) -> DataFrame:
    """Frames that fulfil a condition, which is pushed to the files."""
    rows = register(spark).read.format("quernel_frames").options(pushed="true", **options).load(path)
    return rows.filter(condition) if condition else rows


@dataclass
class ByteRange(InputPartition):
    path: str
    low: int
    high: int


class FrameSource(DataSource):
    """path, frame_index and frame (bytes) of HDF5 files. Options: ``dataset`` (else frames or depth images), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "quernel_frames"

    def schema(self) -> str:
        return "path string, frame_index long, frame binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options)


TESTS = {
    EqualTo: lambda value, bound: value == bound, In: lambda value, bound: value in bound, GreaterThan: lambda value, bound: value > bound, GreaterThanOrEqual: lambda value, bound: value >= bound,
    LessThan: lambda value, bound: value < bound, LessThanOrEqual: lambda value, bound: value <= bound,
}


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pushed = options.get("pushed") == "true"
        self.path, self.dataset, self.split = options["path"], options.get("dataset"), int(options.get("splitBytes", SPLIT_BYTES))
        self.asked: dict[str, list[tuple[str, object]]] = {"path": [], "frame_index": []}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if self.pushed and type(f) in TESTS and len(f.attribute) == 1 else None
            if column in self.asked:
                self.asked[column].append((type(f).__name__, f.value))
            else:
                yield f

    def passes(self, column: str, value) -> bool:
        named = {kind.__name__: test for kind, test in TESTS.items()}
        return all(named[kind](value, bound) for kind, bound in self.asked[column])

    def partitions(self) -> list[ByteRange]:
        parts = []
        for path, size in files_at(self.path, r"\.(hdf5|h5)$"):
            if self.passes("path", path):
                parts += [ByteRange(path, low, low + self.split) for low in range(0, max(size, 1), self.split)]
        return parts

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        from quernel.sources import hdf5

        if partition is None:  # no file is asked for
            return
        with opened(partition.path) as source:
            file = hdf5.File(source)
            frames = file.frames(self.dataset)
            numbers, held, size = [], [], 0
            for number, frame in file.read_frames(frames, lambda k: self.passes("frame_index", k), partition.low, partition.high):
                numbers.append(number)
                held.append(frame)
                size += len(frame)
                if size >= BATCH_BYTES:
                    yield self.batch(partition.path, numbers, held)
                    numbers, held, size = [], [], 0
            if numbers:
                yield self.batch(partition.path, numbers, held)

    @staticmethod
    def batch(path: str, numbers: list[int], frames: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(numbers)), pa.array(numbers, pa.int64()), pa.array(frames, pa.binary())], ["path", "frame_index", "frame"])


# ---- Sheets


@dataclass
class OneFile(InputPartition):
    path: str


class SheetSource(DataSource):
    """Rows of sheets. Options: ``header`` (names in the first row, true unless said otherwise) and ``sheet`` (a name; else the first one).

    Without a schema all columns are strings, named by the first file's first row; with one, cells are read as its types and what is none is null.
    """

    @classmethod
    def name(cls) -> str:
        return "quernel_sheet"

    def schema(self) -> StructType:
        first = next(iter(files_at(self.options["path"], r"\.xlsx$")), None)
        if first is None:
            raise FileNotFoundError(f"no sheet at {self.options['path']}")
        with opened(first[0]) as source:
            row = next(sheet_rows(source, self.options.get("sheet")), [])
        headed = self.options.get("header", "true") == "true"
        return StructType([StructField(str(x) if headed and x is not None else f"_c{k}", StringType()) for k, x in enumerate(row)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(schema, self.options)


class SheetReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.sheet, self.header = schema, options["path"], options.get("sheet"), options.get("header", "true") == "true"

    def partitions(self) -> list[OneFile]:
        return [OneFile(path) for path, _ in files_at(self.path, r"\.xlsx$")]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        arrow = to_arrow_schema(self.schema)
        with opened(partition.path) as source:
            rows = sheet_rows(source, self.sheet)
            # columns are found by name, so files may have them in another order
            names = [None if x is None else str(x) for x in next(rows, [])] if self.header else [f.name for f in self.schema]
            places = [names.index(f.name) if f.name in names else None for f in self.schema]
            held: list[list] = []
            for row in rows:
                held.append([row[k] if k is not None and k < len(row) else None for k in places])
                if len(held) == BATCH_ROWS:
                    yield self.batch(held, arrow)
                    held = []
            if held:
                yield self.batch(held, arrow)

    def batch(self, rows: list[list], arrow: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cell(row[k], f.dataType) for row in rows], arrow.field(k).type) for k, f in enumerate(self.schema)], schema=arrow)


def cell(text: str | None, kind) -> object:
    """A cell's text as a type."""
    if text is None or isinstance(kind, StringType):
        return text
    try:
        if isinstance(kind, BooleanType):
            return {"1": True, "0": False, "true": True, "false": False}.get(text.lower())
        if isinstance(kind, IntegralType):
            return int(text) if re.fullmatch(r"[+-]?\d+", text) else int(value) if (value := float(text)).is_integer() else None
        if isinstance(kind, (DoubleType, FloatType)):
            return float(text)
    except ValueError:
        return None
    raise TypeError(f"sheets are not read as {kind.simpleString()}")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def text_of(element) -> str:
    """The text of a cell or shared string: its runs, without phonetic hints."""
    return "".join(x.text or "" for part in element if local(part.tag) != "rPh" for x in part.iter() if local(x.tag) == "t")


def sheet_rows(source, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts, pulled one by one; rows and cells that are left out are null."""
    with zipfile.ZipFile(source) as book:
        names, shared = set(book.namelist()), []
        relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [x for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(x.tag) == "sheet"]
        chosen = next((x for x in sheets if sheet in (None, x.get("name"))), None)
        if chosen is None:
            raise KeyError(f"no sheet {sheet}")
        target = relations[next(v for k, v in chosen.items() if local(k) == "id")]
        target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                for _, element in ElementTree.iterparse(part):
                    if local(element.tag) == "si":
                        shared.append(text_of(element))
                        element.clear()
        with book.open(target) as part:
            width, at, data = 0, 0, None
            for event, element in ElementTree.iterparse(part, events=("start", "end")):
                if event == "start":
                    data = element if local(element.tag) == "sheetData" else data
                    continue
                if local(element.tag) == "row":
                    number = int(element.get("r") or at + 1)
                    for _ in range(at + 1, number):
                        yield [None] * width
                    at, row = number, []
                    for c in element:
                        place = column_number(c.get("r")) if c.get("r") else len(row)
                        row += [None] * (place - len(row))
                        row.append(cell_text(c, shared))
                    width = max(width, len(row))
                    yield row
                    data.clear()


def column_number(reference: str) -> int:
    """The place of a cell by its name, which is a number of base 26 without a zero."""
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def cell_text(c, shared: list[str]) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return next((text_of(x) for x in c if local(x.tag) == "is"), None)
    value = next((x.text for x in c if local(x.tag) == "v"), None)
    if value is None or kind == "e":
        return None
    return shared[int(value)] if kind == "s" else value
