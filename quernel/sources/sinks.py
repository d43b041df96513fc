"""Sinks: JSON lines and documents, CSV and TSV, spreadsheets, checked Parquet, and outputs that are written once."""

from __future__ import annotations

import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable
from itertools import chain
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields kept."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.option("header", True).option("sep", sep).csv(path)


def document(rows: DataFrame, order: list[str]) -> DataFrame:
    """A small result as one JSON array, in one row."""
    keys = [F.col(c) for c in order]
    items = F.array_sort(F.collect_list(F.struct(*keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_json"))))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["_json"]), ","), F.lit("]")).alias("value"))


def summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A map from key to value as JSON."""
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value)))))).alias("value"))


def write_frames(rows: DataFrame, path: str) -> None:
    """Trajectory frames as Parquet; a state that has not 16 numbers fails the job."""
    sized = rows.withColumn("state", F.when(F.size("state") == 16, F.col("state")).otherwise(F.raise_error(F.lit("a state needs 16 numbers"))))
    sized.write.parquet(path)


#: The columns of converted episodes.
FRAME_COLUMNS = ("observation.state", "action", "timestamp", "frame_index", "episode_index", "index", "task_index")


def validated(rows: DataFrame, columns: tuple[str, ...] = FRAME_COLUMNS, vectors: tuple[str, ...] = ("observation.state", "action")) -> None:
    """Written frames are read back and judged: all columns, some rows, 16 numbers in each vector of each row; raises otherwise."""
    lacks = [c for c in columns if c not in rows.columns]
    if lacks:
        raise ValueError(f"columns are missing: {lacks}")
    wrong = F.lit(False)
    for c in vectors:
        wrong = wrong | F.coalesce(F.size(F.col(f"`{c}`")) != 16, F.lit(True))
    count, bad = rows.agg(F.count("*"), F.count_if(wrong)).first()
    if not count or bad:
        raise ValueError("no rows were written" if not count else f"{bad} rows have vectors that are not of 16 numbers")


def unwritten(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose output is not there yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


#: What a sheet can hold, with its head.
SHEET_ROWS = 1_048_576


def spreadsheet(out, columns: list[str], rows: Iterable[Iterable], sheet: str = "results") -> None:
    """Write an XLSX with inline strings to a stream, row by row."""

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c><v>{value!r}</v></c>"
        text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    name = escape(re.sub(r"[\\/*?:\[\]]", "_", sheet)[:31], {'"': "&quot;"})
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    packages = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{packages}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{packages}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{packages}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for line in chain([columns], rows):
                part.write(f'<row>{"".join(map(cell, line))}</row>'.encode())
            part.write(b"</sheetData></worksheet>")


def write_spreadsheet(rows: DataFrame, path: str, sheet: str = "results", most: int = SHEET_ROWS - 1) -> None:
    """A small result as one XLSX, on the driver, row by row; refused beyond what a sheet can hold."""
    if rows.count() > most:
        raise ValueError("too many rows for a sheet")
    spreadsheet(path, rows.columns, ([r[c] for c in rows.columns] for r in rows.toLocalIterator()), sheet)


def put_file(folder: str, name: str, write: Callable) -> str:
    """A file in a folder that all machines see: written beside its name and moved there, so that a task that is done again does no harm."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    beside = f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        write(out)
    store.move(beside, f"{base}/{name}")
    return f"{folder}/{name}"


def file_for_each(rows: DataFrame, by: str, folder: str, ending: str, write: Callable) -> DataFrame:
    """A file for each value of a column, written where its rows are: (group, path, n), written at once. A value's rows are one task's, so they must fit in it."""

    def one(table: pa.Table) -> pa.Table:
        group = str(table.column(by)[0].as_py())
        plain = re.sub(r"[^A-Za-z0-9_.-]", "_", group)[:100]
        name = plain if plain == group else f"{plain}-{zlib.crc32(group.encode()):08x}"
        path = put_file(folder, f"{name}.{ending}", lambda out: write(out, group, table))
        return pa.table({"group": [group], "path": [path], "n": pa.array([len(table)], pa.int64())})

    rows.groupBy(by).applyInArrow(one, "group string, path string, n long").write.parquet(f"{folder}/_written")
    return rows.sparkSession.read.parquet(f"{folder}/_written")


def write_spreadsheets(rows: DataFrame, by: str, folder: str, order: str | None = None) -> DataFrame:
    """A sheet for each value of a column, named by it, with the other columns."""

    def write(out, group: str, table: pa.Table) -> None:
        if len(table) >= SHEET_ROWS:
            raise ValueError("too many rows for a sheet")
        table = (table.sort_by(order) if order else table).drop_columns([by])
        spreadsheet(out, table.column_names, (row for batch in table.to_batches(5000) for row in zip(*(c.to_pylist() for c in batch.columns))), group)

    return file_for_each(rows, by, folder, "xlsx", write)


def write_frame_files(rows: DataFrame, by: str, order: str, frame: str, folder: str, chunk: int = 16, deflate: bool = False) -> DataFrame:
    """An HDF5 file of frames for each value of a column, the frames in the order of another one."""

    def write(out, group: str, table: pa.Table) -> None:
        from quernel.sources import hdf5

        frames = table.sort_by(order).column(frame).to_pylist()
        out.write(hdf5.write([x if isinstance(x, bytes) else (x or "").encode() for x in frames], chunk, deflate))

    return file_for_each(rows.select(by, order, frame), by, folder, "hdf5", write)


def write_detections(rows: DataFrame, path: str) -> None:
    """Detection results as JSON lines, a box a line, in parallel; ``document`` makes one array of a small result."""
    rows.select(F.to_json(F.struct("image_id", "bbox", "score", "category_id")).alias("value")).write.text(path)


def write_manifest(rows: DataFrame, settings: dict, order: list[str], name: str = "samples") -> DataFrame:
    """One row: settings and the exact list of samples as a JSON object. A manifest is of one evaluation, so it is short."""
    listed = document(rows, order).select("value")
    head = json.dumps(settings, ensure_ascii=False)[:-1]
    return listed.select(F.concat(F.lit(head + (", " if settings else "") + json.dumps(name) + ": "), "value", F.lit("}")).alias("value"))


def write_document(rows: DataFrame, order: list[str], path: str, settings: dict | None = None, name: str = "rows") -> None:
    """One JSON document of any size, a row a line, over the files of a folder in order: an array, or with settings an object that holds them and the rows.

    Rows are written by many tasks; a row's line begins with a comma, but for the first.
    """
    spark = rows.sparkSession
    keyed = rows.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")).select(F.monotonically_increasing_id().alias("id"), "json")
    keyed.write.parquet(f"{path}.ordered")
    listed = spark.read.parquet(f"{path}.ordered")
    first = listed.agg(F.min("id")).first()[0]
    head = "" if settings is None else json.dumps(settings, ensure_ascii=False)[:-1] + (", " if settings else "") + json.dumps(name) + ": "
    ends = spark.createDataFrame([(-1, head + "["), ((1 << 63) - 1, "]" if settings is None else "]}")], "id long, value string")
    lines = listed.select("id", F.when(F.col("id") == F.lit(first), F.col("json")).otherwise(F.concat(F.lit(","), "json")).alias("value"))
    lines.unionByName(ends).orderBy("id").select("value").write.text(path)


def write_texts(rows: DataFrame, by: str, text: str, folder: str) -> DataFrame:
    """A text file for each value of a column, named by it, all in one folder."""

    def write(out, group: str, table: pa.Table) -> None:
        out.write("\n".join(x or "" for x in table.column(text).to_pylist()).encode() + b"\n")

    return file_for_each(rows.select(by, text), by, folder, "txt", write)


def write_issues(issues: DataFrame, path: str) -> None:
    """An issue log, one JSON object a line, null fields kept."""
    write_lines(issues, path)


def image_files(rows: DataFrame, folder: str, image: str = "image", name: str = "index") -> DataFrame:
    """Images in base64 as (path, data), to be written as files: one image is ``<name>.jpg``, several are ``<name>_<k>.jpg``."""
    kind = rows.schema[image].dataType.simpleString()
    listed = F.col(image) if kind.startswith("array") else F.array(image)
    many = F.size(listed) > 1
    each = rows.select(F.col(name).cast("string").alias("_n"), many.alias("_m"), F.posexplode(listed).alias("_k", "_d"))
    path = F.concat(F.lit(folder.rstrip("/") + "/"), "_n", F.when(F.col("_m"), F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise(""), F.lit(".jpg"))
    return each.select(path.alias("path"), F.try_to_binary(F.regexp_replace("_d", "^data:[^,]*,", ""), F.lit("base64")).alias("data")).filter("data is not null")


def write_images(files: DataFrame) -> DataFrame:
    """Write (path, data) where no file is there yet, from the tasks, to a store that all machines see; gives path and whether it was written."""

    def put(batches):
        import pyarrow.fs as pafs

        for batch in batches:
            written = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist()):
                store, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                there = store.get_file_info(base).type != pafs.FileType.NotFound
                if not there:
                    store.create_dir(base.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(base, compression=None) as out:
                        out.write(data)
                written.append(not there)
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "written": pa.array(written, pa.bool_())})

    import pyarrow as pa

    return files.mapInArrow(put, "path string, written boolean")
