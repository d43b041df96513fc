"""Data sources by name: frames in HDF5 files and rows of sheets."""

import io
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quernel.sources import formats, hdf5, sinks


class Counting(hdf5.Memory):
    taken = 0

    def read_at(self, size, at):
        self.taken += size
        return super().read_at(size, at)


def all_frames(data, **options):
    file = hdf5.File(hdf5.Memory(data))
    return [x for _, x in file.read_frames(file.frames(), **options)]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 333, 3000])
@pytest.mark.parametrize("chunk,deflate", [(16, False), (16, True), (0, False), (5, True)])
def test_frames_come_back(n, chunk, deflate):
    rng = random.Random(n)
    frames = [rng.randbytes(rng.randrange(60)) for _ in range(n)]
    data = hdf5.write(frames, chunk, deflate)
    assert all_frames(data) == frames and all_frames(data, wanted=lambda k: k % 7 == 3) == frames[3::7]
    middle = len(data) // 2
    assert sorted(all_frames(data, high=middle) + all_frames(data, low=middle)) == sorted(frames)


def test_few_frames_are_few_bytes():
    frames = [bytes([k % 256]) * 10_000 for k in range(400)]
    data = hdf5.write(frames, 16)
    source = Counting(data)
    file = hdf5.File(source)
    assert list(file.read_frames(file.frames(), lambda k: k == 123)) == [(123, frames[123])]
    assert source.taken < 30_000 < len(data) / 100


def foreign(filters=(), version=2):
    """A file in the newer form: a superblock of version 2, headers with links, and a dataset of rows of four bytes each in chunks, by hand."""
    body = bytearray(b"\0" * 48)

    def put(data):
        at = len(body)
        body.extend(data)
        return at

    rows = [bytes([k, k + 1, k + 2, k + 3]) for k in range(10)]
    keys = b""
    for begin in range(0, 10, 4):
        data = b"".join(rows[begin : begin + 4]).ljust(16, b"\0")
        for kind in filters:
            data = zlib.compress(data) if kind == hdf5.DEFLATE else data
        keys += struct.pack("<IIQQQQ", len(data), 0, begin, 0, 0, put(data))
    tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, 3, hdf5.NOWHERE, hdf5.NOWHERE) + keys + struct.pack("<IIQQQ", 0, 0, 10, 0, 0))

    def header(messages):
        data = b"".join(struct.pack("<BHB", kind, len(x), 0) + x for kind, x in messages)
        return put(b"OHDR" + bytes([2, 0, len(data)]) + data + b"\0\0\0\0")

    pipeline = bytes([2, len(filters)]) + b"".join(struct.pack("<HHHI" if k == hdf5.DEFLATE else "<HHHI", k, 0, 1, 1) for k in filters)
    dataset = header([
        (hdf5.DATASPACE, bytes([2, 2, 0, 1]) + struct.pack("<QQ", 10, 4)), (hdf5.DATATYPE, struct.pack("<B3xIHH", 0x10, 1, 0, 8)),
        (hdf5.LAYOUT, struct.pack("<BBBQIII", 3, 2, 3, tree, 4, 4, 1)), *([(hdf5.FILTERS, pipeline)] if filters else []),
    ])
    root = header([(hdf5.LINK, bytes([1, 0, 6]) + b"frames" + struct.pack("<Q", dataset))])
    body[:48] = hdf5.SIGNATURE + bytes([version, 8, 8, 0]) + struct.pack("<QQQQI", 0, hdf5.NOWHERE, len(body), root, 0)
    return bytes(body), rows


@pytest.mark.parametrize("filters", [(), (hdf5.SHUFFLE,), (hdf5.SHUFFLE, hdf5.DEFLATE)])
def test_newer_files_with_rows_of_one_length(filters):
    data, rows = foreign(filters)
    assert all_frames(data) == rows


def test_what_is_not_read_is_told():
    with pytest.raises(ValueError):
        hdf5.File(hdf5.Memory(b"no file of this kind" * 10))
    with pytest.raises(KeyError):
        all_frames(hdf5.write([b"x"], name="other"))
    assert all_frames(hdf5.write([b"depth"], name="depth_mm_png")) == [b"depth"]


def test_frame_source(spark, tmp_path):
    rng = random.Random(1)
    wanted = {}
    for episode in range(6):
        frames = [rng.randbytes(rng.randrange(2000)) for _ in range(40 * episode)]
        (tmp_path / f"episode_{episode}.hdf5").write_bytes(hdf5.write(frames, 8))
        wanted |= {(episode, k): x for k, x in enumerate(frames)}
    rows = formats.register(spark).read.format("quernel_frames").option("splitBytes", "20000").load(str(tmp_path))
    numbered = rows.withColumn("e", F.regexp_extract("path", r"(\d+)\.hdf5", 1).cast("int"))
    assert rows.rdd.getNumPartitions() > 6
    assert {(r.e, r.frame_index): bytes(r.frame) for r in numbered.collect()} == wanted
    # one table, two scans
    both = numbered.filter("frame_index < 2").unionByName(numbered.filter("frame_index = 30"))
    assert sorted((r.e, r.frame_index) for r in both.collect()) == sorted(k for k in wanted if k[1] in (0, 1, 30))


def test_conditions_are_pushed(spark, tmp_path):
    for episode in range(3):
        (tmp_path / f"episode_{episode}.hdf5").write_bytes(hdf5.write([b"%d-%d" % (episode, k) for k in range(50)], 8))
    path = f"file://{tmp_path}/episode_1.hdf5"
    found = formats.frames(spark, str(tmp_path), f"path = '{path}' AND frame_index IN (3, 4, 49)")
    assert found.rdd.getNumPartitions() == 1
    assert sorted(bytes(r.frame) for r in found.collect()) == [b"1-3", b"1-4", b"1-49"]
    assert formats.frames(spark, str(tmp_path), "path = 'nowhere'").collect() == []
    reader = formats.FrameReader({"path": str(tmp_path), "pushed": "true"})
    left = list(reader.pushFilters([formats.GreaterThan(("frame_index",), 40), formats.EqualTo(("path",), path), formats.EqualTo(("frame",), b"x")]))
    assert [f.attribute for f in left] == [("frame",)] and [p.path for p in reader.partitions()] == [path]
    assert sum(len(b) for b in reader.read(reader.partitions()[0])) == 9
    assert len(list(formats.FrameReader({"path": str(tmp_path)}).pushFilters([formats.GreaterThan(("frame_index",), 40)]))) == 1


def book(sheets, shared=()):
    """A workbook as other programs write it: cells with names, shared strings, rows and cells left out."""
    out, main = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(f"<sheet name={chr(34)}{n}{chr(34)} sheetId={chr(34)}{k}{chr(34)} r:id={chr(34)}r{k}{chr(34)}/>" for k, n in enumerate(sheets))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{"".join(f"<Relationship Id={chr(34)}r{k}{chr(34)} Target={chr(34)}worksheets/s{k}.xml{chr(34)}/>" for k in range(len(sheets)))}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si>{x}</si>" for x in shared)}</sst>')
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


FOREIGN = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="AA1" t="inlineStr"><is><t>far</t></is></c></row>'
    '<row r="2"><c r="B2"><v>2.5</v></c><c r="A2" t="s"><v>2</v></c></row><row r="4"><c r="B4" t="e"><v>#N/A</v></c><c r="AA4" t="b"><v>1</v></c></row>'
)
SHARED = ("<t>name</t>", "<r><t>va</t></r><r><t>lue</t></r><rPh><t>hint</t></rPh>", "<t xml:space='preserve'> x &amp; y </t>")


def test_foreign_sheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book({"first": FOREIGN.replace('<c r="B2"><v>2.5</v></c><c r="A2" t="s"><v>2</v></c>', '<c r="A2" t="s"><v>2</v></c><c r="B2"><v>2.5</v></c>'), "other": "<row><c><v>7</v></c></row><row><c><v>8</v></c></row>"}, SHARED))
    read = formats.register(spark).read.format("quernel_sheet")
    rows = read.load(str(tmp_path / "a.xlsx"))
    assert rows.columns[:2] == ["name", "value"] and len(rows.columns) == 27 and rows.columns[26] == "far"
    assert [(r["name"], r["value"], r["far"]) for r in rows.collect()] == [(" x & y ", "2.5", None), (None, None, None), (None, None, "1")]
    typed = read.schema("far boolean, value double, missing long").load(str(tmp_path)).collect()
    assert [tuple(r) for r in typed] == [(None, 2.5, None), (None, None, None), (True, None, None)]
    assert [r[0] for r in read.option("sheet", "other").option("header", "false").schema("n long").load(str(tmp_path)).collect()] == [7, 8]


def test_own_sheets_of_all_types(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a<b>&\x01", 0.1, True, "g1"), (2, None, None, None, "g1"), (3, "  two\nlines ", -1e300, False, "g/2")], "k long, t string, d double, b boolean, g string")
    done = sinks.write_spreadsheets(rows, "g", f"file://{tmp_path}/books", "k").collect()
    assert sorted((r.group, r.n) for r in done) == [("g/2", 1), ("g1", 2)]
    read = formats.register(spark).read.format("quernel_sheet").schema("k long, t string, d double, b boolean").load(f"file://{tmp_path}/books")
    assert sorted(map(tuple, read.collect())) == [(1, "a<b>&", 0.1, True), (2, None, None, None), (3, "  two\nlines ", -1e300, False)]
    with pytest.raises(Exception, match="nothing"):
        formats.register(spark).read.format("quernel_sheet").load(f"{tmp_path}/nothing")


def test_cells():
    from pyspark.sql.types import DateType, LongType

    assert [formats.cell(x, LongType()) for x in ("3", "3.0", "3.5", "x", None)] == [3, 3, None, None, None]
    assert [formats.column_number(x) for x in ("A1", "Z9", "AA10", "BC2")] == [0, 25, 26, 54]
    with pytest.raises(TypeError):
        formats.cell("1", DateType())
