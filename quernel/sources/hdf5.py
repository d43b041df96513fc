"""Frames in HDF5 files, read by address: superblock, group, chunk index and heap are walked with ranged reads, no file as a whole.

What is read is one dataset of frames: a row of bytes strings of any length (in the global heap), or rows of bytes of one length; contiguous, compact or in
chunks, which may be deflated and shuffled. ``write`` makes such files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# ---- Fixed values of the format.

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = 2**64 - 1
DATASPACE, DATATYPE, LINK, LAYOUT, FILTERS, CONTINUATION, SYMBOLS = 0x01, 0x03, 0x06, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE = 1, 2
VARIABLE = 9
#: Datasets that hold frames, the preferred one first.
DATASETS = ("frames", "depth_mm_png")


@dataclass
class Frames:
    """Where a dataset's frames are."""

    count: int
    width: int  # bytes of an element, or of a reference to it
    variable: bool
    chunk: int  # elements of a chunk
    filters: list[int] = field(default_factory=list)
    chunks: list[tuple[int, int, int, int]] = field(default_factory=list)  # first element, address, bytes, mask of filters left out
    inside: bytes | None = None  # a compact dataset's data


class File:
    """A file of ranged reads; ``read_at(size, offset)`` is all that is asked of it."""

    def __init__(self, source):
        self.source = source
        self.heaps: dict[int, dict[int, tuple[int, int]]] = {}
        self.taken = 0
        head = self.read(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = head[8]
        if version < 2:
            self.root = struct.unpack_from("<Q", head, 24 + 32 + (4 if version else 0) + 8)[0]
            sizes = head[13], head[14]
        else:
            self.root = struct.unpack_from("<Q", head, 36)[0]
            sizes = head[9], head[10]
        if sizes != (8, 8):
            raise ValueError("only addresses of 8 bytes are read")

    def read(self, at: int, size: int) -> bytes:
        data = self.source.read_at(size, at)
        self.taken += len(data)
        return bytes(data)

    def unpack(self, form: str, at: int) -> tuple:
        return struct.unpack("<" + form, self.read(at, struct.calcsize("<" + form)))

    # -- objects

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """The messages of an object's header, with those that it continues elsewhere."""
        head = self.read(at, 64)
        if head[:4] == b"OHDR":
            flags, place = head[5], 6 + (16 if head[5] & 0x20 else 0) + (4 if head[5] & 0x10 else 0)
            wide = 1 << (flags & 3)
            parts = [(at + place + wide, int.from_bytes(head[place : place + wide], "little"))]
            form, extra = "<BHB", 2 if flags & 4 else 0
        else:
            parts, form, extra, flags = [(at + 16, struct.unpack_from("<I", head, 8)[0])], "<HHB", 3, None
        step = struct.calcsize(form) + extra
        while parts:
            begin, size = parts.pop(0)
            block, place = self.read(begin, size), 0
            while place + step <= len(block):
                kind, length, _ = struct.unpack_from(form, block, place)
                data = block[place + step : place + step + length]
                place += step + length
                if kind == CONTINUATION:
                    where, much = struct.unpack("<QQ", data[:16])
                    parts.append((where, much) if flags is None else (where + 4, much - 8))
                elif kind or length:
                    yield kind, data

    def links(self, at: int) -> dict[str, int]:
        """Names and addresses of a group's objects."""
        out = {}
        for kind, data in self.messages(at):
            if kind == SYMBOLS:
                tree, heap = struct.unpack("<QQ", data[:16])
                names = self.unpack("8xQQQ", heap)
                text = self.read(names[2], names[0])
                for node in self.leaves(tree):
                    for k in range(self.unpack("6xH", node)[0]):
                        name, where = self.unpack("QQ", node + 8 + 40 * k)
                        out[text[name : text.index(b"\0", name)].decode()] = where
            elif kind == LINK:
                flags, place = data[1], 2
                hard = not (flags & 8) or data[2] == 0
                place += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 0x10 else 0)
                wide = 1 << (flags & 3)
                size = int.from_bytes(data[place : place + wide], "little")
                name = data[place + wide : place + wide + size].decode()
                if hard:
                    out[name] = struct.unpack_from("<Q", data, place + wide + size)[0]
        return out

    def leaves(self, at: int) -> Iterator[int]:
        """The symbol nodes below a group's tree."""
        level, used = self.unpack("5xBH", at)
        for k in range(used):
            child = self.unpack("Q", at + 24 + 8 + 16 * k)[0]
            yield from self.leaves(child) if level else (child,)

    def tree_chunks(self, at: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """First element, address, bytes and filter mask of the chunks below a tree."""
        if at == NOWHERE:
            return
        level, used = self.unpack("5xBH", at)
        step = 8 + 8 * rank + 8
        block = self.read(at + 24, step * used)
        for k in range(used):
            size, mask, first = struct.unpack_from("<IIQ", block, k * step)
            child = struct.unpack_from("<Q", block, k * step + step - 8)[0]
            if level:
                yield from self.tree_chunks(child, rank)
            else:
                yield first, child, size, mask

    def frames(self, name: str | None = None) -> Frames:
        """The dataset of frames."""
        links = self.links(self.root)
        name = name or next((x for x in DATASETS if x in links), None)
        if name not in links:
            raise KeyError(f"no dataset {name or ' or '.join(DATASETS)}")
        found = dict(self.messages(links[name]))
        space, kind, layout = found[DATASPACE], found[DATATYPE], found[LAYOUT]
        dims = struct.unpack_from(f"<{space[1]}Q", space, 8 if space[0] == 1 else 4)
        variable, size = kind[0] & 15 == VARIABLE, struct.unpack_from("<I", kind, 4)[0]
        width = size * int(np.prod(dims[1:], dtype=np.int64)) if not variable else 16
        if not dims or variable and len(dims) > 1 or layout[0] != 3:
            raise ValueError("a layout that is not read")
        out = Frames(dims[0], width, variable, dims[0], list(self.filter_ids(found.get(FILTERS, b""))))
        if layout[1] == 0:
            out.inside = layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]]
            out.chunks = [(0, 0, len(out.inside), 0)]
        elif layout[1] == 1:
            where, size = struct.unpack_from("<QQ", layout, 2)
            out.chunks = [(0, where, size, 0)] if where != NOWHERE else []
        else:
            rank, where = layout[2], struct.unpack_from("<Q", layout, 3)[0]
            shape = struct.unpack_from(f"<{rank}I", layout, 11)
            if shape[1:-1] != dims[1:]:
                raise ValueError("chunks that cut frames are not read")
            out.chunk = shape[0]
            out.chunks = sorted(self.tree_chunks(where, rank))
        return out

    @staticmethod
    def filter_ids(data: bytes) -> Iterator[int]:
        if not data:
            return
        place = 8 if data[0] == 1 else 2
        for _ in range(data[1]):
            kind = struct.unpack_from("<H", data, place)[0]
            named = data[0] == 1 or kind >= 256
            name = struct.unpack_from("<H", data, place + 2)[0] if named else 0
            values = struct.unpack_from("<H", data, place + (6 if named else 4))[0]
            place += (8 if named else 6) + (-(-name // 8) * 8 if data[0] == 1 else name) + 4 * (values + (values % 2 if data[0] == 1 else 0))
            if kind not in (DEFLATE, SHUFFLE):
                raise ValueError(f"filter {kind} is not read")
            yield kind

    def held(self, address: int, index: int) -> bytes:
        """An object of the global heap. A collection's table is walked once, by its heads alone."""
        if address not in self.heaps:
            sign, size = self.unpack("4s4xQ", address)
            if sign != b"GCOL":
                raise ValueError("not a heap")
            table, place = {}, 16
            while place + 16 <= size:
                number, length = self.unpack("H6xQ", address + place)
                if not number:
                    break
                table[number] = (address + place + 16, length)
                place += 16 + -(-length // 8) * 8
            if len(self.heaps) > 64:
                self.heaps.clear()
            self.heaps[address] = table
        return self.read(*self.heaps[address][index])

    def elements(self, frames: Frames, chunk: tuple[int, int, int, int], wanted) -> Iterator[tuple[int, bytes]]:
        """Numbers and bytes of a chunk's frames that ``wanted`` lets pass. Of data without filters only the wanted elements are read."""
        first, address, size, mask = chunk
        numbers = [k for k in range(first, min(first + frames.chunk, frames.count)) if wanted(k)]
        filters = [f for j, f in enumerate(frames.filters) if not mask >> j & 1]
        if not numbers:
            return
        if frames.inside is not None:
            data, low = frames.inside, 0
        elif filters:
            data, low = self.read(address, size), first
        else:
            data, low = self.read(address + (numbers[0] - first) * frames.width, (numbers[-1] - numbers[0] + 1) * frames.width), numbers[0]
        for kind in reversed(filters):
            data = zlib.decompress(data) if kind == DEFLATE else np.frombuffer(data, np.uint8).reshape(16 if frames.variable else 1, -1).T.tobytes()
        for k in numbers:
            element = data[(k - low) * frames.width : (k - low + 1) * frames.width]
            if frames.variable:
                length, where, index = struct.unpack("<IQI", element)
                element = self.held(where, index)[:length] if length else b""
            yield k, element

    def read_frames(self, frames: Frames, wanted=lambda k: True, low: int = 0, high: int = NOWHERE) -> Iterator[tuple[int, bytes]]:
        """Frames of the chunks that begin in a range of addresses."""
        for chunk in frames.chunks:
            if low <= chunk[1] < high:
                yield from self.elements(frames, chunk, wanted)


class Memory:
    """Bytes as a source of ranged reads."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, size: int, at: int) -> bytes:
        return self.data[at : at + size]


# ---- Files with frames


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def write(frames: list[bytes], chunk: int = 16, deflate: bool = False, name: str = "frames") -> bytes:
    """A file with one dataset of frames of any length, in chunks of at least so many (64 chunks at most); ``chunk`` 0 is contiguous."""
    chunk = max(chunk, -(-len(frames) // 64)) if chunk else 0
    body = bytearray(b"\0" * 96)

    def put(data: bytes) -> int:
        at = len(body)
        body.extend(padded(data))
        return at

    references = []
    for begin in range(0, len(frames), 100):
        objects, at = b"", 0
        part = frames[begin : begin + 100]
        for k, x in enumerate(part):
            objects += struct.pack("<HHIQ", k + 1, 1, 0, len(x)) + padded(x)
        objects += struct.pack("<HHIQ", 0, 0, 0, 16)
        at = put(b"GCOL\1\0\0\0" + struct.pack("<Q", 16 + len(objects)) + objects)
        references += [struct.pack("<IQI", len(x), at, k + 1) for k, x in enumerate(part)]
    filters = b""
    if chunk:
        keys = b""
        for begin in range(0, len(frames), chunk):
            data = b"".join(references[begin : begin + chunk]).ljust(16 * chunk, b"\0")
            data = zlib.compress(data) if deflate else data
            keys += struct.pack("<IIQQQ", len(data), 0, begin, 0, put(data))
        tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, -(-len(frames) // chunk), NOWHERE, NOWHERE) + keys + struct.pack("<IIQQ", 0, 0, len(frames), 0)) if frames else NOWHERE
        layout = struct.pack("<BBBQII", 3, 2, 2, tree, chunk, 16)
        filters = struct.pack("<BB6xHHHHII", 1, 1, DEFLATE, 0, 0, 1, 6, 0) if deflate else b""
    else:
        layout = struct.pack("<BBQQ", 3, 1, put(b"".join(references)) if frames else NOWHERE, 16 * len(frames))
    element = struct.pack("<B3xIHH", 0x10, 1, 0, 8)
    messages = [(DATASPACE, struct.pack("<BBB5xQ", 1, 1, 0, len(frames))), (DATATYPE, struct.pack("<B3xI", 0x10 | VARIABLE, 16) + element), (LAYOUT, layout)] + [(FILTERS, filters)] * bool(filters)

    def header(messages: list[tuple[int, bytes]]) -> int:
        data = b"".join(struct.pack("<HHB3x", kind, len(padded(x)), 0) + padded(x) for kind, x in messages)
        return put(struct.pack("<BxHII4x", 1, len(messages), 1, len(data)) + data)

    dataset = header(messages)
    names = padded(b"\0" * 8 + name.encode() + b"\0")
    heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, len(body) + 32) + names)
    symbols = put(b"SNOD" + struct.pack("<BxH", 1, 1) + struct.pack("<QQI4x16x", 8, dataset, 0))
    tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, symbols, 8))
    root = header([(SYMBOLS, struct.pack("<QQ", tree, heap))])
    top = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHIQQQQ", 4, 16, 0, 0, NOWHERE, len(body), NOWHERE) + struct.pack("<QQI4xQQ", 0, root, 1, tree, heap)
    body[: len(top)] = top
    return bytes(body)
