"""Images inside of tasks: PNG files to pixels, pixels to a size that a model takes.

Columns hold binary images in Arrow batches; an image is one row's work. What is no PNG, or a PNG that is interlaced or broken, gives null.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions import geometry as G
from quernel.functions.media import png

PIXELS = "struct<height:int,width:int,rgb:binary>"
#: Fixed values of the format: samples of a pixel by colour type, and the palette's type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PALETTE, TRUE_ALPHA = 3, 6
#: Fixed values of the resampling: reach and sharpness of the cubic, bits of its weights.
REACH, SHARP, BITS = 2.0, -0.5, 22
#: Pixels beyond which an image is not decoded.
LARGEST = 1 << 27
#: Bytes of images that a task gives back at once.
SLICE = 8 << 20


# ---- PNG


def unfiltered(data: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """The bytes of the lines of an image, whose first byte told how each was predicted from its left and upper neighbours."""
    out = np.zeros((len(data), data.shape[1] + step), np.uint8)  # a pixel of zeros on the left
    above = np.zeros(out.shape[1], np.uint8)
    for row, kind in enumerate(lines.tolist()):
        line = out[row]
        line[step:] = data[row]
        if kind == 1:
            line[step:] = np.cumsum(data[row].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line[step:] += above[step:]
        elif kind in (3, 4):
            now, up = line.tolist(), above.tolist()
            for k in range(step, len(now)):
                a, b = now[k - step], up[k]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[k - step]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[k] = (now[k] + guess) & 255
            line[:] = now
        elif kind:
            raise ValueError("a filter that there is not")
        above = line
    return out[:, step:]


def decoded(file: bytes) -> tuple[int, np.ndarray]:
    """Colour type and pixels (height, width, samples of 8 bits) of a PNG; wider samples keep their high byte."""
    if file[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, palette, head = 8, [], b"", None
    while at + 12 <= len(file):
        size, kind = struct.unpack_from(">I4s", file, at)
        data = file[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = data
        elif kind == b"IDAT":
            packed.append(data)
    width, height, depth, colour, _, _, interlaced = head or (0,) * 7
    if interlaced or not width or not height or colour not in SAMPLES or width * height > LARGEST:
        raise ValueError("an image that is not read")
    bits = depth * SAMPLES[colour]
    length = -(-width * bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)[: height * (length + 1)].reshape(height, length + 1)
    lines = unfiltered(raw[:, 1:], raw[:, 0], max(1, bits // 8))
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        levels = np.unpackbits(lines, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth)[::-1])
        lines = (levels[:, :width] * (1 if colour == PALETTE else 255 // ((1 << depth) - 1))).astype(np.uint8)
    pixels = lines.reshape(height, width, -1)
    if colour == PALETTE:
        table = np.zeros((256, 3), np.uint8)
        colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)[:256]
        table[: len(colours)] = colours
        pixels = table[pixels[..., 0]]
    return colour, pixels


def on_white(colour: int, pixels: np.ndarray) -> np.ndarray:
    """Red, green and blue: colours with an alpha over white (in whole numbers, rounded), grey in all three."""
    if colour == TRUE_ALPHA:
        alpha = pixels[..., 3:].astype(np.int32)
        mixed = pixels[..., :3] * alpha + 255 * (255 - alpha) + 128
        return ((mixed + (mixed >> 8)) >> 8).astype(np.uint8)
    return pixels if pixels.shape[2] == 3 else np.repeat(pixels[..., :1], 3, axis=2)


# ---- Sizes


@lru_cache(256)
def taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """For each new pixel of a line the old ones that it is made of, and their weights as whole numbers."""
    scale = old / new
    wide = max(scale, 1.0)
    middle = (np.arange(new) + 0.5) * scale
    first = np.maximum(np.floor(middle - REACH * wide + 0.5).astype(np.int64), 0)
    last = np.minimum(np.floor(middle + REACH * wide + 0.5).astype(np.int64), old)
    places = first[:, None] + np.arange(int((last - first).max()))
    x = np.abs((places - middle[:, None] + 0.5) / wide)
    cubic = np.where(x < 1, ((SHARP + 2) * x - (SHARP + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * SHARP, 0.0))
    cubic[places >= last[:, None]] = 0.0
    cubic /= cubic.sum(axis=1, keepdims=True)
    scaled = cubic * (1 << BITS)
    return np.minimum(places, old - 1), np.trunc(scaled + np.where(scaled < 0, -0.5, 0.5)).astype(np.int64)


def stretched(pixels: np.ndarray, new: int) -> np.ndarray:
    """An image with another width."""
    if new == pixels.shape[1]:
        return pixels
    places, weights = taps(pixels.shape[1], new)
    total = np.full((pixels.shape[0], new, pixels.shape[2]), 1 << (BITS - 1), np.int64)
    for k in range(places.shape[1]):
        total += pixels[:, places[:, k]] * weights[None, :, k, None]
    return np.clip(total >> BITS, 0, 255).astype(np.uint8)


def resampled(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image in another size: lines first, then columns, each rounded."""
    return stretched(stretched(pixels, width).transpose(1, 0, 2), height).transpose(1, 0, 2)


# ---- Columns


def content(source: object) -> bytes:
    """An image's file: bytes as they are, the data of a data URL, or a file that is read where the task is."""
    if not isinstance(source, str):
        return bytes(source)
    if source.startswith("data:"):
        return base64.b64decode(source.partition(",")[2])
    if source.startswith(("http://", "https://")):
        raise ValueError("images are not fetched from servers")
    import pyarrow.fs as pafs

    store, base = pafs.FileSystem.from_uri(source if "://" in source else f"file://{source}")
    with store.open_input_file(base) as file:
        return file.read()


def pixels_of(source: object) -> np.ndarray | None:
    try:
        return on_white(*decoded(content(source)))
    except (ValueError, OSError, KeyError, struct.error, zlib.error):
        return None


def row_of(pixels: np.ndarray | None) -> tuple | None:
    return None if pixels is None else (pixels.shape[0], pixels.shape[1], pixels.tobytes())


def frame_of(rows: list[tuple | None]) -> pd.DataFrame:
    return pd.DataFrame([x or (None, None, None) for x in rows], columns=["height", "width", "rgb"]).astype({"height": "Int32", "width": "Int32"})


def sliced(rows: Iterable[tuple | None]) -> Iterator[pd.DataFrame]:
    """Images as frames of a few megabytes, so that a task holds no batch's pixels at once."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 64 + (len(row[2]) if row else 0)
        if size > SLICE:
            yield frame_of(some)
            some, size = [], 0
    if some:
        yield frame_of(some)


def rgb(image: Column) -> Column:
    """Height, width and pixels of an image (binary, data URL or path); null fields where there is none that can be read."""

    @F.pandas_udf(PIXELS)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            yield from sliced(None if x is None else row_of(pixels_of(x)) for x in images)

    return read(image)


def resize(pixels: Column, height: Column, width: Column) -> Column:
    """Pixels in another size."""

    def changed(data, h, w, height, width) -> tuple | None:
        there = data is not None and not pd.isna(height) and not pd.isna(width)
        return row_of(resampled(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3), int(height), int(width))) if there else None

    @F.pandas_udf(PIXELS)
    def change(batches: Iterator[tuple[pd.DataFrame, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for images, heights, widths in batches:
            yield from sliced(map(changed, images["rgb"], images["height"], images["width"], heights, widths))

    return change(pixels, height, width)


def model_input(image: Column, factor: int, least: int, most: int) -> Column:
    """An image as a model takes it: over white, with sides that are multiples of the factor and an area within bounds."""
    return sized(rgb(image), factor, least, most)


def sized(pixels: Column, factor: int, least: int, most: int) -> Column:
    """Pixels with sides that are multiples of the factor and an area within bounds."""
    size = G.resized(pixels["height"], pixels["width"], factor, least, most)
    return resize(pixels, size["height"], size["width"])


def written_png(height: Column, width: Column, data: Column) -> Column:
    """PNG files of pixels; data that are too short are filled with zeros."""

    @F.pandas_udf("binary")
    def write(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for heights, widths, rows in batches:
            some, size = [], 0
            for h, w, x in zip(heights, widths, rows):
                some.append(png(int(w), int(h), bytes(x).ljust(int(h) * int(w) * 3, b"\0")))
                size += len(some[-1])
                if size > SLICE:
                    yield pd.Series(some)
                    some, size = [], 0
            if some:
                yield pd.Series(some)

    return write(height, width, data)
