"""PNG files of all kinds to pixels, and sizes against the plain formula."""

import base64
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.functions import images, media


def file_of(pixels, colour, depth=8, filters=None, palette=b"", parts=1):
    """A PNG of samples (height, width, samples), each line under a filter of its own."""
    height, width, samples = pixels.shape
    if depth == 16:
        lines = [np.stack([r, 255 - r], -1).astype(np.uint8).tobytes() for r in pixels.reshape(height, -1)]
    elif depth < 8:
        lines = [np.packbits(np.unpackbits(r.astype(np.uint8)[:, None], axis=1)[:, -depth:].ravel()).tobytes() for r in pixels.reshape(height, -1)]
    else:
        lines = [r.astype(np.uint8).tobytes() for r in pixels.reshape(height, -1)]
    step, above, out = max(1, samples * depth // 8), b"\0" * len(lines[0]), b""
    for k, line in enumerate(lines):
        kind = filters[k % len(filters)] if filters else 0
        done = bytearray()
        for j, x in enumerate(line):
            a, b, c = (line[j - step] if j >= step else 0), above[j], (above[j - step] if j >= step else 0)
            near = min((abs(a + b - c - v), order, v) for order, v in enumerate((a, b, c)))[2]
            done.append((x - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind]) + bytes(done)
        above = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = zlib.compress(out)
    cuts = [data[k * len(data) // parts : (k + 1) * len(data) // parts] for k in range(parts)]
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + b"".join(chunk(b"IDAT", x) for x in cuts) + chunk(b"IEND", b"")


def noise(height, width, samples, most=256, seed=1):
    return np.random.default_rng(seed).integers(0, most, (height, width, samples))


@pytest.mark.parametrize("filters", [None, [1], [2], [3], [4], [4, 3, 2, 1, 0]])
@pytest.mark.parametrize("colour,samples", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
def test_all_filters_and_kinds(filters, colour, samples, depth):
    pixels = noise(9, 7, samples)
    kind, found = images.decoded(file_of(pixels, colour, depth, filters, parts=3))
    assert kind == colour and (found == pixels).all()


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_few_bits(depth):
    pixels = noise(5, 11, 1, 1 << depth)
    assert (images.decoded(file_of(pixels, 0, depth))[1] == pixels * (255 // ((1 << depth) - 1))).all()
    palette = bytes(range(3 * (1 << depth)))
    assert (images.decoded(file_of(pixels, 3, depth, palette=palette))[1] == np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[..., 0]]).all()


def test_own_files_and_white():
    assert (images.decoded(media.png(3, 2, bytes(range(18))))[1].tobytes()) == bytes(range(18))
    rgba = np.array([[[10, 20, 30, 255], [10, 20, 30, 0], [0, 100, 200, 128]]], np.uint8)
    assert images.on_white(6, rgba).tolist() == [[[10, 20, 30], [255, 255, 255], [127, 177, 227]]]
    assert images.on_white(0, rgba[..., :1]).tolist() == [[[10] * 3, [10] * 3, [0] * 3]]


def plain_line(line, new):
    """One line by the formula, in floating-point numbers."""
    scale = len(line) / new
    wide = max(scale, 1.0)
    out = []
    for k in range(new):
        middle = (k + 0.5) * scale
        total = weight = 0.0
        for j in range(max(0, int(middle - 2 * wide + 0.5)), min(len(line), int(middle + 2 * wide + 0.5))):
            x = abs((j - middle + 0.5) / wide)
            w = (1.5 * x - 2.5) * x * x + 1 if x < 1 else (((x - 5) * x + 8) * x - 4) * -0.5 if x < 2 else 0.0
            total, weight = total + w * line[j], weight + w
        out.append(min(255, max(0, int(np.floor(total / weight + 0.5)))))
    return out


@pytest.mark.parametrize("old,new", [(10, 10), (10, 3), (7, 20), (1, 5), (5, 1), (64, 28), (3, 84)])
def test_sizes_by_the_formula(old, new):
    line = noise(1, old, 3, seed=old)
    found = images.resampled(line.astype(np.uint8), 1, new)
    for c in range(3):
        assert np.abs(found[0, :, c].astype(int) - plain_line(line[0, :, c].tolist(), new)).max() <= (0 if old == new else 1)
    assert (images.resampled(line.astype(np.uint8).transpose(1, 0, 2), new, 1) == found.transpose(1, 0, 2)).all()


def test_even_colours_stay():
    even = np.full((13, 9, 3), 77, np.uint8)
    assert (images.resampled(even, 28, 56) == 77).all()


def test_columns(spark, tmp_path):
    pixels = noise(40, 30, 3, seed=5).astype(np.uint8)
    file = file_of(pixels, 2, filters=[4, 1])
    (tmp_path / "x.png").write_bytes(file)
    url = "data:image/png;base64," + base64.b64encode(file).decode()
    rows = spark.createDataFrame([(1, str(tmp_path / "x.png")), (2, url), (3, "data:image/png;base64,AAAA"), (4, None), (5, "http://nowhere/x.png"), (6, "/nowhere.png")], "k int, source string").repartition(2)
    found = {r.k: r for r in rows.select("k", images.rgb(F.col("source")).alias("p"), images.model_input(F.col("source"), 28, 28 * 28 * 4, 28 * 28 * 16).alias("m")).collect()}
    for k in (1, 2):
        assert (found[k].p.height, found[k].p.width, bytes(found[k].p.rgb)) == (40, 30, pixels.tobytes())
        assert (found[k].m.height, found[k].m.width) == (84, 56)
        assert bytes(found[k].m.rgb) == images.resampled(pixels, 84, 56).tobytes()
    assert all(found[k].p.height is None and found[k].m.rgb is None for k in (3, 4, 5, 6))


def test_broken_files_are_none():
    file = file_of(noise(6, 6, 3), 2, filters=[4])
    rng = random.Random(1)
    for _ in range(200):
        cut = bytearray(file[: rng.randrange(len(file))])
        for _ in range(3):
            if cut:
                cut[rng.randrange(len(cut))] = rng.randrange(256)
        images.pixels_of(bytes(cut))
    assert images.pixels_of(file[:40]) is None and images.pixels_of(b"") is None


def test_pixels_come_in_slices():
    from quernel.functions import images

    rows = [(1000, 1000, bytes(3_000_000)), None] * 12
    sizes = [len(frame) for frame in images.sliced(iter(rows))]
    assert sum(sizes) == 24 and max(sizes) <= 6 and list(images.sliced(iter([]))) == []
