"""Pixels, sizes and frame counts of media as column expressions."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions import geometry as G

#: The shares of depth that become black and white, the label of a status that is not known, packing limits.
LOW, HIGH, IGNORED = 0.02, 0.98, -50.0
SECONDS_A_FRAME, FEWEST, MOST = 4, 4, 8
PREFERRED = ("observation.images.cam_high", "observation.images.cam_main", "observation.images.cam_front", "observation.images.head_camera")


def over_white(rgba: Column) -> Column:
    """Red, green and blue of a pixel with an alpha of 0 to 255, over white."""
    share = rgba[3] / 255
    return F.transform(F.slice(rgba, 1, 3), lambda c: F.round(c * share + 255 * (1 - share)).cast("int"))


def resized_strictly(height: Column, width: Column, factor: int, least: int, most: int) -> Column:
    """The size of an image, with an error where a side is smaller than the factor."""
    small = (height < factor) | (width < factor)
    return F.when(small, F.raise_error(F.lit("a side is smaller than the factor"))).otherwise(G.resized(height, width, factor, least, most))


def sample_fps(frames: Column, total: Column, fps: Column) -> Column:
    return frames / F.greatest(total, F.lit(1e-6)) * fps


def frames_of_duration(duration: Column, fps: Column, least: int, most: int) -> Column:
    """How many frames a video of some seconds gives, even where the most is the bound."""
    wanted = F.bround(duration, 0) * fps
    return F.least(F.greatest(wanted, F.lit(least)), F.lit(most // 2 * 2)).cast("int")


def packed_frames(duration: Column, total: Column) -> Column:
    """The frames that a packer takes of a video: one in four seconds, 4 to 8, evenly spread, each once."""
    count = F.least(F.greatest(F.bround(duration / SECONDS_A_FRAME, 0), F.lit(FEWEST)), F.lit(MOST)).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.floor(k * (total - 1) / (count - 1)).cast("int")))


def tokens_of_grid(height: Column, width: Column, patch: int = 16, merge: int = 2) -> Column:
    """How many tokens an image of a resized size takes; none for a missing image."""
    return F.coalesce((height * width / (patch * merge) ** 2).cast("long"), F.lit(0))


def rescaled(point: Column, width: Column, height: Column, scale: int = 999) -> Column:
    """A point of a relative scale in pixels."""
    return F.array(point[0] / scale * width, point[1] / scale * height)


def view_sizes(width: Column, height: Column) -> Column:
    """The sizes of a main view and of the wrist views, which are half as large (1 at least)."""
    half = lambda x: F.greatest(F.lit(1), F.floor(x / 2).cast("int"))
    return F.create_map(F.lit("main"), F.array(width.cast("int"), height.cast("int")), F.lit("wrist"), F.array(half(width), half(height)))


def depth_levels(values: Column) -> Column:
    """Depth as 0 to 255 between its 2nd and 98th percentile (interpolated), clipped."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda share: F.element_at(ordered, (F.floor((n - 1) * share) + 1).cast("int")) + ((n - 1) * share - F.floor((n - 1) * share)) * (
        F.element_at(ordered, F.least(n, (F.floor((n - 1) * share) + 2).cast("int"))) - F.element_at(ordered, (F.floor((n - 1) * share) + 1).cast("int"))
    )
    low, high = at(F.lit(LOW)), at(F.lit(HIGH))
    return F.transform(values, lambda v: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / F.greatest(high - low, F.lit(1e-6)))) * 255).cast("int"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def masked_losses(logit: Column, label: Column) -> tuple[Column, Column]:
    """Binary cross-entropy and squared error of one prediction; null where the label is not known, so that means leave it out."""
    known = label > IGNORED
    soft = F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
    return F.when(known, soft), F.when(known, F.pow(sigmoid(logit) - label, 2))


def shrunk(width: Column, height: Column, longest: int) -> Column:
    """A size whose longer side is at most so long, cut to whole pixels."""
    share = longest / F.greatest(width, height)
    return F.when(F.greatest(width, height) > longest, F.array((width * share).cast("int"), (height * share).cast("int"))).otherwise(F.array(width.cast("int"), height.cast("int")))


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An image of 8-bit red, green and blue as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + rgb[k * 3 * width : (k + 1) * 3 * width] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def data_url(image: Column, kind: str = "png") -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(image))


def from_base64(text: Column) -> Column:
    """The bytes of base64 text, with or without a data URL's head; null for other text."""
    return F.try_to_binary(F.regexp_replace(text, "^data:[^,]*,", ""), F.lit("base64"))


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the head of a PNG or JPEG file, without decoding it."""
    if data and data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2
    while data and data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def video_key(keys: list[str], wanted: str | None, preferred: tuple[str, ...] = PREFERRED) -> str:
    """The feature that is meant: by its whole name, by a suffix that one alone has, else the first of the preferred ones."""
    if not keys:
        raise ValueError("there are no video features")
    if wanted:
        found = [k for k in keys if k == wanted] or [k for k in keys if k.endswith(wanted)]
        if len(found) != 1:
            raise ValueError(f"{wanted!r} names {len(found)} video features")
        return found[0]
    return next((p for p in preferred if p in keys), keys[0])
