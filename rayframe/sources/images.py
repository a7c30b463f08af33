"""Pixels of image files: uncompressed or deflated TIFF to rows, images to greyscale PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Volume

# Fixed values of the TIFF 6.0 specification: numbers of the fields used here.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PREDICTOR, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 339
# Codes of field types to struct formats, of sample formats to numpy kinds.
FIELD = {1: "B", 3: "H", 4: "I"}
KIND = {1: "u", 2: "i", 3: "f"}


class Layout(NamedTuple):
    """Where a file's first picture lies: strips of ``rows`` rows, the last of what is left."""

    width: int
    height: int
    dtype: np.dtype
    deflated: bool
    rows: int
    starts: tuple[int, ...]
    sizes: tuple[int, ...]


def tiff_layout(read: Callable[[int, int], bytes]) -> Layout:
    """The layout of a TIFF file of which ``read(start, length)`` gives bytes; only its fields are read.

    One sample a pixel, in strips, uncompressed or deflated; anything else raises ValueError.
    """

    def unpack(form: str, at: int) -> tuple:
        return struct.unpack(form, read(at, struct.calcsize(form)))

    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    try:
        if order is None or unpack(order + "H", 2) != (42,):
            raise ValueError("not a TIFF file")
        (at,) = unpack(order + "I", 4)
        fields = {}
        for k in range(unpack(order + "H", at)[0]):
            tag, kind, n = unpack(order + "HHI", at + 2 + 12 * k)
            if kind in FIELD:
                form = f"{order}{n}{FIELD[kind]}"
                place = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (place,) = unpack(order + "I", place)
                fields[tag] = unpack(form, place)
        width, height = fields[WIDTH][0], fields[HEIGHT][0]
        bits, form = fields.get(BITS, (1,)), fields.get(SAMPLE_FORMAT, (1,))[0]
        if fields.get(SAMPLES, (1,))[0] != 1 or fields.get(PREDICTOR, (1,))[0] != 1 or bits[0] not in (8, 16, 32, 64) or form not in KIND or (form == 3 and bits[0] == 8):
            raise ValueError("only one plain sample of whole bytes a pixel is supported")
        packed = fields.get(COMPRESSION, (1,))[0]
        if packed not in (1, 8, 32946):
            raise ValueError(f"TIFF compression {packed} is not supported")
        starts, sizes = fields[STRIPS], fields[STRIP_BYTES]
    except (struct.error, KeyError) as e:
        raise ValueError(f"broken TIFF file: {e}") from e
    if len(starts) != len(sizes):
        raise ValueError("broken TIFF file: strips without a length")
    rows = max(1, min(fields.get(ROWS, (height,))[0], height))
    return Layout(width, height, np.dtype(f"{order}{KIND[form]}{bits[0] // 8}"), packed != 1, rows, starts, sizes)


def decode_tiff(content: bytes) -> np.ndarray:
    """(height, width) array of a file's first picture, of the kinds that ``tiff_layout`` knows."""
    t = tiff_layout(lambda at, n: content[at : at + n])
    try:
        strips = (content[s : s + n] for s, n in zip(t.starts, t.sizes, strict=True))
        data = b"".join(zlib.decompress(s) if t.deflated else s for s in strips)
        return np.frombuffer(data, t.dtype, t.width * t.height).reshape(t.height, t.width)
    except zlib.error as e:
        raise ValueError(f"broken TIFF file: {e}") from e


def encode_tiff(pixels: np.ndarray, rows: int = 64) -> bytes:
    """A little-endian TIFF of an (height, width) array, in deflated strips of ``rows`` rows."""
    pixels = np.ascontiguousarray(pixels, pixels.dtype.newbyteorder("<"))
    height, width = pixels.shape
    strips = [zlib.compress(pixels[y : y + rows].tobytes()) for y in range(0, height, rows)]
    sizes = [len(s) for s in strips]
    starts = [8 + int(x) for x in np.cumsum([0, *sizes[:-1]])]
    kind = {v: k for k, v in KIND.items()}[pixels.dtype.kind]
    values = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8 * pixels.itemsize]), (COMPRESSION, [8]), (STRIPS, starts), (SAMPLES, [1]), (ROWS, [rows]), (STRIP_BYTES, sizes), (SAMPLE_FORMAT, [kind])]
    body, more, end = b"", b"", 8 + sum(sizes)
    for tag, v in values:
        packed = struct.pack(f"<{len(v)}I", *v)
        if len(packed) > 4:
            packed, more = struct.pack("<I", end + len(more)), more + packed
        body += struct.pack("<HHI", tag, 4, len(v)) + packed
    at = end + len(more)
    return b"II*\0" + struct.pack("<I", at) + b"".join(strips) + more + struct.pack("<H", len(values)) + body + bytes(4)


def stack_projections(stack: DataFrame) -> DataFrame:
    """(line, value) of a stack of images of one shape, one a view, as ``read_stack`` gives them.

    Lines are numbered as in ``geometry.rays``: view by view, row by row, so view v begins at v times the pixels of an
    image. Each file is decoded where it was read. A null content gives no rows; a file that is no such TIFF raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for view, content in zip(batch["view"], batch["content"], strict=True):
                if content is not None:
                    flat = decode_tiff(bytes(content)).astype(np.float64).ravel()
                    yield pd.DataFrame({"line": np.arange(flat.size, dtype=np.int64) + int(view) * flat.size, "value": flat})

    return stack.filter("view is not null").select("view", "content").mapInPandas(run, "line long, value double")


def encode_png(pixels: np.ndarray) -> bytes:
    """A greyscale PNG of an (height, width) array of bytes."""
    height, width = pixels.shape
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = pixels

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png(image: DataFrame, volume: Volume, size: int = 1024) -> list[bytes]:
    """Pictures of a 2-D image, or of the three middle slices of a 3-D one; the least value black, the greatest white.

    Images above ``size`` voxels along an axis are scaled down by Spark first, so size^2 rows come to the driver at
    most. Voxels without a row count as 0.
    """
    from ..operators.exchange import orthogonal_slices
    from ..operators.image import downscaled

    if volume.dim == 3:
        flat = [Volume(tuple(n for k, n in enumerate(volume.voxels) if k != d)) for d in range(3)]
        return [png(s, v, size)[0] for s, v in zip(orthogonal_slices(image, volume), flat, strict=True)]
    small = tuple(min(size, n) for n in volume.voxels)
    got = (image if small == tuple(volume.voxels) else downscaled(image, volume, small, accumulate=True)).filter(F.col("value").isNotNull()).toPandas()
    value = np.zeros(small[0] * small[1])
    value[got["voxel"].to_numpy(np.int64)] = got["value"].to_numpy(np.float64)
    low, high = value.min(), value.max()
    grey = np.rint((value - low) / (high - low) * 255) if high > low else np.zeros_like(value)
    return [encode_png(grey.astype(np.uint8).reshape(small[1], small[0]))]
