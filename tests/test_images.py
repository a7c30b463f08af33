"""Image files against bytes built here, and angle-based geometries against their vectors."""

import struct
import zlib
from math import cos, pi, sin

import numpy as np
import pytest

from rayframe.model import Volume
from rayframe.sources import formats, images


def tiff(pixels: np.ndarray, order: str = "<", deflate: bool = False, rows: int = 2) -> bytes:
    """A TIFF in strips of ``rows`` rows."""
    height, width = pixels.shape
    raw = [pixels[y : y + rows].astype(pixels.dtype.newbyteorder(order)).tobytes() for y in range(0, height, rows)]
    strips = [zlib.compress(s) if deflate else s for s in raw]
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    n, first = len(strips), 8 + sum(map(len, strips))
    starts = [8 + sum(map(len, strips[:k])) for k in range(n)]
    lists = struct.pack(f"{order}{2 * n}I", *starts, *map(len, strips))
    where = (first, first + 4 * n) if n > 1 else (starts[0], len(strips[0]))
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, pixels.dtype.itemsize * 8), (259, 3, 1, 8 if deflate else 1), (273, 4, n, where[0]), (277, 3, 1, 1), (278, 4, 1, rows), (279, 4, n, where[1]), (339, 3, 1, kind)]
    body = b"".join(struct.pack(order + "HHI", t, k, c) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, c, v in entries)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, first + len(lists))
    return head + b"".join(strips) + lists + struct.pack(order + "H", len(entries)) + body + struct.pack(order + "I", 0)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", ["u1", "u2", "i4", "f4", "f8"])
@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("height", [1, 5])
def test_tiff_round_trip(order, kind, deflate, height):
    pixels = (np.arange(height * 3).reshape(height, 3) * 7).astype(kind)
    assert np.array_equal(images.decode_tiff(tiff(pixels, order, deflate)), pixels)


def test_other_files_raise():
    good = tiff(np.arange(6, dtype="u2").reshape(2, 3))
    for bad in (b"", b"x", b"II*\0", good[:20], good[:-30]):
        with pytest.raises(ValueError):
            images.decode_tiff(bad)


def test_stack(spark, tmp_path):
    stack = np.arange(3 * 2 * 4, dtype="u2").reshape(3, 2, 4)
    for v in range(3):
        (tmp_path / f"scan_{v}.tif").write_bytes(tiff(stack[v]))
    got = images.stack_projections(formats.read_stack(spark, f"{tmp_path}/scan_*.tif")).orderBy("line").collect()
    assert [(r.line, r.value) for r in got] == list(enumerate(stack.ravel().astype(float)))
    odd = spark.createDataFrame([(0, None), (None, bytearray(b"x"))], "view int, content binary")
    assert images.stack_projections(odd).count() == 0


def pixels_of(png: bytes) -> np.ndarray:
    width, height = struct.unpack_from(">II", png, 16)
    at = png.index(b"IDAT")
    data = zlib.decompress(png[at + 4 : at + 4 + struct.unpack_from(">I", png, at - 4)[0]])
    return np.frombuffer(data, np.uint8).reshape(height, width + 1)[:, 1:]


def test_png(spark):
    image = spark.createDataFrame([(0, 1.0), (5, 2.0), (1, None)], "voxel long, value double")
    (got,) = images.png(image, Volume((3, 2)))
    assert pixels_of(got).tolist() == [[128, 0, 0], [0, 0, 255]]
    assert [pixels_of(x).shape for x in images.png(image, Volume((2, 3, 4)))] == [(4, 3), (4, 2), (3, 2)]
    assert pixels_of(images.png(image.limit(0), Volume((2, 2)))[0]).sum() == 0


def test_angles_give_vectors(spark):
    angles = [0.0, pi / 3]
    cone = formats.astra_angles("cone", (0.5, 0.25), angles, 10.0, 5.0)
    assert np.allclose(cone[0], [0, -10, 0, 0, 5, 0, 0.5, 0, 0, 0, 0, 0.25])
    assert np.allclose(cone[1][:6], [10 * sin(pi / 3), -10 * cos(pi / 3), 0, -5 * sin(pi / 3), 5 * cos(pi / 3), 0])
    flat = formats.astra_angles("parallel3d", (1.0, 1.0), angles)
    assert np.allclose(flat[0], [0, -1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    assert formats.astra_views(spark, "cone", 4, 5, cone).count() == 2
    with pytest.raises(ValueError):
        formats.astra_angles("fan", (1.0, 1.0), angles)
