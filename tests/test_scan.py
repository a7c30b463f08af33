"""The data source of image stacks: partitions, filters, large and broken files, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual
from test_images import tiff

from rayframe.sources import images, scan


@pytest.fixture
def stack(tmp_path):
    data = np.arange(6 * 5 * 4, dtype="u2").reshape(6, 5, 4)
    for v in range(6):
        (tmp_path / f"scan_{v:03d}.tif").write_bytes(tiff(data[v], deflate=v % 2 == 1))
    (tmp_path / "scan_x.tif").write_bytes(b"other")
    (tmp_path / "notes.txt").write_bytes(b"other")
    return f"{tmp_path}/scan_*.tif", data


@pytest.mark.parametrize("size", [1, 30, 300, 1 << 20])
def test_all_pixels_once_at_every_size_of_partitions(spark, stack, size):
    pattern, data = stack
    if size == 1:
        reader = scan.ScanReader({"path": pattern, "partitionBytes": "1"})
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    else:
        rows = [r.asDict() for r in scan.read_scan(spark, pattern, size).collect()]
    rows.sort(key=lambda r: r["line"])
    assert [(r["line"], r["value"]) for r in rows] == list(enumerate(data.ravel().astype(float)))
    assert all(r["line"] == (r["view"] * 5 + r["pixel_row"]) * 4 + r["pixel_column"] for r in rows)


def test_schema_and_partitions(spark, stack):
    pattern, _ = stack
    df = scan.read_scan(spark, pattern, 300)
    assert [f"{n} {t}" for n, t in df.dtypes] == ["view int", "line bigint", "pixel_row int", "pixel_column int", "value double"]
    assert 3 <= df.rdd.getNumPartitions() <= 6
    assert len(scan.ScanReader({"path": pattern}).partitions()) == 1


def test_small_images_share_tasks(tmp_path):
    """A stack of many small images is read by few tasks, by as many as run at a time if it is short."""
    for v in range(1100):
        (tmp_path / f"s_{v}.tif").write_bytes(b"never opened")
    for tasks, least, most in ((1, 2, 4), (8, 8, 9), (2000, 1100, 1100)):
        parts = scan.ScanReader({"path": f"{tmp_path}/s_*.tif", "tasks": str(tasks)}).partitions()
        assert least <= len(parts) <= most and sorted(p[0] for r in parts for p in r.pieces) == list(range(1100))


def test_images_are_written_by_partition(spark, tmp_path):
    """One Python function writes all views of a task, in turn, and a view's rows may come in several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pixels = spark.range(40 * 24).selectExpr("id % 40 AS view", "CAST(id DIV 40 DIV 6 AS INT) AS pixel_row", "CAST(id DIV 40 % 6 AS INT) AS pixel_column", "CAST(id AS DOUBLE) AS value")
        wrote = scan.write_scan(pixels.filter("value > 0"), 6, 4, f"file://{tmp_path}/p_*.tif")
        assert "FlatMapGroups" not in wrote._jdf.queryExecution().toString()
        assert sorted((r.view, r.path) for r in wrote.collect()) == sorted((v, f"file://{tmp_path}/p_{v}.tif") for v in range(40))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = scan.read_scan(spark, f"file://{tmp_path}/p_*.tif").collect()
    assert sorted(r.value for r in back) == list(map(float, range(40 * 24)))
    assert all(r.value == (r.pixel_row * 6 + r.pixel_column) * 40 + r.view for r in back)
    assert scan.write_scan(pixels.limit(0), 6, 4, f"file://{tmp_path}/q_*.tif").count() == 0


def test_filters_choose_files(spark, stack, tmp_path):
    pattern, data = stack
    reader = scan.ScanReader({"path": pattern})
    kept = list(reader.pushFilters([In(("view",), (1, 2, 5)), GreaterThan(("view",), 1), EqualTo(("pixel_row",), 0), LessThanOrEqual(("view",), 4)]))
    assert kept == [EqualTo(("pixel_row",), 0)] and [p[0] for r in reader.partitions() for p in r.pieces] == [2]
    # A broken file of another view is never opened.
    (tmp_path / "scan_004.tif").write_bytes(b"broken")
    some = scan.read_scan(spark, pattern).filter("view IN (1, 2) AND pixel_row = 3 AND value IS NOT NULL")
    assert sorted(r.value for r in some.collect()) == sorted(data[1:3, 3].ravel().tolist())
    with pytest.raises(Exception, match="scan_004"):
        scan.read_scan(spark, pattern).collect()


def test_one_strip_is_read_in_chunks(tmp_path, monkeypatch):
    """An image in one strip, plain or deflated, is never held whole: reads are bounded, and so are batches."""
    monkeypatch.setattr(scan, "CHUNK", 512)
    data = np.random.default_rng(1).integers(0, 1 << 16, (200, 16)).astype("u2")
    for deflate in (False, True):
        path = tmp_path / f"scan_{int(deflate)}.tif"
        path.write_bytes(tiff(data, deflate=deflate, rows=200))
        reader = scan.ScanReader({"path": f"{tmp_path}/scan_*.tif", "partitionBytes": "1000"})
        parts = [p for p in reader.partitions() if p.pieces[0][0] == int(deflate)]
        assert len(parts) > 4
        batches = [b for p in parts for b in reader.read(p) if b.column(0)[0].as_py() == int(deflate)]
        assert max(b.num_rows for b in batches) * 2 <= 512
        rows = sorted((r["line"], r["value"]) for b in batches for r in b.to_pylist())
        assert [v for _, v in rows] == data.ravel().tolist()


def test_broken_files(tmp_path):
    good = tiff(np.arange(60, dtype="u2").reshape(10, 6))
    for k, bad in enumerate((b"", b"II*\0", good[:-30], good[:40], tiff(np.arange(60, dtype="u2").reshape(10, 6), deflate=True)[:30])):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "s_0.tif").write_bytes(bad)
        reader = scan.ScanReader({"path": f"{folder}/s_*.tif"})
        with pytest.raises(ValueError, match="s_0.tif"):
            [list(reader.read(p)) for p in reader.partitions()]
    for pattern in (f"{tmp_path}/a.tif", f"{tmp_path}/*/a.tif", f"{tmp_path}/*_*.tif"):
        with pytest.raises(ValueError):
            scan.ScanReader({"path": pattern}).partitions()


def test_no_files(spark, tmp_path):
    assert scan.read_scan(spark, f"{tmp_path}/s_*.tif").count() == 0


@pytest.mark.parametrize("kind", ["u1", "u2", "i4", "f4", "f8"])
def test_encoded(kind):
    for shape in ((1, 1), (3, 4), (130, 7)):
        pixels = np.arange(shape[0] * shape[1]).reshape(shape).astype(kind)
        assert np.array_equal(images.decode_tiff(images.encode_tiff(pixels)), pixels)


def test_round_trip(spark, tmp_path):
    rows = [(0, 0, 1, 2.0), (0, 1, 2, 3.5), (3, 1, 0, None), (3, 0, 0, 1.0), (None, 0, 0, 1.0), (3, 2, 0, 9.0), (3, 0, -1, 9.0)]
    pixels = spark.createDataFrame(rows, "view int, pixel_row int, pixel_column int, value double")
    wrote = scan.write_scan(pixels, 3, 2, f"file://{tmp_path}/out/p_*.tif").collect()
    assert sorted(r.view for r in wrote) == [0, 3]
    back = scan.read_scan(spark, f"file://{tmp_path}/out/p_*.tif").filter(F.col("value") != 0)
    assert sorted((r.view, r.pixel_row, r.pixel_column, r.value) for r in back.collect()) == [(0, 0, 1, 2.0), (0, 1, 2, 3.5), (3, 0, 0, 1.0)]
