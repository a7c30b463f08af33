"""Changes of slices from a stateful stream: upserts, deletes, late requests, restarts, timers; pixels of slices."""

import time

from rayframe.model import Volume
from rayframe.streaming import observe

SCHEMA = "request_id long, kind string, slice_id int, axis int, position double"


def send(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def start(spark, tmp_path, got, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    return observe.serve_changes(stream, lambda df, k: got.append(sorted((r.slice_id, r.kind, r.axis, r.position) for r in df.collect())), f"{tmp_path}/state", **options)


def test_changes_deletes_and_a_restart(spark, tmp_path):
    got = []
    send(spark, f"{tmp_path}/in", "a", [(1, "set", 7, 0, 0.5), (2, "set", 8, 1, 0.1), (3, "set", 7, 2, 0.9), (4, "set", None, 0, 0.0), (None, "set", 1, 0, 0.0)])
    start(spark, tmp_path, got, once=True).awaitTermination()
    assert [x for x in got if x] == [[(7, "set", 2, 0.9), (8, "set", 1, 0.1)]]
    got.clear()
    # A new stream with the same folder: one slice goes, one comes, one is asked for again as it is.
    send(spark, f"{tmp_path}/in", "b", [(9, "remove", 8, None, None), (10, "set", 9, 0, 0.2), (11, "set", 7, 2, 0.9)])
    start(spark, tmp_path, got, once=True).awaitTermination()
    assert [x for x in got if x] == [[(8, "remove", None, None), (9, "set", 0, 0.2)]]
    got.clear()
    # What is older than a slice's last request, a removal too, changes nothing; neither does a removal of what is not set.
    send(spark, f"{tmp_path}/in", "c", [(5, "set", 8, 0, 0.3), (6, "remove", 7, None, None), (12, "remove", 20, None, None)])
    start(spark, tmp_path, got, once=True).awaitTermination()
    assert not [x for x in got if x]
    send(spark, f"{tmp_path}/in", "d", [(13, None, 7, 0, 0.3), (14, "set", 8, 0, None)])
    start(spark, tmp_path, got, once=True).awaitTermination()
    assert [x for x in got if x] == [[(7, "remove", None, None), (8, "set", 0, None)]]


def test_slices_run_out(spark, tmp_path):
    got = []
    send(spark, f"{tmp_path}/in", "a", [(1, "set", 7, 0, 0.5)])
    query = start(spark, tmp_path, got, expire=1500)
    try:
        end = time.time() + 40
        while query.isActive and time.time() < end and [(7, "remove", None, None)] not in got:
            time.sleep(0.3)
    finally:
        query.stop()
    assert [x for x in got if x] == [[(7, "set", 0, 0.5)], [(7, "remove", None, None)]]


def test_registry_of_repeated_batches(spark):
    rows = [(1, 1, "set", 0, 0.5, 0), (1, 1, "set", 0, 0.5, 0), (2, 2, "set", 1, 0.5, 0), (2, 3, "remove", None, None, 1), (1, 4, "set", 2, 0.1, 2)]
    log = spark.createDataFrame(rows, f"{observe.CHANGE}, batch long")
    assert [tuple(r) for r in observe.registry(log).collect()] == [(1, 2, 0.1)]


def test_pixels(spark):
    v = Volume((2, 3, 4))
    image = v.grid(spark).selectExpr("voxel", "cast(voxel as double) as value")
    rows = [(1, 1, "set", 0, 0.5), (2, 2, "set", 2, 1.5), (3, 3, "set", 1, -1.0), (4, 4, "remove", 0, 0.5), (5, 5, "set", 3, 0.5), (6, 6, "set", 0, None), (7, 7, "set", 0, float("nan"))]
    got = {}
    for r in observe.slice_pixels(spark.createDataFrame(rows, observe.CHANGE), image, v).collect():
        got.setdefault(r.slice_id, {})[r.pixel] = r.value
    assert got == {
        1: {y + 3 * z: float(1 + 2 * (y + 3 * z)) for y in range(3) for z in range(4)},
        2: {x + 2 * y: float(x + 2 * (y + 9)) for x in range(2) for y in range(3)},
        3: {x + 2 * z: float(x + 6 * z) for x in range(2) for z in range(4)},
    }
