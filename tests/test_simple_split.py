"""The distributed split against the loop over sorted samples, on all events."""

import math

from rayframe import queries as Q
from rayframe.plans import grcb

SF = "/root/testdata/sf0.01"


def test_rows_against_loop(spark):
    for n, f in ((5, lambda i: 1.0), (10, lambda i: 1.0), (3000, lambda i: 1.0 + i % 5), (3000, lambda i: float(i > 2900)), (3000, lambda i: 0.0)):
        rows = [(i, (i * 7919 % 101) / 101.0, f(i)) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, y double, f double").repartition(3)
        want = grcb.simple_split([(y, w) for y, _, w in sorted((y, i, w) for i, y, w in rows)], 0.0, 1.0)
        assert math.isclose(grcb.simple_split_rows(df, 0.0, 1.0, "id"), want, rel_tol=1e-12)


def test_all_events(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id").collect()
    assert len(rows) > 2000
    samples = sorted(((r.event_id * 7919 % 10007) / 10007.0, r.event_id, 1.0 + r.user_id % 5) for r in rows)
    want = grcb.simple_split([(y, f) for y, _, f in samples], 0.0, 1.0)
    assert math.isclose(Q.simple_split(spark, SF).first()["at"], round(want, 6), abs_tol=1e-9)
