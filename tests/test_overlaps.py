"""Overlaps of shadows against a loop over all pairs."""

import random

from rayframe.operators import exchange


def test_overlaps_by_bands(spark):
    draw = random.Random(3)
    rows = []
    for part in range(25):
        for view in range(3):
            x, y = draw.randrange(50), draw.randrange(50)
            rows.append((part, view, x, y, x + draw.randrange(-1, 20), y + draw.randrange(-1, 30)))
    shadow = spark.createDataFrame(rows, "part int, view int, min_x long, min_y long, max_x long, max_y long")
    expected = sorted(
        (a[0], b[0], a[1], *ends)
        for a in rows
        for b in rows
        if a[1] == b[1] and a[0] != b[0]
        for ends in [(max(a[2], b[2]), max(a[3], b[3]), min(a[4], b[4]), min(a[5], b[5]))]
        if ends[2] >= ends[0] and ends[3] >= ends[1]
    )
    names = ["a", "b", "view", "min_x", "min_y", "max_x", "max_y"]
    for band in (7, 256):
        assert sorted(tuple(r) for r in exchange.overlaps(shadow, band).select(names).collect()) == expected
    assert exchange.overlaps(shadow.limit(0)).count() == 0
