"""Command line: partition volumes, judge partitionings, count messages, run reconstructions.

    python -m rayframe.tools partition SPEC.toml -p 4 8 --method grcb --out DIR
    python -m rayframe.tools stats SPEC.toml TREE.bsp
    python -m rayframe.tools overlap SPEC.toml
    python -m rayframe.tools volumes SPEC.toml -p 4 8
    python -m rayframe.tools messages SPEC.toml -p 4 8 16
    python -m rayframe.tools reconstruct SPEC.toml --iterations 10
    python -m rayframe.tools measure SPEC.toml [TREE.bsp] -p 4 8 --iterations 10 --out DIR
"""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels
from .model import Volume
from .operators import distributed, exchange, image, linop, solvers
from .plans import bisection, grcb, statistics, trees
from .sources import formats, geometry, images
from .storage import discard, keep


def evaluated(rays: DataFrame, volume: Volume, boxes: list[trees.Box]) -> dict[str, float]:
    """Imbalance, messages, communication volume and regulariser volume of a partitioning."""
    matrix = keep(kernels.closest(rays, volume), "closest")
    owned = keep(statistics.owners(matrix, volume, boxes), "owners")
    return {
        "V": statistics.communication_volume(owned).first()[0],
        "Vg": statistics.regularizer_volume(volume, boxes),
        "epsilon": statistics.load_imbalance(statistics.voxel_weights(matrix), volume, boxes).first()[0],
        "messages": statistics.message_count(owned, len(boxes)).first()[0],
    }


def counted_messages(views: DataFrame, volume: Volume, boxes: list[trees.Box]) -> dict[str, int]:
    """Of an iteration: messages between parts, detector pixels they carry, and the most messages of one part."""
    shadow = exchange.shadows(trees.parts(views.sparkSession, boxes), views, volume)
    size = views.agg(F.max("n0"), F.max("n1")).first()
    pairs = keep(exchange.contributions(shadow, size[0], size[1]).filter("owner <> target").groupBy("owner", "target").agg(F.count(F.lit(1)).alias("pixels")), "pairs")
    total = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("pixels"), F.lit(0))).first()
    both = pairs.select(F.col("owner").alias("part")).unionByName(pairs.select(F.col("target").alias("part")))
    most = both.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return {"messages": 2 * total[0], "pixels": 2 * total[1], "most": most}


def partition(rays: DataFrame, views: DataFrame, volume: Volume, parts: int, method: str, **options) -> trees.Tree:
    """A neutral tree by ``grcb`` or ``bisection``."""
    if method == "grcb":
        return grcb.partition(views, volume, parts.bit_length() - 1, **options)
    return trees.to_neutral(bisection.partition_bisection(rays, volume, parts, 0.05), volume)


def communication_table(rays: DataFrame, volume: Volume, counts: list[int]) -> str:
    """Volumes of the bisected and the trivial partitioning, their gain, and what a regulariser adds."""
    matrix = keep(kernels.closest(rays, volume), "closest")
    cells: dict = {}
    for p in counts:
        tree = bisection.partition_bisection(rays, volume, p)
        boxes = trees.boxes(tree, volume)
        vb = statistics.communication_volume(statistics.owners(matrix, volume, boxes)).first()[0]
        axis, slabs, vt = bisection.partition_trivial(matrix, volume, p)
        gain = f"{100 * (vt - vb) / vt:.1f}%" if vt else "-"
        for c, v in (("V_b", vb), ("V_t", f"{vt} (axis {axis})"), ("V_reg", statistics.regularizer_volume(volume, boxes)), ("gain", gain)):
            cells[str(p), c] = v
        if p == 64:
            cube = trees.blocks(volume, (4, 4, 4))
            cells[str(p), "V_c"] = statistics.communication_volume(statistics.owners(matrix, volume, cube)).first()[0]
    return formats.report([str(p) for p in counts], ["V_b", "V_t", "V_reg", "gain", "V_c"], cells)


def measured(views: DataFrame, volume: Volume, boxes: list[trees.Box], iterations: int) -> tuple[DataFrame, dict[str, str]]:
    """The phantom reconstructed over parts, and mean seconds of an iteration, its exchange, and its forward products.

    Forward products are timed part by part: their mean, the slowest, and by how much the slowest exceeds the mean.
    """
    shape = views.agg(F.max("n0"), F.max("n1")).first()
    matrix = keep(kernels.joseph(geometry.rays(views, 3), volume), "joseph")
    projections = linop.forward(matrix, image.phantom(views.sparkSession, volume))
    shadow = exchange.shadows(trees.parts(views.sparkSession, boxes), views, volume)
    shared = distributed.contributed(exchange.contributions(shadow, *shape), views, *shape)
    rounds: list[distributed.Round] = []
    found = distributed.sirt(matrix, projections, volume, boxes, iterations=iterations, shared=shared, rounds=rounds)
    discard(matrix)
    mean = lambda xs: sum(xs) / max(1, len(xs))
    average, most = mean([mean([*r.forward.values()]) for r in rounds]), mean([max(r.forward.values(), default=0.0) for r in rounds])
    times = {"": mean([r.seconds for r in rounds]), " (com)": mean([r.exchange for r in rounds]), " (avg fp)": average, " (max fp)": most}
    return found, {k: f"{v:.2f} s" for k, v in times.items()} | {" (avg eps)": f"{most / average - 1 if average else 0:.2f}"}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rayframe.tools")
    parser.add_argument("tool", choices=["partition", "stats", "overlap", "volumes", "messages", "reconstruct", "measure"])
    parser.add_argument("spec")
    parser.add_argument("tree", nargs="?")
    parser.add_argument("-p", type=int, nargs="+", default=[4])
    parser.add_argument("-k", type=int, default=0)
    parser.add_argument("--method", choices=["grcb", "bisection"], default="grcb")
    parser.add_argument("--splitter", choices=["midway", "equal_shadow", "equal_load", "smart", "smart_simple"], default="midway")
    parser.add_argument("--precision", choices=["low", "medium", "high"], default="low")
    parser.add_argument("--gradient", action="store_true")
    parser.add_argument("--iterations", type=int, default=10)
    parser.add_argument("--out", default=".")
    a = parser.parse_args(args)
    # Without it PySpark looks up where each column was made: some 3 ms an operation, most of the time of small jobs.
    spark = SparkSession.builder.config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    volume, views = formats.read_specification(spark, Path(a.spec).read_text(), a.k or min(4 * max(a.p), 512))
    rays = geometry.rays(views, 3)
    if a.tool == "partition":
        rows = {}
        for p in a.p:
            options = {"splitter": a.splitter, "precision": a.precision, "gradient": a.gradient} if a.method == "grcb" else {}
            began = time.time()
            tree = partition(rays, views, volume, p, a.method, **options)
            took = time.time() - began
            Path(a.out, f"{Path(a.spec).stem}_{p}.bsp").write_text(trees.serialized(tree))
            for k, v in evaluated(rays, volume, trees.boxes(trees.to_voxels(tree, volume), volume)).items():
                rows[str(p), k] = v
            rows[str(p), "seconds"] = f"{took:.1f}"
        print(formats.report([str(p) for p in a.p], ["V", "Vg", "epsilon", "messages", "seconds"], rows))
    elif a.tool == "stats":
        got = evaluated(rays, volume, trees.load_partitioning(Path(a.tree).read_text(), volume))
        print(f"{got['V']} + {got['Vg']} = {got['V'] + got['Vg']} ({got['epsilon']:.4f})")
    elif a.tool == "overlap":
        whole = (volume.origin, tuple(o + n for o, n in zip(volume.origin, volume.lengths, strict=True)))
        for axis in (0, 2):
            halves = grcb.split_at(whole, grcb.split_midway(views, whole, axis), axis)
            print(f"axis {axis}: {grcb.overlaps(views, [halves])[0]:g}")
            shown: dict = {}
            for r in grcb.outlines(views.limit(8), halves).where("outline IS NOT NULL").collect():
                shown.setdefault(r.view, {})[r.k] = [tuple(q) for q in r.outline]
            for view, of in shown.items():
                Path(a.out, f"overlap_{axis}_{view}.svg").write_text(formats.polygon_svg([of[k] for k in sorted(of)]))
    elif a.tool == "messages":
        rows = {}
        for p in a.p:
            tree = partition(rays, views, volume, p, a.method)
            for k, v in counted_messages(views, volume, trees.boxes(trees.to_voxels(tree, volume), volume)).items():
                rows[str(p), k] = v
        print(formats.report([str(p) for p in a.p], ["messages", "pixels", "most"], rows))
    elif a.tool == "measure":
        rows, columns = {}, []
        for p in a.p:
            matrix = kernels.closest(rays, volume)
            ways = {"trivial": bisection.partition_trivial(matrix, volume, p)[1], "bisected": trees.boxes(bisection.partition_bisection(rays, volume, p), volume)}
            if a.tree:
                ways = {"tree": trees.load_partitioning(Path(a.tree).read_text(), volume, p.bit_length() - 1)}
            for way, boxes in ways.items():
                found, times = measured(views, volume, boxes, a.iterations)
                rows |= {(str(p), way + k): v for k, v in times.items()}
                columns += [way + k for k in times if way + k not in columns]
                for name, picture in zip(("yz", "xz", "xy"), images.png(found, volume), strict=True):
                    Path(a.out, f"{Path(a.spec).stem}_{way}_{p}_slice_{name}.png").write_bytes(picture)
        print(formats.report([str(p) for p in a.p], columns, rows))
    elif a.tool == "volumes":
        print(communication_table(rays, volume, a.p))
    else:
        matrix = keep(kernels.joseph(rays, volume), "joseph")
        measured = linop.forward(matrix, image.phantom(spark, volume))
        found = solvers.sirt(matrix, measured, iterations=a.iterations)
        for s in exchange.orthogonal_slices(found, volume):
            print(formats.ascii_plot(s, Volume(volume.voxels[:2])), "\n")


if __name__ == "__main__":
    main()
