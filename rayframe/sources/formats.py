"""Specifications, trees, matrices, reports and pictures as files and text."""

from __future__ import annotations

import tomllib
from math import cos, pi, sin
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Volume
from . import geometry as G

#: Characters by rising intensity.
RAMP = " .:-=+*#%@"


def read_specification(spark: SparkSession, text: str, resolution: int = -1, dim: int = 3) -> tuple[Volume, DataFrame]:
    """(volume, views) of a TOML geometry specification; ``resolution`` above 0 replaces the voxel counts."""
    spec = tomllib.loads(text)
    if spec.get("specifies") != "geometry":
        raise ValueError("the file does not specify a geometry")
    if spec.get("dimension") != dim:
        raise ValueError(f"the geometry has dimension {spec.get('dimension')}, not {dim}")
    v, p, kind = spec["volume"], spec["parameters"], spec["type"]
    low, high = v["min-point"], v["max-point"]
    voxels = (resolution,) * 3 if resolution > 0 else tuple(v["voxels"])
    volume = Volume(voxels[:dim], tuple(low), tuple(h - x for x, h in zip(low, high, strict=True)))
    n = p["projection-count"]
    if kind == "parallel":
        return volume, G.parallel(G.view_range(spark, n), volume, n)
    if kind == "dual-parallel":
        return volume, G.dual_axis_parallel(G.view_range(spark, n // 2 * 2), volume, n // 2)
    common = {"size": p.get("detector-size"), "shape": p.get("detector-shape"), "source": p.get("source-position"), "detector": p.get("detector-position")}
    builders = {
        "circular-cone-beam": lambda b: G.cone_beam(b, volume, n, tilt=p["detector-tilt"], **common),
        "helical-cone-beam": lambda b: G.helical_cone_beam(b, volume, n, rotations=p["rotations"], tilt=p["detector-tilt"], **common),
        "laminography": lambda b: G.laminography(b, volume, n, source_radius=p["source-radius"], detector_radius=p["detector-radius"], **common),
        "tomosynthesis": lambda b: G.tomosynthesis(b, volume, n, arc=p.get("source-arc", 0.7 * pi), **common),
    }
    if kind not in builders:
        raise ValueError(f"geometries of type {kind!r} are not supported")
    return volume, builders[kind](G.view_range(spark, n))


def astra_views(spark: SparkSession, kind: str, rows: int, columns: int, vectors: list[list[float]]) -> DataFrame:
    """Views from 12-number vectors: source or ray, detector centre, u (columns), v (rows).

    Rays of ``parallel3d`` become sources 10^4 times as far away.
    """
    out = []
    for i, x in enumerate(vectors):
        s, d, u, v = x[0:3], x[3:6], x[6:9], x[9:12]
        if kind.startswith("parallel"):
            s = [-1e4 * c for c in s]
        lu, lv = (sum(c * c for c in w) ** 0.5 for w in (u, v))
        out.append((i, [float(c) for c in s], [float(c) for c in d], [lv * columns, lu * rows], [[c / lu for c in u], [c / lv for c in v]], [columns, rows], False))
    views = spark.createDataFrame(out, "view int, source array<double>, detector array<double>, det_size array<double>, tilt array<array<double>>, det_shape array<int>, parallel boolean")
    return G.custom(views)


def astra_angles(kind: str, spacing: tuple[float, float], angles: list[float], source: float = 0.0, detector: float = 0.0) -> list[list[float]]:
    """The 12-number vectors of ``cone`` and ``parallel3d`` geometries given by angles about the third axis.

    ``spacing``: of columns and of rows; ``source``, ``detector``: distances from the origin, for ``cone`` alone.
    """
    if kind not in ("cone", "parallel3d"):
        raise ValueError(f"geometries of type {kind!r} are not given by angles")
    near, far = (source, detector) if kind == "cone" else (1.0, 0.0)
    return [[near * sin(a), -near * cos(a), 0.0, -far * sin(a), far * cos(a), 0.0, spacing[0] * cos(a), spacing[0] * sin(a), 0.0, 0.0, 0.0, spacing[1]] for a in angles]


def write_matrix_market(matrix: DataFrame, lines: int, cells: int, path: str) -> None:
    """One file in coordinate format. Executors write its parts, which are then joined as they are, by their bytes."""
    from ..operators.linop import matrix_market
    from ..storage import shared_dir

    spark = matrix.sparkSession
    header, entries = matrix_market(matrix, lines, cells)
    folder = shared_dir(spark, "matrix-market")
    entries.select(F.format_string("%d %d %s", "row", "col", F.col("value").cast("string")).alias("value")).write.text(folder)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    to, parts = hadoop.fs.Path(path), hadoop.fs.Path(folder)
    there = parts.getFileSystem(conf)
    out = to.getFileSystem(conf).create(to, True)
    try:
        out.write(f"{header}\n".encode())
        for x in sorted(str(f.getPath()) for f in there.listStatus(parts) if f.getPath().getName().startswith("part-")):
            part = there.open(hadoop.fs.Path(x))
            try:
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    there.delete(parts, True)


def read_stack(spark: SparkSession, pattern: str) -> DataFrame:
    """view, content of the image files of a pattern with one ``*`` for the view's number, read where they are."""
    head, tail = (x.replace("\\", "/") for x in pattern.split("*"))
    number = F.regexp_extract("path", f"{_quoted(Path(head).name)}(\\d+){_quoted(tail)}$", 1).cast("int")
    return spark.read.format("binaryFile").load(pattern).select(number.alias("view"), "content")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in text)


def report(rows: list[str], columns: list[str], cells: dict[tuple[str, str], object], latex: bool = False) -> str:
    """A table of named rows and columns as Markdown, or as a LaTeX tabular."""
    table = [["", *columns], *[[r, *[str(cells.get((r, c), "")) for c in columns]] for r in rows]]
    if latex:
        body = " \\\\\n".join(" & ".join(x) for x in table)
        return f"\\begin{{tabular}}{{l{'r' * len(columns)}}}\n{body} \\\\\n\\end{{tabular}}"
    width = [max(len(r[i]) for r in table) for i in range(len(columns) + 1)]
    text = ["| " + " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) + " |" for r in table]
    return "\n".join([text[0], "|" + "|".join("-" * (w + 2) for w in width) + "|", *text[1:]])


def report_frame(df: DataFrame, row: str, column: str, value: str, **options) -> str:
    """A report of a small table: one row a (row, column) pair."""
    got = [(str(r[0]), str(r[1]), r[2]) for r in df.select(row, column, value).collect()]
    return report(list(dict.fromkeys(r for r, _, _ in got)), list(dict.fromkeys(c for _, c, _ in got)), {(r, c): v for r, c, v in got}, **options)


def ascii_plot(image: DataFrame, volume: Volume, size: int = 40, slices: int = 4) -> str:
    """A 2-D image as text, brighter characters for larger values; a 3-D one as evenly spaced slices."""
    from ..operators.image import downscaled, sliced

    if volume.dim == 3:
        layers = [int((k + 0.5) * volume.voxels[2] / slices) for k in range(slices)]
        return "\n\n".join(ascii_plot(sliced(image, volume, 2, z), Volume(volume.voxels[:2]), size) for z in layers)
    small = tuple(min(size, n) for n in volume.voxels)
    values = {r.voxel: r.value for r in downscaled(image, volume, small, accumulate=True).collect()}  # size^2 rows
    top = max([*values.values(), 1e-30])
    pick = lambda v: RAMP[min(len(RAMP) - 1, int((max(v, 0.0) / top) ** 0.5 * (len(RAMP) - 1)))]
    return "\n".join("".join(pick(values.get(x + y * small[0], 0.0)) for x in range(small[0])) for y in range(small[1]))


def polygon_svg(polygons: list[list[tuple[float, float]]], size: int = 400) -> str:
    """Outlines as an SVG picture that fits them all."""
    pts = [p for poly in polygons for p in poly] or [(0.0, 0.0)]
    low = [min(p[d] for p in pts) for d in range(2)]
    k = size / max(max(p[d] for p in pts) - low[d] for d in range(2)) if len(set(pts)) > 1 else 1.0
    shapes = "".join('<polygon fill-opacity="0.3" stroke="black" points="' + " ".join(f"{(x - low[0]) * k:.3f},{(y - low[1]) * k:.3f}" for x, y in poly) + '"/>' for poly in polygons)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">{shapes}</svg>'


def polygon_wkt(polygon: list[tuple[float, float]]) -> str:
    """A polygon in well-known text; its first point comes again at the end."""
    return "POLYGON((" + ", ".join(f"{x:g} {y:g}" for x, y in [*polygon, *polygon[:1]]) + "))"
