"""Volumes, and the numbering of voxels and lines.

Tables: ``image`` (voxel, value), ``matrix`` (line, voxel, value; duplicates allowed), ``projections`` (line, value),
``views`` and ``rays`` (see sources.geometry), ``parts`` (part, lo_0, hi_0, lo_1, hi_1, lo_2, hi_2; inclusive).
An absent voxel or line is zero. Numbers are long, so that matrices beyond 2^31 rows or columns work.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPSILON = 1e-5


@dataclass(frozen=True)
class Volume:
    """A box of voxels: counts, lower corner and lengths by axis; axis 0 varies fastest in voxel numbers."""

    voxels: tuple[int, ...]
    origin: tuple[float, ...] = ()
    lengths: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        d = len(self.voxels)
        object.__setattr__(self, "voxels", tuple(int(x) for x in self.voxels))
        object.__setattr__(self, "origin", tuple(float(x) for x in self.origin) or (0.0,) * d)
        object.__setattr__(self, "lengths", tuple(float(x) for x in self.lengths) or (1.0,) * d)
        if len(self.origin) != d or len(self.lengths) != d or min(self.voxels) < 1:
            raise ValueError(f"not a volume: {self}")

    @classmethod
    def cube(cls, k: int, dim: int = 3) -> Volume:
        return cls((k,) * dim)

    @property
    def dim(self) -> int:
        return len(self.voxels)

    @property
    def cells(self) -> int:
        return prod(self.voxels)

    @property
    def center(self) -> tuple[float, ...]:
        return tuple(o + 0.5 * x for o, x in zip(self.origin, self.lengths, strict=True))

    def corners(self) -> list[tuple[float, ...]]:
        """All corners; axis 0 changes first."""
        d = self.dim
        return [tuple(self.origin[a] + (self.lengths[a] if i >> a & 1 else 0.0) for a in range(d)) for i in range(1 << d)]

    def index(self, at: list[Column]) -> Column:
        out, stride = F.lit(0).cast("long"), 1
        for x, n in zip(at, self.voxels, strict=True):
            out, stride = out + x.cast("long") * F.lit(stride), stride * n
        return out

    def unroll(self, voxel: Column) -> list[Column]:
        out, stride = [], 1
        for n in self.voxels:
            out.append(F.pmod(F.floor(voxel / F.lit(stride)), F.lit(n)).cast("long"))
            stride *= n
        return out

    def valid(self, at: list[Column]) -> Column:
        ok = F.lit(True)
        for x, n in zip(at, self.voxels, strict=True):
            ok = ok & (x >= 0) & (x < n)
        return ok

    def grid(self, spark: SparkSession) -> DataFrame:
        """voxel, i0, i1, ... of every voxel."""
        rows = spark.range(self.cells).withColumnRenamed("id", "voxel")
        return rows.select("voxel", *[x.alias(f"i{d}") for d, x in enumerate(self.unroll(F.col("voxel")))])
