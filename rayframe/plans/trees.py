"""Split trees, and the boxes of voxels they cut a volume into.

A tree is a dict of heap number (root 1, children 2n and 2n + 1) to (axis, at). In a voxel tree the left child keeps
voxels up to ``at`` inclusively; in a neutral tree ``at`` is the start of the right child as a share of the axis.
Trees have a node a part, so they live on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..model import Volume

Tree = dict[int, tuple[int, float]]
Box = list[tuple[int, int]]


def to_neutral(tree: Tree, volume: Volume) -> Tree:
    return {n: (d, (a + 1) / volume.voxels[d]) for n, (d, a) in tree.items()}


def to_voxels(tree: Tree, volume: Volume) -> Tree:
    return {n: (d, int(a * volume.voxels[d] + 0.5) - 1) for n, (d, a) in tree.items()}


def boxes(tree: Tree, volume: Volume) -> list[Box]:
    """The leaves' boxes from left to right."""
    out: list[Box] = []
    stack: list[tuple[int, Box]] = [(1, [(0, n - 1) for n in volume.voxels])]
    while stack:
        node, box = stack.pop()
        if node not in tree:
            out.append(box)
            continue
        d, a = tree[node]
        left, right = list(box), list(box)
        left[d], right[d] = (box[d][0], int(a)), (int(a) + 1, box[d][1])
        stack += [(2 * node + 1, right), (2 * node, left)]
    return out


def parts(spark: SparkSession, of: list[Box]) -> DataFrame:
    """part, lo_0, hi_0, ... of boxes."""
    dim = len(of[0])
    names = "part int, " + ", ".join(f"lo_{d} int, hi_{d} int" for d in range(dim))
    return spark.createDataFrame([(k, *[x for ends in b for x in ends]) for k, b in enumerate(of)], names)


def blocks(volume: Volume, counts: tuple[int, ...]) -> list[Box]:
    """A grid of equal blocks (the last ones may be smaller), axis 0 fastest."""
    out: list[Box] = [[]]
    for n, k in reversed(list(zip(volume.voxels, counts, strict=True))):
        size = -(-n // k)
        out = [[(i * size, min(n, (i + 1) * size) - 1), *b] for b in out for i in range(k)]
    return [b for b in out if all(lo <= hi for lo, hi in b)]


def serialized(tree: Tree, node: int = 1) -> str:
    """Nested lists: [[axis, at], left, right], an absent child as []."""
    if node not in tree:
        return "[]"
    d, a = tree[node]
    return f"[[{d}, {a:g}], {serialized(tree, 2 * node)}, {serialized(tree, 2 * node + 1)}]"


def parsed(text: str, depth: int = -1) -> Tree:
    """The tree of a serialised text down to ``depth`` levels; none for a depth of 0, all for a negative one."""
    tokens = re.findall(r"\[|\]|,|[^\s\[\],]+", text)
    tree: Tree = {}
    at = 0

    def take(token: str) -> None:
        nonlocal at
        if at >= len(tokens) or tokens[at] != token:
            raise ValueError(f"{token!r} is missing at token {at}")
        at += 1

    def read(node: int, left: int) -> None:
        nonlocal at
        take("[")
        if tokens[at] == "]":
            at += 1
            return
        take("[")
        d = int(tokens[at])
        at += 1
        take(",")
        a = float(tokens[at])
        at += 1
        take("]")
        if left != 0:
            tree[node] = (d, a)
        for child in (2 * node, 2 * node + 1):
            take(",")
            read(child, left - 1 if left > 0 else left)
        take("]")

    read(1, depth)
    return tree


def load_partitioning(text: str, volume: Volume, depth: int = -1) -> list[Box]:
    """Boxes of a serialised neutral tree."""
    return boxes(to_voxels(parsed(text, depth), volume), volume)


def printed(tree: Tree, node: int = 1, depth: int = 0) -> str:
    if node not in tree:
        return ""
    d, a = tree[node]
    return f"{'  ' * depth}{depth}: axis {d} at {a:g}\n" + printed(tree, 2 * node, depth + 1) + printed(tree, 2 * node + 1, depth + 1)
