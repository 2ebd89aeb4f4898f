"""Topology of segments by longest ways: each segment goes from its base to the tip that is farthest along the tree, the stem to the top.

Nodes are rows (by, node, up, x, y, z) in whole millimetres; node is unique within `by`, the tree, and up is the node it hangs on, null or unknown at a root. Ways are sums of steps in whole
millimetres, so they don't depend on the order of rows. A task takes whole trees as arrays (see `trees`), and doubled jumps need as many rounds as the logarithm of the deepest way; the result alone is
written to the shared checkpoint folder, where it stays.

Rows with a null in by, node or a coordinate are no nodes, and what hangs on them is a root; of rows with one node the least by (up, x, y, z) counts; nodes that go round in a circle raise an error;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.common import Rounds
from silvaspark.operators import trees
from silvaspark.operators.points import XYZ
from silvaspark.operators.sets import level_parts

#: How near the tree's top, in mm, a tip is looked for at first, by which steps none makes it wider, by which a way too long does, and which ratio of way and distance is too long.
NEAR, NONE, WIDER, RATIO = 500, 500, 1000, 1.05


def _farthest(g: np.ndarray, node: np.ndarray, up: np.ndarray, way: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of the tip above each node that is farthest along the tree, those marked `first` before others, ties to the least node."""
    order = np.lexsort((node, -way, ~first, g))
    best = np.empty(len(g), np.int64)
    best[order] = np.arange(len(g))
    for some, at in trees._jumps(up):
        told = best[some]
        best = best.copy()
        np.minimum.at(best, at, told)
    return order[best]


def _stem_tops(p: pd.DataFrame, tips: np.ndarray, root: np.ndarray, way: np.ndarray, near: int, none: int, wider: int, ratio: float) -> np.ndarray:
    """Places of the tips to which the stem of each root goes.

    Tips are looked for around the place above the root at the height of its highest tip: within `near`, in steps of `none` where there is none, and then `wider` and wider until a tip's way is within `ratio` of its
    distance from the root; of the tips found then the straightest. Where none is so straight, the straightest of all."""
    x, y, z = (p[c].to_numpy() for c in XYZ)
    r = root[tips]
    high, least = np.full(len(x), np.iinfo(np.int64).min), np.full(len(x), np.inf)
    np.maximum.at(high, r, z[tips])
    dx, dy, dz, dh = x[tips] - x[r], y[tips] - y[r], high[r] - z[tips], z[tips] - z[r]
    off, apart = (np.sqrt((dx * dx + dy * dy + d * d).astype(float)) for d in (dz, dh))
    with np.errstate(divide="ignore", invalid="ignore"):
        straight = np.where(apart == 0, np.inf, trees.half_up(way[tips] / apart, 9))
    np.minimum.at(least, r, off)
    begin = np.where(least[r] < near, near, near + none * (np.floor((least[r] - near) / none) + 1))
    much = straight > ratio
    ring = np.where(much | (off < begin), 0, np.floor((off - begin) / wider) + 1)
    order = np.lexsort((p["node"].to_numpy()[tips], straight, ring, much, r))
    return tips[order[trees._starts(r[order])]] if len(tips) else tips


def longest_ways(nodes: DataFrame, by: str = "tree_id", *, near: int = NEAR, none: int = NONE, wider: int = WIDER, ratio: float = RATIO) -> DataFrame:
    """by, node, segment, parent_segment (null for a stem), way, stem of each node: the stem goes from its root to the top (`_stem_tops`), every other segment from where it leaves another one to the tip farthest from there.

    Segments have the number of their tip; way is the length from the root in mm."""

    def run(p: pd.DataFrame, g: np.ndarray) -> pd.DataFrame:
        own = np.r_[True, (g[1:] != g[:-1]) | (p["node"].to_numpy()[1:] != p["node"].to_numpy()[:-1])]
        p, g = p[own].reset_index(drop=True), g[own]
        node, (x, y, z) = p["node"].to_numpy(), (p[c].to_numpy() for c in XYZ)
        up = trees._above(g, node, p["up"].to_numpy(), p["hangs"].to_numpy(bool))
        d2 = sum((v - v[up]) * (v - v[up]) for v in (x, y, z))
        way = trees._summed_down(up, np.where(up >= 0, np.rint(np.sqrt(d2.astype(float))), 0).astype(np.int64))
        root = np.arange(len(g))
        for some, at in trees._jumps(up):
            root = root.copy()
            root[some] = root[at]
        none_first = np.zeros(len(g), bool)
        tips = np.flatnonzero(_farthest(g, node, up, way, none_first) == np.arange(len(g)))
        stem = none_first.copy()
        stem[_stem_tops(p, tips, root, way, near, none, wider, ratio)] = True
        tip = _farthest(g, node, up, way, stem)
        under = np.full(len(g), -1)
        leaves = np.flatnonzero((up >= 0) & (tip[up] != tip))
        under[tip[leaves]] = tip[up[leaves]]
        parent = under[tip]
        return pd.DataFrame({by: p["tree_id"].to_numpy(), "node": node, "segment": node[tip], "parent_segment": node[parent], "known": parent >= 0, "way": way, "stem": stem[tip]})

    n = nodes.select(F.col(by).alias("tree_id"), "node", "up", *XYZ).dropna(subset=["tree_id", "node", *XYZ])
    n = trees._hanging(n, "node", "up", *XYZ)
    kind = lambda c: n.schema[c].dataType.simpleString()
    order = ["node", F.when(F.col("hangs"), F.col("up")).asc_nulls_first(), *XYZ]
    found = trees.in_whole_trees(n, "tree_id", order, run, f"`{by}` {kind('tree_id')}, node {kind('node')}, segment {kind('node')}, parent_segment {kind('node')}, known boolean, way long, stem boolean")
    try:
        out = Rounds(nodes.sparkSession).keep(found)
    except Exception as e:
        if trees.CIRCLE in str(e):
            raise RuntimeError(trees.CIRCLE) from e
        raise
    return out.select(by, "node", "segment", F.when(F.col("known"), F.col("parent_segment")).alias("parent_segment"), "way", "stem")


def long_segments(sets: DataFrame, links: DataFrame, base: DataFrame, by: str = "tree_id", **rule: float) -> DataFrame:
    """by, node, level, part, segment, parent_segment, way, stem of all sets that are linked to a base: the segments of cover sets by longest ways.

    Parts of levels, at the mean place of their sets, hang on the part below that they have most links with; segments have the number of their last part."""
    rounds = Rounds(sets.sparkSession)
    nodes, parts, _ = level_parts(sets, links, base, by, rounds)
    at = sets.select(F.col(by).alias("by"), "node", *XYZ).dropna().dropDuplicates(["by", "node"])
    place = nodes.join(at, ["by", "node"]).groupBy("part").agg(*[F.round(F.avg(c)).cast("long").alias(c) for c in XYZ])
    tree = rounds.keep(parts.join(place, "part").select("by", F.col("part.node").alias("node"), F.col("below.node").alias("up"), *XYZ))
    found = longest_ways(tree, "by", **rule).withColumnRenamed("node", "part")
    out = nodes.select("by", "node", "level", F.col("part.node").alias("part")).join(found, ["by", "part"])
    return rounds.last(out.select(F.col("by").alias(by), "node", "level", "part", "segment", "parent_segment", "way", "stem"))
