"""Leaf and wood of the trees of a stand by their ways to the foot, over the nearest neighbours of occupied voxels.

Points: pid (unique, from 0 up), a column `by` that names the tree, x, y, z (whole mm). Points with a null coordinate or tree have no row in results; points that no way joins to
their tree's foot are leaf; an empty cloud gives no rows. Each round of a way or of growth is written to the shared checkpoint folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.common import durable
from silvaspark.operators import graph, segments, shapes, spatial, structure
from silvaspark.operators.points import XYZ, voxel

CELL = ("vx", "vy", "vz")
INTERVALS = (100, 200, 300, 500, 1000)


def feet(points: DataFrame, by: str, slab: int = 200) -> DataFrame:
    """by, node (negative), x, y, z, low: the foot of each tree, at the circle fitted to its lowest slab, or at the slab's mean where the circle's centre is outside the slab's bounds; low is its lowest z."""
    lowest = points.groupBy(by).agg(F.min("z").alias("low"))
    base = points.select(by, *XYZ).join(lowest, by).where(F.col("z") - F.col("low") < slab)
    bounds = base.groupBy(by).agg(F.min("low").alias("low"), *[f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("m", F.avg), ("a", F.min), ("b", F.max))])
    circles = structure.circle_fit(base.select(F.col(by).alias("tree_id"), F.lit(0).alias("part"), "x", "y", F.lit(0).alias("z"))).select(F.col("tree_id").alias(by), "cx", "cy")
    inside = F.col("cx").between(F.col("ax"), F.col("bx")) & F.col("cy").between(F.col("ay"), F.col("by"))
    middle = [F.round(F.when(inside, F.col(f"c{c}")).otherwise(F.col(f"m{c}"))).cast("long").alias(c) for c in "xy"]
    node = -1 - F.xxhash64(by).bitwiseAND(F.lit(2**62 - 1))
    return bounds.join(circles, by, "left").select(by, (node - 1).alias("node"), *middle, F.round("mz").cast("long").alias("z"), "low")


def tree_links(nodes: DataFrame, roots: DataFrame, by: str, *, reach: int, k: int, slab: int = 200) -> DataFrame:
    """src, dst, w (mm, rounded up, at least 1), both ways: the k nearest nodes of the same tree within reach, and each foot with the nodes of its slab."""
    near = spatial.hybrid_knn(nodes.select(F.col("node").alias("pid"), by, *XYZ), reach, k + 1, (by,)).where("a_pid <> b_pid").select(F.col("a_pid").alias("src"), F.col("b_pid").alias("dst"), "d2")
    r = roots.select(by, F.col("node").alias("src"), "low", *[F.col(c).alias(f"r{c}") for c in XYZ])
    d2 = sum(((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in XYZ), F.lit(0).cast("long"))
    foot = nodes.join(r, by).where(F.col("lowest") - F.col("low") < slab).select("src", F.col("node").alias("dst"), d2.alias("d2"))
    one = near.unionByName(foot)
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2"))
    return both.distinct().select("src", "dst", F.greatest(F.ceil(F.sqrt("d2")), F.lit(1)).cast("long").alias("w"))


def steps(ways: DataFrame, places: DataFrame) -> DataFrame:
    """node, dist, pred, step (length of the last link; null at a foot), sx, sy, sz (its direction, from pred to node)."""
    at = ways.select("node", "dist", "pred").join(places, "node")
    before = ways.select(F.col("node").alias("pred"), F.col("dist").alias("before")).join(places.select(F.col("node").alias("pred"), *[F.col(c).alias(f"p{c}") for c in XYZ]), "pred")
    return at.join(before, "pred", "left").select("node", "dist", "pred", (F.col("dist") - F.col("before")).alias("step"), *[(F.col(c) - F.col(f"p{c}")).alias(f"s{c}") for c in XYZ])


def with_ends(links: DataFrame, ways: DataFrame) -> DataFrame:
    """links with the steps of both ends behind a_ and b_."""
    end = lambda p, on: ways.select(F.col("node").alias(on), *[F.col(c).alias(f"{p}_{c}") for c in ("dist", "step", "sx", "sy", "sz")])
    return links.join(end("a", "src"), "src").join(end("b", "dst"), "dst")


def uncut(ends: DataFrame, factor: float = 2.0, degrees: float = 45.0) -> DataFrame:
    """Those of with_ends' links that are no longer than so many times the shorter step of their ends and whose ends' steps differ by no more than the angle; links of a foot stay."""
    dot = sum((F.col(f"a_s{c}") * F.col(f"b_s{c}") for c in XYZ), F.lit(0).cast("long"))
    size = lambda p: F.sqrt(sum((F.col(f"{p}_s{c}") * F.col(f"{p}_s{c}") for c in XYZ), F.lit(0).cast("long")))
    turned = F.coalesce(dot < math.cos(math.radians(degrees)) * size("a") * size("b"), F.lit(False))
    return ends.where(F.col("a_step").isNull() | F.col("b_step").isNull() | ((F.col("w") <= factor * F.least("a_step", "b_step")) & ~turned))


def pieces(kept: DataFrame, ways: DataFrame, intervals: tuple[int, ...] = INTERVALS) -> DataFrame:
    """interval, node, piece (its least node): nodes linked within one class of the way's length, for classes of each width."""
    every = F.explode(F.array(*[F.lit(i) for i in intervals])).alias("interval")
    node = lambda c: F.struct("interval", F.col(c).alias("node"))
    within = kept.select("src", "dst", "a_dist", "b_dist", every).where(F.floor(F.col("a_dist") / F.col("interval")) == F.floor(F.col("b_dist") / F.col("interval")))
    found = graph.components(ways.select("node", every).select(node("node").alias("node")), within.where("src < dst").select(node("src").alias("src"), node("dst").alias("dst")))
    return found.select("node.interval", "node.node", F.col("root.node").alias("piece"))


def piece_kinds(points: DataFrame, of: DataFrame, ways: DataFrame, by: str, *, least: int = 10, share: int = 20_000, error: float = 0.2, flat: float = 0.01, line: float = 0.9) -> DataFrame:
    """interval, piece, kind of each piece: a radius (mm) for a cylinder, minus the share of the largest variance for a line, 0 for others.

    points: by, node, x, y, z. The axis of a piece is the sum of its steps. Pieces of less than `least` points or one in `share` of the tree's, or whose extent along the axis is not within a
    quarter of the interval, are 0; a cylinder's circle across the axis has a smaller relative error than `error` and a share of the least variance above `flat`."""
    key = ["interval", "piece"]
    axis = of.join(ways, "node").groupBy(*key).agg(*[F.sum(f"s{c}").cast("double").alias(f"t{c}") for c in XYZ])
    length = F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2)
    axis = axis.where(length > 0).select(*key, *[(F.col(f"t{c}") / length).alias(f"t{c}") for c in XYZ])
    side = F.sqrt(F.col("ty") ** 2 + F.col("tz") ** 2)
    axis = axis.select(*key, "tx", "ty", "tz", F.when(side > 0, -F.col("tz") / side).otherwise(1.0).alias("uy"), F.when(side > 0, F.col("ty") / side).otherwise(0.0).alias("uz"))
    totals = points.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    p = durable(of.join(points, "node").select(*key, by, *XYZ))
    along = p.join(axis, key)
    across = [F.round(F.col("y") * F.col("uy") + F.col("z") * F.col("uz")), F.round(F.col("x") * (F.col("ty") * F.col("uz") - F.col("tz") * F.col("uy")) - F.col("y") * F.col("tx") * F.col("uz") + F.col("z") * F.col("tx") * F.col("uy"))]
    h = F.col("x") * F.col("tx") + F.col("y") * F.col("ty") + F.col("z") * F.col("tz")
    sizes = along.groupBy(*key).agg(F.first(by).alias(by), F.count(F.lit(1)).alias("n"), (F.max(h) - F.min(h)).alias("extent")).join(totals, by)
    sizes = sizes.where((F.col("n") >= least) & (share * F.col("n") >= F.col("total")) & F.col("extent").between(0.75 * F.col("interval"), 1.25 * F.col("interval")))
    sized = durable(sizes.select(*key))
    some = along.join(sized, key, "left_semi")
    flatly = some.select(F.struct(*key).alias("tree_id"), F.lit(0).alias("part"), *[e.cast("long").alias(c) for e, c in zip(across, "xy", strict=True)], F.lit(0).alias("z"))
    circles = structure.circle_fit(flatly)
    fits = circles.join(structure.circle_error(flatly, circles), ["tree_id", "layer"]).select("tree_id.interval", "tree_id.piece", "radius", "error")
    shape = shapes.principal_axes(p.join(sized, key, "left_semi"), *key).select(*key, "curvature", (F.col("e1") / F.nullif(F.col("e1") + F.col("e2") + F.col("e3"), F.lit(0.0))).alias("most"))
    kind = F.when((F.col("error") < error) & (F.col("curvature") > flat), F.col("radius")).when(F.col("most") > line, -F.col("most")).otherwise(0.0)
    known = shape.join(fits, key, "left").select(*key, kind.alias("kind"))
    return of.select(*key).distinct().join(known, key, "left").select(*key, F.coalesce("kind", F.lit(0.0)).alias("kind"))


def corrected(kinds: DataFrame, of: DataFrame, ways: DataFrame, passes: int = 3) -> DataFrame:
    """kinds, with 0 for pieces that are larger than the next piece of a kind on their way to the foot; all pieces of a pass are judged at once."""
    key = ["interval", "piece"]
    first = of.join(ways, "node").groupBy(*key).agg(F.min(F.struct("dist", "node", "pred")).alias("m")).select(*key, F.col("m.pred").alias("node"))
    up = durable(first.join(of.select("interval", "node", F.col("piece").alias("up")), ["interval", "node"]).select(*key, "up"))
    for _ in range(passes):
        kinds = durable(kinds)
        above = kinds.select("interval", F.col("piece").alias("up"), F.col("kind").alias("up_kind"))
        next_ = lambda t: t.select("interval", F.col("piece").alias("up"), F.col("up").alias("over"))
        hop = up
        while True:  # pointer jumping over pieces of no kind; ways shorten, so it ends
            seen = durable(hop.join(above, ["interval", "up"]))
            if not seen.where("up_kind = 0").limit(1).count():
                break
            open_ = seen.where("up_kind = 0").select("interval", "piece", "up").join(next_(seen.where("up_kind = 0").select(*key, "up").unionByName(seen.where("up_kind <> 0").select(*key, "up"))), ["interval", "up"]).select(*key, F.col("over").alias("up"))
            hop = durable(seen.where("up_kind <> 0").select(*key, "up").unionByName(open_))
        kinds = kinds.join(seen.where("up_kind <> 0").select(*key, "up_kind"), key, "left").select(*key, F.when(F.col("kind") > F.col("up_kind"), 0.0).otherwise(F.col("kind")).alias("kind"))
    return durable(kinds)


def grown(seeds: DataFrame, ends: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node: seeds and what links lead to from them without a longer way to the foot, and so on, the way itself included; then the links' other ends that are nearer than two steps."""
    down = durable(ends.where("b_dist <= a_dist").select("src", "dst"))
    wood = front = durable(seeds.select("node").distinct())
    for _ in range(max_rounds):
        front = durable(down.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(wood, "node", "left_anti"))
        if not front.limit(1).count():
            break
        wood = durable(wood.unionByName(front))
    else:
        raise RuntimeError("growth did not settle")
    beside = ends.where(F.col("w") < 2 * F.col("a_step")).join(wood.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    return wood.unionByName(beside).distinct()


def leaf_and_wood(points: DataFrame, by: str = "tree_id", *, size: int = 50, reach: int = 500, k: int = 12, slab: int = 200, intervals: tuple[int, ...] = INTERVALS, least: int = 10) -> DataFrame:
    """pid, wood: wood are the pieces of lines and cylinders along the ways to the foot, the ways themselves, what grows down from them, and the stump; all else is leaf."""
    p = durable(points.select("pid", by, *XYZ, *voxel(size)).dropna())
    nodes = durable(p.groupBy(by, *CELL).agg(F.min("pid").alias("node"), F.min("z").alias("lowest"), *[F.round(F.avg(c)).cast("long").alias(c) for c in XYZ]))
    roots = durable(feet(p, by, slab))
    links = durable(tree_links(nodes, roots, by, reach=reach, k=k, slab=slab))
    found = durable(segments.nearest_source(links, roots.select("node", F.col("node").alias("label"))))
    ways = durable(steps(found, nodes.select("node", *XYZ).unionByName(roots.select("node", *XYZ))))
    ends = durable(with_ends(links, ways))
    of = durable(pieces(uncut(ends), ways, intervals))
    placed = durable(p.join(nodes.select(by, *CELL, "node"), [by, *CELL]).select("pid", by, "node", *XYZ))
    kinds = corrected(piece_kinds(placed, of, ways, by, least=least), of, ways)
    seeds = of.join(kinds.where("kind <> 0"), ["interval", "piece"], "left_semi").select("node")
    stump = ends.where("a_step is null").select(F.col("dst").alias("node"))
    wood = durable(grown(seeds, ends).unionByName(stump).distinct().withColumn("is_wood", F.lit(True)))
    foot = roots.select(by, F.col("z").alias("foot_z"))
    return placed.join(wood, "node", "left").join(foot, by).select("pid", (F.coalesce("is_wood", F.lit(False)) | (F.col("z") < F.col("foot_z"))).alias("wood"))
