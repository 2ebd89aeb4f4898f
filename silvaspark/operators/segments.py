"""Trees of a stand and segments of a tree, over a graph of occupied voxels: its density is bounded, however dense the scan is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.common import durable
from silvaspark.operators import graph
from silvaspark.operators.points import XYZ, voxel
from silvaspark.operators.spatial import near_pairs

CELL = ("vx", "vy", "vz")


def voxel_nodes(points: DataFrame, size: int) -> DataFrame:
    """vx, vy, vz, node (least pid), n, x, y, z (mean place, whole mm) of each occupied voxel."""
    return points.groupBy(*voxel(size)).agg(F.min("pid").alias("node"), F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c)).cast("long").alias(c) for c in XYZ])


def voxel_links(nodes: DataFrame, reach: int) -> DataFrame:
    """src, dst, w (mm, rounded up), both ways, of nodes within reach."""
    p = nodes.select(F.col("node").alias("pid"), *XYZ)
    return near_pairs(p, p, reach).where("a_pid <> b_pid").select(F.col("a_pid").alias("src"), F.col("b_pid").alias("dst"), F.ceil(F.sqrt("d2")).cast("long").alias("w"))


def nearest_source(edges: DataFrame, sources: DataFrame, max_rounds: int = 500) -> DataFrame:
    """node, label, dist, pred: shortest way from any source (node, label) over edges (src, dst, w), ties by label, then by predecessor. Nodes out of reach have no row."""
    edges = durable(edges.select("src", "dst", "w"))
    best = sources.groupBy("node").agg(F.min("label").alias("label")).select("node", F.struct(F.lit(0).cast("long").alias("dist"), "label", F.lit(-1).cast("long").alias("pred")).alias("m"))
    best = durable(best)
    front = best
    for _ in range(max_rounds):
        f = front.select(F.col("node").alias("at"), F.col("m").alias("by"))
        new = edges.join(f, F.col("src") == F.col("at")).select(F.col("dst").alias("node"), F.struct((F.col("by.dist") + F.col("w")).alias("dist"), F.col("by.label").alias("label"), F.col("src").alias("pred")).alias("m"))
        both = best.withColumn("old", F.col("m")).unionByName(new.withColumn("old", F.lit(None).cast(best.schema["m"].dataType)))
        now = durable(both.groupBy("node").agg(F.min("m").alias("m"), F.min("old").alias("old")))
        best = now.select("node", "m")
        front = now.where(F.col("old").isNull() | (F.col("m") < F.col("old"))).select("node", "m")
        if not front.limit(1).count():
            return best.select("node", "m.label", "m.dist", F.nullif("m.pred", F.lit(-1)).alias("pred"))
    raise RuntimeError("paths did not settle")


def stem_bases(nodes: DataFrame, links: DataFrame, *, base: int = 600, ground: int = 5000) -> DataFrame:
    """node, label: nodes up to `base` above the lowest of their square of ground, joined to one base where they are linked; label is the base's least node."""
    square = [F.floor(F.col(c) / ground).alias(f"_g{c}") for c in "xy"]
    low = nodes.groupBy(*square).agg(F.min("z").alias("_low"))
    feet = nodes.select("node", "z", *square).join(low, ["_gx", "_gy"]).where(F.col("z") - F.col("_low") < base).select("node")
    feet = durable(feet)
    inside = links.join(feet.withColumnRenamed("node", "_a"), F.col("src") == F.col("_a"), "left_semi").join(feet.withColumnRenamed("node", "_b"), F.col("dst") == F.col("_b"), "left_semi")
    return graph.components(feet, inside.where("src < dst").select("src", "dst")).select("node", F.col("root").alias("label"))


def segment_trees(points: DataFrame, *, size: int = 200, reach: int = 500, base: int = 600) -> DataFrame:
    """pid, tree (label of the stem base that is nearest along the graph; null: none is linked)."""
    nodes = durable(voxel_nodes(points, size))
    links = durable(voxel_links(nodes, reach))
    found = nearest_source(links, stem_bases(nodes, links, base=base)).select(F.col("node").alias("_n"), F.col("label").alias("tree"))
    of = nodes.join(found, F.col("node") == F.col("_n"), "left").select(*CELL, "tree")
    return points.select("pid", *voxel(size)).join(of, list(CELL)).select("pid", "tree")


def _chain_roots(parts: DataFrame, max_rounds: int = 40) -> DataFrame:
    """part, segment: the first part of the chain that each goes on with (part, up); pointer jumping."""
    hop = durable(parts.select("part", F.coalesce("up", "part").alias("segment")))
    for _ in range(max_rounds):
        over = hop.select(F.col("part").alias("_p"), F.col("segment").alias("_s"))
        moved = durable(hop.join(over, F.col("segment") == F.col("_p")).select("part", F.col("segment").alias("was"), F.col("_s").alias("segment")))
        hop = moved.select("part", "segment")
        if not moved.where("was <> segment").limit(1).count():
            return hop
    raise RuntimeError("chains did not settle")


def level_segments(links: DataFrame, sources: DataFrame) -> DataFrame:
    """node, label, level, part, segment, parent_segment (null: the stem), of all nodes that are linked to a source.

    level is the number of links from the source; a part is what is linked within one level of one tree, and goes on from the part of the level below that it has most links with.
    The largest part that goes on from another is the same segment, each other one begins a segment of its own; ties go to the least part."""
    links = durable(links.select("src", "dst"))
    found = nearest_source(links.withColumn("w", F.lit(1).cast("long")), sources).select("node", "label", F.col("dist").alias("level"))
    found = durable(found)
    a, b = (found.select(F.col("node").alias(n), F.col("label").alias(f"{n}_label"), F.col("level").alias(f"{n}_level")) for n in ("src", "dst"))
    within = durable(links.join(a, "src").join(b, "dst").where("src_label = dst_label and dst_level <= src_level"))
    flat = within.where("src_level = dst_level and src < dst").select("src", "dst")
    parts = durable(graph.components(found.select("node"), flat).join(found, "node").select("node", "label", "level", F.col("root").alias("part")))
    down = within.where("dst_level = src_level - 1").select("src", "dst")
    of = lambda n, name: parts.select(F.col("node").alias(n), F.col("part").alias(name))
    meet = down.join(of("src", "part"), "src").join(of("dst", "below"), "dst").groupBy("part", "below").agg(F.count(F.lit(1)).alias("n"))
    below = meet.groupBy("part").agg(F.min(F.struct((-F.col("n")).alias("n"), "below")).alias("m")).select("part", "m.below")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    all_ = durable(sizes.join(below, "part", "left"))
    heirs = all_.where("below is not null").groupBy("below").agg(F.min(F.struct((-F.col("size")).alias("s"), "part")).alias("m")).select(F.col("m.part").alias("heir"))
    chained = all_.join(heirs, F.col("part") == F.col("heir"), "left").select("part", F.when(F.col("heir").isNotNull(), F.col("below")).alias("up"))
    chains = _chain_roots(chained)
    root = all_.select(F.col("part").alias("_s"), F.col("below").alias("_b"))
    above = chains.select(F.col("part").alias("_q"), F.col("segment").alias("parent_segment"))
    known = chains.join(root, F.col("segment") == F.col("_s")).join(above, F.col("_b") == F.col("_q"), "left").select("part", "segment", "parent_segment")
    return parts.join(known, "part").select("node", "label", "level", "part", "segment", "parent_segment")


def segment_stand(points: DataFrame, *, size: int = 200, reach: int = 500, base: int = 600) -> DataFrame:
    """tree, segment, parent_segment, levels, voxels, low, high of each segment of each tree of a stand."""
    nodes = durable(voxel_nodes(points, size))
    links = durable(voxel_links(nodes, reach))
    s = level_segments(links, stem_bases(nodes, links, base=base)).join(nodes.select("node", "z"), "node")
    return s.groupBy(F.col("label").alias("tree"), "segment", "parent_segment").agg(F.count_distinct("level").alias("levels"), F.count(F.lit(1)).alias("voxels"), F.min("z").alias("low"), F.max("z").alias("high"))

