"""Iterative graph operators over edge tables; each round is written to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import Rounds, durable
from silvaspark.operators.points import XYZ
from silvaspark.operators.spatial import near_pairs


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the least node that each reaches; label propagation with pointer jumping. nodes: node; edges: src, dst."""
    rounds = Rounds(nodes.sparkSession)
    edges = rounds.keep(both_ways(edges).distinct())
    labels = nodes.select("node").distinct().withColumn("root", F.col("node"))
    for _ in range(max_rounds):
        near = edges.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("root").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = lower.select(F.col("node").alias("at"), F.col("root").alias("up"))
        moved = rounds.keep(lower.join(up, F.col("root") == F.col("at")).select("node", "was", F.col("up").alias("root")))
        labels = moved.select("node", "root")
        if not moved.where("was <> root").limit(1).count():
            return rounds.last(labels)
    raise RuntimeError("components did not settle")


def dbscan(points: DataFrame, radius: int, min_points: int) -> DataFrame:
    """pid, cluster (least core pid; null: noise): cores have min_points within the radius, themselves included; a border point goes to its least core cluster."""
    pairs = durable(near_pairs(points.select("pid", *XYZ), points.select("pid", *XYZ), radius).select(F.col("a_pid").alias("src"), F.col("b_pid").alias("dst")))
    cores = durable(pairs.groupBy(F.col("src").alias("node")).count().where(F.col("count") >= min_points).select("node"))
    links = pairs.join(cores, F.col("src") == F.col("node"), "left_semi").join(cores, F.col("dst") == F.col("node"), "left_semi").where("src < dst")
    found = components(cores, links)
    reach = pairs.join(found, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("pid")).agg(F.min("root").alias("near"))
    own = found.withColumnRenamed("node", "core")
    out = points.select("pid").join(own, F.col("pid") == F.col("core"), "left").select("pid", "root").join(reach, "pid", "left")
    return out.select("pid", F.coalesce("root", "near").alias("cluster"))


def shortest_paths(edges: DataFrame, sources: DataFrame, by: str, max_rounds: int = 500) -> DataFrame:
    """by, node, dist, pred from the source of each graph: relaxation of the frontier until nothing shortens. edges: by, src, dst, w both ways; sources: by, node."""
    edges = durable(edges.select(by, "src", "dst", "w"))
    best = durable(sources.select(by, "node", F.lit(0).cast("bigint").alias("dist"), F.lit(None).cast("bigint").alias("pred")))
    frontier = best
    for _ in range(max_rounds):
        f = frontier.select(F.col(by).alias("_by"), F.col("node").alias("at"), F.col("dist").alias("so_far"))
        reach = edges.join(f, (F.col(by) == F.col("_by")) & (F.col("src") == F.col("at"))).select(by, F.col("dst").alias("node"), (F.col("so_far") + F.col("w")).alias("dist"), F.col("src").alias("pred"))
        both = best.withColumn("old", F.lit(True)).unionByName(reach.withColumn("old", F.lit(False)))
        least = both.groupBy(by, "node").agg(F.min(F.struct("dist", F.coalesce("pred", F.lit(-1)).alias("p"))).alias("m"), F.min(F.when(F.col("old"), F.col("dist"))).alias("was"))
        now = durable(least.select(by, "node", "m.dist", F.expr("nullif(m.p, -1)").alias("pred"), "was"))
        best = now.drop("was")
        frontier = now.where(F.col("was").isNull() | (F.col("dist") < F.col("was")))
        if not frontier.limit(1).count():
            return best
    raise RuntimeError("paths did not settle")


def cover(points: DataFrame, patch: int, ball: int, min_points: int = 1, max_rounds: int = 1000) -> DataFrame:
    """pid, center (null: in no ball): centres are the first independent set, in the order of a hash, of points closer than the patch; each point goes to its nearest centre within the ball."""
    pairs = near_pairs(points.select("pid", *XYZ), points.select("pid", *XYZ), max(patch, ball)).select("a_pid", "b_pid", "d2")
    pairs = durable(pairs.where(F.col("d2") < max(patch, ball) ** 2).withColumn("rank", F.xxhash64("b_pid")))
    full = pairs.where(F.col("d2") < ball * ball).groupBy(F.col("a_pid").alias("pid")).count().where(F.col("count") >= min_points).select("pid")
    rivals = durable(pairs.where(F.col("d2") < min(patch, ball) ** 2).select("a_pid", "b_pid"))
    open_ = durable(full.withColumn("rank", F.xxhash64("pid")))
    centers = None
    for _ in range(max_rounds):
        o = open_.select(F.col("pid").alias("q"), F.struct("rank", "pid").alias("r"))
        least = rivals.join(o, F.col("b_pid") == F.col("q")).groupBy("a_pid").agg(F.min("r").alias("least"))
        new = durable(open_.join(least, F.col("pid") == F.col("a_pid")).where(F.col("least.pid") == F.col("pid")).select("pid"))
        centers = new if centers is None else centers.unionByName(new)
        covered = rivals.join(new, F.col("a_pid") == F.col("pid")).select(F.col("b_pid").alias("gone")).distinct()
        open_ = durable(open_.join(covered, F.col("pid") == F.col("gone"), "left_anti"))
        if not open_.limit(1).count():
            break
    else:
        raise RuntimeError("centres did not settle")
    centers = durable(centers)
    c = centers.withColumnRenamed("pid", "c")
    near = pairs.where(F.col("d2") < ball * ball).join(c, F.col("b_pid") == F.col("c")).groupBy("a_pid").agg(F.min(F.struct("d2", "rank", "c")).alias("m"))
    return points.select("pid").join(near, F.col("pid") == F.col("a_pid"), "left").select("pid", F.col("m.c").alias("center"))


def cover_neighbors(points: DataFrame, cover_of: DataFrame, ball: int) -> DataFrame:
    """src, dst, both ways: patches of which one's ball holds a point of the other."""
    owned = points.select("pid", *XYZ).join(cover_of.where("center is not null"), "pid")
    middles = owned.where("pid = center").select("center", *XYZ)
    met = near_pairs(owned.select("center", *XYZ), middles, ball).where(F.col("d2") < ball * ball).select(F.col("b_center").alias("src"), F.col("a_center").alias("dst")).where("src <> dst")
    return both_ways(met).distinct()


def descendants(links: DataFrame, by: str, start: DataFrame, hops: int) -> DataFrame:
    """by, node, hop: nodes reached from start over child links (by, parent, node) in up to so many hops."""
    front = start.select(by, "node", F.lit(0).alias("hop"))
    out = front
    for hop in range(1, hops + 1):
        f = front.select(F.col(by).alias("_by"), F.col("node").alias("at"))
        front = links.join(f, (F.col(by) == F.col("_by")) & (F.col("parent") == F.col("at"))).select(by, "node", F.lit(hop).alias("hop"))
        out = out.unionByName(front)
    return out


def first_of_each(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
