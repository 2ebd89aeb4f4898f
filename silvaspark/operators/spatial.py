"""Neighbour joins of points by a grid: equal cells join, exact distances decide; no cross join.

Cells have twice the radius. Each left point is in one, each right point in all that its surroundings touch, eight at most, so a pair meets once. What follows for each left point is grouped
by its cell first, where the join was, so that no more than the result of each cell moves. A cell of very many points is split by adaptive execution's skew join.

Points with a null coordinate meet nothing; rows of one pid are points of their own in pairs, and one in what is grouped by pid; columns of any name are kept behind a_ and b_.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable
from silvaspark.operators.points import XYZ

CELL = [f"cell_{c}" for c in XYZ]
AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def distance2(a: str = "a_", b: str = "b_"):
    return sum(((F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in XYZ), F.lit(0).cast("bigint"))


def _met(left: DataFrame, right: DataFrame, radius: int, on: tuple[str, ...] = ()) -> DataFrame:
    """a_*, b_*, d2 and the cell of each pair within the radius, of equal columns `on`."""
    edge = 2 * radius
    a = left.select([F.col(c).alias(f"a_{c}") for c in left.columns] + [F.floor(F.col(c) / edge).alias(n) for n, c in zip(CELL, XYZ, strict=True)])
    b = right.select([F.col(c).alias(f"b_{c}") for c in right.columns])
    for c in XYZ:
        b = b.withColumn(f"cb{c}", F.explode(F.sequence(F.floor((F.col(f"b_{c}") - radius) / edge), F.floor((F.col(f"b_{c}") + radius) / edge))))
    meet = [F.col(n) == F.col(f"cb{c}") for n, c in zip(CELL, XYZ, strict=True)] + [F.col(f"a_{c}") == F.col(f"b_{c}") for c in on]
    met = a.join(b, meet).drop(*[f"cb{c}" for c in XYZ])
    return met.withColumn("d2", distance2()).where(F.col("d2") <= radius * radius)


def near_pairs(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """a_*, b_*, d2 for all pairs of left and right within the radius. right is dealt to the cells that it touches; so give the smaller side there."""
    return _met(left, right, radius).drop(*CELL)


def forward_pairs(points: DataFrame, radius: int) -> DataFrame:
    """Each unordered pair within the radius once, a_pid < b_pid."""
    return near_pairs(points, points, radius).where(F.col("a_pid") < F.col("b_pid"))


def degrees(points: DataFrame, radius: int) -> DataFrame:
    """pid, degree: number of points within the radius, itself included."""
    p = points.select("pid", *XYZ)
    return _met(p, p, radius).groupBy(*CELL, F.col("a_pid").alias("pid")).agg(F.count(F.lit(1)).alias("n")).groupBy("pid").agg(F.sum("n").alias("degree"))


def _nearest(met: DataFrame, k: int) -> DataFrame:
    """a_pid, b_pid, d2, rank of the k nearest of each a_pid: k of each cell first, where they are, so that no more than these move."""
    w = lambda *by: Window.partitionBy(*by, "a_pid").orderBy("d2", "b_pid")
    few = met.select(*CELL, "a_pid", "b_pid", "d2").withColumn("rank", F.row_number().over(w(*CELL))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(w())).where(F.col("rank") <= k).select("a_pid", "b_pid", "d2", "rank")


def hybrid_knn(points: DataFrame, radius: int, k: int, on: tuple[str, ...] = ()) -> DataFrame:
    """a_pid, b_pid, d2, rank: the k nearest within the radius, itself included, of equal columns `on`, ties by pid."""
    p = points.select("pid", *on, *XYZ)
    return _nearest(_met(p, p, radius, on), k)


def knn(queries: DataFrame, points: DataFrame, k: int, radius: int, growth: int = 2, max_rounds: int = 30) -> DataFrame:
    """a_pid, b_pid, d2, rank: exact k nearest, by a radius that grows for those queries that have too few within it."""
    total = points.limit(k).count()
    if not total:
        return near_pairs(queries, points, radius).select("a_pid", "b_pid", "d2", F.lit(0).alias("rank"))
    done, left = None, queries.select("pid", *XYZ)
    for _ in range(max_rounds):
        near = durable(_nearest(_met(left, points.select("pid", *XYZ), radius), k))
        full = near.where(F.col("rank") == min(k, total)).select("a_pid")
        found = near.join(full, "a_pid", "left_semi")
        done = found if done is None else done.unionByName(found)
        left = durable(left.join(full, F.col("pid") == F.col("a_pid"), "left_anti"))
        if not left.limit(1).count():
            return done
        radius *= growth
    raise RuntimeError("points too far apart for the largest radius")


def nearest_match(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """a_pid, b_pid: the nearest point of right within the tolerance, ties by pid."""
    near = _met(left.select("pid", *XYZ), right.select("pid", *XYZ), tolerance)
    best = near.groupBy(*CELL, "a_pid").agg(F.min(F.struct("d2", "b_pid")).alias("best"))
    return best.groupBy("a_pid").agg(F.min("best").alias("best")).select("a_pid", "best.b_pid", "best.d2")


def closest_between(points: DataFrame, by: str, of: str, radius: int, growth: int = 2, max_rounds: int = 30) -> DataFrame:
    """by, from, to, d2: the least distance between each two groups `of` of one cloud `by`, found by a growing radius."""
    points = durable(points.select(by, of, *XYZ))
    kinds = points.select(by, of).distinct()
    b = kinds.select(F.col(by).alias("by2"), F.col(of).alias("to"))
    open_ = durable(kinds.join(b, (F.col(by) == F.col("by2")) & (F.col(of) < F.col("to"))).select(F.col(by).alias("_by"), F.col(of).alias("_of"), F.col("to").alias("_to")))
    done = None
    for _ in range(max_rounds):
        # only the points of open pairs of groups, each pair by itself
        side = lambda end: points.select(F.col(by).alias("_p"), F.col(of).alias("_o"), *XYZ).join(open_, (F.col("_p") == F.col("_by")) & (F.col("_o") == F.col(end))).select("_by", "_of", "_to", *XYZ)
        pairs = _met(side("_of"), side("_to"), radius, ("_by", "_of", "_to"))
        found = durable(pairs.groupBy(F.col("a__by").alias(by), F.col("a__of").alias("from"), F.col("a__to").alias("to")).agg(F.min("d2").alias("d2")))
        done = found if done is None else done.unionByName(found)
        open_ = durable(open_.join(found, (F.col("_by") == F.col(by)) & (F.col("_of") == F.col("from")) & (F.col("_to") == F.col("to")), "left_anti"))
        if not open_.limit(1).count():
            return done
        radius *= growth
    raise RuntimeError("groups too far apart for the largest radius")


def overlapping_boxes(boxes: DataFrame, key: str, cell: int) -> DataFrame:
    """a, b of boxes (min_x ... max_z) that overlap, by the cells of the ground plan that they touch."""
    cells = lambda c: F.sequence(F.floor(F.col(f"min_{c}") / cell), F.floor(F.col(f"max_{c}") / cell))
    at = boxes.withColumn("i", F.explode(cells("x"))).withColumn("j", F.explode(cells("y")))
    a, b = (at.select("i", "j", *[F.col(c).alias(f"{p}{c}") for c in boxes.columns]) for p in "ab")
    over = [(F.col(f"amin_{c}") < F.col(f"bmax_{c}")) & (F.col(f"bmin_{c}") < F.col(f"amax_{c}")) for c in XYZ]
    met = a.join(b, ["i", "j"]).where(F.col(f"a{key}") < F.col(f"b{key}"))
    for o in over:
        met = met.where(o)
    return met.select(F.col(f"a{key}").alias("a"), F.col(f"b{key}").alias("b")).distinct()
