"""From points to models: bases of trees, circles by least squares, cylinders at breast height, plausible shapes, volumes in a box, and the model of each tree of a cloud.

Groups are summed where they lie; only sums and the cylinders themselves move. Points with a null coordinate take part in nothing; repeated points count as often; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable
from silvaspark.operators import shapes
from silvaspark.operators.points import XYZ
from silvaspark.operators.rules import total
from silvaspark.operators.segments import voxel_nodes
from silvaspark.operators.spatial import CELL, _met


def base_sets(points: DataFrame, size: int = 200) -> DataFrame:
    """tree_id, base_mm, n, width_mm: the foot of each tree, of cover sets (cells) below its lowest and 2 % of its height, 1.5 m at most; while it is wider than three tenths of the tree it loses 50 mm, five times at most, down to 50 mm."""
    s = durable(voxel_nodes(points.where("part is not null"), size).join(points.select(F.col("pid").alias("node"), "tree_id").dropDuplicates(["node"]), "node"))
    wide = lambda x, y: F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y))
    t = s.groupBy("tree_id").agg(F.min("z").alias("low"), (F.max("z") - F.min("z")).alias("tall"), wide("x", "y").alias("all"))
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("base", F.least(F.lit(1500.0), 0.02 * F.col("tall")))
    t = t.withColumn("base", F.when(F.col("k") == 0, F.col("base")).otherwise(F.greatest(F.col("base") - 50 * F.col("k"), F.lit(50.0))))
    f = s.join(t, "tree_id").where(F.col("z") < F.col("low") + F.col("base"))
    f = f.groupBy("tree_id", "k").agg(F.first("base").alias("base"), F.first("all").alias("all"), F.count(F.lit(1)).alias("n"), wide("x", "y").alias("width"))
    pick = F.min(F.struct(F.when((F.col("width") <= 0.3 * F.col("all")) | (F.col("k") == 5), 0).otherwise(1).alias("open"), "k", "base", "n", "width")).alias("m")
    return f.groupBy("tree_id").agg(pick).select("tree_id", F.round("m.base", 4).alias("base_mm"), "m.n", F.col("m.width").alias("width_mm"))


def circle_steps(points: DataFrame, circles: DataFrame, *, rounds: int, free: bool, layer: int = 1000) -> DataFrame:
    """tree_id, layer, cx, cy, radius after so many Gauss-Newton steps of the least-squares circle of each layer of the trunks, from circles (the same columns); the radius is kept unless free."""
    p = durable(points.where("part = 0").select("tree_id", F.floor(F.col("z") / layer).alias("layer"), "x", "y").join(circles.select("tree_id", "layer"), ["tree_id", "layer"], "left_semi"))
    state = circles.select("tree_id", "layer", "cx", "cy", "radius")
    for _ in range(rounds):
        j = p.join(state, ["tree_id", "layer"])
        g = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
        j = j.withColumn("g", F.greatest(g, F.lit(1e-9))).withColumn("u", (F.col("x") - F.col("cx")) / F.col("g")).withColumn("v", (F.col("y") - F.col("cy")) / F.col("g"))
        if free:
            j = j.withColumn("radius", F.avg("g").over(Window.partitionBy("tree_id", "layer")))
        e = F.col("g") - F.col("radius")
        s = j.groupBy("tree_id", "layer").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("radius").alias("radius"), F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in (("su", F.col("u")), ("sv", F.col("v")), ("a", F.col("u") * F.col("u")), ("b", F.col("u") * F.col("v")), ("c", F.col("v") * F.col("v")), ("d", F.col("u") * e), ("f", F.col("v") * e))])
        if free:  # the best radius moves with the centre
            s = s.withColumn("a", F.col("a") - F.col("su") * F.col("su") / F.col("n")).withColumn("b", F.col("b") - F.col("su") * F.col("sv") / F.col("n")).withColumn("c", F.col("c") - F.col("sv") * F.col("sv") / F.col("n"))
        det = F.nullif(F.col("a") * F.col("c") - F.col("b") * F.col("b"), F.lit(0.0))
        cx = F.col("cx") + F.coalesce((F.col("d") * F.col("c") - F.col("f") * F.col("b")) / det, F.lit(0.0))
        cy = F.col("cy") + F.coalesce((F.col("a") * F.col("f") - F.col("b") * F.col("d")) / det, F.lit(0.0))
        state = durable(s.select("tree_id", "layer", cx.alias("cx"), cy.alias("cy"), "radius"))
    return state


def breast_height_cylinders(points: DataFrame, known: DataFrame, least: int = 100) -> DataFrame:
    """tree_id, dbh_mm, fitted: the diameter of the cylinder of the trunk's points from 1.1 to 1.5 m above its foot, if these are more than `least` and it is upright and within a fifth of the known one; else that. known: tree_id, dbh_mm."""
    trunk = points.where("part = 0")
    foot = trunk.groupBy("tree_id").agg(F.min("z").alias("foot"))
    p = trunk.join(foot, "tree_id").where((F.col("z") - F.col("foot") > 1100) & (F.col("z") - F.col("foot") < 1500))
    many = p.groupBy("tree_id").count().where(F.col("count") > least).select("tree_id")
    fit = shapes.fit_cylinders(p.join(many, "tree_id", "left_semi"), "tree_id").select("tree_id", (2 * F.col("radius")).alias("d"), "wz", "settled")
    good = F.coalesce(F.col("settled") & (F.abs("wz") > 0.9) & (F.col("d") > 0.8 * F.col("dbh_mm")) & (F.col("d") < 1.2 * F.col("dbh_mm")), F.lit(False))
    return known.join(fit, "tree_id", "left").select("tree_id", F.when(good, F.col("d")).otherwise(F.col("dbh_mm")).alias("dbh_mm"), good.alias("fitted"))


def plausible_segments(points: DataFrame, *, apart: int = 20, reach: int = 200, thin: int = 10, long: int = 50) -> DataFrame:
    """tree_id, part, mean_mm, label: -2 where points lie further apart than `apart` on average (from the nearest of their segment, `reach` at most), -1 for long and very thin segments, else the segment's number."""
    p = points.select("pid", *XYZ, (F.col("tree_id") * 4 + F.col("part")).alias("seg"))
    near = _met(p, p, reach, ("seg",)).where("a_pid <> b_pid").groupBy(*CELL, "a_pid").agg(F.min("d2").alias("d2")).groupBy(F.col("a_pid").alias("n")).agg(F.sqrt(F.min("d2").cast("double")).alias("d"))
    mean = p.join(near, F.col("pid") == F.col("n"), "left").groupBy("seg").agg(F.avg(F.coalesce("d", F.lit(float(reach)))).alias("mean"))
    from silvaspark.operators.rules import oriented_boxes

    box = oriented_boxes(p, shapes.box_axes(p, "seg"), "seg")
    label = F.when(F.col("mean") > apart, -2).when((F.col("thin_mm") < thin) & (F.col("long_mm") > long), -1).otherwise(F.col("seg"))
    return mean.join(box, "seg", "left").select(F.floor(F.col("seg") / 4).alias("tree_id"), (F.col("seg") % 4).alias("part"), F.round("mean", 4).alias("mean_mm"), label.cast("long").alias("label"))


def _line(points: DataFrame, axes: DataFrame, by: list[str]) -> DataFrame:
    """points with t (mm along the axis of their group, from its mean place) and d (distance from that line)."""
    mid = points.groupBy(*by).agg(*[F.avg(c).alias(f"m{c}") for c in XYZ])
    p = points.join(mid, by).join(axes.select(*by, *[f"axis_{c}" for c in XYZ]), by)
    off = [F.col(c) - F.col(f"m{c}") for c in XYZ]
    p = p.withColumn("t", total([o * F.col(f"axis_{c}") for o, c in zip(off, XYZ, strict=True)]))
    return p.withColumn("d", F.sqrt(F.greatest(F.lit(0.0), total([o * o for o in off]) - F.col("t") * F.col("t"))))


def box_volumes(points: DataFrame, low: tuple, high: tuple, *, least: int = 5, thickest: float = 250.0) -> DataFrame:
    """tree_id, part, n, length_mm, radius_mm, litres of the part of each segment inside a box: a cylinder of the median distance from the longest axis, between the mean places of its lowest and highest tenths; thicker ones than `thickest` are left out."""
    by = ["tree_id", "part"]
    p = points
    for c, a, b in zip(XYZ, low, high, strict=True):
        p = p.where((F.col(c) > a) & (F.col(c) < b))
    p = durable(p.select(*by, "pid", *XYZ))
    p = p.join(p.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), by)
    q = _line(p, shapes.box_axes(p, *by).where("axis_z is not null"), by)
    q = q.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("t", "pid")))
    bottom, top = F.col("rn") <= F.greatest(F.floor(0.1 * F.col("n")), F.lit(1)), F.col("rn") > F.least(F.floor(0.9 * F.col("n")), F.col("n") - 1)
    ends = [F.avg(F.when(w, F.col(c))).alias(f"{e}{c}") for e, w in (("a", bottom), ("b", top)) for c in XYZ]
    g = q.groupBy(*by).agg(F.first("n").alias("n"), F.median("d").alias("r"), *ends)
    length = F.sqrt(total([(F.col(f"b{c}") - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in XYZ]))
    g = g.withColumn("l", length).where(F.col("r") <= thickest)
    return g.select(*by, "n", F.round("l", 3).alias("length_mm"), F.round("r", 3).alias("radius_mm"), F.round(F.pi() * F.col("r") * F.col("r") * F.col("l") / 1e6, 6).alias("litres"))


def cylinders_of(points: DataFrame, *, step: int = 500, least_radius: float = 2.5, rounds: int = 12) -> DataFrame:
    """tree_id, part, layer, n, radius, length, start_x to start_z, axis_x to axis_z, mad, settled, parent_part, parent_layer: a cylinder for each stretch of `step` mm along the longest axis of each segment.

    A stretch starts from its segment's axis and goes to least squares. One that doesn't settle, or gives a radius of twice the mean distance from the segment's axis or more, keeps that axis and distance.
    Its parent is the stretch before; of a branch's first stretch, the nearest of the trunk; of the trunk's first, none. Stretches of fewer than six points give no cylinder."""
    by, of = ["tree_id", "part"], ["tree_id", "part", "layer"]
    axes = shapes.box_axes(points, *by).where("axis_z is not null")
    q = _line(points.select(*by, *XYZ), axes, by)
    # from the end that is nearer to the trunk's foot: the lower one of trunks, the inner one of branches
    foot = points.where("part = 0").groupBy("tree_id").agg(*[F.avg(c).alias(f"f{c}") for c in "xy"])
    ends = q.join(foot, "tree_id", "left").groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.first(F.when(F.col("part") == 0, F.col("axis_z")).otherwise(-(F.col("axis_x") * (F.col("fx") - F.col("mx")) + F.col("axis_y") * (F.col("fy") - F.col("my"))))).alias("side"))
    q = q.join(ends, by).withColumn("s", F.when(F.coalesce(F.col("side"), F.lit(1.0)) >= 0, F.col("t") - F.col("lo")).otherwise(F.col("hi") - F.col("t")))
    q = durable(q.withColumn("layer", F.floor(F.col("s") / step)).select(*of, *XYZ, "d", *[f"axis_{c}" for c in XYZ]))
    own = q.groupBy(*of).agg(F.avg("d").alias("mean_d"), *[F.first(f"axis_{c}").alias(f"axis_{c}") for c in XYZ])
    fit = shapes.fit_cylinders(q.select(*of, *XYZ), *of, start=own, rounds=rounds).join(own, of)
    good = F.col("settled") & (F.col("radius") < 2 * F.col("mean_d"))
    fit = fit.select(*of, "n", "settled", "mad", F.greatest(F.lit(least_radius), F.when(good, F.col("radius")).otherwise(F.col("mean_d"))).alias("radius"), *[F.col(f"c{c}").alias(f"o{c}") for c in XYZ], *[F.when(good, F.col(f"w{c}")).otherwise(F.col(f"axis_{c}")).alias(f"w{c}") for c in XYZ])
    e = q.select(*of, *XYZ).join(fit, of)
    along = total([(F.col(c) - F.col(f"o{c}")) * F.col(f"w{c}") for c in XYZ])
    e = e.groupBy(*of).agg(F.min(along).alias("a"), F.max(along).alias("b"))
    c = fit.join(e, of).select(*of, "n", "radius", (F.col("b") - F.col("a")).alias("length"), *[(F.col(f"o{x}") + F.col("a") * F.col(f"w{x}")).alias(f"start_{x}") for x in XYZ], *[F.col(f"w{x}").alias(f"axis_{x}") for x in XYZ], "mad", "settled")
    c = durable(c)
    before = F.lag("layer").over(Window.partitionBy(*by).orderBy("layer"))
    c = c.withColumn("before", before)
    t = c.where("part = 0").select(F.col("tree_id").alias("t"), F.col("layer").alias("stem"), *[(F.col(f"start_{x}") + F.col("length") / 2 * F.col(f"axis_{x}")).alias(f"s{x}") for x in XYZ])
    first = c.where("part > 0 and before is null").join(t, F.col("tree_id") == F.col("t"))
    near = first.groupBy(*by).agg(F.min(F.struct(total([(F.col(f"start_{x}") - F.col(f"s{x}")) * (F.col(f"start_{x}") - F.col(f"s{x}")) for x in XYZ]).alias("d2"), "stem")).alias("m")).select(*by, F.col("m.stem").alias("stem"))
    j = c.join(near, by, "left")
    attached = F.col("before").isNull() & F.col("stem").isNotNull()
    return j.select(*c.drop("before").columns, F.when(F.col("before").isNotNull(), F.col("part")).when(attached, F.lit(0)).cast("long").alias("parent_part"), F.coalesce("before", "stem").alias("parent_layer"))


def tree_rows(cyl: DataFrame, breast: float = 1300.0) -> DataFrame:
    """tree_id, n_cylinders, n_branches, litres of all, trunk and branches, trunk_mm, height_mm, dbh_mm (of the trunk's first cylinder whose summed length gets to breast height, else of its last), unsettled."""
    litres = lambda w: F.round(F.coalesce(F.sum(F.when(w, F.pi() * F.col("radius") * F.col("radius") * F.col("length"))), F.lit(0.0)) / 1e6, 4)
    is_trunk: Column = F.col("part") == 0
    end = F.col("start_z") + F.col("length") * F.col("axis_z")
    upto = Window.partitionBy("tree_id", "part").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    c = cyl.withColumn("sum", F.sum("length").over(upto))
    g = c.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_cylinders"), F.count_distinct(F.when(~is_trunk, F.col("part"))).alias("n_branches"), litres(F.lit(True)).alias("litres"), litres(is_trunk).alias("trunk_litres"), litres(~is_trunk).alias("branch_litres"),
        F.round(F.coalesce(F.sum(F.when(is_trunk, F.col("length"))), F.lit(0.0)), 3).alias("trunk_mm"), F.round(F.greatest(F.max("start_z"), F.max(end)) - F.least(F.min("start_z"), F.min(end)), 3).alias("height_mm"),
        F.min(F.when(is_trunk & (F.col("sum") >= breast), F.struct("layer", "radius"))).alias("hit"), F.max(F.when(is_trunk, F.struct("layer", "radius"))).alias("last"), F.sum(F.when(F.col("settled"), 0).otherwise(1)).alias("unsettled"),
    )
    return g.withColumn("dbh_mm", F.round(2 * F.coalesce("hit.radius", "last.radius"), 3)).drop("hit", "last")
