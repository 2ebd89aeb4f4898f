"""Rules over points, cylinders and their trees: tiles, ground, lines, directions, bends, sizes, topology and crowns.

Points are (pid, tree_id, part, x, y, z, intensity) and cylinders those of ``fixtures.cylinders``, in whole millimetres. Throughout: rows with a null in a column that a rule reads are in no
group's count or extreme, as in SQL; repeated rows count as often as they are there; an empty table gives an empty result; columns that a rule doesn't name are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable
from silvaspark.operators import graph
from silvaspark.operators.points import XYZ, assign_tiles, stem_section
from silvaspark.operators.spatial import near_pairs
from silvaspark.operators.structure import axis, breast_height_diameter, summed_to_root, tips, trunk

MM = 1000.0


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


# ---- points


def tiles_around_mean(points: DataFrame, size: int) -> DataFrame:
    """tile_i, tile_j, n, low and high corner of each tile from the mean of all points: sums of tiles add up to it, weighted by their numbers of points."""
    t = assign_tiles(points, size).groupBy("tile_i", "tile_j").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in XYZ], *[f(c).alias(f"{p}{c}") for c in XYZ for p, f in (("l", F.min), ("h", F.max))])
    mean = t.agg(*[(F.sum(f"s{c}") / F.sum("n")).alias(f"m{c}") for c in XYZ])  # one row
    return t.join(F.broadcast(mean)).select("tile_i", "tile_j", "n", *[F.round(F.col(f"{p}{c}") - F.col(f"m{c}"), 3).alias(f"{name}_{c}") for c in XYZ for p, name in (("l", "low"), ("h", "high"))])


def restored_places(cyl: DataFrame, points: DataFrame) -> DataFrame:
    """tree_id, pos, x, y, z: starts of models that were built around the (whole) mean of their cloud, put back there."""
    mean = points.groupBy("tree_id").agg(*[F.floor(F.avg(c)).alias(f"m{c}") for c in XYZ])
    return cyl.join(mean, "tree_id").select("tree_id", "pos", *[(F.col(f"{c}0") + F.col(f"m{c}")).alias(c) for c in XYZ])


def ground_band_by_area(points: DataFrame, *, band: int = 100, per_m2: int = 100, offset: int = 200, by: str = "tree_id") -> DataFrame:
    """Points above the ground: the lowest band of height with more than so many points a square metre of the cloud's plan, else the fullest, and `offset` more are cut off."""
    plan = points.groupBy(by).agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("mm2"))
    bands = points.groupBy(by, F.floor(F.col("z") / band).alias("b")).agg(F.count(F.lit(1)).alias("n")).join(plan, by)
    full = F.col("n") * 1_000_000 > F.col("mm2") * per_m2
    cut = bands.groupBy(by).agg(F.coalesce(F.min(F.when(full, F.col("b"))), F.max_by("b", F.struct("n", -F.col("b")))).alias("ground"))
    return points.join(cut, by).where(F.col("z") > (F.col("ground") + 1) * band + offset)


def cloth(points: DataFrame, *, cell: int = 500, rounds: int = 3, sag: int = 100) -> DataFrame:
    """gi, gj, ground: a cloth over the lowest place of each cell of the plan; where it lies more than `sag` above the mean of its neighbours (itself included) it falls to that mean, in rounds."""
    c = points.groupBy(F.floor(F.col("x") / cell).alias("gi"), F.floor(F.col("y") / cell).alias("gj")).agg(F.min("z").alias("ground"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for _ in range(rounds):
        near = c.withColumn("o", F.explode(around)).groupBy((F.col("gi") + F.col("o.i")).alias("ni"), (F.col("gj") + F.col("o.j")).alias("nj")).agg(F.floor(F.avg("ground")).alias("mean"))
        c = c.join(near, (F.col("gi") == F.col("ni")) & (F.col("gj") == F.col("nj"))).select("gi", "gj", F.when(F.col("ground") > F.col("mean") + sag, F.col("mean")).otherwise(F.col("ground")).alias("ground"))
        c = durable(c)
    return c


def above_cloth(points: DataFrame, *, cell: int = 500, height: int = 300) -> DataFrame:
    """Points higher than `height` above the cloth of their cell."""
    g = cloth(points, cell=cell)
    p = points.withColumn("gi", F.floor(F.col("x") / cell)).withColumn("gj", F.floor(F.col("y") / cell))
    return p.join(g, ["gi", "gj"]).where(F.col("z") > F.col("ground") + height).drop("gi", "gj", "ground")


def wood_by_intensity(points: DataFrame, by: str = "tree_id", of: str = "part") -> DataFrame:
    """by, of, n, median, wood: a cluster is wood if it is its tree's largest (ties: the least) or its median intensity reaches the largest one's lower quartile."""
    c = points.groupBy(by, of).agg(F.count(F.lit(1)).alias("n"), F.median("intensity").alias("median"), F.percentile("intensity", F.lit(0.25)).alias("q25"))
    main = c.groupBy(by).agg(F.max(F.struct("n", (-F.col(of)).alias("order"), "q25")).alias("m")).select(F.col(by).alias("_t"), (-F.col("m.order")).alias("stem"), F.col("m.q25").alias("quartile"))
    return c.join(main, F.col(by) == F.col("_t")).select(by, of, "n", "median", ((F.col(of) == F.col("stem")) | (F.col("median") >= F.col("quartile"))).alias("wood"))


def segments_of_points(points: DataFrame, cell: int = 400) -> DataFrame:
    """pid, seg: each point has the segment of its cover set; a set that several segments hold goes to the last."""
    cell_of = [F.floor(F.col(c) / cell).alias(f"v{c}") for c in XYZ]
    p = points.select("pid", *cell_of, (F.col("tree_id") * 4 + F.col("part")).alias("own"))
    sets = p.groupBy("vx", "vy", "vz").agg(F.max("own").alias("seg"))
    return p.join(sets, ["vx", "vy", "vz"]).select("pid", "seg")


def input_parameters(points: DataFrame, n: int = 2, by: str = "tree_id") -> DataFrame:
    """by, i, first, low and high patch diameters and the two ball radii (mm): n variants around what height, stem radius and resolution of the foot of the stem suggest.

    The stem's axis is upright through the mean place of its foot."""
    tall = points.groupBy(by).agg((F.max("z") - F.min("z")).alias("tall"))
    s = stem_section(points, by).join(tall, by)
    section = F.least(F.lit(4000.0), 0.1 * F.col("tall")) - 0.02 * F.col("tall")
    s = s.withColumn("res", F.sqrt(2 * F.pi() * F.col("radius") * section / F.col("n")))
    low, step = 0.9 - 0.1 * (n - 2), 2 * (0.1 + 0.1 * (n - 2)) / max(n - 1, 1)
    factor = F.lit(1.0) if n == 1 else F.lit(low) + F.lit(step) * F.col("i")
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("pd1", F.col("radius") / 3 * factor)
    s = s.withColumn("pd2", F.col("radius") / 6 * F.least(F.lit(1.0), 20 * MM / F.col("tall")) * factor).withColumn("pd3", F.col("radius") / 2.5 * factor)
    ball = lambda d, res, up: F.greatest(F.col(d) + res * F.col("res"), F.least(up * F.col(d), F.col(d) + 25))
    out = {"patch1": F.col("pd1"), "patch2_min": F.col("pd2"), "patch2_max": F.col("pd3"), "ball1": ball("pd1", 1.5, 1.25), "ball2": ball("pd3", 1.25, 1.2)}
    return s.select(by, "i", *[F.round(v, 3).alias(k) for k, v in out.items()])


def layer_directions(points: DataFrame, layer: int = 500, by: str = "tree_id") -> DataFrame:
    """by, layer, dx, dy, dz: from the mean place three layers below (or up to two more up, where there are no points) to that two layers above (or up to two down), as a unit vector; zero where these don't differ."""
    low = points.groupBy(by).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    at = F.floor((F.col("z") - F.col("low")) / layer).alias("layer")
    mean = durable(points.join(low, by).groupBy(by, at).agg(*[F.avg(c).alias(f"m{c}") for c in XYZ], F.max(F.floor((F.col("high") - F.col("low")) / layer)).alias("last")))

    def end(first: Column, sign: int, name: str) -> DataFrame:
        want = mean.select(F.col(by).alias("_b"), F.col("layer").alias("_l"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (first + sign * k).alias("at")) for k in (0, 1, 2)])).alias("c"))
        met = want.join(mean, (F.col("_b") == F.col(by)) & (F.col("c.at") == F.col("layer")))
        return met.groupBy("_b", "_l").agg(F.min(F.struct("c.k", "c.at", *[f"m{c}" for c in XYZ])).alias(name))

    bottom, top = end(F.greatest(F.col("layer") - 3, F.lit(0)), 1, "bot"), end(F.least(F.col("layer") + 2, F.col("last")), -1, "top")
    j = bottom.join(top, ["_b", "_l"])
    d = {c: F.col(f"top.m{c}") - F.col(f"bot.m{c}") for c in XYZ}
    size = F.sqrt(total([v * v for v in d.values()]))
    up = F.col("top.at") > F.col("bot.at")
    return j.select(F.col("_b").alias(by), F.col("_l").alias("layer"), *[F.when(up, F.round(v / size, 6) + F.lit(0.0)).otherwise(0.0).alias(f"d{c}") for c, v in d.items()])


def arc_coverage(points: DataFrame, circles: DataFrame, layer: int = 1000, sectors: int = 100) -> DataFrame:
    """tree_id, layer, coverage: share of the sectors around a fitted centre (cx, cy) that hold a point of the trunk's layer."""
    p = points.where("part = 0").withColumn("layer", F.floor(F.col("z") / layer)).join(circles.select("tree_id", "layer", "cx", "cy"), ["tree_id", "layer"])
    angle = F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")) + F.pi()
    sector = F.least(F.floor(angle * sectors / (2 * F.pi())), F.lit(sectors - 1))
    return p.groupBy("tree_id", "layer").agg((F.count_distinct(sector) / sectors).alias("coverage"))


def rotated_coverage(points: DataFrame, axes: DataFrame, *, layer: int = 1000, layers: int = 10, sectors: int = 20) -> DataFrame:
    """tree_id, layer, coverage, litres: the highest share of cells (layers along the axis by sectors) with a point, of four baselines a quarter of a sector apart, and the
    volume whose cells have their points' mean distance from the axis, of the last baseline, with holes filled from the cells around them (`filled_cells`). axes: tree_id, layer, cx, cy."""
    p = points.where("part = 0").withColumn("layer", F.floor(F.col("z") / layer)).join(axes, ["tree_id", "layer"])
    ux, uy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    turn = (F.atan2(uy, ux) + F.pi()) * sectors / (2 * F.pi())
    p = p.select("tree_id", "layer", F.floor((F.col("z") - F.col("layer") * layer) * layers / layer).alias("h"), turn.alias("turn"), F.sqrt((ux * ux + uy * uy).cast("double")).alias("d"))
    p = p.withColumn("b", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("s", F.pmod(F.floor(F.col("turn") + F.col("b") / 4), F.lit(sectors)))
    cells = p.groupBy("tree_id", "layer", "b", "h", "s").agg(F.avg("d").alias("r"))
    share = cells.groupBy("tree_id", "layer").agg(*[F.sum(F.when(F.col("b") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(4)])
    filled = filled_cells(cells.where("b = 3"), ["tree_id", "layer"], layers, sectors)
    volume = filled.groupBy("tree_id", "layer").agg((F.pi() * F.sum(F.col("r") * F.col("r")) / sectors * (layer / layers) / 1e6).alias("litres"))
    return share.join(volume, ["tree_id", "layer"]).select("tree_id", "layer", (F.greatest(*[F.col(f"n{i}") for i in range(4)]) / (layers * sectors)).alias("coverage"), F.round("litres", 4).alias("litres"))


def filled_cells(cells: DataFrame, by: list[str], layers: int, sectors: int) -> DataFrame:
    """*by, h, s, r, window for all layers * sectors cells of each surface; cells: *by, h (0 ... layers - 1), s (0 ... sectors - 1), r, one row a cell that has a value.

    A cell without a value takes the mean of the window of 3 x 3 cells around it, or of 5 x 5, or of 7 x 7: the first that has two values or more; else the mean of all the surface's values.
    window says which: 1 its own, 3, 5, 7, or null for the surface's mean. Sectors wrap round; beyond its ends the surface goes on as in a mirror. So a value may be in a window more than once.
    Surfaces without a value have no rows; null values are left out. Each value goes to 49 cells for each of its three mirror rows at most, whatever the number of points."""
    known = cells.where("r is not null").select(*by, "h", "s", "r")
    if sectors < 7:
        raise ValueError("a window of seven sectors would meet itself")
    steps = F.array(*[F.lit(i) for i in range(-3, 4)])
    rows = known.withColumn("row", F.explode(F.array(F.col("h"), -1 - F.col("h"), 2 * layers - 1 - F.col("h")))).withColumn("dh", F.explode(steps))
    rows = rows.withColumn("at", F.col("row") + F.col("dh")).where((F.col("at") >= 0) & (F.col("at") < layers)).withColumn("ds", F.explode(steps))
    ring = F.greatest(F.abs("dh"), F.abs("ds"))
    own = (ring == 0) & (F.col("row") == F.col("h"))
    sums = [F.max(F.when(own, F.col("r"))).alias("own")]
    for k in (1, 2, 3):
        sums += [F.sum(F.when(ring <= k, F.col("r"))).alias(f"sum{k}"), F.count(F.when(ring <= k, 1)).alias(f"n{k}")]
    near = rows.groupBy(*by, F.col("at").cast("long").alias("h"), F.pmod(F.col("s") + F.col("ds"), F.lit(sectors)).cast("long").alias("s")).agg(*sums)
    whole = known.groupBy(*by).agg(F.avg("r").alias("mean"))
    every = whole.withColumn("h", F.explode(F.expr(f"sequence(0L, {layers - 1}L)"))).withColumn("s", F.explode(F.expr(f"sequence(0L, {sectors - 1}L)")))
    windows = [F.when(F.col(f"n{k}") > 1, F.col(f"sum{k}") / F.col(f"n{k}")) for k in (1, 2, 3)]
    kind = F.when(F.col("own").isNotNull(), 1)
    for k in (1, 2, 3):
        kind = kind.when(F.col(f"n{k}") > 1, 2 * k + 1)
    return every.join(near, [*by, "h", "s"], "left").select(*by, "h", "s", F.coalesce("own", *windows, "mean").alias("r"), kind.alias("window"))


def covered_surface(points: DataFrame, axes: DataFrame, *, layer: int = 1000, fine: int = 100, sectors: int = 20) -> DataFrame:
    """tree_id, layer, pid, d, radius, coverage, mad, keep: points of a trunk's layer near the innermost of their cell, and the measures of what the cells say.

    First cells of `fine` height give a radius, the median of cells' least distances grown by 5 % or 20 mm; its size sets the cells of a second pass, in which points up to a
    twentieth of the radius (10 mm at least) beyond their cell's least distance stay. axes: tree_id, layer, cx, cy."""
    p = points.where("part = 0").withColumn("layer", F.floor(F.col("z") / layer)).join(axes, ["tree_id", "layer"])
    ux, uy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    p = p.select("tree_id", "layer", "pid", "z", F.sqrt((ux * ux + uy * uy).cast("double")).alias("d"), ((F.atan2(uy, ux) + F.pi()) / (2 * F.pi())).alias("turn"))
    p = durable(p.join(p.groupBy("tree_id", "layer").agg(F.min("z").alias("low")), ["tree_id", "layer"]).withColumn("h", (F.col("z") - F.col("low")) / float(layer)))
    key = ["tree_id", "layer"]
    cell = lambda v, n: F.greatest(F.lit(1), F.least(F.ceil(v * n), n))
    grown = F.least(1.05 * F.col("least"), F.col("least") + 20)
    coarse = p.groupBy(*key, cell(F.col("h"), F.lit(layer // fine)).alias("i"), cell(F.col("turn"), F.lit(sectors)).alias("j")).agg(F.min("d").alias("least")).groupBy(*key).agg(F.median(grown).alias("r0"))
    edge = F.greatest(F.lit(20.0), 0.2 * F.col("r0"))
    sizes = coarse.select(*key, "r0", F.least(F.lit(36), F.greatest(F.ceil(2 * F.pi() * F.col("r0") / edge), F.lit(8))).alias("ns"), F.greatest(F.ceil(layer / edge), F.lit(3)).alias("nl"))
    p = p.join(sizes, key).withColumn("i", cell(F.col("h"), F.col("nl"))).withColumn("j", cell(F.col("turn"), F.col("ns")))
    cells = durable(p.groupBy(*key, "i", "j").agg(F.min("d").alias("least"), F.first("r0").alias("r0"), (F.first("nl") * F.first("ns")).alias("all")))
    found = cells.groupBy(*key).agg(F.median(grown).alias("radius"), (F.count(F.lit(1)) / F.first("all")).alias("coverage"))
    p = p.select(*key, "pid", "d", "i", "j").join(cells, [*key, "i", "j"]).withColumn("keep", F.col("d") <= F.col("least") + F.greatest(F.lit(10.0), 0.05 * F.col("r0")))
    return p.select(*key, "pid", "d", "keep").join(found, key)


def bends(points: DataFrame, chunks: int = 5, degrees: float = 60.0, least: int = 10) -> DataFrame:
    """tree_id, part, n, bend: the first of equal chunks of a segment, in order of height, whose direction turns from the one before by more than the angle (null: none).

    The first direction is that between the mean places of the first two chunks; later ones go from a chunk's first point to its last. Chunks of fewer than `least` points end the search."""
    key = ["tree_id", "part"]
    order = Window.partitionBy(*key).orderBy("z", "pid")
    p = points.select(*key, "pid", *XYZ, (F.row_number().over(order) - 1).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("n"))
    p = p.withColumn("size", F.floor(F.col("n") / chunks)).where("size > 0").withColumn("chunk", F.floor(F.col("rn") / F.col("size"))).where(F.col("chunk") < chunks)
    at = F.struct(*XYZ)
    c = p.groupBy(*key, "n", "size", "chunk").agg(*[F.avg(x).alias(f"m{x}") for x in XYZ], F.min_by(at, "rn").alias("a"), F.max_by(at, "rn").alias("b"))
    by = Window.partitionBy(*key).orderBy("chunk")
    c = c.select(*key, "n", "size", "chunk", *[F.when(F.col("chunk") == 1, F.col(f"m{x}") - F.lag(f"m{x}").over(by)).otherwise(F.col(f"b.{x}") - F.col(f"a.{x}")).alias(f"v{x}") for x in XYZ])
    before = {x: F.lag(f"v{x}").over(by) for x in XYZ}
    dot = total([F.col(f"v{x}") * before[x] for x in XYZ])
    norm = F.sqrt(total([F.col(f"v{x}") * F.col(f"v{x}") for x in XYZ])) * F.sqrt(total([v * v for v in before.values()]))
    c = c.withColumn("cos", dot / F.nullif(norm, F.lit(0.0)))
    turned = (F.col("chunk") >= 2) & (F.col("size") >= least) & (F.col("cos") < F.cos(F.radians(F.lit(degrees))))
    return c.groupBy(*key, "n").agg(F.min(F.when(turned, F.col("chunk"))).alias("bend"))


def hashed_subset(points: DataFrame, n: int) -> DataFrame:
    """pid of n points, the first by a digest of their ids: the same on each run."""
    return points.select("pid", F.md5(F.col("pid").cast("string")).alias("h")).orderBy("h").limit(n).select("pid")


def hashed_share(points: DataFrame, one_in: int) -> DataFrame:
    """Points of which a digest of the id falls into one of so many classes."""
    return points.where(F.pmod(F.conv(F.substring(F.md5(F.col("pid").cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(one_in)) == 0)


def oriented_boxes(points: DataFrame, axes: DataFrame, *by: str) -> DataFrame:
    """by, long_mm, mid_mm, thin_mm: extents of each group along three axes of its own at right angles. axes: by, axis_x to axis_z (unit, longest), normal_x to normal_z (unit, thinnest)."""
    p = points.select(*by, *XYZ).join(axes, list(by))
    a, n = [F.col(f"axis_{c}") for c in XYZ], [F.col(f"normal_{c}") for c in XYZ]
    m = [a[1] * n[2] - a[2] * n[1], a[2] * n[0] - a[0] * n[2], a[0] * n[1] - a[1] * n[0]]
    along = {k: total([F.col(c) * u for c, u in zip(XYZ, v, strict=True)]) for k, v in (("long", a), ("mid", m), ("thin", n))}
    return p.groupBy(*by).agg(*[F.round(F.max(v) - F.min(v), 3).alias(f"{k}_mm") for k, v in along.items()])


def variable_cover(points: DataFrame, *, patch_min: float, patch_max: float, ball: float, min_points: int = 1, max_rounds: int = 1000) -> DataFrame:
    """pid, center (null: in no set): cover sets whose size follows the points' rel_size (0 to 255; 0 never seeds), small sizes first.

    With m = patch_min / patch_max a seed of relative size s has rs = s / 256 (1 - m) + m, bars other seeds within patch_max rs, and has a ball of that radius and sqrt(rs) (ball - patch_max) more. Seeds
    of fewer than min_points in their ball give no set. A point goes to the nearest set whose ball holds it, ties by the seed's order. Points: pid, x, y, z, rel_size.
    Seeds are chosen as if one after another, by size, then by a hash: in each round those that no open seed before them bars."""
    m = patch_min / patch_max
    rs = F.col("rel_size") / 256 * (1 - m) + m
    p = points.select("pid", *XYZ, "rel_size", (rs * patch_max).alias("far"), (rs * patch_max + F.sqrt(rs) * (ball - patch_max)).alias("reach"), F.struct("rel_size", F.xxhash64("pid").alias("h"), "pid").alias("rank"))
    seeds = durable(p.where("rel_size > 0"))
    widest = max(1, int(-(-max(ball, patch_max) // 1)))
    pairs = near_pairs(points.select("pid", *XYZ), seeds.select("pid", *XYZ, "far", "reach"), widest)
    pairs = durable(pairs.select("a_pid", "b_pid", "d2", (F.col("d2") < F.col("b_far") * F.col("b_far")).alias("bars"), (F.col("d2") < F.col("b_reach") * F.col("b_reach")).alias("holds")).where("bars or holds"))
    full = pairs.where("holds").groupBy("b_pid").count().where(F.col("count") >= min_points).select("b_pid")
    open_ = durable(seeds.join(full, F.col("pid") == F.col("b_pid"), "left_semi").select("pid", "rank"))
    centers = open_.limit(0)
    for _ in range(max_rounds):
        if not open_.limit(1).count():
            break
        o = open_.select(F.col("pid").alias("q"), F.col("rank").alias("r"))
        first = pairs.where("bars").join(o, F.col("b_pid") == F.col("q")).groupBy("a_pid").agg(F.min("r").alias("least"))
        new = durable(open_.join(first, F.col("pid") == F.col("a_pid")).where(F.col("least.pid") == F.col("pid")).select("pid", "rank"))
        centers = durable(centers.unionByName(new))
        barred = pairs.where("bars").join(new, F.col("b_pid") == F.col("pid")).groupBy(F.col("a_pid").alias("gone")).agg(F.min("rank").alias("by"))
        open_ = durable(open_.join(barred, (F.col("pid") == F.col("gone")) & (F.col("by") <= F.col("rank")), "left_anti"))  # a set bars those after it
    else:
        raise RuntimeError("seeds did not settle")
    c = centers.select(F.col("pid").alias("c"), "rank")
    near = pairs.where("holds").join(c, F.col("b_pid") == F.col("c")).groupBy("a_pid").agg(F.min(F.struct("d2", "rank")).alias("m"))
    return points.select("pid").join(near, F.col("pid") == F.col("a_pid"), "left").select("pid", F.col("m.rank.pid").alias("center"))


def relative_sizes(layers: DataFrame) -> DataFrame:
    """tree_id, segment, layer, base_size, rel_size of segments of cover sets. layers: tree_id, segment, parent (segment at whose foot it begins; null: the stem), order, layer (from 0), n_sets, low, high (mm).

    The base of a segment is the mean number of sets of its layers 1 to 5 (of layer 0 where there is one only), in 256ths of the stem's and no more than order and height allow; sizes fall from there to 1 with the root of the layer's share."""
    s = layers.groupBy("tree_id", "segment").agg(F.count(F.lit(1)).alias("s"), F.sum(F.when(F.col("layer").between(1, 5), F.col("n_sets"))).alias("sets"), F.sum(F.when(F.col("layer").between(1, 5), 1)).alias("k"), F.max(F.when(F.col("layer") == 0, F.col("n_sets"))).alias("first"), F.max(F.when(F.col("layer") == 0, F.col("low"))).alias("foot"), F.max("order").alias("order"))
    s = s.withColumn("base", F.coalesce(F.col("sets") / F.col("k"), F.col("first").cast("double")))
    t = layers.groupBy("tree_id").agg(F.min("low").alias("bottom"), F.max("high").alias("top"), (F.max("order") + 1).alias("orders"))
    stem = s.where("order = 0").groupBy("tree_id").agg(F.min_by("base", "segment").alias("stem_base"))
    s = s.join(t, "tree_id").join(stem, "tree_id")
    height = F.col("top") - F.col("bottom")
    most = F.ceil(256 * ((F.col("orders") - F.col("order")) / F.col("orders")) * ((height - (F.col("foot") - F.col("bottom"))) / height))
    size = F.when(F.col("order") == 0, F.lit(256.0)).otherwise(F.least(F.when(F.col("k").isNotNull(), F.ceil(F.col("base") / F.col("stem_base") * 256).cast("double")).otherwise(F.col("base") / F.col("stem_base") * 256), most.cast("double")))
    s = s.select("tree_id", "segment", "s", size.alias("base_size"))
    j = layers.select("tree_id", "segment", "layer").join(s, ["tree_id", "segment"])
    ramp = F.floor(F.col("base_size") - (F.col("base_size") - 1) * F.sqrt(F.col("layer") / F.col("s")) + 0.5)
    return j.select("tree_id", "segment", "layer", "base_size", F.least(F.lit(255), F.greatest(F.lit(0), ramp)).cast("long").alias("rel_size"))


# ---- cylinders


def line_distances(cyl: DataFrame, place: tuple[float, float, float], way: tuple[float, float, float]) -> DataFrame:
    """tree_id, pos, dist, on_ray, on_line (mm): distance of the line of each cylinder's axis from the line through a place, and where on either; a parallel line is met at the place itself."""
    size = sum(w * w for w in way) ** 0.5
    d1 = [F.lit(w / size) for w in way]
    c = cyl.select("tree_id", "pos", *[F.col(f"{x}0").cast("double").alias(f"p{x}") for x in XYZ], *[u.alias(f"u{x}") for x, u in zip(XYZ, axis(), strict=True)])
    u, w0 = [F.col(f"u{x}") for x in XYZ], [F.lit(float(a)) - F.col(f"p{x}") for a, x in zip(place, XYZ, strict=True)]
    dot = lambda a, b: total([x * y for x, y in zip(a, b, strict=True)])
    c = c.select("*", dot(d1, u).alias("b"), dot(d1, w0).alias("d"), dot(u, w0).alias("e"))
    den = F.nullif(1 - F.col("b") * F.col("b"), F.lit(0.0))
    c = c.withColumn("s", F.coalesce((F.col("b") * F.col("e") - F.col("d")) / den, F.lit(0.0))).withColumn("t", F.coalesce((F.col("e") - F.col("b") * F.col("d")) / den, F.col("e")))
    gap = [w + F.col("s") * a - F.col("t") * b for w, a, b in zip(w0, d1, u, strict=True)]
    return c.select("tree_id", "pos", F.round(F.sqrt(dot(gap, gap)), 3).alias("dist"), F.round("s", 3).alias("on_ray"), F.round("t", 3).alias("on_line"))


def parent_angles(cyl: DataFrame) -> DataFrame:
    """tree_id, pos, angle: between the axes of a cylinder and of its parent, as lines: 0 to 90 degrees."""
    up = cyl.select(F.col("tree_id").alias("t"), F.col("pos").alias("p"), *[v.alias(f"q{c}") for c, v in zip(XYZ, axis(), strict=True)])
    j = cyl.join(up, (F.col("tree_id") == F.col("t")) & (F.col("parent") == F.col("p")))
    dot = F.abs(total([v * F.col(f"q{c}") for c, v in zip(XYZ, axis(), strict=True)]))
    return j.select("tree_id", "pos", F.round(F.degrees(F.acos(F.least(F.lit(1.0), dot))), 3).alias("angle"))


def rounded(value: Column) -> Column:
    """Fewer decimals the larger a number is: none from 1000 on, one more for each power of ten below, five under 0.1."""
    of, out = F.abs(value), F.round(value, 5)
    for least, digits in ((0.1, 4), (1.0, 3), (10.0, 2), (100.0, 1), (1000.0, 0)):
        out = F.when(of >= least, F.round(value, digits)).otherwise(out)
    return out


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, n of whole numbers in equal classes from the least to the greatest; empty classes too. A value only: all in the first class."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))  # one row
    at = F.least(F.floor((F.col(column) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))), F.lit(bins - 1))
    n = values.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    return values.sparkSession.range(bins).join(n, F.col("id") == F.col("b"), "left").select(F.col("id").alias("bin"), F.coalesce("k", F.lit(0)).alias("n"))


def smoothed_by_coverage(cyl: DataFrame, high: int = 70) -> DataFrame:
    """tree_id, pos, radius_mm: a cylinder of low surface coverage between two of high coverage has the mean of their radii."""
    w = Window.partitionBy("tree_id", "branch").orderBy("pos")
    side = lambda c: (F.lag(c).over(w), F.lead(c).over(w))
    (sa, sb), (ra, rb) = side("surf_pct"), side("r_mm")
    return cyl.select("tree_id", "pos", F.when((F.col("surf_pct") < high) & (sa >= high) & (sb >= high), (ra + rb) / 2).otherwise(F.col("r_mm").cast("double")).alias("radius_mm"))


def stem_polyline(cyl: DataFrame, stride: int = 3) -> DataFrame:
    """tree_id, nodes, length_mm, ratio: the way over every so manieth start of the trunk and its last, and that way to the distance of its ends."""
    w = Window.partitionBy("tree_id").orderBy("pos")
    t = cyl.where(trunk()).select("tree_id", "pos", "x0", "y0", "z0", F.lead("pos").over(w).isNull().alias("last"))
    t = t.where((F.col("pos") % stride == 0) | F.col("last"))
    step = F.sqrt(total([(F.lead(c).over(w) - F.col(c)) * (F.lead(c).over(w) - F.col(c)) for c in ("x0", "y0", "z0")]).cast("double"))
    at = F.struct("x0", "y0", "z0")
    g = t.withColumn("step", step).groupBy("tree_id").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("way"), F.min_by(at, "pos").alias("a"), F.max_by(at, "pos").alias("b"))
    far = F.sqrt(total([(F.col(f"b.{c}") - F.col(f"a.{c}")) * (F.col(f"b.{c}") - F.col(f"a.{c}")) for c in ("x0", "y0", "z0")]).cast("double"))
    return g.select("tree_id", "nodes", F.round("way", 4).alias("length_mm"), F.round(F.col("way") / F.nullif(far, F.lit(0.0)), 6).alias("ratio"))


def path_lengths(cyl: DataFrame) -> DataFrame:
    """tree_id, pos, dist: the summed lengths (mm) of the cylinders from a tree's foot to a cylinder's start."""
    up = cyl.select(F.col("tree_id").alias("t"), F.col("pos").alias("p"), F.col("l_mm").alias("before"))
    first = cyl.select("tree_id", "pos", "parent").join(up, (F.col("tree_id") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
    return summed_to_root(first.select("tree_id", "pos", F.col("p").alias("up"), F.coalesce("before", F.lit(0)).alias("dist")), "pos", "dist")


INTERVALS = (100, 200, 300, 500, 1000)


def path_buckets(cyl: DataFrame, intervals: tuple[int, ...] = INTERVALS) -> DataFrame:
    """tree_id, pos, interval, bucket: path lengths in classes of several widths."""
    return path_lengths(cyl).select("tree_id", "pos", F.explode(F.array(*[F.lit(i) for i in intervals])).alias("interval"), "dist").select("tree_id", "pos", "interval", F.floor(F.col("dist") / F.col("interval")).alias("bucket"))


def merged_boxes(overlaps: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """key, merged: boxes that overlap, and so on from box to box, are one: the least key. overlaps: a, b."""
    found = graph.components(boxes.select(F.col(key).alias("node")), overlaps.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("node").alias(key), F.col("root").alias("merged"))


def component_classes(parts: DataFrame, *by: str, main: bool = True) -> DataFrame:
    """by, part, kind (continuation or branch) of the parts of study regions. parts: by, part, size (cover sets), base (those at its foot), cut (those of the region's cut), goes_on.

    Parts that don't go on and are small are no branches; one that has most of the cut or of the region continues the segment; else, with main, the largest branch (ties: the least part) does."""
    study = F.sum("size").over(Window.partitionBy(*by))
    stays = ~F.col("goes_on")
    small = stays & ((F.col("base") == F.col("size")) | ((F.col("base") == 1) & (F.col("size") <= 2)) | ((F.col("base") < 0.05 * F.col("cut")) & (2 * F.col("base") >= F.col("size"))) | (F.col("size") <= 3))
    p = parts.withColumn("study", study).withColumn("small", small)
    p = p.withColumn("most", ~F.col("small") & ((F.col("base") >= 0.7 * F.col("cut")) | (F.col("size") >= 0.7 * F.col("study"))))
    branch = ~F.col("small") & ~F.col("most")
    top = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(branch, F.col("size")).desc_nulls_last(), "part"))
    p = p.withColumn("any_most", F.max("most").over(Window.partitionBy(*by))).withColumn("top", top)
    heir = branch & ~F.col("any_most") & (F.col("top") == 1) & F.lit(main)
    return p.select(*by, "part", F.when(branch & ~heir, "branch").otherwise("continuation").alias("kind"))


def parabola_taper(cyl: DataFrame, least_mm: float = 2.5, more_than: int = 4) -> DataFrame:
    """tree_id, branch, pos, radius_mm: radii of branches of more than four cylinders held within a parabola over the way from the branch's foot.

    The parabola a s^2 + c is fitted to the radii, 5 % larger and weighted by surface coverage, and to the least radius at the tip; it falls at least. Radii above it shrink towards it, by their
    coverage if that is low, or if they are a third larger; radii under three quarters of it (half of that, where coverage is high) are lifted."""
    w = Window.partitionBy("tree_id", "branch").orderBy("pos")
    key = ["tree_id", "branch"]
    c = cyl.select(*key, "pos", F.col("r_mm").cast("double").alias("r"), (F.col("surf_pct") / 100).alias("sc"), ((2 * F.coalesce(F.sum("l_mm").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("l_mm")) / 2000).alias("s"), (F.col("l_mm") / MM).alias("l"))
    q = F.col("s") * F.col("s")
    g = c.groupBy(*key).agg(F.count(F.lit(1)).alias("nc"), F.sum("l").alias("len"), F.max("r").alias("top"), F.sum(F.col("sc") * q * q).alias("a4"), F.sum(F.col("sc") * q).alias("a2"), F.sum("sc").alias("a0"), F.sum(F.col("sc") * 1.05 * F.col("r") * q).alias("y2"), F.sum(F.col("sc") * 1.05 * F.col("r")).alias("y0"))
    end = F.col("len") * F.col("len")
    g = g.select(*key, "nc", "top", (F.col("a4") + end * end).alias("a4"), (F.col("a2") + end).alias("a2"), (F.col("a0") + 1).alias("a0"), (F.col("y2") + least_mm * end).alias("y2"), (F.col("y0") + least_mm).alias("y0"))
    det = F.nullif(F.col("a4") * F.col("a0") - F.col("a2") * F.col("a2"), F.lit(0.0))
    g = g.select(*key, "nc", "top", F.least((F.col("y2") * F.col("a0") - F.col("a2") * F.col("y0")) / det, F.lit(-0.1)).alias("x0"), ((F.col("a4") * F.col("y0") - F.col("a2") * F.col("y2")) / det).alias("x1"))
    j = c.join(g, key).withColumn("up", F.greatest(F.col("x0") * q + F.col("x1"), F.lit(least_mm)))
    highest = F.max("up").over(Window.partitionBy(*key))
    j = j.withColumn("up", F.when(highest > F.col("top"), F.col("top") / highest * F.col("up")).otherwise(F.col("up"))).withColumn("low", F.greatest(0.75 * F.col("up"), F.lit(least_mm)))
    j = j.withColumn("own", F.col("r"))
    r = F.when((F.col("r") > F.col("up")) & (F.col("sc") < 0.7), F.col("up") + (F.col("r") - F.col("up")) * F.col("sc") / 0.7).otherwise(F.col("r"))
    j = j.withColumn("r", r).withColumn("r", F.when((F.col("r") > 1.333 * F.col("up")) & (F.col("sc") >= 0.7), F.col("up") + (F.col("r") - F.col("up")) * F.col("sc")).otherwise(F.col("r")))
    lifted = F.when(((F.col("r") < F.col("low")) & (F.col("sc") < 0.7)) | (F.col("r") < 0.5 * F.col("low")), F.col("low")).otherwise(F.col("r"))
    taken = j.where(F.col("nc") > more_than).select(*key, "pos", F.round(lifted, 4).alias("radius_mm"))
    return taken.unionByName(j.where(F.col("nc") <= more_than).select(*key, "pos", F.round("own", 4).alias("radius_mm")))


def growth_volumes(cyl: DataFrame, max_rounds: int = 64) -> DataFrame:
    """tree_id, pos, volume: litres of a cylinder and of all that grows from it. In round k each adds to its 2^k-th ancestor what it has of that depth."""
    v = F.col("r_mm") * F.col("r_mm") * F.col("l_mm")
    have = cyl.select(F.col("tree_id").alias("ht"), F.col("pos").alias("hp"))
    links = cyl.select("tree_id", "pos", "parent", v.alias("sum")).join(have, (F.col("tree_id") == F.col("ht")) & (F.col("parent") == F.col("hp")), "left")
    hop = durable(links.select("tree_id", "pos", F.col("hp").alias("up"), "sum"))
    for _ in range(max_rounds):
        if not hop.where("up is not null").limit(1).count():
            return hop.select("tree_id", "pos", (F.pi() * F.col("sum") / 1e6).alias("volume"))
        gift = hop.where("up is not null").groupBy(F.col("tree_id").alias("gt"), F.col("up").alias("gp")).agg(F.sum("sum").alias("gift"))
        nxt = hop.select(F.col("tree_id").alias("t"), F.col("pos").alias("p"), F.col("up").alias("up2"))
        hop = hop.join(gift, (F.col("tree_id") == F.col("gt")) & (F.col("pos") == F.col("gp")), "left").join(nxt, (F.col("tree_id") == F.col("t")) & (F.col("up") == F.col("p")), "left")
        hop = durable(hop.select("tree_id", "pos", F.col("up2").alias("up"), (F.col("sum") + F.coalesce("gift", F.lit(0))).alias("sum")))
    raise RuntimeError("parents go round in a circle")


def parent_candidates(cyl: DataFrame, k: int = 4) -> DataFrame:
    """tree_id, branch, rank, pos, d2: the k cylinders of the parent branch whose starts are nearest to a branch's first start, ties by pos."""
    first = cyl.groupBy("tree_id", "branch").agg(F.min_by(F.struct("x0", "y0", "z0", "parent"), "pos").alias("f"))
    of = cyl.select(F.col("tree_id").alias("t"), F.col("pos").alias("p"), F.col("branch").alias("up"))
    first = first.join(of, (F.col("tree_id") == F.col("t")) & (F.col("f.parent") == F.col("p"))).select(F.col("tree_id").alias("ft"), F.col("branch").alias("fb"), "f", "up")
    met = first.join(cyl.select("tree_id", "branch", "pos", "x0", "y0", "z0"), (F.col("ft") == F.col("tree_id")) & (F.col("up") == F.col("branch")))
    d2 = total([(F.col(c) - F.col(f"f.{c}")) * (F.col(c) - F.col(f"f.{c}")) for c in ("x0", "y0", "z0")])
    w = Window.partitionBy("ft", "fb").orderBy("d2", "pos")
    return met.withColumn("d2", d2).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("ft").alias("tree_id"), F.col("fb").alias("branch"), "rank", "pos", "d2")


def height_classes(cyl: DataFrame, width: int = 1000) -> DataFrame:
    """tree_id, bin, volume, area, length by class of height above the lowest start, up to the tree's height; a cylinder counts in the two classes that it spans at most, by its share in each."""
    up = F.col("l_mm") * F.cos(F.radians(F.col("zenith")))
    low = cyl.groupBy("tree_id").agg(F.min("z0").alias("bottom"), F.max(F.greatest(F.col("z0"), F.col("z0") + up)).alias("top"))
    low = low.withColumn("bins", F.ceil((F.col("top") - F.col("bottom")) / width))
    c = cyl.join(low, "tree_id").withColumn("b", (F.col("z0") - F.col("bottom")) / width).withColumn("t", (F.col("z0") + up - F.col("bottom")) / width)
    c = c.where(F.abs(F.floor("t") - F.floor("b")) <= 1).withColumn("bin", F.explode(F.array_distinct(F.array(F.floor("b"), F.floor("t")))))
    inside = F.least(F.greatest("b", "t"), F.col("bin") + 1) - F.greatest(F.least("b", "t"), F.col("bin"))
    share = F.when(F.floor("b") == F.floor("t"), F.lit(1.0)).otherwise(inside / F.abs(F.col("t") - F.col("b")))
    c = c.where((F.col("bin") >= 0) & (F.col("bin") < F.col("bins"))).withColumn("share", share)
    sums = {"volume": F.pi() * F.sum(F.col("r_mm") * F.col("r_mm") * F.col("l_mm") * F.col("share")) / 1e6, "area": 2 * F.pi() * F.sum(F.col("r_mm") * F.col("l_mm") * F.col("share")) / 1e6, "length": F.sum(F.col("l_mm") * F.col("share")) / MM}
    g = c.groupBy("tree_id", "bin").agg(*[F.round(v, 4).alias(k) for k, v in sums.items()])
    all_ = low.where("bins > 0").select("tree_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return all_.join(g, ["tree_id", "bin"], "left").select("tree_id", "bin", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in sums])


def _descending(branches: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """tree_id, branch of roots and of all that descend from them. branches: tree_id, branch, parent_branch."""
    links = durable(branches.select(F.col("tree_id").alias("lt"), F.col("branch").alias("lb"), F.col("parent_branch").alias("lp")))
    front = durable(roots.select("tree_id", "branch"))
    out = front
    for _ in range(max_rounds):
        front = durable(links.join(front, (F.col("lt") == F.col("tree_id")) & (F.col("lp") == F.col("branch"))).select(F.col("lt").alias("tree_id"), F.col("lb").alias("branch")))
        if not front.limit(1).count():
            return out
        out = out.unionByName(front)
    raise RuntimeError("branches go round in a circle")


def crown_base(cyl: DataFrame, branches: DataFrame) -> DataFrame:
    """tree_id, base_mm: the lowest place, above the trunk's foot, of the first major branch by height and of all that descend from it; trees without one have no row.

    Major is a first-order branch thicker than 50 mm or a twentieth of the diameter at breast height, the less of them, that reaches, in breast-height radii, beyond 10 or the median of the branches, the less of them."""
    dbh = breast_height_diameter(cyl)
    ends = cyl.where("branch_order = 1").groupBy("tree_id", "branch").agg(F.min_by(F.struct("x0", "y0", "z0", "r_mm"), "pos").alias("a"), F.max_by("pos", "pos").alias("last"))
    tip = tips(cyl).select(F.col("tree_id").alias("tt"), F.col("pos").alias("tp"), "x1", "y1", "z1")
    e = ends.join(tip, (F.col("tree_id") == F.col("tt")) & (F.col("last") == F.col("tp"))).join(dbh, "tree_id")
    reach = F.round(F.sqrt((F.col("x1") - F.col("a.x0")) * (F.col("x1") - F.col("a.x0")) + (F.col("y1") - F.col("a.y0")) * (F.col("y1") - F.col("a.y0"))) / F.col("dbh_mm") * 2, 9)
    e = durable(e.select("tree_id", "branch", F.col("a.z0").alias("z"), (2 * F.col("a.r_mm")).alias("dia"), "dbh_mm", reach.alias("reach")))
    most = e.groupBy("tree_id").agg(F.least(F.lit(10.0), F.median("reach")).alias("m"))
    big = e.join(most, "tree_id").where((F.col("dia") > F.least(F.lit(50.0), 0.05 * F.col("dbh_mm"))) & (F.col("reach") > F.col("m")))
    first = big.groupBy("tree_id").agg(F.min(F.struct("z", "branch")).alias("f")).select("tree_id", F.col("f.branch").alias("branch"))
    crown = _descending(branches, first).select(F.col("tree_id").alias("ct"), F.col("branch").alias("cb")).distinct()
    up = F.col("l_mm") * F.cos(F.radians(F.col("zenith")))
    foot = cyl.groupBy("tree_id").agg(F.min_by("z0", "pos").alias("foot"))
    low = cyl.join(crown, (F.col("tree_id") == F.col("ct")) & (F.col("branch") == F.col("cb"))).groupBy("tree_id").agg(F.min(F.least(F.col("z0"), F.col("z0") + up)).alias("low"))
    return low.join(foot, "tree_id").select("tree_id", F.round(F.col("low") - F.col("foot"), 4).alias("base_mm"))


def cylinder_table(cyl: DataFrame) -> DataFrame:
    """The seventeen columns of a model's cylinder file, metres with four decimals."""
    m = lambda c: F.round(c / MM, 4)
    w = Window.partitionBy("tree_id", "branch").orderBy("pos")
    return cyl.select(
        "tree_id", "pos", m(F.col("r_mm")).alias("radius"), m(F.col("l_mm")).alias("length"), *[m(F.col(f"{c}0")).alias(f"start_{c}") for c in XYZ], *[(F.round(v, 4) + F.lit(0.0)).alias(f"axis_{c}") for c, v in zip(XYZ, axis(), strict=True)],
        "parent", "extension", "branch", "branch_order", F.row_number().over(w).cast("long").alias("position_in_branch"), m(F.col("mad_mm")).alias("mad"), (F.col("surf_pct") / 100).alias("surf_cov"), "added",
    )


def distance_table(metrics: DataFrame) -> DataFrame:
    """The ten columns of a fit's distance file for each model."""
    return metrics.select("tree_id", "model_id", *[F.col(f"{p}_{k}_dis").alias(f"{p}_{k}") for k in ("mean", "max") for p in ("all", "trunk", "branch", "branch1", "branch2")])


def retained(models: DataFrame, chosen: DataFrame) -> DataFrame:
    """The cylinders of the chosen model of each tree: what is kept where the others' files go."""
    c = chosen.select(F.col("tree_id").alias("t"), F.col("model_id").alias("m"))
    return models.join(c, (F.col("tree_id") == F.col("t")) & (F.col("model_id") == F.col("m")), "left_semi")
