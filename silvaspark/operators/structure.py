"""Roll-ups of cylinder models: volumes, heights, branches, distributions. Sums are of whole millimetres, so results don't depend on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable

LITRE, AREA, METRE = 1e6, 1e6, 1000.0


def trunk() -> Column:
    return F.col("branch") == 0


def volume() -> Column:
    return F.col("r_mm") * F.col("r_mm") * F.col("l_mm")


def _in(where: Column | None, value: Column) -> Column:
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0))


def litres(where: Column | None = None) -> Column:
    return F.pi() * _in(where, volume()) / LITRE


def square_metres(where: Column | None = None) -> Column:
    return 2 * F.pi() * _in(where, F.col("r_mm") * F.col("l_mm")) / AREA


def metres(where: Column | None = None) -> Column:
    return _in(where, F.col("l_mm")) / METRE


def axis() -> tuple[Column, Column, Column]:
    zen, azi = F.radians(F.col("zenith")), F.radians(F.col("azimuth"))
    return F.sin(zen) * F.cos(azi), F.sin(zen) * F.sin(azi), F.cos(zen)


def tips(cyl: DataFrame) -> DataFrame:
    """End places of cylinders, in mm."""
    return cyl.select("tree_id", "pos", *[(F.col(f"{c}0") + F.col("l_mm") * u).alias(f"{c}1") for c, u in zip("xyz", axis(), strict=True)])


def tree_rollup(cyl: DataFrame) -> DataFrame:
    """Volumes (L), areas, lengths, height, numbers of branches and the highest order of each tree, in one aggregation."""
    top = F.max_by(F.struct("z0", "l_mm", "zenith"), F.struct("z0", "pos"))
    t = cyl.groupBy("tree_id").agg(
        *[f(w).alias(f"{part}_{n}") for n, f in (("volume", litres), ("area", square_metres), ("length", metres)) for part, w in (("total", None), ("trunk", trunk()), ("branch", ~trunk()))],
        top.alias("top"), F.min("z0").alias("low"), (F.count_distinct("branch") - 1).alias("n_branches"), F.max("branch_order").alias("max_order"),
    )
    up = F.col("top.l_mm") * F.cos(F.radians(F.col("top.zenith")))
    height = (F.col("top.z0") + F.greatest(up, F.lit(0.0)) - F.col("low")) / METRE
    return t.withColumn("height", F.round(height, 6)).drop("top", "low")


def breast_height_diameter(cyl: DataFrame, at_mm: int = 1300) -> DataFrame:
    """Diameter (mm) of the first trunk cylinder whose summed length gets to breast height; of the last one if none does."""
    upto = Window.partitionBy("tree_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = cyl.where(trunk()).withColumn("sum", F.sum("l_mm").over(upto))
    found = t.groupBy("tree_id").agg(F.min(F.when(F.col("sum") >= at_mm, F.struct("pos", "r_mm"))).alias("hit"), F.max(F.struct("pos", "r_mm")).alias("last"))
    return found.select("tree_id", (2 * F.coalesce("hit.r_mm", "last.r_mm")).alias("dbh_mm"))


def stem_taper(cyl: DataFrame) -> DataFrame:
    """Distance along the trunk and diameter: a row at each cylinder's start, and one at the end."""
    before = Window.partitionBy("tree_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = cyl.where(trunk()).withColumn("along", F.coalesce(F.sum("l_mm").over(before), F.lit(0))).withColumn("last", F.lead("pos").over(Window.partitionBy("tree_id").orderBy("pos")).isNull())
    ends = F.when(F.col("last"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.select("tree_id", "pos", F.explode(ends).alias("end"), "along", "l_mm", "r_mm").select("tree_id", "pos", "end", (F.col("along") + F.col("end") * F.col("l_mm")).alias("along_mm"), (2 * F.col("r_mm")).alias("diameter_mm"))


def positions(cyl: DataFrame) -> DataFrame:
    w = Window.partitionBy("tree_id", "branch").orderBy("pos")
    mid = F.coalesce(F.sum("l_mm").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("l_mm") / 2
    return cyl.select("tree_id", "pos", "branch", (F.row_number().over(w) - 1).cast("long").alias("position"), mid.alias("mid_mm"))


def summed_to_root(links: DataFrame, node: str, value: str, max_rounds: int = 64) -> DataFrame:
    """tree_id, node, value: what links (tree_id, node, up, value) add up to on the way to the root, null ends. Pointer jumping, each round written: rounds grow with the logarithm of the depth."""
    hop = durable(links.select("tree_id", node, "up", value))
    for _ in range(max_rounds):
        if not hop.where("up is not null").limit(1).count():
            return hop.select("tree_id", node, value)
        nxt = hop.select(F.col("tree_id").alias("t"), F.col(node).alias("n"), F.col("up").alias("up2"), F.col(value).alias("more"))
        hop = hop.join(nxt, (F.col("tree_id") == F.col("t")) & (F.col("up") == F.col("n")), "left")
        hop = durable(hop.select("tree_id", node, F.col("up2").alias("up"), (F.col(value) + F.coalesce("more", F.lit(0))).alias(value)))
    raise RuntimeError("parents go round in a circle")


def branch_orders(cyl: DataFrame) -> DataFrame:
    """Order of each branch by its parents: the parent branch's and one more."""
    of = cyl.select(F.col("tree_id").alias("t"), F.col("pos").alias("p"), F.col("branch").alias("up"))
    first = cyl.where("pib = 0").join(of, (F.col("tree_id") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
    return summed_to_root(first.select("tree_id", "branch", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("order")), "branch", "order")


def branch_rollup(cyl: DataFrame) -> DataFrame:
    """Of each branch: order, parent branch, diameter, volume, area, length, height, azimuth, zenith, and the angle to the parent cylinder."""
    ux, uy, uz = axis()
    b = cyl.groupBy("tree_id", "branch").agg(
        F.min_by(F.struct("branch_order", "parent", "r_mm", "z0", "azimuth", "zenith", "added", ux.alias("ux"), uy.alias("uy"), uz.alias("uz")), "pos").alias("f"),
        F.min(F.when(F.col("pib") == 1, F.struct("pos", ux.alias("ux"), uy.alias("uy"), uz.alias("uz")))).alias("s"),
        litres().alias("volume"), square_metres().alias("area"), metres().alias("length"),
    )
    up = cyl.select(F.col("tree_id").alias("t"), F.col("pos").alias("p"), F.col("branch").alias("parent_branch"), ux.alias("px"), uy.alias("py"), uz.alias("pz"))
    b = b.join(up, (F.col("tree_id") == F.col("t")) & (F.col("f.parent") == F.col("p")), "left")
    own = lambda c: F.when(F.col("f.added") & F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"f.{c}"))
    dot = own("ux") * F.col("px") + own("uy") * F.col("py") + own("uz") * F.col("pz")
    angle = F.round(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))), 4)
    return b.select("tree_id", "branch", F.col("f.branch_order").alias("branch_order"), F.coalesce("parent_branch", F.lit(-1)).cast("long").alias("parent_branch"), (2 * F.col("f.r_mm")).alias("diameter_mm"), "volume", "area", "length", F.col("f.z0").alias("height_mm"), F.col("f.azimuth").alias("azimuth"), F.col("f.zenith").alias("zenith"), F.coalesce(angle, F.lit(0.0)).alias("angle"))


def cylinder_distribution(cyl: DataFrame, value: Column, width: int) -> DataFrame:
    """Volume, area and length of cylinders by half-open classes of a value; empty classes up to the highest are zero."""
    by = cyl.groupBy("tree_id", F.floor(value / width).alias("bin")).agg(litres().alias("volume"), square_metres().alias("area"), metres().alias("length"))
    return _filled(by, ["volume", "area", "length"])


def _filled(by: DataFrame, columns: list[str]) -> DataFrame:
    bins = by.groupBy("tree_id").agg(F.max("bin").alias("top")).select("tree_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("bin"))
    return bins.join(by, ["tree_id", "bin"], "left").select("tree_id", "bin", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def height_distribution(cyl: DataFrame, width: int = 1000) -> DataFrame:
    """Length (mm of height) and share of volume by metre of height; a cylinder is split over all classes that it spans."""
    up = F.col("l_mm") * F.cos(F.radians(F.col("zenith")))
    c = cyl.withColumn("low", F.col("z0").cast("double")).withColumn("high", F.col("z0") + F.greatest(up, F.lit(1e-9)))
    c = c.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    share = (F.least("high", (F.col("bin") + 1) * width) - F.greatest("low", F.col("bin") * width)) / (F.col("high") - F.col("low"))
    return c.groupBy("tree_id", "bin").agg(F.round(F.sum(F.pi() * volume() * share) / LITRE, 4).alias("volume"), F.round(F.sum(F.col("l_mm") * share) / METRE, 4).alias("length"))


def branch_distribution(branches: DataFrame, value: str, width: float) -> DataFrame:
    """Volume, area, length and number of branches by class, of all and of first order."""
    one = F.col("branch_order") == 1
    sums = [F.round(F.coalesce(F.sum(v if w is None else F.when(w, v)), F.lit(0.0)), 6).alias(f"{p}_{n}") for p, w in (("all", None), ("first", one)) for n, v in (("volume", F.col("volume")), ("area", F.col("area")), ("length", F.col("length")), ("number", F.lit(1.0)))]
    by = branches.groupBy("tree_id", F.floor(F.col(value) / width).alias("bin")).agg(*sums)
    return _filled(by, [c for c in by.columns if c not in ("tree_id", "bin")])


def order_distribution(branches: DataFrame) -> DataFrame:
    return branches.groupBy("tree_id", "branch_order").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("volume", "area", "length")], F.count(F.lit(1)).alias("number"))


def relative(dist: DataFrame, column: str) -> DataFrame:
    """Share of the tree's total in per cent, and its running sum over classes."""
    w = Window.partitionBy("tree_id")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(column).over(w)
    return dist.select("tree_id", "bin", F.round(100 * F.col(column) / total, 4).alias("percent"), F.round(100 * F.sum(column).over(upto) / total, 4).alias("running"))


def cube_volume(cyl: DataFrame, edge: int) -> DataFrame:
    """Litres of cylinders by the cube where they start."""
    cube = [F.floor(F.col(f"{c}0") / edge).alias(f"v{c}") for c in "xyz"]
    return cyl.groupBy("tree_id", *cube).agg(litres().alias("volume"))


def near_place(cyl: DataFrame, place: tuple[float, float, float], radius: float) -> DataFrame:
    """Number and litres of the cylinders that start or end within the radius of a place, of each tree."""
    d2 = lambda e: sum(((e[c] - p) * (e[c] - p) for c, p in zip("xyz", place, strict=True)), F.lit(0.0))
    start, end = {c: F.col(f"{c}0") for c in "xyz"}, {c: F.col(f"{c}0") + F.col("l_mm") * u for c, u in zip("xyz", axis(), strict=True)}
    return cyl.where(F.least(d2(start), d2(end)) < radius * radius).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), litres().alias("volume"))


def taper_fit(cyl: DataFrame) -> DataFrame:
    """Weighted least-squares line of radius over distance along each branch: five sums and Cramer's rule."""
    w = Window.partitionBy("tree_id", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    c = cyl.withColumn("s", 2 * F.coalesce(F.sum("l_mm").over(w), F.lit(0)) + F.col("l_mm")).withColumn("w", F.col("surf_pct") + 1)  # s: twice the distance
    s0, s1, s2, t0, t1 = (F.sum(x) for x in (F.col("w"), F.col("w") * F.col("s"), F.col("w") * F.col("s") * F.col("s"), F.col("w") * F.col("r_mm"), F.col("w") * F.col("s") * F.col("r_mm")))
    g = c.groupBy("tree_id", "branch").agg(*[x.cast("double").alias(n) for x, n in zip((s0, s1, s2, t0, t1), ("s0", "s1", "s2", "t0", "t1"), strict=True)])
    det = F.nullif(F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"), F.lit(0.0))
    slope = (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / det
    return g.select("tree_id", "branch", F.round(2 * slope, 6).alias("slope"), F.round((F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det, 4).alias("start_mm"))


def clamp_radii(cyl: DataFrame, share: float = 0.95) -> DataFrame:
    """No cylinder thicker than 0.95 of its parent where it begins a branch, and no less than 2.5 mm."""
    up = cyl.select(F.col("tree_id").alias("t"), F.col("pos").alias("p"), F.col("r_mm").alias("parent_r"))
    j = cyl.join(up, (F.col("tree_id") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
    top = F.when((F.col("pib") == 0) & F.col("parent_r").isNotNull(), F.least(F.col("r_mm").cast("double"), share * F.col("parent_r"))).otherwise(F.col("r_mm").cast("double"))
    return j.select("tree_id", "pos", F.greatest(top, F.lit(2.5)).alias("radius_mm"))


def linear_taper(cyl: DataFrame) -> DataFrame:
    """Radii of a branch on a straight line from its first to its last."""
    ends = cyl.groupBy("tree_id", "branch").agg(F.min_by("r_mm", "pos").alias("a"), F.max_by("r_mm", "pos").alias("b"), F.count(F.lit(1)).alias("n"))
    return cyl.join(ends, ["tree_id", "branch"]).select("tree_id", "pos", F.when(F.col("n") == 1, F.col("a").cast("double")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("pib") / (F.col("n") - 1)).alias("radius_mm"))


def fit_summary(cyl: DataFrame) -> DataFrame:
    """Distance statistics of each tree over all cylinders, trunk, branches and the first two orders."""
    parts = {"all": None, "trunk": trunk(), "branch": ~trunk(), "order1": F.col("branch_order") == 1, "order2": F.col("branch_order") == 2}
    of = lambda f, w: F.coalesce(f(F.col("dist_mm") if w is None else F.when(w, F.col("dist_mm"))).cast("double"), F.lit(0.0))
    aggs = [of(f, w).alias(f"{p}_{n}") for p, w in parts.items() for n, f in (("mean", F.avg), ("max", F.max), ("median", F.median))]
    return cyl.groupBy("tree_id").agg(*aggs)


def trimmed_mean(cyl: DataFrame, share: float = 0.95, least: int = 20) -> DataFrame:
    """Mean distance of each branch order of a tree, without the largest 5 % where there are 20 or more."""
    w = Window.partitionBy("tree_id", "branch_order")
    r = cyl.withColumn("rn", F.row_number().over(w.orderBy("dist_mm", "pos"))).withColumn("m", F.count(F.lit(1)).over(w))
    return r.where((F.col("m") < least) | (F.col("rn") <= F.floor(share * F.col("m")))).groupBy("tree_id", "branch_order").agg(F.avg("dist_mm").alias("mean_mm"))


def surface_coverage(points: DataFrame, *, layer: int = 500, sectors: int = 36) -> DataFrame:
    """Share of the cells (layer by sector around the trunk's mean axis) of each trunk that hold a point."""
    stems = points.where("part = 0")
    mid = stems.groupBy("tree_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("z").alias("low"), F.max("z").alias("high"))
    p = stems.join(mid, "tree_id")
    angle = F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx"))
    sector = F.least(F.floor((angle + F.pi()) * sectors / (2 * F.pi())), F.lit(sectors - 1))
    cells = p.select("tree_id", F.floor((F.col("z") - F.col("low")) / layer).alias("layer"), sector.alias("sector"), (F.floor((F.col("high") - F.col("low")) / layer) + 1).alias("layers")).distinct()
    return cells.groupBy("tree_id").agg((F.count(F.lit(1)) / (F.max("layers") * sectors)).alias("coverage"))


def circle_fit(points: DataFrame, layer: int = 1000) -> DataFrame:
    """Least-squares circle of each layer of a trunk from power sums up to the third order, in closed form, and its relative error."""
    p = points.where("part = 0").withColumn("layer", F.floor(F.col("z") / layer))
    key = ["tree_id", "layer"]
    mid = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("x")).alias("ox"), F.floor(F.avg("y")).alias("oy")).where("n >= 3")
    p = p.join(mid, key).withColumn("u", F.col("x") - F.col("ox")).withColumn("v", F.col("y") - F.col("oy"))
    s = lambda e: F.sum(F.expr(e)).cast("double")
    m = p.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("n", "ox", "oy")], *[s(e).alias(a) for a, e in (("su", "u"), ("sv", "v"), ("suu", "u*u"), ("svv", "v*v"), ("suv", "u*v"), ("sp", "u*(u*u+v*v)"), ("sq", "v*(u*u+v*v)"))])
    n = F.col("n").cast("double")
    a, b, c = (n * F.col("suu") - F.col("su") * F.col("su")), (n * F.col("suv") - F.col("su") * F.col("sv")), (n * F.col("svv") - F.col("sv") * F.col("sv"))
    z = F.col("suu") + F.col("svv")
    d, e = 0.5 * (n * F.col("sp") - F.col("su") * z), 0.5 * (n * F.col("sq") - F.col("sv") * z)
    det = F.nullif(a * c - b * b, F.lit(0.0))
    m = m.withColumn("cu", (d * c - e * b) / det).withColumn("cv", (a * e - b * d) / det)
    r2 = (z - 2 * F.col("cu") * F.col("su") - 2 * F.col("cv") * F.col("sv")) / n + F.col("cu") * F.col("cu") + F.col("cv") * F.col("cv")
    return m.where("cu is not null").select(*key, "n", (F.col("ox") + F.col("cu")).alias("cx"), (F.col("oy") + F.col("cv")).alias("cy"), F.sqrt(r2).alias("radius"))


def circle_error(points: DataFrame, circles: DataFrame, layer: int = 1000) -> DataFrame:
    p = points.where("part = 0").withColumn("layer", F.floor(F.col("z") / layer)).join(circles, ["tree_id", "layer"])
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2) - F.col("radius")
    return p.groupBy("tree_id", "layer").agg(F.round(F.sqrt(F.avg(d * d)) / F.first("radius"), 5).alias("error"))


def sweep(cyl: DataFrame) -> DataFrame:
    """Three models of each tree: radius factor 9, 10 and 11 tenths, distances a tenth larger each time; in tenths and hundredths."""
    return cyl.withColumn("model_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))).withColumn("r_mm", F.col("r_mm") * (9 + F.col("model_id"))).withColumn("dist_mm", F.col("dist_mm") * (10 + F.col("model_id")))


def model_metrics(models: DataFrame) -> DataFrame:
    """Mean and highest distance, and lack of surface coverage, of each model over parts of the tree: the base of all selection metrics."""
    parts = {"all": F.lit(True), "trunk": trunk(), "branch": ~trunk(), "branch1": F.col("branch_order") == 1, "branch2": F.col("branch_order") == 2}
    aggs = []
    for p, w in parts.items():
        d, s = F.when(w, F.col("dist_mm")), F.when(w, F.col("surf_pct"))
        aggs += [F.coalesce(F.avg(d), F.lit(0.0)).alias(f"{p}_mean_dis"), (F.coalesce(F.max(d).cast("double"), F.lit(0.0)) / 2).alias(f"{p}_max_dis"), (1 - F.coalesce(F.avg(s), F.lit(0.0)) / 100).alias(f"{p}_mean_surf"), (1 - F.coalesce(F.min(s).cast("double"), F.lit(0.0)) / 100).alias(f"{p}_min_surf")]
    volumes = [litres(None).alias("total_volume"), litres(trunk()).alias("trunk_volume"), litres(~trunk()).alias("branch_volume")]
    return models.groupBy("tree_id", "model_id").agg(*aggs, *volumes)


def select_model(metrics: DataFrame, metric: str, *, lowest: bool = True) -> DataFrame:
    """The model of each tree with the lowest metric (highest for compatibility), ties by id."""
    value = F.col(metric) if lowest else -F.col(metric)
    return metrics.groupBy("tree_id").agg(F.min(F.struct(value.alias("v"), "model_id")).alias("m")).select("tree_id", "m.model_id")


def model_spread(metrics: DataFrame, column: str) -> DataFrame:
    """Standard deviation and relative range of a quantity over the models of a tree."""
    c = F.col(column)
    return metrics.groupBy("tree_id").agg(F.round(F.stddev_pop(c), 6).alias("std"), F.round((F.max(c) - F.min(c)) / F.nullif(F.avg(c), F.lit(0.0)), 6).alias("spread"))


def accuracy(labelled: DataFrame, truth: Column, found: Column) -> DataFrame:
    """Precision, recall and F1 of wood and leaf, accuracy and Cohen's kappa, from one conditional aggregation."""
    n = lambda w: F.sum(F.when(w, 1).otherwise(0)).cast("double")
    a = labelled.agg(n(truth & found).alias("tp"), n(~truth & found).alias("fp"), n(truth & ~found).alias("fn"), n(~truth & ~found).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    hit = (tp + tn) / total
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (total * total)
    out = {"wood_precision": tp / (tp + fp), "wood_recall": tp / (tp + fn), "wood_f1": 2 * tp / (2 * tp + fp + fn), "leaf_precision": tn / (tn + fn), "leaf_recall": tn / (tn + fp), "leaf_f1": 2 * tn / (2 * tn + fp + fn), "accuracy": hit, "kappa": (hit - chance) / (1 - chance)}
    return a.select(*[F.round(v, 9).alias(k) for k, v in out.items()])
