"""Alpha shapes of many groups of places: the edges whose disc of a given radius touches both ends and holds no place.

A disc that touches a place is known by the direction of its centre, and each neighbour within twice the radius shuts an arc of directions. Where an arc begins outside all others,
the disc touches the place and that neighbour, is empty and lies to the right of the way from one to the other: an edge of the shape, with the inside on its left. So the edges of all
places follow from one grid join and one sweep over the arcs of each place; no triangles are made, and no group meets in one task. Arcs about one sector are joined by a hash aggregation first, so that a place sorts some tens of arcs, however many neighbours it has. Areas are sums over edges: holes don't count, and an edge
with an empty disc on both sides (a line of places) is met in both directions and adds nothing.

Places with a null, or whose group has a null radius or none above zero, are left out; equal places are one; groups without edges have area 0. Of more than two places on one circle of just
that radius, rounding decides which are joined. Work grows with the neighbours within twice the radius of each distinct place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sectors of directions around a place within which arcs are joined before they are sorted.
SECTORS = 16


def _places(places: DataFrame, by: str, radius: float | Column, x: str, y: str) -> DataFrame:
    r = radius if isinstance(radius, Column) else F.lit(radius)
    given = places.select(F.col(by).alias("g"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), r.cast("double").alias("r"))
    return given.dropna().where("r > 0").distinct()


def alpha_edges(places: DataFrame, by: str, radius: float | Column, *, x: str = "x", y: str = "y") -> DataFrame:
    """g (the group), px, py, qx, qy: directed edges of each group's shape, the inside on their left. The radius is a number or a column that is the same all over a group."""
    p = _places(places, by, radius, x, y)
    edge, reach = 4 * F.col("r"), 2 * F.col("r")
    here = p.select("*", *[F.floor(F.col(c) / edge).alias(n) for n, c in (("i", "px"), ("j", "py"))])
    there = p.select(F.col("g").alias("qg"), F.col("px").alias("qx"), F.col("py").alias("qy"), "r")
    for n, c in (("qi", "qx"), ("qj", "qy")):
        there = there.withColumn(n, F.explode(F.sequence(F.floor((F.col(c) - reach) / edge), F.floor((F.col(c) + reach) / edge))))
    met = here.join(there.drop("r"), (F.col("g") == F.col("qg")) & (F.col("i") == F.col("qi")) & (F.col("j") == F.col("qj")))
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    met = met.withColumn("d2", dx * dx + dy * dy).where((F.col("d2") > 0) & (F.col("d2") < 4 * F.col("r") * F.col("r")))
    half, turn = F.acos(F.sqrt("d2") / (2 * F.col("r"))), F.atan2(dy, dx)
    met = met.select("g", "px", "py", "qx", "qy", turn.alias("turn"), half.alias("half"))
    # arcs about one sector of directions, each at least half as wide as it to either side, overlap: they are one arc, and only its beginning can be open
    sector, wide = F.floor((F.col("turn") + F.pi()) * SECTORS / (2 * F.pi())), F.col("half") > math.pi / SECTORS
    own = [F.when(~wide, F.col(c)).alias(f"own_{c}") for c in ("qx", "qy")]
    begin, end = F.col("turn") - F.col("half"), F.col("turn") + F.col("half")
    arcs = met.groupBy("g", "px", "py", sector.alias("sector"), *own).agg(F.min(begin).alias("begin"), F.max(end).alias("end"), *[F.min_by(c, begin).alias(c) for c in ("qx", "qy")])
    a = F.col("begin") + F.when(F.col("begin") < -F.pi(), 2 * F.pi()).otherwise(0.0)
    met = arcs.select("g", "px", "py", "qx", "qy", a.alias("a"), (a + (F.col("end") - F.col("begin"))).alias("b"))
    at = Window.partitionBy("g", "px", "py")
    # arcs that go on past a half turn shut its beginning as well
    shut = F.greatest(F.max("b").over(at.orderBy("a", "qx", "qy").rowsBetween(Window.unboundedPreceding, -1)), F.max("b").over(at) - 2 * F.pi())
    return met.withColumn("open", F.col("a") >= shut).where("open").select("g", "px", "py", "qx", "qy")


def alpha_shapes(places: DataFrame, by: str, radius: float | Column, *, x: str = "x", y: str = "y") -> DataFrame:
    """by, n_edges, area, perimeter of each group's shape. Edges in both directions count in neither measure of length nor area."""
    e = alpha_edges(places, by, radius, x=x, y=y)
    # of an edge in both directions the two rows cancel: the lesser end first, and the sign of the way
    ahead = F.struct("px", "py") < F.struct("qx", "qy")
    ends = [F.when(ahead, F.col(f"p{c}")).otherwise(F.col(f"q{c}")).alias(f"u{c}") for c in "xy"] + [F.when(ahead, F.col(f"q{c}")).otherwise(F.col(f"p{c}")).alias(f"v{c}") for c in "xy"]
    once = e.select("g", *ends, F.when(ahead, 1).otherwise(-1).alias("way")).groupBy("g", "ux", "uy", "vx", "vy").agg(F.sum("way").alias("way")).where("way != 0")
    size = F.sqrt((F.col("vx") - F.col("ux")) * (F.col("vx") - F.col("ux")) + (F.col("vy") - F.col("uy")) * (F.col("vy") - F.col("uy")))
    found = once.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("way") * (F.col("ux") + F.col("vx")) * (F.col("vy") - F.col("uy"))) / 2).alias("area"), F.sum(size).alias("perimeter"))
    groups = _places(places, by, radius, x, y).groupBy("g").agg(F.count(F.lit(1)).alias("places"))
    return groups.join(found, "g", "left").select(F.col("g").alias(by), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in ((F.col("n"), "n_edges"), (F.col("area"), "area"), (F.col("perimeter"), "perimeter"))])
