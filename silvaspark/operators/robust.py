"""Cylinders that outliers don't move: concentration steps for the axis, then for the circle, of all groups in shared rounds.

A step keeps the half of a group's points that is nearest to its model and fits the model to these; it is repeated until the model moves by less than a hundredth, at most for so many rounds; settled tells of the last circle. "Nearest half" is told from counts by classes of
distance, whole classes at a time, so that no group is sorted in one task; models come from sums. First the model is the covariance of the points, with distances scaled by it; then the least-squares circle of the points seen along the
first axis of that half.

Defined cases: points with a null in a coordinate or key count for nothing; repeated rows count as often as they are there; groups of fewer than 6 points, and those whose kept half lies in a plane, on a line or in one place, give no cylinder;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import Rounds
from silvaspark.operators.points import XYZ
from silvaspark.operators.shapes import principal_axes

#: Classes of scaled distance, of 1/64 each; of distance from the circle, of 1/4 mm each; the last class has all that is farther.
CLASSES, PER_SCALED, PER_MM = 4096, 64, 4
PAIRS = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]


def _nearest_half(measured: DataFrame, key: list[str], share: float) -> DataFrame:
    """key, cut: the least class up to which a group has so much of its points. measured: key, cls."""
    counts = measured.groupBy(*key, "cls").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key)
    sums = counts.withColumn("_all", F.sum("_n").over(w)).withColumn("_upto", F.sum("_n").over(w.orderBy("cls")))
    return sums.where(F.col("_upto") >= share * F.col("_all")).groupBy(*key).agg(F.min("cls").alias("cut"))


def _moments(p: DataFrame, key: list[str]) -> DataFrame:
    """key, kept, means and covariances of x, y, z."""
    m = p.groupBy(*key).agg(F.count(F.lit(1)).alias("kept"), *[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.avg(F.col(a) * F.col(b)).alias(f"_{a}{b}") for a, b in PAIRS])
    return m.select(*key, "kept", *[f"m{c}" for c in XYZ], *[(F.col(f"_{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}")).alias(f"v{a}{b}") for a, b in PAIRS])


def _scaled() -> Column:
    """Distance of x, y, z from the means, scaled by the covariances; null where these have no inverse."""
    v = lambda a, b: F.col(f"v{min(a, b)}{max(a, b)}")
    minor = {}
    for i, a in enumerate(XYZ):
        for j, b in enumerate(XYZ):
            (r, s), (t, u) = [x for x in XYZ if x != a], [x for x in XYZ if x != b]
            minor[a, b] = (v(r, t) * v(s, u) - v(r, u) * v(s, t)) * (-1) ** (i + j)
    det = sum((v("x", b) * minor["x", b] for b in XYZ), F.lit(0.0))
    size = v("x", "x") * v("y", "y") * v("z", "z")
    d = {c: F.col(c) - F.col(f"m{c}") for c in XYZ}
    q = sum((d[a] * d[b] * minor[a, b] for a in XYZ for b in XYZ), F.lit(0.0))
    return F.sqrt(F.greatest(F.when(det > 1e-12 * size, q / det), F.lit(0.0)))


def _circle(p: DataFrame, key: list[str]) -> DataFrame:
    """key, kept, cu, cv, r: least-squares circle of u, v from sums, in closed form; null on a line."""
    s = lambda e, a: F.sum(e).alias(a)
    u, v = F.col("u"), F.col("v")
    m = p.groupBy(*key).agg(F.count(F.lit(1)).alias("kept"), s(u, "su"), s(v, "sv"), s(u * u, "suu"), s(v * v, "svv"), s(u * v, "suv"), s(u * (u * u + v * v), "sp"), s(v * (u * u + v * v), "sq"))
    n = F.col("kept").cast("double")
    a, b, c = n * F.col("suu") - F.col("su") ** 2, n * F.col("suv") - F.col("su") * F.col("sv"), n * F.col("svv") - F.col("sv") ** 2
    z = F.col("suu") + F.col("svv")
    d, e = 0.5 * (n * F.col("sp") - F.col("su") * z), 0.5 * (n * F.col("sq") - F.col("sv") * z)
    det = F.when(a * c - b * b > 1e-9 * a * c, a * c - b * b)
    m = m.withColumn("cu", (d * c - e * b) / det).withColumn("cv", (a * e - b * d) / det)
    r2 = (z - 2 * F.col("cu") * F.col("su") - 2 * F.col("cv") * F.col("sv")) / n + F.col("cu") ** 2 + F.col("cv") ** 2
    return m.select(*key, "kept", "cu", "cv", F.sqrt(F.greatest(r2, F.lit(0.0))).alias("r"))


def _until_same(rounds: Rounds, state: DataFrame, step, key: list[str], max_rounds: int) -> DataFrame:
    """state after steps, with settled: each step takes the open groups of state to their next one. Groups whose values move by less than a hundredth are done."""
    values = [c for c in state.columns if c not in key]
    state, done = rounds.keep(state.withColumn("settled", F.lit(False))), None
    for _ in range(max_rounds):
        if not state.limit(1).count():
            break
        was = state.select(*key, *[F.col(c).alias(f"was_{c}") for c in values])
        same = [F.abs(F.col(c) - F.col(f"was_{c}")) <= 1e-2 * (1 + F.abs(F.col(c))) for c in values if c != "kept"]
        settled = same[0]
        for s in same[1:]:
            settled = settled & s
        now = rounds.keep(step(state.drop("settled")).join(was, key).withColumn("settled", settled).select(*key, *values, "settled"))
        ended = now.where("settled")
        done = ended if done is None else done.unionByName(ended)
        state = now.where("not settled")
    return state if done is None else done.unionByName(state)


def _frames(rounds: Rounds, kept: DataFrame, key: list[str]) -> DataFrame:
    """key, the first axis w of the kept points and two directions a and b across it: from the upright or, for a steep axis, from the x axis."""
    # written before it is filtered: closed forms of eigenvectors are long, and filters would repeat them
    axes = rounds.keep(principal_axes(kept, *key)).where("axis_z is not null and e3 > 0").select(*key, *[F.col(f"axis_{c}").alias(f"w{c}") for c in XYZ])
    x, y, z = (F.col(f"w{c}") for c in XYZ)
    steep = F.abs(z) > 0.7
    a = [F.when(steep, F.lit(0.0)).otherwise(y), F.when(steep, z).otherwise(-x), F.when(steep, -y).otherwise(F.lit(0.0))]
    size = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    a = [c / size for c in a]
    b = [y * a[2] - z * a[1], z * a[0] - x * a[2], x * a[1] - y * a[0]]
    return rounds.keep(axes.select(*key, "wx", "wy", "wz", *[c.alias(f"a{n}") for n, c in zip(XYZ, a, strict=True)], *[c.alias(f"b{n}") for n, c in zip(XYZ, b, strict=True)]))


def _seen(rows: DataFrame, frame: DataFrame, key: list[str]) -> DataFrame:
    """rows with their places u, v across and t along the axis."""
    along = lambda f: sum((F.col(c) * F.col(f"{f}{c}") for c in XYZ), F.lit(0.0))
    return rows.join(frame, key).withColumn("u", along("a")).withColumn("v", along("b")).withColumn("t", along("w"))


def robust_cylinders(points: DataFrame, *by: str, share: float = 0.5, max_rounds: int = 8) -> DataFrame:
    """by, n, kept, axis_x to axis_z, radius, length, start_x to start_z, settled of each group: axis by concentration of the covariance, circle by concentration of least squares; then both again
    from the points on the surface that were found.

    The length and start are those of the points that lie no farther from the circle than three times what bounds the kept half, a millimetre at least, but for a hundredth of them at either end."""
    key, rounds = list(by), Rounds(points.sparkSession)
    p = points.select(*key, *XYZ).dropna()
    mid = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.floor(F.avg(c)).alias(f"_o{c}") for c in XYZ]).where("n >= 6")
    p = rounds.keep(p.join(mid, key).select(*key, "n", *[f"_o{c}" for c in XYZ], *[(F.col(c) - F.col(f"_o{c}")).cast("double").alias(c) for c in XYZ]))

    def near(state: DataFrame, distance: Column, per: int) -> DataFrame:
        return p_now.join(state, key).withColumn("cls", F.least(F.floor(distance * per), F.lit(CLASSES))).where("cls is not null")

    def half(state: DataFrame, distance: Column, per: int) -> DataFrame:
        measured = near(state, distance, per)
        return measured.join(_nearest_half(measured, key, share), key).where("cls <= cut")

    p_now, scaled = p, _scaled()
    spread = _until_same(rounds, _moments(p, key), lambda s: _moments(half(s, scaled, PER_SCALED).select(*key, *XYZ), key), key, max_rounds)
    spread = rounds.keep(spread)
    kept = rounds.keep(half(spread.drop("settled", "kept"), scaled, PER_SCALED).select(*key, *XYZ))
    off = F.abs(F.sqrt((F.col("u") - F.col("cu")) ** 2 + (F.col("v") - F.col("cv")) ** 2) - F.col("r"))
    for _ in range(2):  # the first circle tells the surface, whose points have the axis
        frame = _frames(rounds, kept, key)
        p_now = rounds.keep(_seen(p, frame, key).select(*key, "n", *[f"_o{c}" for c in XYZ], *XYZ, "u", "v", "t"))
        start = _circle(_seen(kept, frame, key), key).where("cu is not null")
        circle = rounds.keep(_until_same(rounds, start, lambda s: _circle(half(s, off, PER_MM).select(*key, "u", "v"), key).where("cu is not null"), key, max_rounds))
        measured = near(circle, off, PER_MM)
        cut = _nearest_half(measured, key, share).withColumn("within", F.greatest(3 * (F.col("cut") + 1) / PER_MM, F.lit(1.0)))
        surface = rounds.keep(measured.join(cut.drop("cut"), key).where(off <= F.col("within")).select(*key, "n", *[f"_o{c}" for c in XYZ], *XYZ, "t"))
        kept = surface.select(*key, *XYZ)
    ends = surface.groupBy(*key).agg(F.first("n").alias("n"), *[F.first(f"_o{c}").alias(f"_o{c}") for c in XYZ], F.percentile_approx("t", [0.01, 0.99], 10_000).alias("_t"))
    ends = ends.withColumn("low", F.col("_t")[0]).withColumn("high", F.col("_t")[1])
    out = circle.join(ends, key).join(frame, key)
    place = lambda c: F.col(f"_o{c}") + F.col("cu") * F.col(f"a{c}") + F.col("cv") * F.col(f"b{c}") + F.col("low") * F.col(f"w{c}")
    out = out.select(*key, "n", "kept", *[F.round(f"w{c}", 6).alias(f"axis_{c}") for c in XYZ], F.round("r", 3).alias("radius"), F.round(F.col("high") - F.col("low"), 3).alias("length"), *[F.round(place(c), 3).alias(f"start_{c}") for c in XYZ], "settled")
    return rounds.last(out)
