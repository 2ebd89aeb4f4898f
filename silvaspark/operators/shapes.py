"""Shapes of groups of points: principal axes, normals, smooth regions, least-squares cylinders, distances to a model. Sums per group only: no group meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable, maybe_broadcast
from silvaspark.operators import graph
from silvaspark.operators.points import XYZ
from silvaspark.operators.spatial import AROUND, near_pairs

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _spread(df: DataFrame, by: list[str], u: dict[str, Column]) -> DataFrame:
    """by, n and the covariances of whole-number columns u[x], u[y], u[z]; the sums are exact."""
    sums = [F.sum(u[c]).cast("double").alias(f"s{c}") for c in XYZ] + [F.sum(u[p[0]] * u[p[1]]).cast("double").alias(f"s{p}") for p in PAIRS]
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    return g.select(*by, "n", *[((F.col(f"s{p}") - F.col(f"s{p[0]}") * F.col(f"s{p[1]}") / F.col("n")) / F.col("n")).alias(p) for p in PAIRS])


def _eigenvalues(df: DataFrame) -> DataFrame:
    """Adds e1 >= e2 >= e3 of the symmetric matrix in PAIRS, in closed form."""
    xx, xy, xz, yy, yz, zz = (F.col(p) for p in PAIRS)
    q, p = F.col("_q"), F.col("_p")
    df = df.withColumn("_q", (xx + yy + zz) / 3)
    df = df.withColumn("_p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    bent = F.coalesce(det / F.nullif(2 * p * p * p, F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("_phi", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), bent))) / 3)
    df = df.withColumn("e1", q + 2 * p * F.cos("_phi")).withColumn("e3", F.greatest(F.lit(0.0), q + 2 * p * F.cos(F.col("_phi") + 2 * F.pi() / 3)))
    return df.withColumn("e2", F.least(F.col("e1"), F.greatest(F.col("e3"), 3 * q - F.col("e1") - F.col("e3")))).drop("_q", "_p", "_phi")


def _eigenvector(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the unit vector name_x, name_y, name_z of an eigenvalue, the last part that is not zero positive; null where the direction is open."""
    e = F.col(value)
    rows = [(F.col("xx") - e, F.col("xy"), F.col("xz")), (F.col("xy"), F.col("yy") - e, F.col("yz")), (F.col("xz"), F.col("yz"), F.col("zz") - e)]
    crosses = [(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]) for a, b in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2]))]
    df = df.withColumn("_v", F.array_max(F.array(*[F.struct((x * x + y * y + z * z).alias("l2"), x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in crosses])))
    x, y, z = (F.col(f"_v.{c}") for c in XYZ)
    down = (z < 0) | ((z == 0) & ((y < 0) | ((y == 0) & (x < 0))))
    size = F.when(F.col("_v.l2") > 1e-18 * F.col("e1") ** 4, F.sqrt("_v.l2") * F.when(down, -1.0).otherwise(1.0))
    return df.select(*[c for c in df.columns if c != "_v"], *[(v / size).alias(f"{name}_{c}") for c, v in zip(XYZ, (x, y, z), strict=True)])


def principal_axes(points: DataFrame, *by: str) -> DataFrame:
    """by, n, e1 to e3 (variances along the axes, mm2), axis_x to axis_z, linearity (e1 - e2) / e1 and curvature e3 / sum; both null where all points are one place."""
    key = list(by)
    mid = points.groupBy(*key).agg(*[F.floor(F.avg(c)).alias(f"_o{c}") for c in XYZ])
    p = points.select(*key, *XYZ).join(mid, key)
    d = _eigenvalues(_spread(p, key, {c: F.col(c) - F.col(f"_o{c}") for c in XYZ}))
    d = _eigenvector(d, "e1", "axis")
    total = F.nullif(F.col("e1") + F.col("e2") + F.col("e3"), F.lit(0.0))
    return d.select(*key, "n", "e1", "e2", "e3", *[f"axis_{c}" for c in XYZ], ((F.col("e1") - F.col("e2")) / F.nullif("e1", F.lit(0.0))).alias("linearity"), (F.col("e3") / total).alias("curvature"))


def normals(points: DataFrame, radius: int, min_points: int = 4) -> DataFrame:
    """pid, n, normal_x to normal_z, curvature from the points within the radius; null normals where there are too few or they lie on one line."""
    near = near_pairs(points.select("pid", *XYZ), points.select("pid", *XYZ), radius)
    d = _eigenvalues(_spread(near, ["a_pid"], {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in XYZ}))
    d = _eigenvector(d, "e3", "normal")
    enough = (F.col("n") >= min_points) & (F.col("e2") > 1e-9 * F.col("e1"))
    total = F.nullif(F.col("e1") + F.col("e2") + F.col("e3"), F.lit(0.0))
    return d.select(F.col("a_pid").alias("pid"), "n", *[F.when(enough, F.col(f"normal_{c}")).alias(f"normal_{c}") for c in XYZ], F.when(enough, F.col("e3") / total).alias("curvature"))


def smooth_regions(points: DataFrame, radius: int, *, degrees: float = 15.0, max_curvature: float = 0.05, min_points: int = 4) -> DataFrame:
    """pid, region (least pid; null: none): flat points within the radius whose normals differ by no more than the angle are one region, and so on from point to point.

    A point that is not flat goes to the region of the nearest flat point whose normal it shares, if its own normal is known."""
    facing = durable(normals(points, radius, min_points))  # a filter pushed into the closed forms would repeat them many times over
    flat = durable(points.select("pid", *XYZ).dropDuplicates(["pid"]).join(facing.where("normal_x is not null"), "pid").select("pid", *XYZ, *[f"normal_{c}" for c in XYZ], "curvature"))
    seed = F.col("curvature") <= max_curvature
    met = near_pairs(flat, flat.where(seed), radius)
    dot = sum((F.col(f"a_normal_{c}") * F.col(f"b_normal_{c}") for c in XYZ), F.lit(0.0))
    met = durable(met.where(F.abs(dot) >= float(np.cos(np.radians(degrees)))).select("a_pid", "b_pid", "d2", "a_curvature"))
    links = met.where((F.col("a_curvature") <= max_curvature) & (F.col("a_pid") < F.col("b_pid"))).select(F.col("a_pid").alias("src"), F.col("b_pid").alias("dst"))
    found = graph.components(flat.where(seed).select(F.col("pid").alias("node")), links)
    edge = met.where(F.col("a_curvature") > max_curvature).groupBy(F.col("a_pid").alias("e")).agg(F.min(F.struct("d2", "b_pid")).alias("m")).select("e", F.col("m.b_pid").alias("to"))
    edge = edge.join(found, F.col("to") == F.col("node")).select(F.col("e").alias("node"), "root")
    placed = found.unionByName(edge)
    return points.select("pid").join(placed, F.col("pid") == F.col("node"), "left").select("pid", F.col("root").alias("region"))


def wood_regions(points: DataFrame, regions: DataFrame, *, min_linearity: float = 0.6, min_points: int = 10) -> DataFrame:
    """pid, wood: true for points of regions of enough points that are long or curved little enough to be a stem or branch, judged by their principal axes."""
    of = points.select("pid", *XYZ).join(regions.where("region is not null"), "pid")
    shape = durable(principal_axes(of, "region"))
    good = shape.where((F.col("n") >= min_points) & (F.col("linearity") >= min_linearity)).select(F.col("region").alias("_r"))
    return regions.join(good, F.col("region") == F.col("_r"), "left").select("pid", F.col("_r").isNotNull().alias("wood"))


def _frame(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors across each row of w."""
    other = np.where(np.abs(w[:, 2:]) < 0.9, np.array([[0.0, 0.0, 1.0]]), np.array([[1.0, 0.0, 0.0]]))
    u = np.cross(w, other)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u, np.cross(w, u)


C, W, U, V = (tuple(f"_{n}{c}" for c in XYZ) for n in "cwuv")
STATE = (*C, *W, *U, *V)
UPPER = [(i, j) for i in range(5) for j in range(i, 5)]
HEIGHT = 1000.0


def _step(tolerance: float):
    """Solves the normal equations of each group, moves its cylinder and says whether it stands still."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = np.zeros((len(pdf), 5, 5)), pdf[[f"b{i}" for i in range(5)]].to_numpy(float)
            for i, j in UPPER:
                a[:, i, j] = a[:, j, i] = pdf[f"a{i}{j}"].to_numpy(float)
            a += 1e-9 * np.eye(5) * np.trace(a, axis1=1, axis2=2)[:, None, None]
            d = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            c, w, u, v = (pdf[list(n)].to_numpy(float) for n in (C, W, U, V))
            c = c + d[:, :1] * u + d[:, 1:2] * v
            w = w + (d[:, 2:3] * u + d[:, 3:4] * v) / HEIGHT
            w /= np.linalg.norm(w, axis=1, keepdims=True)
            out = pdf[[x for x in pdf.columns if x[0] not in "ab_"]].copy()
            for names, value in zip((C, W, U, V), (c, w, *_frame(w)), strict=True):
                out[list(names)] = value
            out["_r"] = pdf["_r"].to_numpy(float) + d[:, 4]
            out["_done"] = (np.abs(d) < tolerance).all(1) | ~np.isfinite(d).all(1)
            yield out

    return step


def fit_cylinders(points: DataFrame, *by: str, start: DataFrame | None = None, rounds: int = 50, tolerance: float = 1e-3) -> DataFrame:
    """by, n, place (cx, cy, cz), axis (wx, wy, wz), radius, mean absolute distance (mad) and settled of the least-squares cylinder of each group, from axes of start (by, axis_x to axis_z), upright where it has none.

    A Gauss-Newton step needs twenty sums of each group, which Spark adds up map-side; only they meet the solver. Groups of fewer than six points are left out;
    names of by must not begin with a, b or an underscore."""
    key = list(by)
    p = durable(points.select(*key, *XYZ))
    state = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for c, n in zip(XYZ, C, strict=True)]).where("n >= 6")
    if start is None:
        state = state.select("*", *[F.lit(v).alias(n) for n, v in zip(W, (0.0, 0.0, 1.0), strict=True)])
    else:
        given = F.col("axis_z").isNotNull()
        state = state.join(start.select(*key, *[f"axis_{c}" for c in XYZ]), key, "left").select(*key, "n", *C, *[F.when(given, F.col(f"axis_{c}")).otherwise(F.lit(v)).alias(n) for n, c, v in zip(W, XYZ, (0.0, 0.0, 1.0), strict=True)])
    x, y, z = (F.col(n) for n in W)
    steep = F.abs(z) < 0.9
    u = (F.when(steep, y).otherwise(0.0), F.when(steep, -x).otherwise(z), F.when(steep, 0.0).otherwise(-y))
    long = F.sqrt(sum((v * v for v in u), F.lit(0.0)))
    state = state.select("*", *[(v / long).alias(n) for n, v in zip(U, u, strict=True)])
    ux, uy, uz = (F.col(n) for n in U)
    state = state.select("*", *[v.alias(n) for n, v in zip(V, (y * uz - z * uy, z * ux - x * uz, x * uy - y * ux), strict=True)])
    state = durable(state.select(*key, "n", *STATE, F.lit(0.0).alias("_r"), F.lit(False).alias("_done")))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
    done = None

    def placed(open_: DataFrame) -> DataFrame:
        j = p.join(maybe_broadcast(open_), key)
        along = lambda n: sum(((F.col(c) - F.col(o)) * F.col(x) for c, o, x in zip(XYZ, C, n, strict=True)), F.lit(0.0))
        j = j.withColumn("_s", along(U)).withColumn("_t", along(V)).withColumn("_h", along(W) / HEIGHT)
        return j.withColumn("_d", F.greatest(F.sqrt(F.col("_s") * F.col("_s") + F.col("_t") * F.col("_t")), F.lit(1e-9)))

    for _ in range(rounds):
        j = placed(state)
        slope = [F.col("_s") / F.col("_d"), F.col("_t") / F.col("_d")]
        slope += [F.col("_h") * x for x in slope] + [F.lit(1.0)]
        sums = j.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("n", *STATE, "_r", "_done")], *[F.avg(slope[i] * slope[k]).alias(f"a{i}{k}") for i, k in UPPER], *[F.avg(x * (F.col("_d") - F.col("_r"))).alias(f"b{i}") for i, x in enumerate(slope)])
        state = durable(sums.mapInPandas(_step(tolerance), types))
        still = state.where("_done")
        done = still if done is None else done.unionByName(still)
        state = state.where("not _done")
        if not state.limit(1).count():
            break
    end = placed(done.unionByName(state)).withColumn("_e", F.abs(F.col("_d") - F.col("_r")))
    names = dict(zip((*C, *W, "_r"), ("cx", "cy", "cz", "wx", "wy", "wz", "radius"), strict=True))
    return end.groupBy(*key).agg(F.first("n").alias("n"), *[F.first(k).alias(v) for k, v in names.items()], F.avg("_e").alias("mad"), F.first("_done").alias("settled"))


def model_distances(points: DataFrame, model: DataFrame, reach: int) -> DataFrame:
    """pid, cyl, dist: for each point within reach of an axis (cyl, sx to sz, ex to ez, r) the cylinder whose surface is nearest, ties by cyl.

    Axes are dealt to the cells around places along them, so that points and axes meet by an equal cell; a point is in one cell."""
    cell = reach + (reach + 1) // 2
    length2 = sum(((F.col(f"e{c}") - F.col(f"s{c}")) * (F.col(f"e{c}") - F.col(f"s{c}")) for c in XYZ), F.lit(0.0))
    m = model.select("cyl", "r", *[f"{e}{c}" for e in "se" for c in XYZ]).withColumn("_l2", length2)
    steps = F.greatest(F.lit(1), F.ceil(F.sqrt("_l2") / reach))
    m = m.withColumn("_k", steps).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k").cast("long"))))
    m = m.withColumn("_o", F.explode(F.array(*[F.struct(*[F.lit(o).alias(c) for o, c in zip(t, XYZ, strict=True)]) for t in AROUND])))
    at = lambda c: F.floor((F.col(f"s{c}") + (F.col(f"e{c}") - F.col(f"s{c}")) * F.col("_i") / F.col("_k")) / cell) + F.col(f"_o.{c}")
    m = m.select("cyl", "r", "_l2", *[f"{e}{c}" for e in "se" for c in XYZ], *[at(c).alias(f"_m{c}") for c in XYZ]).distinct()
    p = points.select("pid", *XYZ, *[F.floor(F.col(c) / cell).alias(f"_p{c}") for c in XYZ])
    j = p.join(m, [F.col(f"_p{c}") == F.col(f"_m{c}") for c in XYZ])
    along = sum(((F.col(c) - F.col(f"s{c}")) * (F.col(f"e{c}") - F.col(f"s{c}")) for c in XYZ), F.lit(0.0))
    j = j.withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along / F.nullif("_l2", F.lit(0.0)), F.lit(0.0)))))
    off = [F.col(c) - F.col(f"s{c}") - F.col("_t") * (F.col(f"e{c}") - F.col(f"s{c}")) for c in XYZ]
    j = j.withColumn("_a", F.sqrt(sum((o * o for o in off), F.lit(0.0)))).where(F.col("_a") <= reach)
    best = j.groupBy("pid").agg(F.min(F.struct(F.abs(F.col("_a") - F.col("r")).alias("dist"), "cyl")).alias("b"))
    return best.select("pid", "b.cyl", "b.dist")


def distance_summary(distances: DataFrame, share: float = 0.95, least: int = 20) -> DataFrame:
    """tree_id, n_cyl, mean_mm, max_mm, median_mm, std_mm over the cylinders' trimmed mean distances. distances: tree_id, cyl, pid, d."""
    w = Window.partitionBy("cyl")
    r = distances.withColumn("rn", F.row_number().over(w.orderBy("d", "pid"))).withColumn("m", F.count(F.lit(1)).over(w))
    c = r.where((F.col("m") < least) | (F.col("rn") <= F.floor(share * F.col("m")))).groupBy("tree_id", "cyl").agg(F.avg("d").alias("d"))
    stats = {"mean": F.avg("d"), "max": F.max("d"), "median": F.median("d"), "std": F.stddev_pop("d")}
    return c.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_cyl"), *[F.round(v, 4).alias(f"{k}_mm") for k, v in stats.items()])


def box_axes(points: DataFrame, *by: str) -> DataFrame:
    """by, axis_x to axis_z, normal_x to normal_z: unit vectors of the greatest and the least spread of each group; null where open."""
    key = list(by)
    mid = points.groupBy(*key).agg(*[F.floor(F.avg(c)).alias(f"_o{c}") for c in XYZ])
    p = points.select(*key, *XYZ).join(mid, key)
    d = durable(_eigenvalues(_spread(p, key, {c: F.col(c) - F.col(f"_o{c}") for c in XYZ})))
    return _eigenvector(_eigenvector(d, "e1", "axis"), "e3", "normal").select(*key, *[f"{n}_{c}" for n in ("axis", "normal") for c in XYZ])
