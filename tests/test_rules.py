"""Rules without SQL against brute force, and the cases of cover sets and relative sizes that are known by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaspark import catalog
from silvaspark.operators import models, rules, shapes, spatial, structure

POINT = "pid long, x long, y long, z long, rel_size int"


def covered(spark, rows, **how):
    df = spark.createDataFrame(rows, POINT)
    return {r.pid: r.center for r in rules.variable_cover(df, **how).collect()}


def greedy(rows, order, patch_min, patch_max, ball, min_points):
    """Seeds one after another in the given order, as the docstring has it."""
    m = patch_min / patch_max
    rs = {p[0]: p[4] / 256 * (1 - m) + m for p in rows}
    d = lambda a, b: math.dist(a[1:4], b[1:4])
    reach = {p: patch_max * r + math.sqrt(r) * (ball - patch_max) for p, r in rs.items()}
    seeds = [p for p in rows if p[4] > 0 and sum(d(p, q) < reach[p[0]] for q in rows) >= min_points]
    barred, centers = set(), []
    for p in sorted(seeds, key=lambda p: order[p[0]]):
        if p[0] not in barred:
            centers.append(p)
            barred |= {q[0] for q in rows if d(p, q) < patch_max * rs[p[0]]}
    return {q[0]: min(((d(p, q), order[p[0]], p[0]) for p in centers if d(p, q) < reach[p[0]]), default=(0, 0, None))[2] for q in rows}


def test_variable_cover_is_the_greedy_one(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), *map(int, r.integers(0, 600, 3)), int(r.integers(0, 256))) for i in range(250)]
    how = {"patch_min": 60, "patch_max": 150, "ball": 180, "min_points": 2}
    hashed = spark.createDataFrame(rows, POINT).select("pid", "rel_size", F.xxhash64("pid").alias("h")).collect()
    order = {x.pid: (x.rel_size, x.h, x.pid) for x in hashed}
    assert covered(spark, rows, **how) == greedy(rows, order, **how)


def test_sizes_of_a_line_grow_with_relative_size(spark):
    rows = [(i, 500 * i, 0, 0, 255 if i < 5 else 32) for i in range(10)]
    got = covered(spark, rows, patch_min=300, patch_max=1200, ball=2000)
    assert None not in got.values()
    small = [p for p in range(5, 10) if got[p] == p]
    assert len(small) >= len([p for p in range(5) if got[p] == p])  # small sizes seed first and more densely


def test_points_of_size_zero_seed_nothing(spark):
    got = covered(spark, [(0, 0, 0, 0, 55), (1, 1000, 0, 0, 0), (2, 2000, 0, 0, 55)], patch_min=500, patch_max=1000, ball=1500)
    assert got[0] == 0 and got[2] == 2 and got[1] != 1


def test_too_few_points_give_no_set(spark):
    rows = [(i, 20 * i, 0, 0, 255) for i in range(4)]
    assert set(covered(spark, rows, patch_min=100, patch_max=200, ball=300, min_points=5).values()) == {None}
    assert rules.variable_cover(spark.createDataFrame([], POINT), patch_min=1, patch_max=2, ball=3).count() == 0


LAYER = "tree_id long, segment long, parent long, order int, layer int, n_sets long, low long, high long"


def test_relative_sizes_by_hand(spark):
    one = rules.relative_sizes(spark.createDataFrame([(1, 0, None, 0, 0, 1, 0, 0)], LAYER)).collect()
    assert [r.rel_size for r in one] == [255]
    rows = [(1, 0, None, 0, i, 4, 100 * i, 100 * i + 99) for i in range(8)] + [(1, 1, 0, 1, i, n, 300 + 50 * i, 340 + 50 * i) for i, n in enumerate((9, 2, 2))]
    got = {(r.segment, r.layer): (r.base_size, r.rel_size) for r in rules.relative_sizes(spark.createDataFrame(rows, LAYER)).collect()}
    most = math.ceil(256 * 0.5 * (799 - 300) / 799)
    assert got[1, 0] == (min(128, most), min(128, most)) and got[0, 0] == (256.0, 255)
    assert got[0, 2][1] == math.floor(256 - 255 * math.sqrt(2 / 8) + 0.5)


def test_kinds_of_parts(spark):
    rows = [(1, 1, 10, 8, 10, True), (1, 2, 9, 1, 10, True), (1, 3, 3, 1, 10, False), (2, 1, 9, 2, 10, True), (2, 2, 12, 3, 10, True), (2, 3, 12, 3, 10, True), (3, 1, 5, 5, 5, False)]
    df = spark.createDataFrame(rows, "t long, part long, size long, base long, cut long, goes_on boolean")
    got = {(r.t, r.part): r.kind[0] for r in rules.component_classes(df, "t").collect()}
    assert got == {(1, 1): "c", (1, 2): "b", (1, 3): "c", (2, 1): "b", (2, 2): "c", (2, 3): "b", (3, 1): "c"}
    assert {r.kind for r in rules.component_classes(df.where("t = 2"), "t", main=False).collect()} == {"branch"}


def test_boxes_of_slanting_rods(spark):
    r = np.random.default_rng(1)
    u = np.array([[1, 2, 2], [2, 1, -2], [-2, 2, -1]]) / 3
    p = np.round(((r.random((600, 3)) - 0.5) * [3000, 200, 60]) @ u).astype(int)
    df = spark.createDataFrame([(1, i, *map(int, q)) for i, q in enumerate(p)], "g long, pid long, x long, y long, z long")
    got = rules.oriented_boxes(df, shapes.box_axes(df, "g"), "g").first()
    assert got.long_mm == pytest.approx(3000, rel=0.03) and got.mid_mm == pytest.approx(200, rel=0.1) and got.thin_mm == pytest.approx(60, rel=0.25)


def test_cylinders_of_slanting_branches(spark):
    r = np.random.default_rng(5)
    w = np.array([2, 1, 2]) / 3
    u = np.array([1, -2, 0]) / math.sqrt(5)
    v = np.cross(w, u)
    t, a = r.random(500) * 1500, r.random(500) * 2 * math.pi
    p = np.round(np.outer(t, w) + 40 * (np.outer(np.cos(a), u) + np.outer(np.sin(a), v))).astype(int)
    df = spark.createDataFrame([(1, i, *map(int, q)) for i, q in enumerate(p)], "g long, pid long, x long, y long, z long")
    got = shapes.fit_cylinders(df, "g", start=shapes.box_axes(df, "g")).first()
    assert got.settled and got.radius == pytest.approx(40, abs=0.5) and abs(np.dot([got.wx, got.wy, got.wz], w)) > 0.9999


def test_neighbours_by_brute_force(spark):
    r = np.random.default_rng(9)
    p = [(int(i), *map(int, q)) for i, q in enumerate(np.vstack([r.integers(-200, 200, (300, 3)), np.zeros((20, 3), int)]))]
    df = spark.createDataFrame(p, "pid long, x long, y long, z long")
    d2 = lambda a, b: sum((i - j) ** 2 for i, j in zip(a[1:], b[1:], strict=True))
    want = {(a[0], b[0]) for a in p for b in p if d2(a, b) <= 35 * 35}
    pairs = [(x.a_pid, x.b_pid) for x in spatial.near_pairs(df, df, 35).collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    assert {(x.pid, x.degree) for x in spatial.degrees(df, 35).collect()} == {(a[0], sum(i == a[0] for i, _ in want)) for a in p}
    near = {a[0]: [(d, i) for d, i in sorted((d2(a, b), b[0]) for b in p) if d <= 35 * 35][:3] for a in p}
    got = {}
    for x in sorted(spatial.hybrid_knn(df, 35, 3).collect(), key=lambda x: x["rank"]):
        got.setdefault(x.a_pid, []).append((x.d2, x.b_pid))
    assert got == near


def test_deep_chains_have_their_order(spark):
    links = spark.createDataFrame([(1, i, i - 1 if i else None, 1 if i else 0) for i in range(500)], "tree_id long, branch long, up long, order long")
    assert {(r.branch, r.order) for r in structure.summed_to_root(links, "branch", "order").collect()} == {(i, i) for i in range(500)}
    with pytest.raises(RuntimeError):
        structure.summed_to_root(spark.createDataFrame([(1, 1, 2, 1), (1, 2, 1, 1)], "tree_id long, branch long, up long, order long"), "branch", "order", max_rounds=8)


def test_cover_query_at_small_scale(spark, sf):
    got = catalog.QUERIES["cover_variable"](spark, sf)
    assert got.where("center is not null").count() > 0.5 * got.count() and got.join(got.select(F.col("pid").alias("p"), F.col("center").alias("c")), F.col("center") == F.col("p")).where("c is null").count() == 0


def test_model_of_a_stand_has_its_known_sizes(spark):
    p = catalog.points(spark, "/root/testdata/sf0.01")
    c = models.cylinders_of(p)
    trunk = c.where("part = 0 and n >= 40").toPandas()
    want = 150 - 0.01 * (trunk["start_z"] + trunk["length"] / 2 * trunk["axis_z"])  # radii fall by 10 mm a metre
    assert len(trunk) > 300 and (trunk["radius"] - want).abs().quantile(0.95) < 6 and trunk["axis_z"].abs().min() > 0.95
    branch = c.where("part > 0 and n >= 40").toPandas()
    assert (branch["radius"] - 30).abs().quantile(0.9) < 4 and branch["axis_z"].abs().quantile(0.9) < 0.1 and set(branch["parent_part"]) <= {0, 1, 2, 3}
    roots = c.where("parent_layer is null").toPandas()
    assert set(roots["part"]) == {0} and len(roots) == 24
    rows = models.tree_rows(c).toPandas()
    assert len(rows) == 24 and (rows["n_branches"] == 3).all() and rows["dbh_mm"].between(250, 300).all()
    tall = rows["trunk_mm"] / 1000
    solid = math.pi * 1000 * ((0.15**3 - (0.15 - 0.01 * tall) ** 3) / 0.03)  # litres of the tapered trunk
    assert (rows["trunk_litres"] / solid).between(0.9, 1.1).all()


def test_volumes_in_a_box_and_plausible_segments(spark):
    r = np.random.default_rng(2)
    rows = []
    for part, (n, radius, length) in enumerate(((2000, 50, 2000), (40, 60, 4000))):
        t, a = r.random(n) * length, r.random(n) * 2 * math.pi
        rows += [(10_000 * part + i, 1, part, int(1000 * part + radius * math.cos(v)), int(radius * math.sin(v)), int(u), 1) for i, (u, v) in enumerate(zip(t, a, strict=True))]
    df = spark.createDataFrame(rows, "pid long, tree_id long, part long, x long, y long, z long, intensity long")
    got = {x.part: x for x in models.box_volumes(df, (-500, -500, 500), (500, 500, 1500)).collect()}
    assert set(got) == {0} and got[0].radius_mm == pytest.approx(50, rel=0.05) and got[0].length_mm == pytest.approx(900, rel=0.05)
    assert {x.part: x.label for x in models.plausible_segments(df).collect()} == {0: 4, 1: -2}


def test_circles_by_plain_least_squares(spark):
    r = np.random.default_rng(4)
    a = r.random(200) * 2 * math.pi
    x, y = (300 * np.cos(a) + 40 + r.normal(0, 5, 200)).round().astype(int), (300 * np.sin(a) - 70 + r.normal(0, 5, 200)).round().astype(int)
    df = spark.createDataFrame([(i, 1, 0, int(u), int(v), 10) for i, (u, v) in enumerate(zip(x, y, strict=True))], "pid long, tree_id long, part long, x long, y long, z long")
    start = spark.createDataFrame([(1, 0, 20.0, -20.0, 280.0)], "tree_id long, layer long, cx double, cy double, radius double")
    loss = lambda cx, cy, rad: ((np.hypot(x - cx, y - cy) - rad) ** 2).sum()
    for free in (False, True):
        g = models.circle_steps(df, start, rounds=12, free=free).first()
        near = [loss(g.cx + i, g.cy + j, g.radius + k) for i in (-0.5, 0.5, 0) for j in (-0.5, 0.5, 0) for k in ((-0.5, 0.5, 0) if free else (0,))]
        assert loss(g.cx, g.cy, g.radius) <= min(near) and (free or g.radius == 280.0)
