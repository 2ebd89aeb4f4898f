"""Robust cylinders of known size among outliers, and odd groups."""

from __future__ import annotations

import random

import numpy as np

from silvaspark.operators import robust, shapes

SCHEMA = "g long, x long, y long, z long"


def cylinder(seed, g, axis, centre, radius, length, n, outliers):
    r = np.random.default_rng(seed)
    w = np.array(axis, float) / np.linalg.norm(axis)
    a = np.cross(w, [0, 0, 1] if abs(w[2]) < 0.9 else [1, 0, 0])
    a /= np.linalg.norm(a)
    b = np.cross(w, a)
    t, f, d = r.uniform(-length / 2, length / 2, n), r.uniform(0, 2 * np.pi, n), radius + r.normal(0, 1.5, n)
    p = np.array(centre) + t[:, None] * w + d[:, None] * (np.cos(f)[:, None] * a + np.sin(f)[:, None] * b)
    p[:outliers] = np.array(centre) + r.uniform(-length * 0.7, length * 0.7, (outliers, 3))
    return [(g, *map(int, np.round(q))) for q in p]


def test_known_cylinders_with_three_tenths_of_outliers(spark):
    truth = {1: ((0, 0, 1), (100, -50, 700), 100, 1200), 2: ((1, 0.2, 0.1), (0, 0, 5000), 40, 900), 3: ((0.5, -1, 0.8), (-900, 20, 30), 150, 1500)}
    rows = [x for g, (axis, centre, radius, length) in truth.items() for x in cylinder(g, g, axis, centre, radius, length, 1500, 450)]
    random.Random(1).shuffle(rows)
    points = spark.createDataFrame(rows, SCHEMA)
    got = {r.g: r for r in robust.robust_cylinders(points, "g").collect()}
    plain = {r.g: r for r in shapes.fit_cylinders(points, "g").collect()}
    assert set(got) == set(truth)
    for g, (axis, centre, radius, length) in truth.items():
        r, w = got[g], np.array(axis) / np.linalg.norm(axis)
        own = np.array([r.axis_x, r.axis_y, r.axis_z])
        assert r.settled and r.n == 1500 and 700 < r.kept < 850 and abs(own @ w) > np.cos(np.radians(3)), r
        assert abs(r.radius - radius) <= 0.02 * radius + 1 and 0.9 * length < r.length < 1.1 * length, r
        start = np.array([r.start_x, r.start_y, r.start_z]) - np.array(centre)
        assert np.linalg.norm(start - (start @ w) * w) < 0.1 * radius
        assert g not in plain or abs(plain[g].radius - radius) > abs(r.radius - radius)  # least squares of all points is farther off


def test_odd_groups(spark):
    good = cylinder(9, 5, (0, 0, 1), (0, 0, 0), 60, 600, 300, 60)
    rows = [*good, (1, 0, 0, 0), *[(2, i, i, i) for i in range(50)], *[(3, i % 7, i // 7, 0) for i in range(49)], *[(4, 5, 5, 5)] * 30, (6, None, 1, 1), (None, 1, 1, 1)]
    random.Random(1).shuffle(rows)
    got = robust.robust_cylinders(spark.createDataFrame(rows, SCHEMA).repartition(3), "g").collect()
    assert [r.g for r in got] == [5] and abs(got[0].radius - 60) < 3
    assert robust.robust_cylinders(spark.createDataFrame([], SCHEMA), "g").count() == 0
