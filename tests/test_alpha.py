"""Alpha shapes: areas of made figures, and edges against a search over all pairs and places; holes of surfaces, filled."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from silvaspark.operators.alpha import alpha_edges, alpha_shapes
from silvaspark.operators.rules import filled_cells


def brute(places: list[tuple[int, int]], r: float) -> set:
    """Directed pairs whose disc to the right is empty."""
    out = set()
    for p in places:
        for q in places:
            d = math.dist(p, q)
            if 0 < d < 2 * r:
                h = math.sqrt(r * r - d * d / 4)
                c = ((p[0] + q[0]) / 2 + h * (q[1] - p[1]) / d, (p[1] + q[1]) / 2 - h * (q[0] - p[0]) / d)
                if not any(math.dist(c, v) < r - 1e-9 for v in places if v not in (p, q)):
                    out.add((*p, *q))
    return out


def test_edges_are_those_of_a_search_over_all(spark):
    rng = random.Random(4)
    groups = {g: list({(rng.randrange(-2000, 2000), rng.randrange(-2000, 2000)) for _ in range(n)}) for g, n in ((1, 150), (2, 30), (3, 2), (4, 1))}
    radii = {1: 410.0, 2: 900.0, 3: 1500.0, 4: 100.0}
    rows = [(g, float(x), float(y), radii[g]) for g, ps in groups.items() for x, y in ps] * 2  # each place twice
    df = spark.createDataFrame([*rows, (1, None, 5.0, 410.0), (None, 1.0, 1.0, 9.0), (7, 1.0, 1.0, None)], "id long, x double, y double, radius double")
    got = {g: set() for g in groups}
    for e in alpha_edges(df, "id", F.col("radius")).collect():
        got[e.g].add((e.px, e.py, e.qx, e.qy))
    for g, ps in groups.items():
        assert got[g] == brute(ps, radii[g]), g
    sizes = {r.id: r for r in alpha_shapes(df, "id", F.col("radius")).collect()}
    assert sorted(sizes) == [1, 2, 3, 4] and sizes[4].area == sizes[3].area == 0 and sizes[3].n_edges == 0
    for g, ps in groups.items():
        assert sizes[g].area == sum((a + c) * (d - b) for a, b, c, d in brute(ps, radii[g])) / 2


def test_figures(spark):
    """A filled square, an L, a square ring whose hole doesn't count, two squares apart, a line and an empty group.

    In an inner corner the disc of 173 touches the places 200 from the corner, so each such corner keeps half a square of 200."""
    grid = [(x, y) for x in range(0, 2001, 100) for y in range(0, 2001, 100)]
    figures = {
        1: (grid, 4.0), 2: ([p for p in grid if p[0] <= 1000 or p[1] <= 1000], 3.02), 3: ([p for p in grid if not (500 < p[0] < 1500 and 500 < p[1] < 1500)], 3.08),
        4: ([p for p in grid if p[0] <= 500 or p[0] >= 1500], 2.0), 5: ([(x, 0) for x in range(0, 2001, 100)], 0.0),
    }
    df = spark.createDataFrame([(g, x + 5_000_000_000, y) for g, (ps, _) in figures.items() for x, y in ps], "id long, x long, y long")
    got = {r.id: (r.area / 1e6, r.perimeter / 1e3) for r in alpha_shapes(df, "id", 173.0).collect()}
    assert {g: a for g, (a, _) in got.items()} == {g: a for g, (_, a) in figures.items()}
    corner = 0.2 * 2**0.5 - 0.4
    assert got[1][1] == 8 and abs(got[2][1] - 8 - corner) < 1e-9 and abs(got[3][1] - 12 - 4 * corner) < 1e-9 and got[5][1] == 0
    assert alpha_shapes(df.where("id > 9"), "id", 173.0).count() == 0


def test_holes_are_filled_from_their_surroundings(spark):
    """Own values, windows of three, five and seven over the seam and the mirrored ends, and the mean where all is far; against a search over the extended grid."""
    layers, sectors, rng = 9, 20, random.Random(8)
    surfaces = {0: {(h, s): rng.uniform(50, 150) for h in range(9) for s in range(20) if rng.random() < 0.3}, 1: {(4, 0): 10.0, (4, 1): 20.0}, 2: {(0, 19): 7.0}, 3: {}}
    rows = [(g, h, s, v) for g, cells in surfaces.items() for (h, s), v in cells.items()] + [(3, 1, 1, None)]
    got = {(r.g, r.h, r.s): (r.r, r.window) for r in filled_cells(spark.createDataFrame(rows, "g long, h long, s long, r double"), ["g"], layers, sectors).collect()}
    assert len(got) == 3 * layers * sectors
    for g in (0, 1, 2):
        cells = surfaces[g]
        at = lambda h, s, cells=cells: cells.get((-1 - h if h < 0 else 2 * layers - 1 - h if h >= layers else h, s % sectors))
        for h in range(layers):
            for s in range(sectors):
                want, kind = cells.get((h, s)), 1
                for k in (1, 2, 3):
                    if want is None:
                        near = [v for i in range(h - k, h + k + 1) for j in range(s - k, s + k + 1) if (v := at(i, j)) is not None]
                        want, kind = (sum(near) / len(near), 2 * k + 1) if len(near) > 1 else (None, None)
                want = sum(cells.values()) / len(cells) if want is None else want
                r, window = got[g, h, s]
                assert math.isclose(r, want) and window == kind, (g, h, s)
