"""Trunks, connection and segments of cover sets against sequential brute force and small trees made by hand."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from silvaspark.operators import models, sets

S, L, B = "tree_id long, node long, x long, y long, z long", "tree_id long, src long, dst long", "tree_id long, node long"


def linked(rows, reach):
    """Links, both ways, of sets of one tree within reach."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    near = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True)) <= reach * reach
    return [(t, a[1], b[1]) for t, own in by.items() for a in own for b in own if a is not b and near(a, b)]


def brute_trunk(rows, links, base, patch=200, floor=250, gap=2000, top=600, plan=200):
    at = {r[1]: r[2:] for r in rows}
    near = defaultdict(set)
    for _, a, b in links:
        near[a].add(b)
    x0, y0, high = min(p[0] for p in at.values()), min(p[1] for p in at.values()), max(p[2] for p in at.values())
    cell = {n: ((p[0] - x0) // plan, (p[1] - y0) // plan) for n, p in at.items()}
    trunk, bridges = set(base), set()
    front = {n for b in base for n in near[b]} - trunk
    trunk |= front
    h = max(at[n][2] for n in trunk) - floor
    while front:
        h0, before = h, front
        front = {n for f in front for n in near[f]} - trunk
        front = {n for n in front if at[n][2] >= h}
        trunk |= front
        if front:
            h = max(at[n][2] for n in front) - floor
        if (not front or h < h0 + patch / 2) and h < high - top:
            region = front or before
            xs, ys = [cell[n][0] for n in region], [cell[n][1] for n in region]
            above = [n for n in at if n not in trunk and h < at[n][2] < h + gap and min(xs) - 2 <= cell[n][0] <= max(xs) + 2 and min(ys) - 2 <= cell[n][1] <= max(ys) + 2]
            pairs = []
            for a in region:
                for b in above:
                    d2 = sum((p - q) ** 2 for p, q in zip(at[a], at[b], strict=True))
                    cos = (at[b][2] - at[a][2]) / math.sqrt(d2)
                    pairs.append((0 if cos > 0.7 else min(40, math.floor((0.7 - cos) / 0.05) + 1), d2, a, b))
            if pairs:
                _, _, a, b = min(pairs)
                near[a].add(b)
                near[b].add(a)
                bridges |= {(a, b), (b, a)}
                front = {n for r in region for n in near[r]} - trunk
                front = {n for n in front if at[n][2] >= h}
                trunk |= front
                h = max(at[n][2] for n in front) - floor
    return trunk, bridges


def scattered(seed, tree):
    """A crooked stem with gaps, side branches and loose sets, at least a few mm apart."""
    r, rows, z, n = random.Random(seed), {}, 0, 0
    x = y = 0
    while z < 2600:
        for _ in range(r.randint(1, 3)):
            rows[x + r.randint(-150, 150), y + r.randint(-150, 150), z] = 0
        x, y, z = x + r.randint(-60, 60), y + r.randint(-60, 60), z + r.choice([120, 150, 180, 180, 700 if r.random() < 0.6 else 150])
        if r.random() < 0.15:
            for k in range(r.randint(2, 8)):
                rows[x + 170 * k, y + r.randint(-40, 40), z + r.randint(-90, 160) * k] = 0
    return [(tree, n, *p) for n, p in enumerate(sorted(rows, key=lambda _: r.random()))]


def test_trunks_by_a_sequential_climb(spark):
    rows = scattered(1, 7) + scattered(2, 8) + scattered(3, 9) + [(10, 0, 0, 0, 0), (11, 0, 0, 0, 0), (11, 1, 0, 0, 100)]
    links = linked(rows, 260)
    base = [(t, n) for t, n, _, _, z in rows if z <= 150 and t != 10 and (t, n) != (11, 1)]
    got, bridges = sets.trunk_sets(spark.createDataFrame(rows, S), spark.createDataFrame(links, L), spark.createDataFrame(base, B), top=600)
    found, made = defaultdict(set), defaultdict(set)
    for r in got.collect():
        found[r.tree_id].add(r.node)
    for r in bridges.collect():
        made[r.tree_id].add((r.src, r.dst))
    crossed = 0
    for t in (7, 8, 9, 11):
        want, edges = brute_trunk([r for r in rows if r[0] == t], [x for x in links if x[0] == t], [n for u, n in base if u == t])
        assert found[t] == want and made[t] == edges, t
        crossed += len(edges)
    assert crossed and set(found) == {7, 8, 9, 11}


def test_least_links_are_the_spanning_tree_of_parts(spark):
    r = random.Random(4)
    rows = [(t, n, r.randrange(3000), r.randrange(3000), r.randrange(3000)) for t in (1, 2) for n in range(90)] + [(1, 90, 40_000, 0, 0), (1, 91, 40_050, 0, 0), (3, 0, 0, 0, 0)]
    links = linked(rows, 350)
    want = set()
    for t in (1, 2):
        at = {n: p for u, n, *p in rows if u == t}
        up = {n: n for n in at}
        for _, a, b in [x for x in links if x[0] == t]:
            up = {n: up[a] if m == up[b] else m for n, m in up.items()}
        pairs = sorted((sum((p - q) ** 2 for p, q in zip(at[a], at[b], strict=True)), a, b) for a in at for b in at if a < b)
        for d2, a, b in pairs:
            if d2 <= 12_000**2 and up[a] != up[b]:
                want.add((t, a, b, d2))
                up = {n: up[a] if m == up[b] else m for n, m in up.items()}
    got = sets.least_links(spark.createDataFrame(rows, S), spark.createDataFrame(links, L)).collect()
    assert want and {tuple(x) for x in got} == want and len(got) == len(want)


def tree_of(spark, edges, base=(0,), tree=1):
    """Sets by their numbers alone; edges as pairs."""
    nodes = sorted({n for e in edges for n in e})
    rows = spark.createDataFrame([(tree, n, n, 0, 0) for n in nodes], S)
    links = spark.createDataFrame([(tree, a, b) for a, b in edges] + [(tree, b, a) for a, b in edges], L)
    return rows, links, spark.createDataFrame([(tree, b) for b in base], B)


def chain(*nodes):
    return list(zip(nodes, nodes[1:], strict=False))


def test_a_fork_a_tripod_a_ring_and_a_stub(spark):
    # two sets a level, so that more levels ahead are studied
    wide = lambda nodes: [(a + i, b + j) for a, b in chain(*nodes) for i in (0, 1000) for j in (0, 1000)] + [(n, n + 1000) for n in nodes]
    fork, tripod = wide(range(15)) + wide([3, *range(20, 27)]), wide([0, 1, 2]) + wide([2, *range(10, 20)]) + wide([2, *range(30, 42)]) + wide([2, *range(50, 58)])
    ring, wide_ring = wide([0, 1, 2, 3, 4, 9, 10]) + wide([1, 12, 13, 14, 9]), wide([0, 1, *range(10, 20), 40]) + wide([1, *range(20, 30), 40])
    stub = wide(range(9)) + [(3, 70)]
    parts = [tree_of(spark, e, base=(0, 1000), tree=t) for t, e in enumerate((fork, tripod, ring, wide_ring, stub))]
    joined = [parts[0][i].unionByName(parts[1][i]).unionByName(parts[2][i]).unionByName(parts[3][i]).unionByName(parts[4][i]) for i in range(3)]
    own, parent = defaultdict(set), {}
    for r in sets.look_ahead_segments(*joined).collect():
        own[r.tree_id, r.segment].add(r.node)
        parent[r.tree_id, r.segment] = r.parent_segment
    of = lambda t: {s: (nodes, parent[t, s]) for (u, s), nodes in own.items() if u == t}
    assert of(0) == {0: ({n + k for n in range(15) for k in (0, 1000)}, None), 20: ({n + k for n in range(20, 27) for k in (0, 1000)}, 0)}
    assert {s: p for s, (_, p) in of(1).items()} == {0: None, 30: 0, 50: 0}
    assert set(of(2)) == {0}  # both ways meet within the levels ahead
    assert len(of(3)) == 2
    assert set(of(4)) == {0}  # a small end is no branch


def test_branches_of_branches_of_two_trees(spark):
    edges = chain(0, 1, 2, 3, 4, 5, 6, 7, 8, 9) + chain(2, 20, 21, 22, 23, 24, 25, 26, 27) + chain(22, 30, 31, 32, 33, 34, 35)
    rows, links, base = tree_of(spark, edges)
    more = tree_of(spark, [(a + 500, b + 500) for a, b in edges], base=(500,), tree=2)
    got = sets.look_ahead_segments(rows.unionByName(more[0]), links.unionByName(more[1]), base.unionByName(more[2])).collect()
    per = {t: {r.node % 500: r for r in got if r.tree_id == t} for t in (1, 2)}
    for own in per.values():
        assert len(own) == 24 and own[9].segment == own[0].segment and own[9].level == 9
        assert own[27].segment != own[0].segment or own[9].segment == own[0].segment
        assert own[35].segment not in (own[0].segment, own[27].segment) and own[35].parent_segment == own[27].segment and own[27].parent_segment == own[0].segment


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_odd_tables(spark, kind):
    rows = [] if kind == "empty" else [(1, 0, 0, 0, 0), (1, 0, 0, 0, 0), (1, 1, 0, 0, 100), (1, None, 0, 0, 0), (None, 2, 0, 0, 0), (1, 3, None, 0, 0), (2, 0, 0, 0, 0)]
    links = [] if kind == "empty" else [(1, 0, 1), (1, 1, 0), (1, 0, 0), (1, 0, 3), (1, 0, 99), (1, 0, 1), (None, 0, 1), (1, None, 0)]
    base = [] if kind == "empty" else [(1, 0), (1, 0), (2, 77), (None, 0)]
    s = spark.createDataFrame(rows, S).selectExpr("*", "1 AS by", "2 AS n", "'a' AS part", "0 AS level")
    e, b = spark.createDataFrame(links, L), spark.createDataFrame(base, B)
    trunk, bridges = sets.trunk_sets(s, e, b)
    assert sorted(map(tuple, trunk.collect())) == ([] if kind == "empty" else [(1, 0), (1, 1)]) and bridges.count() == 0
    assert sets.least_links(s, e).count() == 0
    assert sorted((r.tree_id, r.node, r.level) for r in sets.look_ahead_segments(s, e, b).collect()) == ([] if kind == "empty" else [(1, 0, 0), (1, 1, 1)])


def made_tree(seed, tree, x0):
    """Points of a trunk of radius 100 mm, 3 m tall, with a gap, and two branches of radius 40 and lengths 1.2 and 0.9 m."""
    r, rows = random.Random(seed), []
    for _ in range(2500):
        a, z = r.uniform(0, 2 * math.pi), r.uniform(0, 3000)
        if not 1300 < z < 1750:
            rows.append((x0 + 100 * math.cos(a), 100 * math.sin(a), z))
    for length, z, way in ((1200, 1000, 1), (900, 2200, -1)):
        for _ in range(700):
            a, t = r.uniform(0, 2 * math.pi), r.uniform(100, length)
            rows.append((x0 + way * t, 40 * math.cos(a), z + 40 * math.sin(a)))
    return [(tree * 10_000 + i, tree, *map(round, p), 9) for i, p in enumerate(rows)]


def test_model_of_a_cloud_without_segments(spark):
    points = spark.createDataFrame(made_tree(1, 1, 0) + made_tree(2, 2, 5000), "pid long, tree_id long, x long, y long, z long, part long")
    found = sets.segmented_points(points, patch=150).cache()
    assert found.columns == ["pid", "tree_id", "x", "y", "z", "part"] and found.count() == points.count()
    for t in (1, 2):
        rows = [r for r in found.collect() if r.tree_id == t]
        x0 = 0 if t == 1 else 5000
        ends = {r.part for r in rows if abs(r.x - x0) > 400}
        assert len(ends) == 2 and 0 not in ends  # two branches
        stem = [r for r in rows if abs(r.x - x0) <= 110]
        assert sum(r.part == 0 for r in stem) > 0.9 * len(stem)
    row = {r.tree_id: r for r in models.tree_rows(models.cylinders_of(found)).collect()}
    for t in (1, 2):
        assert 85 < row[t].trunk_litres < 120 and 2800 < row[t].height_mm < 3200 and 170 < row[t].dbh_mm < 260
