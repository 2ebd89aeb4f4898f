"""Neighbour joins and graph operators against plain Python."""

from __future__ import annotations

import itertools
import random

import pytest

from silvaspark.operators import graph, spatial


@pytest.fixture(scope="module")
def cloud(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(3), r.randint(-300, 300), r.randint(-300, 300), r.randint(0, 200)) for i in range(400)]
    rows += [(400 + i, 0, *rows[i][2:]) for i in range(5)]  # points of one place
    return rows, spark.createDataFrame(rows, "pid long, part long, x long, y long, z long").cache()


def d2(a, b):
    return sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True))


def test_radius_pairs(cloud):
    rows, df = cloud
    want = {(a[0], b[0], d2(a, b)) for a, b in itertools.combinations(rows, 2) if d2(a, b) <= 50 * 50}
    assert {tuple(r) for r in spatial.forward_pairs(df, 50).select("a_pid", "b_pid", "d2").collect()} == want
    assert spatial.forward_pairs(df.limit(0), 50).count() == 0


def test_knn_grows_its_radius(cloud):
    rows, df = cloud
    got = spatial.knn(df.where("pid < 60"), df, 5, 10).collect()
    for a in rows[:60]:
        best = sorted((d2(a, b), b[0]) for b in rows)[:5]
        assert sorted((r.d2, r.b_pid) for r in got if r.a_pid == a[0]) == best


def test_closest_between(cloud):
    rows, df = cloud
    got = {(r["from"], r["to"]): r.d2 for r in spatial.closest_between(df.selectExpr("1 as tree_id", "*"), "tree_id", "part", 3).collect()}
    for s, t in itertools.combinations(range(3), 2):
        assert got[s, t] == min(d2(a, b) for a in rows for b in rows if a[1] == s and b[1] == t)


def test_dbscan(cloud):
    rows, df = cloud
    near = {a[0]: [b[0] for b in rows if d2(a, b) <= 45 * 45] for a in rows}
    core = {i for i, n in near.items() if len(n) >= 4}
    label = {i: i for i in core}
    while any(label[i] > (m := min(label[j] for j in near[i] if j in core)) and not label.update({i: m}) for i in core):
        pass
    want = {i: label[i] if i in core else min((label[j] for j in near[i] if j in core), default=None) for i in near}
    assert {r.pid: r.cluster for r in graph.dbscan(df, 45, 4).collect()} == want


def test_cover_is_an_independent_set_that_covers(cloud):
    rows, df = cloud
    at = {r[0]: r for r in rows}
    got = {r.pid: r.center for r in graph.cover(df, 60, 80).collect()}
    centers = {c for c in got.values() if c is not None}
    assert all(d2(at[a], at[b]) >= 60 * 60 for a, b in itertools.combinations(centers, 2))
    for i, c in got.items():
        inside = [d2(at[i], at[x]) for x in centers if d2(at[i], at[x]) < 80 * 80]
        assert (c is None) == (not inside) and (c is None or d2(at[i], at[c]) == min(inside))
    assert all(any(d2(at[i], at[c]) < 60 * 60 for c in centers) for i in at)
    edges = {(r.src, r.dst) for r in graph.cover_neighbors(df, graph.cover(df, 60, 80), 80).collect()}
    assert edges and all((b, a) in edges for a, b in edges)


def test_shortest_paths_and_components(spark):
    r = random.Random(6)
    edges = [(g, a, b, r.randint(1, 9)) for g in (1, 2) for a, b in {tuple(sorted(r.sample(range(25), 2))) for _ in range(40)}]
    df = spark.createDataFrame([*edges, *[(g, b, a, w) for g, a, b, w in edges]], "g long, src long, dst long, w long")
    got = {(x.g, x.node): x.dist for x in graph.shortest_paths(df, spark.createDataFrame([(1, 0), (2, 0)], "g long, node long"), "g").collect()}
    for g in (1, 2):
        dist = {0: 0}
        for _ in range(30):
            for h, a, b, w in [*edges, *[(h, b, a, w) for h, a, b, w in edges]]:
                if h == g and a in dist:
                    dist[b] = min(dist.get(b, 1 << 30), dist[a] + w)
        assert {n: v for (h, n), v in got.items() if h == g} == dist
    roots = {x.node: x.root for x in graph.components(spark.range(30).toDF("node"), df.where("g = 1 and src < 12 and dst < 12").select("src", "dst")).collect()}
    for _, a, b, _ in [e for e in edges if e[0] == 1 and e[1] < 12 and e[2] < 12]:
        assert roots[a] == roots[b] <= min(a, b)
    assert roots[29] == 29
