"""Longest ways against a walk over each tree; stems against a search that widens step by step."""

from __future__ import annotations

import math
import random

import pytest

from silvaspark.operators.topology import long_segments, longest_ways

SCHEMA = "tree_id long, node long, up long, x long, y long, z long"


def walk(nodes: dict[int, tuple]) -> dict[int, tuple]:
    """node: (segment, parent_segment, way, stem), of nodes (up, x, y, z) whose ups come before them."""
    kids = {n: [] for n in nodes}
    way = {}
    for n, (up, *at) in nodes.items():
        if up in nodes:
            kids[up].append(n)
            way[n] = way[up] + round(math.dist(at, nodes[up][1:]))
        else:
            way[n] = 0
    root = {}
    for n, (up, *_) in nodes.items():
        root[n] = root[up] if up in nodes else n
    tops = {}
    for r in set(root.values()):
        tips = [n for n in nodes if root[n] == r and not kids[n]]
        high = max(nodes[n][3] for n in tips)
        off = {n: math.dist(nodes[n][1:], (*nodes[r][1:3], high)) for n in tips}
        straight = {n: way[n] / d if (d := math.dist(nodes[n][1:], nodes[r][1:])) else math.inf for n in tips}
        reach = 500
        while not any(off[n] < reach for n in tips):
            reach += 500
        while True:
            found = [n for n in tips if off[n] < reach]
            tops[r] = min(found, key=lambda n: (round(straight[n], 9), n))
            if straight[tops[r]] <= 1.05 or len(found) == len(tips):
                break
            reach += 1000
    top = set(tops.values())
    best = {n: (n not in top, 0, n) for n in nodes}
    for n in reversed(nodes):
        up = nodes[n][0]
        if up in nodes:
            later, back, tip = best[n]
            best[up] = min(best[up], (later, back - (way[n] - way[up]), tip))
    seg = {n: best[n][2] for n in nodes}
    parent = {seg[n]: seg[nodes[n][0]] for n in nodes if nodes[n][0] in nodes and seg[nodes[n][0]] != seg[n]}
    return {n: (seg[n], parent.get(seg[n]), way[n], seg[n] in top) for n in nodes}


def test_against_a_walk(spark):
    rng = random.Random(12)
    trees = {}
    for t in range(6):
        nodes = {0: (None, 0, 0, 0)}
        for n in range(1, (1, 2, 40, 200, 300, 500)[t]):
            up = rng.choice(list(nodes)[-(3 if t % 2 else 60):]) if n % 97 else 10_000  # a tree may have several roots
            _, x, y, z = nodes.get(up, (0, 0, 0, 0))
            nodes[n] = (up, x + rng.randrange(-60, 60), y + rng.randrange(-60, 60), z + rng.randrange(0, 200))
        trees[t] = nodes
    rows = [(t, n, *v) for t, nodes in trees.items() for n, v in nodes.items()]
    rng.shuffle(rows)
    odd = [(0, None, 0, 1, 1, 1), (None, 5, 0, 1, 1, 1), (1, 77, 0, None, 1, 1), *rows[:20]]
    got = {}
    for r in longest_ways(spark.createDataFrame(rows + odd, SCHEMA)).collect():
        got.setdefault(r.tree_id, {})[r.node] = (r.segment, r.parent_segment, r.way, r.stem)
    for t, nodes in trees.items():
        assert got[t] == walk(nodes), t


def test_a_stem_prefers_the_straight_top_to_the_longest_way(spark):
    """A trunk of 5 m, a branch that leaves it at 4 m and winds on for 3 m, and another that leaves the branch."""
    trunk = [(0, None, 0, 0, 0)] + [(i, i - 1, 0, 0, 500 * i) for i in range(1, 11)]
    branch = [(20, 8, 800, 0, 4000), (21, 20, 1600, 0, 4100), (22, 21, 2400, 0, 4200), (23, 22, 2400, 800, 4300), (30, 21, 1600, 300, 4100)]
    got = {r.node: r for r in longest_ways(spark.createDataFrame([(1, *r) for r in trunk + branch], SCHEMA)).collect()}
    assert {n: r.segment for n, r in got.items()} == {**{i: 10 for i in range(11)}, 20: 23, 21: 23, 22: 23, 23: 23, 30: 30}
    assert got[23].parent_segment == 10 and got[30].parent_segment == 23 and got[10].parent_segment is None
    assert [n for n, r in sorted(got.items()) if r.stem] == list(range(11)) and got[10].way == 5000


def test_odd_tables(spark):
    assert longest_ways(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(RuntimeError, match="circle"):
        longest_ways(spark.createDataFrame([(1, 1, 2, 0, 0, 0), (1, 2, 3, 1, 0, 0), (1, 3, 1, 2, 0, 0)], SCHEMA))


def test_trees_of_any_depth_take_a_few_jobs(spark):
    """Rounds of joins, as many as the logarithm of the depth, left plans and file lists in the driver."""
    rows = [(t, n, n - 1, 0, 0, 100 * n) for t in range(30) for n in range(400)]
    spark.sparkContext.setJobGroup("ways", "ways")
    try:
        got = longest_ways(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == len(rows) and {r.segment for r in got} == {399} and max(r.way for r in got) == 39_900
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ways")) < 8


def test_segments_of_cover_sets(spark):
    """A trunk of two sets a level that forks: the straight arm goes on as the stem, the other, which reaches as far, is a branch; a set that nothing links is left out."""
    sets, links = [], []
    for k in range(10):
        sets += [(1, 2 * k, 0, 0, 300 * k), (1, 2 * k + 1, 100, 0, 300 * k)]
        links += [(1, 2 * k, 2 * k + 1)] + ([(1, 2 * k - 2, 2 * k), (1, 2 * k - 1, 2 * k + 1)] if k else [])
    sets += [(1, 100 + k, 100 + 250 * k, 0, 1200) for k in range(1, 12)] + [(1, 500, 9000, 0, 0)]
    links += [(1, 9, 101)] + [(1, 100 + k, 101 + k) for k in range(1, 11)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    both = links + [(t, b, a) for t, a, b in links]
    got = {r.node: r for r in long_segments(frame(sets, "tree_id long, node long, x long, y long, z long"), frame(both, "tree_id long, src long, dst long"), frame([(1, 0), (1, 1)], "tree_id long, node long")).collect()}
    assert set(got) == set(range(20)) | set(range(101, 112))
    stem, branch = {got[n].segment for n in range(20)}, {got[n].segment for n in range(101, 112)}
    assert stem == {18} and branch == {111} and got[101].parent_segment == 18 and got[0].stem and not got[101].stem
