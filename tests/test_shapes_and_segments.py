"""Principal axes, normals, regions, cylinders, model distances and segments against numpy and plain Python; LAS files and arriving tiles by round trip."""

from __future__ import annotations

import heapq
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaspark.operators import segments, shapes
from silvaspark.sources.las import LasSource
from silvaspark.streaming import arrivals


def frame(spark, rows, names="pid long, x long, y long, z long"):
    return spark.createDataFrame([tuple(int(v) for v in r) for r in rows], names)


def test_principal_axes_and_normals(spark):
    r = np.random.default_rng(3)
    a = (r.normal(size=(300, 3)) * [900, 40, 10] @ np.linalg.qr(r.normal(size=(3, 3)))[0]).round().astype(int)
    df = frame(spark, [(i, *p) for i, p in enumerate(a)]).withColumn("g", F.lit(1))
    got = shapes.principal_axes(df, "g").collect()[0]
    e, v = np.linalg.eigh(np.cov(a.T, bias=True))
    assert np.allclose([got.e3, got.e2, got.e1], e, rtol=1e-5)
    assert abs(np.dot([got.axis_x, got.axis_y, got.axis_z], v[:, 2])) > 1 - 1e-9
    near = {x.pid: x for x in shapes.normals(df, 150).collect()}
    for i in range(0, 300, 29):
        b = a[((a - a[i]) ** 2).sum(1) <= 150 * 150]
        e, v = np.linalg.eigh(np.cov(b.T, bias=True))
        assert near[i].n == len(b)
        if near[i].normal_x is not None and e[1] > 2 * e[0]:
            assert abs(np.dot([near[i].normal_x, near[i].normal_y, near[i].normal_z], v[:, 0])) > 1 - 1e-6
    one = shapes.principal_axes(frame(spark, [(1, 5, 5, 5), (2, 5, 5, 5)]).withColumn("g", F.lit(1)), "g").collect()[0]
    assert one.n == 2 and one.linearity is None and one.axis_x is None


def test_smooth_regions_part_two_walls(spark):
    walls = [(x, 0, z) for x in range(100, 1000, 50) for z in range(0, 500, 50)] + [(0, y, z) for y in range(100, 1000, 50) for z in range(0, 500, 50)]
    df = frame(spark, [(i, *p) for i, p in enumerate(walls)] + [(9999, 5000, 5000, 5000)])
    got = {r.pid: r.region for r in shapes.smooth_regions(df, 110).collect()}
    half = len(walls) // 2
    assert {got[i] for i in range(half)} == {0} and {got[i] for i in range(half, 2 * half)} == {half} and got[9999] is None


def test_cylinders_are_found(spark):
    r, rows, want = np.random.default_rng(8), [], {}
    for g in range(4):
        axis = np.array([0.2 * g, -0.1 * g, 1.0])
        axis /= np.linalg.norm(axis)
        u, v = shapes._frame(axis[None])
        t, h = r.uniform(0, 2 * math.pi, 400), r.uniform(-900, 900, 400)
        radius = 90 + 40 * g
        p = np.array([3000.0 * g, 500, 2000]) + h[:, None] * axis + (radius + r.normal(0, 2, 400))[:, None] * (np.cos(t)[:, None] * u + np.sin(t)[:, None] * v)
        rows += [(g, *x) for x in p.round()]
        want[g] = axis, radius
    got = {x.g: x for x in shapes.fit_cylinders(frame(spark, [*rows, (9, 1, 1, 1)], "g long, x long, y long, z long"), "g").collect()}
    assert set(got) == set(want)
    for g, (axis, radius) in want.items():
        x = got[g]
        assert abs(x.radius - radius) < 1 and abs(np.dot([x.wx, x.wy, x.wz], axis)) > 0.9999 and x.mad < 3


def test_model_distances_against_all_pairs(spark):
    r = random.Random(2)
    model = [(k, *(r.randint(-900, 900) for _ in range(6)), r.randint(10, 90)) for k in range(12)] + [(50, 7, 7, 7, 7, 7, 7, 20)]
    pts = [(i, *(r.randint(-1000, 1000) for _ in range(3))) for i in range(300)]
    got = {x.pid: (x.cyl, x.dist) for x in shapes.model_distances(frame(spark, pts), frame(spark, model, "cyl long, sx long, sy long, sz long, ex long, ey long, ez long, r long"), 250).collect()}
    want = {}
    for i, *p in pts:
        for k, *m, radius in model:
            s, e, q = np.array(m[:3], float), np.array(m[3:], float), np.array(p, float)
            l2 = ((e - s) ** 2).sum()
            a = float(np.linalg.norm(q - s - (min(1, max(0, np.dot(q - s, e - s) / l2)) if l2 else 0) * (e - s)))
            if a <= 250:
                want[i] = min(want.get(i, (math.inf, 0)), (abs(a - radius), k))
    assert set(got) == set(want)
    assert all(got[i][0] == k and abs(got[i][1] - d) < 1e-6 for i, (d, k) in want.items())


def test_nearest_source_against_dijkstra(spark):
    r = random.Random(5)
    one = {tuple(sorted(r.sample(range(40), 2))): r.randint(1, 9) for _ in range(60)}
    edges = [(a, b, w) for (a, b), w in one.items()] + [(b, a, w) for (a, b), w in one.items()]
    sources = [(0, 100), (1, 200), (1, 150)]
    best, heap = {}, [(0, label, n) for n, label in sources]
    while heap:
        d, label, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d, label
            for a, b, w in edges:
                if a == n:
                    heapq.heappush(heap, (d + w, label, b))
    got = segments.nearest_source(spark.createDataFrame(edges, "src long, dst long, w long"), spark.createDataFrame(sources, "node long, label long"))
    assert {x.node: (x.dist, x.label) for x in got.collect()} == best


def test_a_fork_has_two_segments(spark):
    links = [(i, i + 1) for i in range(6)] + [(6, 10), (10, 11), (11, 12), (6, 20), (20, 21), (20, 22), (21, 22)]  # node 20 is no larger than 10, so 10 goes on
    both = frame(spark, links + [(b, a) for a, b in links] + [(90, 91), (91, 90)], "src long, dst long")
    got = {x.node: (x.segment, x.parent_segment, x.level) for x in segments.level_segments(both, frame(spark, [(0, 0)], "node long, label long")).collect()}
    assert set(got) == {*range(7), 10, 11, 12, 20, 21, 22}
    assert all(got[n][:2] == (0, None) for n in (*range(7), 10, 11, 12)) and all(got[n][:2] == (20, 0) for n in (20, 21, 22)) and got[22][2] == 8


def test_two_trees_of_a_stand(spark):
    rows = [(k * 1000 + i, 6000 * k + (i * 37) % 100, (i * 53) % 100, i * 40) for k in range(2) for i in range(80)]
    got = {x.pid: x.tree for x in segments.segment_trees(frame(spark, [*rows, (9000, 3000, 0, 9000), (9000, 3000, 0, 9000)])).collect()}
    assert {t for p, t in got.items() if p < 1000} == {0} and {t for p, t in got.items() if 1000 <= p < 9000} == {1000} and got[9000] is None


@pytest.mark.parametrize(("kind", "record"), [(1, 28), (6, 30)])
def test_las_files(spark, tmp_path, kind, record):
    def write(name, points):
        h = bytearray(375)
        h[:4], h[25], h[104] = b"LASF", 4, kind
        struct.pack_into("<I", h, 96, 375)
        struct.pack_into("<H", h, 105, record)
        struct.pack_into("<6d", h, 131, 0.001, 0.001, 0.001, 10, 20, 30)
        struct.pack_into("<Q", h, 247, len(points))
        body = b"".join(struct.pack("<iiiH", *p[:4]) + (bytes([0, 0, p[4]]) if kind >= 6 else bytes([0, p[4]])).ljust(record - 14, b"\0") for p in points)
        (tmp_path / name).write_bytes(bytes(h) + body)

    points = [(i, -i, 2 * i, i % 65536, i % 7) for i in range(1000)]
    write("a.las", points)
    write("b.las", [])
    spark.dataSource.register(LasSource)
    df = spark.read.format("las").option("records", 300).load(str(tmp_path))
    got = sorted((round(1000 * (r.x - 10)), round(1000 * (r.y - 20)), round(1000 * (r.z - 30)), r.intensity, r.classification) for r in df.collect())
    assert got == sorted(points) and df.rdd.getNumPartitions() == 4
    write("c.laz.las", [])
    raw = bytearray((tmp_path / "c.laz.las").read_bytes())
    raw[104] |= 0x80
    (tmp_path / "c.laz.las").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="compressed"):
        spark.read.format("las").load(str(tmp_path)).count()


def test_tiles_arrive_in_parts(spark, tmp_path):
    rows = [(i, (i * 97) % 4000, (i * 31) % 3000, i % 500) for i in range(600)]
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):
        frame(spark, rows[part * 200 : (part + 1) * 200]).coalesce(1).write.mode("append").parquet(src)
        arrivals.take_arrivals(spark.readStream.schema("pid long, x long, y long, z long").parquet(src), 1500, out, state)
    want = {}
    for _, x, y, z in rows:
        n, low, high = want.get((x // 1500, y // 1500), (0, 9999, -1))
        want[x // 1500, y // 1500] = n + 1, min(low, z), max(high, z)
    assert {(r.tile_i, r.tile_j): (r.n, r.low, r.high) for r in arrivals.latest_totals(spark, out).collect()} == want
