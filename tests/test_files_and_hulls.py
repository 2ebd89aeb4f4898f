"""Point files by round trips, hulls against plain Python."""

from __future__ import annotations

import itertools
import random

import pytest

from silvaspark.operators.hull import convex_hulls
from silvaspark.sources import clouds


def test_xyz_round_trip(spark, tmp_path):
    rows = [(0.5, -1.25, 3.0, 100.0), (1e3, 2.0, 0.0, 50.0), (0.0, 0.0, 0.0, 7.0)]
    clouds.write_xyz(spark.createDataFrame(rows, "x double, y double, z double, intensity double"), f"{tmp_path}/a", ("x", "y", "z", "intensity"))
    got = clouds.read_xyz(spark, f"{tmp_path}/a", 50)
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(rows[:2])
    (tmp_path / "b.xyz").write_text("\n 1\t2  3 \n\n4 5 6\n")
    assert sorted(tuple(r)[1:] for r in clouds.read_xyz(spark, f"{tmp_path}/b.xyz", 50).collect()) == [(1, 2, 3, None), (4, 5, 6, None)]
    (tmp_path / "c.xyz").write_text("1 2\n")
    with pytest.raises(Exception, match="columns"):
        clouds.read_xyz(spark, f"{tmp_path}/c.xyz").collect()
    (tmp_path / "d.xyz").write_text("")
    assert clouds.read_xyz(spark, f"{tmp_path}/d.xyz").count() == 0


def test_ascii_clouds(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nend_header\n1 2 3 9\n-1.5 .5 1e-3 8\n")
    (tmp_path / "b.pcd").write_text("# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity\nDATA ascii\n4 5 6 7\n")
    got = clouds.read_ascii_cloud(spark, f"{tmp_path}/*.p*").collect()
    assert sorted(tuple(r)[1:] for r in got) == [(-1.5, 0.5, 0.001, 8), (1, 2, 3, 9), (4, 5, 6, 7)]
    assert len({r.file for r in got}) == 2


def test_tables_and_classes(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456, 0), (2, 2.0, 1)], "id long, r double, class int")
    clouds.write_table(df, f"{tmp_path}/t")
    assert sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/t", sep="\t", header=True, inferSchema=True).collect()) == [(1, 0.1235, 0), (2, 2.0, 1)]
    clouds.write_by_class(df, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c/class=1").count() == 1


def test_convex_hulls(spark):
    r = random.Random(8)
    rows = [(1, x, y) for x, y in [(0, 0), (40, 0), (40, 20), (0, 20), (20, 0)]] + [(1, r.randint(1, 39), r.randint(1, 19)) for _ in range(200)]
    rows += [(2, r.randint(-99, 99), r.randint(-99, 99)) for _ in range(150)]
    rows += [(3, i, 2 * i) for i in range(9)] + [(4, 5, 5)] * 3 + [(5, None, 1)]
    got = {x.g: x for x in convex_hulls(spark.createDataFrame(rows, "g long, x long, y long").repartition(5), "g").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].n_corners, got[1].area, got[1].cx, got[1].cy) == (4, 800, 20, 10)
    for g in (1, 2, 3, 4):
        places = [(x, y) for k, x, y in rows if k == g]
        far = max((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 for a in places for b in places)
        assert got[g].diameter == pytest.approx(far**0.5)
    assert got[3].area == got[4].area == 0 and (got[4].cx, got[4].cy) == (5, 5)
    two = list({(x, y) for k, x, y in rows if k == 2})
    edges = [(a, b) for a, b in itertools.permutations(two, 2) if all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) >= 0 for c in two)]
    corner = {a for a, _ in edges}
    longest = {a: max((b for s, b in edges if s == a), key=lambda b: (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) for a in corner}
    start = at = min(corner)
    area = 0
    while True:
        nxt = longest[at]
        area += at[0] * nxt[1] - at[1] * nxt[0]
        at = nxt
        if at == start:
            break
    assert got[2].area == pytest.approx(area / 2)
    assert convex_hulls(spark.createDataFrame([], "g long, x long, y long"), "g").count() == 0
