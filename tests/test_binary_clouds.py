"""Binary PLY and PCD files by round trips of made bytes."""

from __future__ import annotations

import random
import struct

import pytest

from silvaspark.sources.binary import CloudSource


def test_binary_clouds(spark, tmp_path):
    rng = random.Random(6)
    pts = [tuple(float(rng.randrange(-4000, 4000)) / 8 for _ in range(3)) + (rng.randrange(256),) for _ in range(1000)]
    for name, order, word in (("a.ply", "<", "little"), ("b.PLY", ">", "big")):
        head = f"ply\r\nformat binary_{word}_endian 1.0\ncomment {'long ' * 1000}\nelement camera 2\nproperty double f\nelement vertex {len(pts)}\nproperty uchar Intensity\nproperty double x\nproperty float32 y\nproperty short flag\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
        (tmp_path / name).write_bytes(head.encode() + struct.pack(order + "2d", 1, 2) + b"".join(struct.pack(order + "Bdfhf", i, x, y, 7, z) for x, y, z, i in pts) + struct.pack(order + "B3i", 3, 0, 1, 2))
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z normal\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 3\nWIDTH {len(pts) + 1}\nHEIGHT 1\nDATA binary\n"
    (tmp_path / "c.pcd").write_bytes(head.encode() + b"".join(struct.pack("<6f", x, y, z, 0, 0, 1) for x, y, z, _ in [*pts, (float("nan"), 0, 0, 0)]))
    (tmp_path / "d.pcd").write_bytes(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 0\nDATA binary\n")
    (tmp_path / "notes.txt").write_text("not a cloud")
    spark.dataSource.register(CloudSource)
    df = spark.read.format("cloud").option("records", 300).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 12
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.x, r.y, r.z, r.intensity))
    assert sorted(got) == ["a.ply", "b.PLY", "c.pcd"]
    assert sorted(got["a.ply"]) == sorted(got["b.PLY"]) == sorted(pts)
    assert sorted(p[:3] for p in got["c.pcd"]) == sorted(p[:3] for p in pts) and {p[3] for p in got["c.pcd"]} == {None}


@pytest.mark.parametrize(
    ("data", "says"),
    [
        (b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n", "not binary"),
        (b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 1\nDATA binary_compressed\n", "compressed"),
        (b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + bytes(20), "ends before"),
        (b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nend_header\n", "no x, y and z"),
        (b"hello", "neither"),
        (b"", "neither"),
    ],
)
def test_faults_are_told(spark, tmp_path, data, says):
    (tmp_path / "a.ply").write_bytes(data)
    spark.dataSource.register(CloudSource)
    with pytest.raises(Exception, match=says):
        spark.read.format("cloud").load(str(tmp_path / "a.ply")).collect()
