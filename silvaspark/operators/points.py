"""Filters, transforms, tiles and voxels of point clouds (tree_id, part, pid, x, y, z, intensity); coordinates in whole millimetres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def intensity_filter(points: DataFrame, threshold: float, *, strict: bool = False) -> DataFrame:
    """Points of at least the threshold; above it if strict."""
    c = F.col("intensity")
    return points.where(c > threshold if strict else c >= threshold)


def bbox_filter(points: DataFrame, low: tuple, high: tuple, *, inclusive: bool = True) -> DataFrame:
    for c, a, b in zip(XYZ, low, high, strict=True):
        points = points.where(F.col(c).between(a, b) if inclusive else (F.col(c) > a) & (F.col(c) < b))
    return points


def percentile_filter(points: DataFrame, share: float = 0.05, by: str = "tree_id") -> DataFrame:
    """Points of at least the given percentile of intensity in their cloud; the few thresholds join by cloud."""
    low = points.groupBy(by).agg(F.percentile("intensity", F.lit(share)).alias("threshold"))
    return points.join(low, by).where(F.col("intensity") >= F.col("threshold"))


def normalize(points: DataFrame, by: str = "tree_id") -> DataFrame:
    """Coordinates from the cloud's mean, in columns nx, ny, nz. Means are summed map-side and joined, so that no cloud meets in one task."""
    mean = points.groupBy(by).agg(*[F.avg(c).alias(f"m{c}") for c in XYZ])
    return points.join(mean, by).select(*points.columns, *[(F.col(c) - F.col(f"m{c}")).alias(f"n{c}") for c in XYZ])


def ground_zero(points: DataFrame, by: str = "tree_id") -> DataFrame:
    low = points.groupBy(by).agg(F.min("z").alias("ground"))
    return points.join(low, by).withColumn("height", F.col("z") - F.col("ground")).drop("ground")


def bounding_box(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])


def scaled_intensity(points: DataFrame, factor: float = 1.0) -> DataFrame:
    return points.withColumn("scaled", F.col("intensity") / 65535 * factor)


def remove_duplicates(points: DataFrame) -> DataFrame:
    """One point of each place, that of the smallest pid: min of a struct, combined map-side."""
    rest = [c for c in points.columns if c not in XYZ and c != "pid"]
    first = F.min(F.struct("pid", *rest)).alias("first")
    return points.groupBy(*XYZ).agg(first).select(*XYZ, "first.*").select(*points.columns)


def voxel(size: int, *, origin: tuple = (0, 0, 0)) -> list[Column]:
    """vx, vy, vz: the cell of a place."""
    return [F.floor((F.col(c) - o) / size).alias(f"v{c}") for c, o in zip(XYZ, origin, strict=True)]


def voxel_counts(points: DataFrame, size: int) -> DataFrame:
    return points.groupBy(*voxel(size)).agg(F.count(F.lit(1)).alias("n"))


def assign_tiles(points: DataFrame, size: int) -> DataFrame:
    """Half-open square tiles over the whole height."""
    return points.withColumn("tile_i", F.floor(F.col("x") / size)).withColumn("tile_j", F.floor(F.col("y") / size))


def assign_tiles_inclusive(points: DataFrame, size: int) -> DataFrame:
    """Tiles with both edges: a point on an edge is in the tiles on either side."""
    sides = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / size), F.ceil(F.col(c) / size) - 1))
    return points.withColumn("tile_i", F.explode(sides("x"))).withColumn("tile_j", F.explode(sides("y")))


def ground_band(points: DataFrame, *, band: int = 100, threshold: int = 100, offset: int = 200, by: str = "tree_id") -> DataFrame:
    """Points above the ground: the lowest band of height with over `threshold` points, else the fullest, and `offset` more are cut off."""
    bands = points.groupBy(by, F.floor(F.col("z") / band).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cut = bands.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("n") > threshold, F.col("b"))), F.max_by("b", F.struct("n", -F.col("b")))).alias("ground"))
    return points.join(cut, by).where(F.col("z") > (F.col("ground") + 1) * band + offset)


def stem_section(points: DataFrame, by: str = "tree_id") -> DataFrame:
    """Of the part of a stem from 2 % of the height up to a tenth of it, 4 m at most: points, extent, median squared distance from the mean place."""
    tall = points.groupBy(by).agg(F.min("z").alias("low"), (F.max("z") - F.min("z")).alias("tall"))
    part = points.join(tall, by).where((F.col("z") - F.col("low") > 0.02 * F.col("tall")) & (F.col("z") - F.col("low") < F.least(F.lit(4000.0), 0.1 * F.col("tall"))))
    mean = part.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.max("z") - F.min("z")).alias("extent"))
    far = part.join(mean, by).withColumn("d", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2))
    return far.groupBy(by).agg(F.first("n").alias("n"), F.first("extent").alias("extent"), F.median("d").alias("radius"))


def patch_diameters(spark, diameter: float, n: int) -> DataFrame:
    """n patch diameters around one, further apart the more there are."""
    i = F.col("id")
    low, high = diameter * (0.9 - 0.1 * (n - 2)), diameter * (1.1 + 0.1 * (n - 2))
    return spark.range(n).select(i.alias("i"), F.lit(diameter) if n == 1 else (low + (high - low) * i / (n - 1)).alias("diameter"))


def hash_sample(points: DataFrame, one_in: int) -> DataFrame:
    """A reproducible sample by a hash of the id."""
    return points.where(F.pmod(F.xxhash64("pid"), F.lit(one_in)) == 0)


def chunk_directions(points: DataFrame, n: int = 5, by: str = "tree_id") -> DataFrame:
    """Mean places of n chunks of equal height range of each cloud, and the squared cosine of the bend to the next chunk."""
    span = points.groupBy(by).agg(F.min("z").alias("low"), (F.max("z") - F.min("z") + 1).alias("tall"))
    chunk = F.floor((F.col("z") - F.col("low")) * n / F.col("tall")).alias("chunk")
    mean = points.join(span, by).groupBy(by, chunk).agg(*[F.avg(c).alias(c) for c in XYZ])
    w = Window.partitionBy(by).orderBy("chunk")
    step = mean.select(by, "chunk", *[(F.lead(c).over(w) - F.col(c)).alias(f"d{c}") for c in XYZ])
    nxt = [F.lead(f"d{c}").over(w) for c in XYZ]
    dot = sum((F.col(f"d{c}") * e for c, e in zip(XYZ, nxt, strict=True)), F.lit(0.0))
    norm = lambda cs: sum((c * c for c in cs), F.lit(0.0))
    return step.select(by, "chunk", (dot * dot / F.nullif(norm([F.col(f"d{c}") for c in XYZ]) * norm(nxt), F.lit(0.0))).alias("cos2"))
