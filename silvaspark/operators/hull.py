"""Convex hulls of many groups of places. A hull of hulls is the hull: each batch keeps its own corners only, before any shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corners(xy: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise, without places on its edges; one or two corners where all places are on a line."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy

    def side(places: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for p in places:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(side(xy.tolist()) + side(xy[::-1].tolist()))


def convex_hulls(places: DataFrame, by: str, *, x: str = "x", y: str = "y", fan: int = 32) -> DataFrame:
    """by (long), n_corners, area, cx, cy (centroid of the area; of the corners where it is zero), diameter (largest distance of two places) for each group.

    Batches give their corners, these meet in `fan` parts of a group and then in one, so no task sees more than the corners of `fan` hulls.
    Places with a null are left out; groups without places have no row."""
    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The corners of what a batch has of each part of a group."""
        for pdf in batches:
            if len(pdf):
                pdf = pdf.sort_values(["key", "part"])
                key, part, xy = pdf["key"].to_numpy(), pdf["part"].to_numpy(), pdf[["x", "y"]].to_numpy()
                starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1]
                found = [corners(some) for some in np.split(xy, starts[1:])]
                sizes = [len(c) for c in found]
                yield pd.DataFrame({"key": np.repeat(key[starts], sizes), "part": np.repeat(part[starts], sizes), "x": np.concatenate(found)[:, 0], "y": np.concatenate(found)[:, 1]})

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [size(corners(np.column_stack([np.asarray(xs, float), np.asarray(ys, float)]))) for xs, ys in zip(pdf["xs"], pdf["ys"], strict=True)]
            yield pd.DataFrame(rows, columns=["n_corners", "area", "cx", "cy", "diameter"]).assign(key=pdf["key"].to_numpy())[["key", "n_corners", "area", "cx", "cy", "diameter"]]

    def size(c: np.ndarray) -> tuple:
        mid = c.mean(0)
        p, q = c - mid, np.roll(c - mid, -1, axis=0)
        cross = p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]
        area = cross.sum() / 2 if len(c) > 2 else 0.0
        at = mid + ((p + q) * cross[:, None]).sum(0) / (6 * area) if area else mid
        return len(c), area, at[0], at[1], max(float((((c - v) ** 2).sum(1)).max()) for v in c) ** 0.5

    schema = "key long, part int, x double, y double"
    given = places.select(F.col(by).cast("long").alias("key"), (F.spark_partition_id() % fan).alias("part"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    parts = given.mapInPandas(reduced, schema).repartition("key", "part").mapInPandas(reduced, schema)
    whole = parts.groupBy("key").agg(F.collect_list(F.struct("x", "y")).alias("c")).select("key", F.col("c.x").alias("xs"), F.col("c.y").alias("ys"))
    found = whole.mapInPandas(measured, "key long, n_corners long, area double, cx double, cy double, diameter double")
    return found.withColumnRenamed("key", by)
