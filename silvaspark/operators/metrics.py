"""Metrics by which the best of several models of a tree is chosen, over what ``structure.model_metrics`` gives."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvaspark.operators.structure import litres, metres, square_metres, trunk

#: The parts of a tree whose values a metric adds up.
PARTS = {
    "all": ("all",), "trunk": ("trunk",), "branch": ("branch",), "branch1": ("branch1",), "branch2": ("branch2",),
    "trunk_branch": ("trunk", "branch"), "trunk_branch1": ("trunk", "branch1"), "trunk_branch1_branch2": ("trunk", "branch1", "branch2"), "branch1_branch2": ("branch1", "branch2"),
}
KINDS = {"mean_dis": ("mean_dis",), "max_dis": ("max_dis",), "mean_max_dis": ("mean_dis", "max_dis"), "mean_surf": ("mean_surf",), "min_surf": ("min_surf",)}


def selection_metrics(metrics: DataFrame) -> DataFrame:
    """The 45 metrics of distance and surface coverage of each model: nine combinations of parts by five kinds."""
    of = lambda kinds, parts: reduce(add, [F.col(f"{p}_{k}") for k in kinds for p in parts])
    return metrics.select("tree_id", "model_id", *[of(kinds, parts).alias(f"{name}_{kind}") for kind, kinds in KINDS.items() for name, parts in PARTS.items()])


def volume_deviations(metrics: DataFrame) -> DataFrame:
    """Standard deviations, over a tree's models, of the volume of all, trunk and branches, and of the last two added."""
    std: dict[str, Column] = {p: F.stddev_pop(f"{p}_volume") for p in ("total", "trunk", "branch")}
    return metrics.groupBy("tree_id").agg(*[F.round(c, 6).alias(f"{p}_vol_std") for p, c in std.items()], F.round(std["trunk"] + std["branch"], 6).alias("trunk_branch_vol_std"))


def size_deviations(models: DataFrame) -> DataFrame:
    """Standard deviations, over a tree's models, of areas, lengths and the number of branches. models: cylinders with model_id."""
    parts = {"tot": None, "trunk": trunk(), "branch": ~trunk()}
    sizes = [f(w).alias(f"{p}_{n}") for n, f in (("are", square_metres), ("len", metres)) for p, w in parts.items()]
    m = models.groupBy("tree_id", "model_id").agg(*sizes, (F.count_distinct("branch") - 1).alias("branch_num"))
    std = {c: F.stddev_pop(c) for c in ("tot_are", "trunk_are", "branch_are", "trunk_len", "branch_len", "branch_num")}
    pair = lambda n: (std[f"trunk_{n}"] + std[f"branch_{n}"]).alias(f"trunk_branch_{n}_std")
    both = m.groupBy("tree_id").agg(*[v.alias(f"{c}_std") for c, v in std.items()], pair("are"), pair("len"))
    return both.select("tree_id", *[F.round(c, 6).alias(c) for c in both.columns[1:]])


def distribution_spreads(models: DataFrame, bin_: Column, top: int, name: str, *, with_number: bool = False) -> DataFrame:
    """Mean and largest, over the first `top` classes, of the relative range (max - min) / mean over a tree's models of the volume, area and length in a class.

    A class that a model lacks is zero there; a class that all lack counts as 0. with_number adds the number of branches. models: cylinders with model_id."""
    values = {"vol": litres(), "are": square_metres(), "len": metres()} | ({"num": F.count_distinct("branch").cast("double")} if with_number else {})
    by = models.groupBy("tree_id", "model_id", bin_.alias("bin")).agg(*[v.alias(k) for k, v in values.items()]).where(F.col("bin").between(0, top - 1))
    count = models.groupBy("tree_id").agg(F.count_distinct("model_id").alias("_models"))
    j = by.join(count, "tree_id").groupBy("tree_id", "bin", "_models").agg(F.count(F.lit(1)).alias("_have"), *[f(k).alias(f"{k}_{n}") for k in values for n, f in (("max", F.max), ("min", F.min), ("sum", F.sum))])
    low = lambda k: F.when(F.col("_have") < F.col("_models"), 0.0).otherwise(F.col(f"{k}_min"))
    spread = {k: F.coalesce((F.col(f"{k}_max") - low(k)) / F.nullif(F.col(f"{k}_sum") / F.col("_models"), F.lit(0.0)), F.lit(0.0)) for k in values}
    found = j.select("tree_id", *[v.alias(k) for k, v in spread.items()]).groupBy("tree_id")
    found = found.agg(*[F.round(F.sum(k) / top, 6).alias(f"{k}_mean") for k in values], *[F.round(F.max(k), 6).alias(f"{k}_max") for k in values])
    prefix = "branch" if with_number else "cyl"
    named = [F.coalesce(f"{k}_{n}", F.lit(0.0)).alias(f"{prefix}_{k}_{name}_{n}") for n in ("mean", "max") for k in values]
    return models.select("tree_id").distinct().join(found, "tree_id", "left").select("tree_id", *named)
