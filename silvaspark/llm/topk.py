"""Operator 12: the k highest inner products of each query, exactly, by elimination with a table of distances to pivots.

Vectors are whole numbers. Equal vectors are one class with its k + 1 smallest ids, so that copies, however many, are searched once. Pivots are found by farthest-first traversal of a bounded sample
(`SAMPLE` classes by hash, at most `PIVOTS` pivots); they decide how much is eliminated, never what is found. Each class has its distances to all pivots. By the triangle inequality the
greatest difference of two distances to one pivot is a lower bound of the distance d of a query and a candidate, so (|q|^2 + |x|^2 - d^2) / 2 gives an upper bound of their inner product.

Classes are dealt to blocks by their nearest pivot and their distance to it. A query's own block gives the score that a candidate must reach; then each block of queries meets each block of
candidates in a task of its own, where candidates are evaluated in the order of their bounds, chunk by chunk, until no bound reaches the score of the k + 1 best.
Bounds are taken with a margin over their rounding, and products are exact: in float32 or float64 while the norms show that all sums are whole there, else in 64-bit integers.

Defined cases: a null vector, or one with null, NaN or infinite components, takes no part; shorter vectors are as if filled up with zeros; vectors whose squared norm passes 2^62 raise an error,
for scores could pass 64 bits; a null id is no query, and the last of its ties as a candidate; rows that agree in id and vector are queries of their own, but no candidates of each other, and of others as often
as they are there; a row of the same id with another vector is a candidate like any; fewer candidates than k are all returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable

K, EVERY = 20, 20
PIVOTS, SAMPLE = 32, 4096
#: Classes of a block, at most and, if that leaves cores idle, at least; bounds that are held at once; candidates of the first chunk.
BLOCK, SMALL_BLOCK, BOUNDS, CHUNK = 65_536, 2048, 4_000_000, 512
LAST = 2**63 - 1


def whole_numbers(vector: Column) -> Column:
    """floor(64 * x) of each component; null for a vector that takes no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(vector, lambda x: F.floor(64 * x.cast("double"))))


def vector_classes(rows: DataFrame, asked: Column, k: int) -> DataFrame:
    """cls, v, ids (null last, id, n: rows of it) of the k + 1 smallest ids, asked (some of its rows are queries), for each different v of rows (vec_id, v)."""
    each = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    few = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy(F.col("vec_id").asc_nulls_last())
    first = each.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1)
    ids = first.groupBy("v").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "n"))), 1, k + 1).alias("ids"))
    wanted = each.where(asked).select(F.col("v").alias("_v")).distinct().withColumn("asked", F.lit(True))
    found = ids.join(wanted, F.col("v") == F.col("_v"), "left").select("v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    return durable(found.withColumn("cls", F.monotonically_increasing_id()))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal: the first row, then always the row that is farthest from those chosen."""
    if not len(sample):
        return sample
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """A row of whole numbers for each vector, filled up with zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def pivot_table(classes: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """cls, asked, least (id, or `LAST`), vec (32-bit numbers), norm (squared), away (distances to the pivots), near (the nearest one), off (distance to it)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["v"], dim)
            f = x.astype(np.float64)
            if len(f) and (f * f).sum(1).max() > 2.0**62:
                raise OverflowError("the squared norm of a vector passes 2^62, so scores may pass 64 bits")
            away = np.stack([np.sqrt(((f - p) ** 2).sum(1)) for p in pivots], 1) if len(f) else np.empty((0, len(pivots)))
            near = away.argmin(1)
            yield pd.DataFrame({"cls": pdf["cls"], "asked": pdf["asked"], "least": pdf["least"], "vec": [v.tobytes() for v in x.astype(np.int32)], "norm": (x * x).sum(1), "away": [a.tobytes() for a in away.astype(np.float32)], "near": near, "off": away[np.arange(len(near)), near]})

    least = F.coalesce(F.col("ids")[0]["vec_id"], F.lit(LAST)).alias("least")
    return classes.select("cls", "asked", least, "v").mapInPandas(rows, "cls long, asked boolean, least long, vec binary, norm long, away binary, near long, off double")


class Side:
    """The columns of one side of a meeting."""

    def __init__(self, pdf: pd.DataFrame, dim: int) -> None:
        self.cls, self.least, self.norm = pdf["cls"].to_numpy(), pdf["least"].to_numpy(), pdf["norm"].to_numpy()
        self.vec = np.frombuffer(b"".join(pdf["vec"]), np.int32).reshape(len(pdf), dim)
        self.away = np.ascontiguousarray(np.frombuffer(b"".join(pdf["away"]), np.float32).reshape(len(pdf), -1).T)  # a row a pivot


def exact_type(q: Side, x: Side) -> type:
    """In what all sums of products are whole numbers: no part of a sum passes the product of the norms."""
    most = float(np.sqrt(q.norm.max())) * float(np.sqrt(x.norm.max()))
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


def upper_bounds(q: Side, x: Side, some: slice) -> np.ndarray:
    """Upper bounds of the inner products of some queries with all candidates, with a margin over what float32 rounds away."""
    least = np.zeros((len(q.norm[some]), len(x.norm)), np.float32)
    for dq, dx in zip(q.away, x.away, strict=True):
        gap = np.subtract.outer(dq[some], dx)
        np.abs(gap, out=gap)
        np.maximum(least, gap, out=least)
    least -= np.float32(1e-6) * (q.away.max(initial=0) + x.away.max(initial=0))
    np.maximum(least, 0, out=least)
    least *= least
    both = np.add.outer(q.norm[some].astype(np.float32), x.norm.astype(np.float32))
    return (both * np.float32(1 + 2e-6) - least) * np.float32(0.5)


def search(q: Side, x: Side, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate (rows of q and x) and score of the k best candidates of each query, ties by least id; of scores under `reach` none."""
    kind = exact_type(q, x)
    qv, xv = q.vec.astype(kind), x.vec.astype(kind)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    many = max(1, BOUNDS // max(1, len(x.cls)))
    for at in range(0, len(q.cls), many):
        bounds = upper_bounds(q, x, slice(at, at + many))
        for i, bound in enumerate(bounds, at):
            limit, size = float(reach[i]), CHUNK
            left = np.flatnonzero(bound >= limit)
            best, score = np.empty(0, np.int64), np.empty(0, np.int64)
            while len(left):
                if len(left) > size:  # the highest bounds of those left
                    parted = np.argpartition(bound[left], len(left) - size)
                    now, left = left[parted[-size:]], left[parted[:-size]]
                else:
                    now, left = left, left[:0]
                got = (xv[now] @ qv[i]).astype(np.int64)
                good = got >= limit
                best, score = np.r_[best, now[good]], np.r_[score, got[good]]
                if len(best) > k:
                    order = np.lexsort((x.least[best], -score))[:k]
                    best, score = best[order], score[order]
                    limit = max(limit, float(score[-1]))
                left, size = left[bound[left] >= limit], 4 * size
            out.append((np.full(len(best), i), best, score))
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _home(dim: int, k: int):
    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf[pdf["asked"]]
        if not len(asked):
            return pd.DataFrame({"query": [], "reach": []}, dtype="int64")
        q, x = Side(asked, dim), Side(pdf, dim)
        row, _, score = search(q, x, np.full(len(asked), -np.inf), k)
        found = pd.DataFrame({"query": q.cls[row], "score": score}).groupby("query")["score"].agg(["size", "min"]).reset_index()
        return found[found["size"] == k].rename(columns={"min": "reach"})[["query", "reach"]]

    return home


def _meet(dim: int, k: int):
    def meet(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(pdf):
            return pd.DataFrame({"query": [], "cls": [], "least": [], "score": []}, dtype="int64")
        q, x = Side(asked, dim), Side(pdf, dim)
        reach = asked["reach"].astype("Float64").to_numpy(np.float64, na_value=-np.inf)
        row, candidate, score = search(q, x, reach, k)
        return pd.DataFrame({"query": q.cls[row], "cls": x.cls[candidate], "least": x.least[candidate], "score": score})

    return meet


def exact_top_k(rows: DataFrame, *, k: int = K, every: int = EVERY, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, small_block: int = SMALL_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each row of rows (vec_id, embedding) whose id is divisible by `every`, against all rows but those of its id and vector; ties to the smaller id."""
    asked = F.col("vec_id") % every == 0
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v")).where("v is not null")
    classes = vector_classes(own, asked, k)
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked").cast("int")).alias("asked"), F.max(F.size("v")).alias("dim")).first()
    n, n_asked, dim = size["n"], size["asked"] or 0, max(1, size["dim"] or 0)
    some = classes.orderBy(F.xxhash64("v"), "cls").limit(sample).select("v").toPandas()
    chosen = choose_pivots(_matrix(some["v"], dim).astype(np.float64), pivots)
    chosen = chosen if len(chosen) else np.zeros((1, dim))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n // block), min(2 * cores, -(-n // small_block)))
    of_queries = max(1, -(-n_asked // block))
    table = pivot_table(classes, chosen, dim).repartitionByRange(n_blocks, "near", "off", "cls").withColumn("block", F.spark_partition_id().cast("long"))
    table = durable(table)
    reach = table.groupBy("block").applyInPandas(_home(dim, k + 1), "query long, reach long")
    queries = table.where("asked").join(reach, F.col("cls") == F.col("query"), "left").drop("query").withColumn("query_block", F.least(F.floor(F.col("block") * of_queries / n_blocks), F.lit(of_queries - 1)).cast("long"))
    queries = durable(queries)
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(max(0, table.rdd.getNumPartitions() - 1)).cast("long"))
    to_blocks = queries.drop("block").withColumn("block", F.explode(blocks))
    to_queries = table.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_queries - 1).cast("long"))))
    met = to_blocks.groupBy("query_block", "block").cogroup(to_queries.groupBy("query_block", "block")).applyInPandas(_meet(dim, k + 1), "query long, cls long, least long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "least")
    best = met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).select("query", "cls", "score")
    # ids of the best classes: at most k + 1 of each of k + 1
    named = best.join(classes.select(F.col("cls").alias("_c"), F.explode("ids").alias("i")), F.col("cls") == F.col("_c"))
    lists = named.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "i.none", "i.vec_id", "i.n", (F.col("query") == F.col("cls")).alias("own")))), 1, k + 1).alias("found"))
    lists = durable(lists.join(classes.select("cls", "v"), F.col("query") == F.col("cls")).select(F.col("v").alias("_v"), "found"))
    each = own.where(asked).select(F.col("vec_id").alias("query_id"), "v").join(lists, F.col("v") == F.col("_v")).select("query_id", "found")
    others = F.filter("found", lambda f: ~(f["own"] & f["vec_id"].eqNullSafe(F.col("query_id"))))
    repeated = F.flatten(F.transform(others, lambda f: F.array_repeat(f, F.least(f["n"], F.lit(k)).cast("int"))))
    top = each.select("query_id", F.posexplode(F.slice(repeated, 1, k)).alias("at", "f"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", (-F.col("f.below")).alias("score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id OR q.e <> c.e WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
