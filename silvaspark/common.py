"""Helpers that every job shares: durable cuts of the lineage, size-checked broadcasts, table readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; its size is counted first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir. Where there is none: a folder of our own in local mode, an error on a cluster, whose machines can't read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="silvaspark-checkpoints-"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out where it comes in fewer partitions than there are cores, as from one small file; else df."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: a lost executor costs no earlier work."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of the rounds of a loop, written as Parquet to a folder of their own under the shared checkpoint folder.

    A checkpoint hands the estimated size of a join on to the next round's plan, where it is multiplied again: after some tens of rounds it has millions of digits, and planning takes all the time.
    Files have the size that they have, so that small frontiers are also seen to be small. `last` leaves the loop with checkpoints and removes the folder."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.n = spark, 0
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rounds-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def last(self, *dfs: DataFrame):
        """The tables, as one or a tuple, checkpointed; those of the rounds are gone."""
        out = tuple(durable(df) for df in dfs)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out if len(out) > 1 else out[0]


def maybe_broadcast(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if a count finds it within bound; otherwise it is left to a shuffled join (AQE splits hot keys)."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def uniform_hash(*parts: Column | str) -> Column:
    """A reproducible uniform number in (0, 1) from 52 bits of an MD5 digest of the parts; the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))
