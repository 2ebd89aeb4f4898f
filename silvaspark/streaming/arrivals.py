"""Tiles that arrive as files: running totals of each tile, with the state in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.common import ensure_checkpoint_dir
from silvaspark.operators.points import assign_tiles

TOTALS = "tile_i long, tile_j long, n long, low long, high long, batch long"


def running_totals(stream: DataFrame, size: int) -> DataFrame:
    """tile_i, tile_j, n, low, high of a stream of points so far; the state is one row a tile."""
    tiles = assign_tiles(stream, size).groupBy("tile_i", "tile_j")
    return tiles.agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))


def take_arrivals(stream: DataFrame, size: int, out: str, checkpoint: str) -> None:
    """Take in all that has arrived since the last call with this checkpoint, and append the new totals of the tiles it touched to `out`, with the number of the batch.

    A batch that is run again after a failure writes its own folder again, so no total is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/run={number}")

    query = running_totals(stream, size).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """The newest totals of each tile."""
    found = spark.read.schema(TOTALS).parquet(f"{out}/run=*")
    return found.groupBy("tile_i", "tile_j").agg(F.max_by(F.struct("n", "low", "high"), "batch").alias("m")).select("tile_i", "tile_j", "m.*")


def stream_totals(spark: SparkSession, points_of, sf_dir: str, size: int = 1500) -> DataFrame:
    """Totals of the points of the lineitem files of a folder, taken as a stream."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/arrivals-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/lineitem.parquet*")
    take_arrivals(points_of(stream), size, f"{folder}/out", f"{folder}/state")
    return latest_totals(spark, f"{folder}/out")
