"""Readers and writers of text point clouds and model tables. Spark splits the files; none passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: A row of numbers; what else an ASCII cloud file has is its header.
NUMBERS = r"^\s*[-+]?(?:\d|\.\d|nan|inf)[-+.\deE\s]*(?:nan|inf|[-+.\deE\s])*$"


def _cells(spark: SparkSession, path: str) -> DataFrame:
    """file, value, cell (array of string) of each line that is not blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    one = F.trim(F.regexp_replace("value", r"\s+", " "))
    return lines.where(one != "").withColumn("cell", F.split(one, " "))


def read_xyz(spark: SparkSession, path: str, threshold: float = 0.0) -> DataFrame:
    """file, x, y, z, intensity of whitespace-separated text: a file, folder or pattern; each file is a cloud of its own.

    Rows of four columns are kept from the threshold on; rows of three are all kept, with null intensity. Any other row, and what is no number, fails the job.
    Blank lines are left out; an empty file gives no row."""
    n = F.size("cell")
    first = F.when(n.isin(3, 4), F.col("cell")[0]).otherwise(F.raise_error(F.concat(F.lit("not three or four columns: "), "value")).cast("string"))
    rows = _cells(spark, path).select("file", first.cast("double").alias("x"), F.col("cell")[1].cast("double").alias("y"), F.get("cell", F.lit(2)).cast("double").alias("z"), F.get("cell", F.lit(3)).cast("double").alias("intensity"))
    return rows.where(F.col("intensity").isNull() | (F.col("intensity") >= threshold))


def read_ascii_cloud(spark: SparkSession, path: str, fields: tuple[str, ...] = ("x", "y", "z", "intensity")) -> DataFrame:
    """file and the named fields, as double, of point rows of ASCII PLY or PCD files without faces. The order of fields is a parameter, since a file's header may be in another split
    than its rows. Header lines start with a word and are left out; a row with fewer numbers fails the job."""
    rows = _cells(spark, path).where(F.lower("value").rlike(NUMBERS))
    short = F.when(F.size("cell") < len(fields), F.raise_error(F.concat(F.lit("too few fields: "), "value")).cast("string"))
    return rows.select("file", *[F.coalesce(short, F.get("cell", F.lit(i))).cast("double").alias(f) for i, f in enumerate(fields)])


def write_xyz(points: DataFrame, path: str, columns: tuple[str, ...] = ("x", "y", "z")) -> None:
    """Space-separated text without header: coordinates, and whichever labels are asked for."""
    points.select(*columns).write.csv(path, sep=" ", header=False)


def write_by_class(points: DataFrame, path: str, label: str = "class") -> None:
    """Parquet in a folder for each label; classes without points have none."""
    points.write.partitionBy(label).parquet(path)


def write_table(rows: DataFrame, path: str, decimals: int = 4) -> None:
    """Tab-separated text with header; fractions rounded."""
    broken = {f.name for f in rows.schema.fields if isinstance(f.dataType, DoubleType | FloatType)}
    rows.select(*[F.round(c, decimals).alias(c) if c in broken else F.col(c) for c in rows.columns]).write.csv(path, sep="\t", header=True)
