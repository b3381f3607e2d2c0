"""Images that grow while pulses arrive.

The image is a sum over pulses, in any order, so a stream of pulses is a streaming
aggregation: the state is the image chip, not the pulses. Sums don't need watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.formation import backprojection


def pulse_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Pulses of a folder to which files are added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def growing_image(pulses: DataFrame, pixels: list[tuple[int, int, float, float, float]]) -> DataFrame:
    """(r, c, re, im), to be written in complete or update mode."""
    return backprojection(pulses, pixels)


def windowed_power(samples: DataFrame, width: str = "10 seconds", slide: str = "1 second", late: str = "30 seconds") -> DataFrame:
    """Mean power over sliding windows of transmit time; samples has ts, re, im."""
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.avg(power).alias("power"), F.count(F.lit(1)).alias("n"))
