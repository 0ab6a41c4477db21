"""Documents as they arrive: a stream of snapshots, and review events with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources import docx

_FILES = "path string, modificationTime timestamp, length long, content binary"


def snapshots(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A streaming DataFrame of parsed documents; every file is read once."""
    found = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return docx.parse_files(found.withColumn("package", docx.sniff()))


def review_activity(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Review events (ts, state) counted by window and state; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "state").agg(F.count("*").alias("events"))
