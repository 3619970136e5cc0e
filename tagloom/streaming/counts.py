"""Tag counting over a stream of arriving library files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_tagcounts(spark: SparkSession, folder: str) -> DataFrame:
    """(lib, tag, abun) sums over tag-count files as they arrive; run in update or complete mode."""
    s = spark.readStream.csv(folder, sep="\t", schema="tag string, abun long").filter("tag IS NOT NULL")
    lib = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]+)*$", 1)
    return s.withColumn("lib", lib).groupBy("lib", "tag").agg(F.sum("abun").alias("abun"))


def stream_windowed(events: DataFrame, ts: str, window: str, late: str) -> DataFrame:
    """Reads per event-time window and library, with late rows dropped behind a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "lib").agg(F.sum("abun").alias("abun")).select("w.start", "w.end", "lib", "abun")
