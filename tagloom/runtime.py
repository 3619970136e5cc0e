"""What a job needs from the session: package shipping, the shared checkpoint folder, small Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tagloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tagloom-")
    archive = os.path.join(folder, f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    sc.addPyFile(archive)
    sc._tagloom_shipped = True


def ship_file(spark: SparkSession, path: str) -> None:
    """Sends a file to the executors once for each application; shipped_file() finds it there."""
    sc = spark.sparkContext
    sent = getattr(sc, "_tagloom_files", set())
    if path not in sent:
        sc.addFile(path)
        sc._tagloom_files = sent | {path}


def shipped_file(path: str) -> str:
    """In a task: where the file is, at its own place or where it was sent to."""
    from pyspark import SparkFiles

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset a folder of our own, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = getattr(spark.sparkContext, "_tagloom_checkpoints", None) or tempfile.mkdtemp(prefix="tagloom-ck-")
        spark.sparkContext._tagloom_checkpoints = named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable copy in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a compressed table in the shared folder, for what is too wide to keep as a checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 1 << 26) -> None:
    """Bounds the rows and the bytes of an Arrow batch, since one text may be very long. Both are settings of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns whose expressions are evaluated once for each row. Those of withColumn are copied into all that uses them, lambdas too."""
    from pyspark.sql import functions as F

    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


FEW = 10_000


def few_rows(df: DataFrame, most: int = FEW) -> DataFrame:
    """A checkpointed copy, marked for broadcast only if it is found to have ``most`` rows at most."""
    from pyspark.sql import functions as F

    kept = checkpoint(df)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept
