"""Writers. Every sink writes one file per task; nothing passes through the driver."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.sources.readers import ANNOT_KEYS


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files.

    On a cluster this is under the shared folder of `spark.checkpoint.dir`; the
    machine-local fallback is for local sessions only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = os.path.join(tempfile.gettempdir(), "varloom")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a small intermediate table once and go on from the file.

    For results that several later steps read (loci, tops, spans). The lineage is cut,
    and the table outlives any lost executor.
    """
    spark = df.sparkSession
    path = scratch(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps, after a `settle` that leaves large ones.

    It removes what no live frame refers to, on both sides of the bridge to the JVM. Spark's
    event queue refers to the last query until another one ends.
    """
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def sink_tsv(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    df.write.csv(path, sep=sep, header=True, mode=mode)


def sink_by_chromosome(
    df: DataFrame, path: str, order: list[str], chrom: str = "CHR", fmt: str = "csv",
) -> None:
    """One folder per chromosome, sorted inside its files.

    Rows are range-partitioned by (chromosome, sort columns), so a large chromosome
    becomes several ordered files and no task holds it whole.
    """
    keys = [chrom, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = ranged.write.partitionBy(chrom)
    if fmt == "csv":
        writer.csv(path, sep="\t", header=True)
    else:
        writer.format(fmt).save(path)


def sink_annot_gz(df: DataFrame, path: str, labels: list[str]) -> None:
    """Long (keys, label, value) to a wide gzipped matrix; absent means 0."""
    wide = df.groupBy(*ANNOT_KEYS).pivot("label", labels).agg(F.max("value")).fillna(0, subset=labels)
    wide.write.csv(path, sep="\t", header=True, compression="gzip")
