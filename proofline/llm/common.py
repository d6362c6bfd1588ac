"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A public byte-pair model of 32,000 pieces; any other of its kind will do.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python this many rows at once: texts may be long, and all are in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def give_back() -> None:
    """Return memory a task has freed to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # One machine is the whole cluster, as in tests.
        base = f"file://{tempfile.mkdtemp(prefix='proofline-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """``df`` written once to the shared folder and read back, its lineage cut."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables a job writes on its way, in a folder of its own in the shared one.

    ``drop`` removes those that nothing reads any more; what a returned frame still
    reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.parts = spark, shared_folder(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.parts += 1
        path = f"{self.base}/{self.parts}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove the tables behind these frames, as ``keep`` returned them."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lowest_by_hash(df: DataFrame, id: str, most: int, *ties: str) -> DataFrame:
    """At most ``most`` rows: those whose id hashes lowest.

    Rows that cannot be among them are dropped where they are read, so what
    meets in one task does not grow with the input.
    """
    h = F.xxhash64(id)
    share = 1.5 * most / max(1, df.count())
    if share < 1:
        df = df.where(h < F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(h, id, *ties).limit(most)


def remainder_of_id(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % by
