"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only in plain local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Written intermediate tables of one operator call.

    ``table`` writes a frame as Parquet and reads it back, so a lost executor costs a read of files and not a
    recomputation of all earlier rounds. ``drop`` frees a table that a later one has replaced; what a result still
    reads goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        self._at: dict[int, tuple[str, DataFrame]] = {}

    def table(self, df: DataFrame) -> DataFrame:
        at = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self._at[id(out)] = at, out
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            at, _ = self._at.pop(id(df), (None, None))
            if at:
                self._fs.delete(self._path(at), True)
