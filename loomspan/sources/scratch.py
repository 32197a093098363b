"""Tables for intermediate results, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where none is set, a temporary one is made for a local master, whose executors are the driver; on a cluster that
    would be a folder of one machine, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loomspan-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written to the shared folder, to cut lineage so that a lost executor costs one stage only.

    Tables that no later step reads are dropped as soon as that is known; those that a returned DataFrame still reads
    are removed when the driver ends, since only then is it known that nobody reads them any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/loomspan/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, tag: str = "t") -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back; its shuffle files go as soon as it is written."""
        self.n += 1
        path, conf = f"{self.base}/{self.n:03d}-{tag}", self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        if self.n == 1:
            folder, fs = self._folder(self.base)
            fs.deleteOnExit(folder)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loomspan_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later result reads."""
        for t in tables:
            folder, fs = self._folder(t._loomspan_path)
            fs.delete(folder, True)

    def _folder(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self, tag: str) -> str:
        """The path of a new folder, for writers of other formats; removed when the driver ends."""
        self.n += 1
        path, fs = self._folder(f"{self.base}/{self.n:03d}-{tag}")
        fs.mkdirs(path.getParent())
        base, _ = self._folder(self.base)
        fs.deleteOnExit(base)
        return path.toString()
