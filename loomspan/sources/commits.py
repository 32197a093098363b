"""Results that grow run by run and survive a crash: staged folders, and an append-only log of the runs that count.

A table's folder has ``data/<run>``, ``groups/<run>`` and ``log/<version>.json``. A run's rows are written whole before its entry is made in the log, by
creating one small file that must not exist yet, a line that ends in a brace; so readers see a run entirely or not at all, and two writers get two versions. The
file system must create files atomically, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunTable:
    """A table of results by group (columns ``by``), where a later run replaces the groups that it has and leaves the others."""

    def __init__(self, spark: SparkSession, path: str, by: list[str]):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> list[tuple[int, str]]:
        """(version, run) of every committed run, the first one first."""
        folder, fs = self._fs(f"{self.path}/log")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        text = {r["f"]: r["value"] for r in self.spark.read.text([f"{self.path}/log/{n}" for n in names]).select(F.col("_metadata.file_name").alias("f"), "value").collect()} if names else {}
        return [(int(n.removesuffix(".json")), json.loads(text[n])["run"]) for n in names if text.get(n, "").endswith("}")]  # an entry cut off is none

    def stage(self, rows: DataFrame) -> str:
        """Writes the rows of a run where no reader looks; the run's id. A crash here or later leaves the table as it was."""
        run = uuid.uuid4().hex
        rows.hint("rebalance", *self.by).write.parquet(f"{self.path}/data/{run}")
        self.spark.read.parquet(f"{self.path}/data/{run}").select(*self.by).distinct().write.parquet(f"{self.path}/groups/{run}")
        return run

    def commit(self, run: str) -> int:
        """Makes a staged run count; its version. A run that counts already is left as it is."""
        known = self.log()
        for version, other in known:
            if other == run:
                return version
        version = known[-1][0] + 1 if known else 0
        while True:
            target, fs = self._fs(f"{self.path}/log/{version:012d}.json")
            try:
                out = fs.create(target, False)  # fails where another writer has made this version
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                version += 1
                continue
            out.write(bytearray(json.dumps({"run": run}).encode()))
            out.close()
            return version

    def write(self, rows: DataFrame) -> int:
        """Stages and commits a run."""
        return self.commit(self.stage(rows))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last committed run of each group, as of a version if one is given. Null groups are groups."""
        runs = [(v, run) for v, run in self.log() if version is None or v <= version]
        if not runs:
            raise FileNotFoundError(f"{self.path} has no committed run")
        name = F.element_at(F.split("_metadata.file_path", "/"), -2)
        versions = F.create_map(*[F.lit(x) for v, run in runs for x in (run, v)])
        groups = self.spark.read.parquet(*[f"{self.path}/groups/{run}" for _, run in runs])
        last = groups.select(F.struct(*self.by).alias("_g"), versions[name].alias("_v")).groupBy("_g").agg(F.max("_v").alias("_v"))
        rows = self.spark.read.parquet(*[f"{self.path}/data/{run}" for _, run in runs])
        marked = rows.withColumn("_v", versions[name]).withColumn("_g", F.struct(*self.by))
        return marked.join(last, ["_g", "_v"], "left_semi").drop("_g", "_v")

    def vacuum(self) -> int:
        """Removes staged runs that are not committed; how many. Only while nobody writes."""
        known, gone = {run for _, run in self.log()}, 0
        for kind in ("data", "groups"):
            folder, fs = self._fs(f"{self.path}/{kind}")
            for s in fs.listStatus(folder) if fs.exists(folder) else ():
                if s.getPath().getName() not in known:
                    fs.delete(s.getPath(), True)
                    gone += kind == "data"
        return gone
