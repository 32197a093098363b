"""Fingerprints of files and folders by content, such as those of a model's weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block, the leaf of a file's digest tree.
BLOCK_BYTES = 4 << 20


def file_digests(spark: SparkSession, path: str, pattern: str | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """``name`` (below the path), ``size`` and ``digest`` of every file of a tree that is not empty; a file may have up to 2 GB.

    A file's digest is that of its size and of the digests of its blocks in order, each with its place.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    root = F.lit(path.rstrip("/").split("://")[-1].split(":")[-1])
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    name = F.regexp_replace(F.when(plain.startswith(root), F.substring(plain, F.length(root) + 1, F.length(plain))).otherwise(F.element_at(F.split(plain, "/"), -1)), "^/+", "")
    places = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("length") / block) - 1, F.lit(0).cast("bigint")))
    blocks = F.transform(places, lambda i: F.sha2(F.concat(i.cast("string").cast("binary"), F.lit(":").cast("binary"), F.substring(F.col("content"), (i * block + 1).cast("int"), F.lit(block))), 256))
    return files.select(name.alias("name"), F.col("length").alias("size"), F.sha2(F.concat_ws(" ", F.col("length").cast("string"), F.array_join(blocks, " ")), 256).alias("digest"))


def content_fingerprint(spark: SparkSession, path: str, pattern: str | None = None, block: int = BLOCK_BYTES) -> str:
    """The root: of the names, sizes and digests of all files, whatever the order in which they were read or the folder's own place."""
    leaves = file_digests(spark, path, pattern, block).select(F.concat_ws("\t", "name", F.col("size").cast("string"), "digest").alias("l"))
    return leaves.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("root")).head()["root"]
