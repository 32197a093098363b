"""Sinks: partitioned tables, CSV that survives any text, JSON lines, and checks by reading back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(rows: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """One folder per group; only the groups written are replaced, so results of one model can be added at a time.

    Rows are rebalanced, so that a large group is written by several tasks.
    """
    out = rows.hint("rebalance", *by) if by else rows
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.format(fmt).save(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; newlines and quotes in texts survive a round trip."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_json(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_envelope(rows: DataFrame, path: str, experiment: str, config: dict[str, str]) -> None:
    """The fact table of a run, and beside it one row that says what it is."""
    rows.write.mode("overwrite").parquet(f"{path}/cells")
    spark = rows.sparkSession
    told = spark.range(1).select(F.lit(experiment).alias("experiment"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.create_map(*[F.lit(x) for kv in config.items() for x in kv]).alias("config") if config else F.create_map().cast("map<string,string>").alias("config"))
    told.write.mode("overwrite").json(f"{path}/envelope")


def verified(spark: SparkSession, path: str, schema: str, rows: int, numeric: list[str]) -> DataFrame:
    """Reads a written CSV back and fails unless it has as many rows and all its numbers are numbers."""
    text = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    bad = F.lit(False)
    for c in numeric:
        bad = bad | F.col(c).try_cast("double").isNull()
    seen = text.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).head()
    if seen["n"] != rows or seen["bad"]:
        raise ValueError(f"{path}: {seen['n']} rows of {rows}, {seen['bad']} with broken numbers")
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def build_report(rows: DataFrame, dropped: DataFrame, by: list[str]) -> DataFrame:
    """Rows, distinct systems and documents, mean score and dropped rows of each set."""
    made = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("system").alias("systems"), F.count_distinct("doc_id").alias("docs"), F.avg("score").alias("mean_score"))
    gone = dropped.groupBy(*by).agg(F.count(F.lit(1)).alias("dropped"))
    return made.join(gone, by, "left").na.fill(0, ["dropped"])


def yaml_lines(value, indent: int = 0) -> list[str]:
    """Nested dictionaries, lists and plain values as YAML, in their order; texts are quoted as JSON, which YAML reads."""
    pad, out = "  " * indent, []
    for key, v in value.items() if isinstance(value, dict) else [(None, v) for v in value]:
        lead = f"{pad}{key}:" if key is not None else f"{pad}-"
        if isinstance(v, (dict, list, tuple)) and v:
            out += [lead, *yaml_lines(v, indent + 1)]
        else:
            out.append(f"{lead} {json.dumps(v if not isinstance(v, tuple) else list(v), ensure_ascii=False)}")
    return out


def write_yaml(spark: SparkSession, path: str, config: dict) -> None:
    """A configuration as one text file in a folder."""
    text = "\n".join(yaml_lines(config))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
