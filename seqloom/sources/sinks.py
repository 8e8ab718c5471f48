"""Sinks: appended CSV, manifests of contents, and an inventory of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a folder of CSV files, each with a header."""
    df.write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def manifest(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys, bytes, sha256 of binary contents."""
    return df.select(*keys, F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, bytes, sha256 of every file under a path; kind by the first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.decode(F.substring("content", 1, 4), "iso-8859-1")
    kind = F.when(head == "PAR1", "parquet").when(head == "RIFF", "riff").when(F.startswith(head, F.lit("PK")), "zip").when(F.startswith(head, F.lit("{")), "json").otherwise("other")
    return files.select("path", kind.alias("kind"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
