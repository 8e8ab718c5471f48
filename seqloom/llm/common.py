"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: The bytes that every contract here calls white space: space and the five ASCII controls 9 to 13.
WS = b" \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it nor lose it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables from cut() that no later step reads, and let Spark drop the shuffles that nothing refers to."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    for t in tables[:1]:
        t.sparkSession._jvm.System.gc()  # Spark's cleaner follows the driver's collector


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Hash buckets of keys in prefiltered() and marked(); what is broadcast has at most one row for each.
BUCKETS = 1 << 20


def marked(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows and a boolean: may its columns `on` be among keys? False is certain.

    The buckets are broadcast; there are BUCKETS at most, whatever the size of the tables. An exact join must follow.
    """
    bucket = f"bucket_{uuid.uuid4().hex}"
    of = F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).alias(bucket)
    wanted = keys.select(of).distinct().withColumn(name, F.lit(True))
    found = rows.withColumn(bucket, F.pmod(F.xxhash64(*on), F.lit(BUCKETS))).join(F.broadcast(wanted), bucket, "left")
    return found.withColumn(name, F.coalesce(name, F.lit(False))).drop(bucket)


def prefiltered(rows: DataFrame, keys: DataFrame, on: list[str] | None = None) -> DataFrame:
    """The rows whose key shares a hash bucket with one of keys: few texts move where few are wanted; see marked()."""
    on, bucket = on or ["key"], f"bucket_{uuid.uuid4().hex}"
    wanted = keys.select(F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).alias(bucket)).distinct()
    return rows.withColumn(bucket, F.pmod(F.xxhash64(*on), F.lit(BUCKETS))).join(F.broadcast(wanted), bucket, "left_semi").drop(bucket)


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    """rows joined with keyed, where keys of `heavy` may have any share of rows.

    Rows of these keys are dealt over all shuffle partitions, and what keyed has for them is copied to each; so heavy
    keys should have far more rows than there are partitions.
    """
    flag, salt, n = f"heavy_{uuid.uuid4().hex}", f"salt_{uuid.uuid4().hex}", n_parts(rows.sparkSession)
    dealt = F.when(F.col(flag), F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int")).otherwise(F.lit(0))
    left = marked(rows, heavy, on, flag).withColumn(salt, dealt)
    right = marked(keyed, heavy, on, flag).withColumn(salt, F.explode(F.when(F.col(flag), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    return left.drop(flag).join(right.drop(flag), [*on, salt]).drop(salt)
