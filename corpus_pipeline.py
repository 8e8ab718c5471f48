"""A corpus from documents: quality, exact and near dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.bpe import encode
from seqloom.llm.common import cut, marked, shared_dir, table
from seqloom.llm.exact import deduplicated
from seqloom.llm.mixing import mixed_documents
from seqloom.llm.ngrams import classes_of
from seqloom.llm.quality import fit, score
from seqloom.llm.queries import bpe_file, held_out
from seqloom.session import ship

#: Documents with a lower score go.
KEEP_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    net = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out(4, 2))
    name = f"score_{uuid.uuid4().hex}"  # docs may have any columns
    return score(docs, net, name=name).filter(F.col(name) >= KEEP_SCORE).drop(name)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8; the smallest doc_id of each group stays, rows that share it together."""
    ship(spark)
    classes = classes_of(docs, k=5, percent=80).select(F.col("doc_id").alias("key"), (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("goes"))
    gone = cut(classes.filter("goes").select("key").distinct(), "near-copies")
    # Rows that certainly stay, by their key's hash bucket, aren't shuffled.
    rows = marked(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key")), gone, ["key"], "maybe")
    left = rows.filter("maybe").alias("r").join(gone.alias("g"), F.col("r.key").eqNullSafe(F.col("g.key")), "left_anti")
    return rows.filter("not maybe").select("row").unionByName(left.select("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes twice come twice."""
    ship(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of what the ids decode to."""
    ship(spark)
    out = encode(docs, bpe_file(), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources", mix),
    ("BPE encoding", tokens),
]

#: A trained network isn't SQL; the stages after it are tested against brute force on its output.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
