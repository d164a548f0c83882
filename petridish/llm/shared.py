"""Spark helpers of the pipeline operators: materialised steps, components, shard numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petridish.session import checkpoint_dir

#: Spark's setting to remove shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _folder(spark: SparkSession) -> str:
    """The shared folder for intermediate results, below the one that the session names."""
    checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small frame with checkpoint()."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large frame: write it to the shared folder as Parquet and read it.

    Nothing reads the shuffles of this write again, so Spark removes their files when it ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4()}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def carrying(docs: DataFrame, carry: list[str] | None) -> tuple[DataFrame, str]:
    """doc_id and text, with columns to bring along in `row`; and a schema to put more between.

    With columns to bring along the text comes back as well, so it isn't to be among them.
    """
    given = docs.select("doc_id", "text", *([F.struct(*carry).alias("row")] if carry else []))
    kind = lambda c: given.schema[c].dataType.simpleString()
    more = f", text string, row {kind('row')}" if carry else ""
    return given, f"doc_id {kind('doc_id')}, {{}}{more}"


def shard_count(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that is linked with each end of an edge.

    Edges are contracted until none is left: in each round every node goes to the least of its
    neighbours and itself, in the natural order in even rounds (a star is done in one) and in the
    order of a fresh hash in odd rounds, which shrinks any graph by a constant factor as expected
    (long chains too). No round collects a neighbourhood; all steps are minima and equi-joins, and
    the end test, no edge left, is exact.
    """
    left = written(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    )
    nodes = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
    at = nodes.withColumn("rep", F.col("node"))
    turn = 0
    while not left.isEmpty():
        both = left.union(left.select("v", "u")).toDF("u", "v")
        if turn % 2:
            key = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("x"))
        else:
            key = lambda c: F.struct(c.alias("x"))
        step = both.groupBy("u").agg(F.min(key(F.col("v"))).alias("m"))
        step = written(
            step.select("u", F.least("m", key(F.col("u")))["x"].alias("to")).filter("u <> to")
        )
        moved = step.select(F.col("u").alias("rep"), "to")
        at = written(
            at.join(moved, "rep", "left").select("node", F.coalesce("to", "rep").alias("rep"))
        )
        left = left.join(step, "u", "left").select(F.coalesce("to", "u").alias("u"), "v")
        left = left.join(step.toDF("v", "to"), "v", "left").select(
            "u", F.coalesce("to", "v").alias("v")
        )
        left = written(left.filter("u <> v").distinct())
        turn += 1
    least = at.groupBy("rep").agg(F.min("node").alias("component"))
    return at.join(least, "rep").select("node", "component")
