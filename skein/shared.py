"""Tables in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset a new local one, which only a local master can use: elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _local[app] = _local.get(app) or "file://" + tempfile.mkdtemp(prefix="skein-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(label: str) -> str:
    """A label of its own, to settle tables under it (f"{name}/rows") that `discard` removes at once."""
    return f"{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, name: str) -> None:
    """Remove the tables settled under a scratch label. Nothing that is still to be read may rest on them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}/{name}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def connected(edges: DataFrame, label: str, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in edges. Min labels spread and jump until nothing changes; each
    round is a written table, the join inputs are plain scans so that adaptive execution can split a hub's rows, and mins combine map-side."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = settle(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{label}-edges")
    near = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("least"))
    labels = settle(near.select("id", F.least("id", "least").alias("component")), f"{label}-labels")
    while True:
        # a component tells its members what it is part of, as an edge would: one join spreads labels and jumps
        told = both.unionByName(labels.where("component <> id").select(F.col("component").alias("u"), F.col("id").alias("v")))
        said = told.join(labels, told.u == labels.id).select(F.col("v").alias("id"), "component").unionByName(labels)
        after = settle(said.groupBy("id").agg(F.min("component").alias("component"), F.max("component").alias("worst")), f"{label}-labels")
        if after.where("component <> worst").isEmpty():
            return after.select("id", "component")
        labels = after.select("id", "component")
