"""Tables that are written in place: keyed merges, days replaced, partitions dropped by age, and a log of revisions that readers resume from.

A table is a folder of Parquet files in partitions of one column. A write goes to a staging table first and then over the partitions that it touches,
so it may be run again, after a failure or by mistake, with the same result: what is written depends on stored rows by key and on the changes only.
Two writers must not merge into one partition at the same time; the log of revisions is for writers side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.shared import settle
from skein.sources.files import exists


def _folders(spark: SparkSession, path: str, part: str) -> dict[str, str]:
    """Folder names of a table's partitions by their value as text."""
    if not exists(spark, path):
        return {}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if x.isDirectory()]
    return {n.split("=", 1)[1]: n for n in names if n.startswith(f"{part}=")}


def _remove(spark: SparkSession, path: str, folders: list[str]) -> None:
    for name in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _over(rows: DataFrame, path: str, part: str) -> None:
    """Write rows over the partitions that they are in, and over no other. A task takes some partitions, so files are few."""
    rows.repartition(F.col(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def load(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table's rows in like's columns; none where nothing has been written."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns) if exists(spark, path) else spark.createDataFrame([], like.schema)


def merge(path: str, changes: DataFrame, keys: list[str], part: str, gone: str | None = None, label: str = "merge", keep_old: list[str] | None = None) -> None:
    """Bring changes into the table: a row replaces the stored one with its keys or is added; with the flag column gone it removes it. part must be
    decided by the keys (they hold it or it is a function of them). Columns in keep_old keep the stored value where the change has null. Keys are
    unique in changes and not null. Only partitions that changes touch are read and written; a partition that becomes empty goes."""
    spark, columns = changes.sparkSession, [c for c in changes.columns if c != gone]
    changes = settle(changes.withColumn("_change", F.lit(1)), f"{label}-changes")
    touched = changes.select(part).distinct()
    old = load(spark, path, changes.select(*columns)).join(touched, part, "left_semi")
    new = changes.withColumnsRenamed({c: f"_new_{c}" for c in columns})
    both = old.join(new, [old[k] == new[f"_new_{k}"] for k in keys], "full")
    if gone:
        both = both.where(F.col("_change").isNull() | ~F.coalesce(gone, F.lit(False)))
    kept = set(keep_old or [])
    take = lambda c: F.coalesce(f"_new_{c}", c) if c in kept else F.when(F.col("_change").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c))
    staged = settle(both.select(*[take(c).alias(c) for c in columns]), f"{label}-staged")
    _over(staged, path, part)
    empty = touched.join(staged.select(part).distinct(), part, "left_anti").select(F.col(part).cast("string").alias("x")).collect()  # a row an emptied partition
    here = _folders(spark, path, part)
    _remove(spark, path, [here[r.x] for r in empty if r.x in here])


def replace(path: str, rows: DataFrame, part: str, values: list[str], label: str = "replace") -> None:
    """Put rows in the place of the partitions named by values: all of these that rows don't fill go. Rows of other partitions aren't written."""
    spark = rows.sparkSession
    staged = settle(rows.where(F.col(part).cast("string").isin(values)), f"{label}-staged")
    _over(staged, path, part)
    filled = {r.x for r in staged.select(F.col(part).cast("string").alias("x")).distinct().collect()}  # of values, which were named one by one
    here = _folders(spark, path, part)
    _remove(spark, path, [here[v] for v in values if v in here and v not in filled])


def drop_before(spark: SparkSession, path: str, part: str, least: str) -> list[str]:
    """Drop the partitions whose value, as text, is below least; no file is read. Days in ISO form are in order as text."""
    here = _folders(spark, path, part)
    gone = sorted(v for v in here if v < least)
    _remove(spark, path, [here[v] for v in gone])
    return gone


# -- a log of revisions ------------------------------------------------------------------------------------------------------------------------


def record(path: str, changes: DataFrame, revision: int) -> None:
    """Write changes, with a flag column gone, as a revision: a partition of the log. A revision is written once; the same one again takes its place."""
    changes.withColumn("revision", F.lit(revision).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("revision").parquet(path)


def since(spark: SparkSession, path: str, like: DataFrame, watermark: int, overlap: int = 0) -> DataFrame:
    """Changes of the revisions from watermark - overlap on, each with its revision. A writer that took its revision before another may finish after it,
    so a reader looks back over as many revisions as can be in flight; applying a change twice does no harm."""
    schema = like.withColumn("revision", F.lit(0).cast("long")).schema
    rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return rows.where(F.col("revision") >= watermark - overlap)


def newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's last change. A key that changes in every revision is summed up map-side: no window holds its history."""
    last = F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), "revision")
    return changes.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def follow(copy: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A reader's copy, with the revision of each row, after changes of its log: a key's newest revision wins, a removed row stays as its last revision with
    gone set, so that an older change that is read later doesn't bring it back."""
    return newest(copy.unionByName(changes), keys)
