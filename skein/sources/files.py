"""Files as sources and sinks: scans by kind, encrypted exports with a manifest and their restore, cached tables with an age."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: rounds of the key derivation.
ROUNDS = 600_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can see something at a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", missing_ok: bool = False, **options: str) -> DataFrame:
    """The rows of a file of a kind (json, csv, parquet, orc, text; another one counts as parquet), read under a schema; none where it is missing and may be."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).format(kind if kind in ("json", "csv", "orc", "text") else "parquet").load(path)


def read_sources(spark: SparkSession, sources: list[dict], schema: StructType | str) -> DataFrame:
    """Rows of all sources, each read by its own kind: dicts with key, path, and kind and options where they aren't the usual. Adds source_key."""
    parts = [read(spark, x["path"], schema, x.get("kind", "parquet"), x.get("missing_ok", False), **x.get("options", {})).withColumn("source_key", F.lit(x["key"])) for x in sources]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A relational table; with a numeric key in `parts` ranges that are read side by side. Filters and columns reach the database."""
    ranged = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)} if key else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranged, **options).load()


def derived_key(passphrase: str, salt: bytes, rounds: int = ROUNDS) -> Column:
    """A 256-bit key from a passphrase, as a literal."""
    return F.unhex(F.lit(hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds).hex()))


def sealed(text: Column, key: Column) -> Column:
    """A text under AES-GCM, as base64; each row has an initial vector of its own."""
    return F.translate(F.base64(F.aes_encrypt(text, key, F.lit("GCM"))), "\r\n", "")


def opened(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key, F.lit("GCM")).cast("string")


def export(tables: dict[str, DataFrame], folder: str, passphrase: str | None = None) -> DataFrame:
    """Write each table as JSON lines to a new folder, sealed line by line under a passphrase's key if there is one, and a manifest, which is returned:
    (name, n, schema). A table's rows keep their nulls."""
    spark = next(iter(tables.values())).sparkSession
    key = derived_key(passphrase, folder.encode()) if passphrase else None
    found = []
    for name, df in sorted(tables.items()):
        line = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
        df.select((sealed(line, key) if passphrase else line).alias("value")).write.text(f"{folder}/{name}")
        found.append((name, spark.read.text(f"{folder}/{name}").count(), df.schema.json()))
    manifest = spark.createDataFrame(found, "name string, n long, schema string")
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return spark.read.schema("name string, n long, schema string").json(f"{folder}/manifest")


def restore(spark: SparkSession, folder: str, passphrase: str | None = None) -> dict[str, DataFrame]:
    """The tables of an export; a table that has lost rows is an error."""
    out = {}
    for row in spark.read.schema("name string, n long, schema string").json(f"{folder}/manifest").collect():
        lines = spark.read.text(f"{folder}/{row.name}")
        if lines.count() != row.n:
            raise ValueError(f"{row.name} has {lines.count()} rows instead of {row.n}")
        line = opened(F.col("value"), derived_key(passphrase, folder.encode())) if passphrase else F.col("value")
        schema = StructType.fromJson(json.loads(row.schema))
        out[row.name] = lines.select(F.from_json(line, schema).alias("x")).select("x.*")
    return out


def cached(spark: SparkSession, folder: str, make, now: str, hours: float) -> DataFrame:
    """make()'s rows from a folder, written anew when those there are older than so many hours at `now`, or missing. Versions are folders named by their
    time; readers of an older one aren't disturbed."""
    stamp = now.replace(":", "").replace(" ", "T")
    schema = "at string, path string"
    known = read(spark, f"{folder}/index", schema, "json", missing_ok=True)
    age = F.timestamp_diff("SECOND", F.col("at").cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")) / 3600.0
    last = known.where((age >= 0) & (age < hours)).orderBy(F.desc("at")).first()
    if last is None:
        make().write.mode("overwrite").parquet(f"{folder}/{stamp}")
        spark.createDataFrame([(now, f"{folder}/{stamp}")], schema).coalesce(1).write.mode("append").json(f"{folder}/index")
        return spark.read.parquet(f"{folder}/{stamp}")
    return spark.read.parquet(last.path)
