"""Version folding: a model that is named without its version is the same launch as the one with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.models import VERSION
from skein.shared import settle


def version_parents(keys: DataFrame) -> DataFrame:
    """(key, parent): for each key `name|lab` that another one of its lab extends by a version, the shortest such; of equal lengths the smallest.

    A longer key offers every shorter one that it extends: the digits and dots at its name's end are cut at each digit, and before a v. So
    keys meet by equality, a key's offers are as many as its version has digits, and no pair of keys of a lab is tried."""
    name, lab = F.substring_index("key", "|", 1), F.substring_index("key", "|", -1)
    tail = F.regexp_extract(name, r"v?[0-9][0-9.]*$", 0)
    cuts = F.transform(F.sequence(F.lit(0), F.length(tail)), lambda i: i + F.length(name) - F.length(tail))
    short = F.filter(F.transform(cuts, lambda n: F.substring(name, F.lit(1), n)), lambda s: (s != "") & (s != name) & F.substring(name, F.length(s) + 1, F.length(name)).rlike(f"^{VERSION}$"))
    offers = keys.select(F.col("key").alias("parent"), lab.alias("lab"), F.explode(short).alias("name")).select("parent", F.concat_ws("|", "name", "lab").alias("key"))
    found = offers.join(keys.select("key"), "key").groupBy("key").agg(F.min(F.struct(F.length("parent").alias("n"), "parent"))["parent"].alias("parent"))
    return found.select("key", "parent")


def fold_versions(rows: DataFrame, label: str = "folding") -> DataFrame:
    """(key, sources, first_at, folded): rows (key, sources, first_at), each folded into the key that extends its name by a version, as far as that goes;
    sources add up, the earliest date stays, folded counts the rows. A row that nothing folds into and that has no date leaves the date open
    wherever it is folded. Keys are taken to be distinct. Chains are followed by pointer doubling."""
    rows = settle(rows.select("key", "sources", "first_at"), f"{label}-rows")
    steps = settle(version_parents(rows), f"{label}-steps")
    leaf = rows.join(steps.select(F.col("parent").alias("key")).distinct(), "key", "left_anti").where("first_at IS NULL").select("key", F.lit(True).alias("undated"))
    while True:
        on = steps.select(F.col("key").alias("parent"), F.col("parent").alias("up"))
        after = settle(steps.join(on, "parent", "left").select("key", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")), f"{label}-steps")
        steps = after.select("key", "parent")
        if after.where("moved").isEmpty():
            break
    named = rows.join(steps, "key", "left").join(leaf, "key", "left")
    open_date = F.max(F.coalesce("undated", F.lit(False)) & F.col("parent").isNotNull())
    folded = named.groupBy(F.coalesce("parent", "key").alias("key")).agg(F.sum("sources").alias("sources"), F.min("first_at").alias("least"), open_date.alias("open"), F.count("*").alias("folded"))
    return folded.select("key", "sources", F.when(~F.col("open"), F.col("least")).alias("first_at"), "folded")
