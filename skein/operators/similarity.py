"""Title fingerprints and vector operators on Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

#: Parts that a 64-bit fingerprint is cut into: with up to eleven differing bits one of four parts has two at most.
PARTS = 4


def fingerprints(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, h): 64-bit similarity hash of word pairs: a bit is set where more pairs' hashes have it set than not. A text without words that count
    has the empty pair. Row by row: nothing is shuffled."""
    words = F.filter(T.tokens(text), lambda t: ~t.isin(T.STOP))
    pairs = rows.select(key, F.when(F.size(words) > 0, T.shingles(words)).otherwise(F.array(F.lit(""))).alias("pairs"))
    hashed = pairs.select(key, F.transform("pairs", lambda p: F.conv(F.substring(F.md5(p), 17, 16), 16, -10).cast("long")).alias("x"))
    votes = "aggregate(x, array_repeat(0, 64), (n, v) -> transform(n, (m, i) -> m + IF((shiftright(v, i) & 1) = 1, 1, -1)))"
    return hashed.select(key, F.expr(f"aggregate(transform({votes}, (m, i) -> IF(m > 0, shiftleft(1L, i), 0L)), 0L, (h, b) -> h | b)").alias("h"))


def near_pairs(prints: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(a, b, apart): fingerprints within `most` bits. Equal ones are one row; either side offers its parts as they are and with each one bit
    turned, so that parts two bits apart meet; an equality join proposes and the bit count decides. most must be below 3 * PARTS. A row makes
    17 * PARTS probes, which no size estimate knows of: the join is told to merge, else it may broadcast them all through the driver."""
    if most >= 3 * PARTS:
        raise ValueError("most must be below 3 * PARTS")
    kinds = prints.groupBy("h").agg(F.min(key).alias("rep"))
    width = 64 // PARTS
    near = []
    for i in range(PARTS):
        part = f"shiftright(h, {width * i}) & {(1 << width) - 1}"
        near += [f"cast({part} as int) | {i << width}", *[f"cast(({part}) ^ {1 << bit} as int) | {i << width}" for bit in range(width)]]
    probes = kinds.select("rep", "h", F.explode(F.expr(f"array({', '.join(near)})")).alias("probe")).hint("merge")
    x, y = (probes.withColumnsRenamed({"rep": n, "h": f"h{n}"}) for n in ("a", "b"))
    apart = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return x.join(y, "probe").where((F.col("a") < F.col("b")) & (apart <= most)).select("a", "b", apart.alias("apart")).distinct()


def members(prints: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, rep, n_links) for every row: the smallest key of its fingerprint, which near_pairs' rows name, and how many other rows are linked to
    it: those of its own fingerprint and of all that pairs has next to it. Sizes are added up by fingerprint; rows never meet."""
    kinds = prints.groupBy("h").agg(F.min(key).alias("rep"), F.count("*").alias("n"))
    sizes = kinds.select("rep", "n")
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    beside = ends.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("n").alias("beside"))
    linked = kinds.join(beside, "rep", "left").select("h", "rep", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
    return prints.select(key, "h").join(linked, "h").select(key, "rep", "n_links")


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, mean): the members' mean vector at length one."""
    per = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = per.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    norm = F.sqrt(T.dot(F.col("mean"), F.col("mean")))
    return lists.select(group, F.transform("mean", lambda m: m / norm).alias("mean"))


def block_pairs(rows: DataFrame, key: str, group: Sequence[str], most: int) -> DataFrame:
    """rows (key, span, group, ...) once for each pair of blocks that they are in, with p, apart, q, left and right: each group's span is dealt to blocks of about
    `most` rows, and each of its blocks p meets each block q of the span itself (apart 0) and of the next one (apart 1). left: the row is in p; right: in q."""
    at = ["span", *group]
    parts = rows.groupBy(*at).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    ahead = parts.select((F.col("span") - 1).alias("span"), *group, F.col("parts").alias("ahead"))
    behind = parts.select((F.col("span") + 1).alias("span"), *group, F.col("parts").alias("behind"))
    dealt = rows.join(parts, at).join(ahead, at, "left").join(behind, at, "left").withColumn("own", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    own = F.col("own")
    meets = lambda n, f: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), f)
    pair = lambda span, p, apart, q, left, right: F.struct(span.alias("span"), p.alias("p"), F.lit(apart).alias("apart"), q.alias("q"), left.alias("left"), right.alias("right"))
    same = meets(F.col("parts"), lambda i: pair(F.col("span"), F.least(own, i), 0, F.greatest(own, i), own <= i, own >= i))
    later = meets(F.col("ahead"), lambda i: pair(F.col("span"), own, 1, i, F.lit(True), F.lit(False)))
    before = meets(F.col("behind"), lambda i: pair(F.col("span") - 1, i, 1, own, F.lit(False), F.lit(True)))
    kept = [k for k in rows.columns if k != "span"]
    return dealt.select(*kept, F.explode(F.concat(same, later, before)).alias("k")).select(*kept, "k.*")
