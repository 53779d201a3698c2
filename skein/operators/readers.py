"""Reader analytics: visitor profiles, automated-visit tagging, engagement and daily panels.

A visitor is coalesce(visitor, session); a view is automated when the visitor did nothing else, came direct and is in a bot-heavy zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of an event type in an article's engagement; caps of one session's dwell and of its other events.
EVENT_WEIGHTS = {"view": 1.0, "click_source": 3.0, "dwell": 1.0 / 30.0, "share": 5.0, "save": 4.0, "follow": 2.0, "newsletter_click": 2.0, "comment": 4.0}
DWELL_CAP, OTHER_CAP = 600.0, 1.0
#: Seconds below which a dwell is what a closing page sends by itself.
PASSIVE_SECONDS = 10


def since(now: str, days: int) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL '{days}' DAY")


def passive() -> Column:
    return (F.col("type") == "dwell") & (F.col("value") < PASSIVE_SECONDS)


def did_something() -> Column:
    return (F.col("type") != "view") & ~passive()


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def visitor_profiles(events: DataFrame, now: str, short: int = 7, long: int = 30) -> DataFrame:
    """One row a visitor over the long window."""
    recent = events.where(F.col("ts") >= since(now, long))
    return recent.groupBy("who").agg(
        F.max("tz").alias("tz"), n_if(did_something()).alias("acts"), n_if(F.col("type") == "view").alias("views"),
        F.max(F.coalesce("source", F.lit("direct"))).alias("src"), n_if(F.col("ts") >= since(now, short)).alias("recent"),
    )


def zone_counts(profiles: DataFrame) -> DataFrame:
    """Visitors and bare visitors (one direct view, nothing else) a zone, over both windows."""
    bare, recent = F.expr("acts = 0 AND views = 1 AND src = 'direct'"), F.col("recent") > 0
    return profiles.where("views > 0 AND tz IS NOT NULL").groupBy("tz").agg(
        F.count("*").alias("visitors"), n_if(bare).alias("bare"), n_if(recent).alias("visitors_recent"), n_if(bare & recent).alias("bare_recent")
    )


def bot_heavy_zones(zones: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    heavy = lambda n, b: (F.col(b) >= least) & (F.col(b) >= share * F.col(n))
    return zones.where(heavy("visitors", "bare") | heavy("visitors_recent", "bare_recent")).select("tz")


def tagged(events: DataFrame, zones: DataFrame, start: str, until: str | None = None) -> DataFrame:
    """Events of the period with auto, 1 on a likely automated view. Visitors are judged a day to either side of the period; the trim comes
    after the window, which must see the wider rows."""
    wide = events.where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{start}' - INTERVAL '1' DAY"))
    if until:
        wide = wide.where(F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{until}' + INTERVAL '1' DAY"))
    by = Window.partitionBy("who")
    alone = (n_if(F.col("type") == "view").over(by) == 1) & (n_if(did_something()).over(by) == 0) & (n_if(F.coalesce("source", F.lit("direct")) != "direct").over(by) == 0)
    marked = wide.withColumn("alone", alone).join(zones.select(F.col("tz").alias("zone")), F.col("tz") == F.col("zone"), "left")
    auto = F.when(((F.col("type") == "view") | passive()) & F.col("alone") & F.col("zone").isNotNull(), 1).otherwise(0)
    rows = marked.withColumn("auto", auto).drop("alone", "zone").where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{start}'"))
    return rows.where(F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{until}'")) if until else rows


def engagement(events: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Engagement an article: a session counts once a type and day, its dwell up to DWELL_CAP seconds, its other events up to OTHER_CAP."""
    weights = EVENT_WEIGHTS if weights is None else weights
    per = events.groupBy("article_id", "type", "session", "day").agg(F.sum("value").alias("total"), F.max("value").alias("top"))
    value = F.when(F.col("type") == "dwell", F.least("total", F.lit(DWELL_CAP))).otherwise(F.least(F.coalesce("top", F.lit(1.0)), F.lit(OTHER_CAP)))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return per.withColumn("w", F.try_element_at(table, F.col("type"))).where("w IS NOT NULL").groupBy("article_id").agg(F.sum(value * F.col("w")).alias("engagement"))


def daily_panel(events: DataFrame) -> DataFrame:
    """Views, automated views, visitors, reading sessions and sums by type, a day. events: tagged."""
    real = F.col("auto") == 0
    view = F.col("type") == "view"
    return events.groupBy("day").agg(
        n_if(view & real).alias("views"), n_if(view & ~real).alias("automated"),
        F.count_distinct(F.when(view & real, F.col("who"))).alias("visitors"),
        F.count_distinct(F.when((F.col("type") == "dwell") & real, F.concat("session", F.lit("|"), F.col("story_id").cast("string")))).alias("readings"),
        n_if((F.col("type") == "click_source") & real).alias("clicks"), n_if(F.col("type") == "follow").alias("follows"), n_if(F.col("type") == "search").alias("searches"),
    )
