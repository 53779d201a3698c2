"""Axis steps, kinds of price changes and old news. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import let

#: Days after which articles are old for a story that is shown as new, and days that the month in an address may lie back.
OLD_DAYS, OLD_URL_DAYS = 10, 62


def nice_scale(value: Column, bands: int = 4) -> Column:
    """struct<step, most>: one, two or five times a power of ten, so that about so many steps cover the value, and the first whole step that does. A step is one at
    least."""
    top = F.greatest(F.lit(1.0), value.cast("double"))
    power = F.pow(F.lit(10.0), F.floor(F.log10(top / bands)))
    share = F.round(top / bands / power, 9)
    step = F.greatest(F.lit(1.0), F.when(share <= 1, 1).when(share <= 2, 2).when(share <= 5, 5).otherwise(10) * power)
    return let(step, lambda s: F.struct(s.alias("step"), (s * F.greatest(F.lit(1), F.ceil(F.round(top / s, 9)))).alias("most")))


def ticks(scale: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.round(scale["most"] / scale["step"]).cast("int")), lambda i: i * scale["step"])


def rank_ticks(worst: Column) -> Column:
    """Ticks of an axis of ranks, from 1 to a round end at or below the worst rank."""
    w = F.greatest(F.lit(1), worst)
    fixed = {10: [1, 5, 10], 20: [1, 5, 10, 15, 20], 50: [1, 10, 20, 30, 40, 50], 100: [1, 10, 20, 40, 60, 80, 100]}  # fixed values
    out = None
    for end, marks in fixed.items():
        marks = F.array(*[F.lit(float(m)) for m in marks])
        out = F.when(w <= end, marks) if out is None else out.when(w <= end, marks)
    return out.otherwise(F.concat(F.array(F.lit(1.0)), F.filter(ticks(nice_scale(w, 5)), lambda t: t > 1)))


def change_kind(old: Column, new: Column) -> Column:
    """What changed between two observations (price, currency, free: what is free, as text): opened, where it costs nothing now or something is free that wasn't;
    rose or fell, in one currency; free, where what is free changed; else null."""
    was, now = F.trim(F.coalesce(old["free"], F.lit(""))), F.trim(F.coalesce(new["free"], F.lit("")))
    opened = ((old["price"] > 0) & (new["price"] == 0)) | ((was == "") & (now != ""))
    one = F.coalesce(old["currency"], F.lit("")) == F.coalesce(new["currency"], F.lit(""))
    return F.when(opened, "opened").when(one & (new["price"] > old["price"]), "rose").when(one & (new["price"] < old["price"]), "fell").when(was != now, "free")


def old_news(first: Column, year: Column, newest: Column, lead_at: Column, url_month: Column) -> Column:
    """Why a story that was first shown at `first` is old, or null: a year in a title, then its newest article, then its lead's date, then the month in the lead's
    address."""
    before = lambda at, days: at < first - F.make_dt_interval(F.lit(days))
    said = F.when(year.isNotNull(), F.concat(F.lit("the title says ("), year.cast("string"), F.lit(")")))
    said = said.when(before(newest, OLD_DAYS), F.concat(F.lit("its articles are from "), F.date_format(newest, "dd MMM yyyy")))
    said = said.when(before(lead_at, OLD_DAYS), F.concat(F.lit("the main article is from "), F.date_format(lead_at, "dd MMM yyyy")))
    return said.when(before(url_month, OLD_URL_DAYS), F.concat(F.lit("the article link is dated "), F.date_format(url_month, "MMM yyyy")))
