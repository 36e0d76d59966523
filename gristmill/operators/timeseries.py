"""Windows, high-low-close aggregates, trend reversals and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First day of a week as the offset of window() from Thursday 1970-01-01.
WEEK_FROM = {"monday": "4 days", "friday": "1 day"}


def week(ts: str | Column, first: str = "monday") -> Column:
    """Struct of start and end of the seven days that hold ts."""
    return F.window(ts, "7 days", "7 days", WEEK_FROM[first])


def common_friday(window_end: Column) -> Column:
    """The Friday of a week that ends on window_end (a Monday midnight)."""
    return F.date_sub(F.to_date(window_end), 3)


def high_low(df: DataFrame, keys: Sequence[str | Column], date: str = "date", price: str = "price") -> DataFrame:
    """Highest and lowest price with their dates, and both in the order of time.

    Of equal highs the earliest date counts, of equal lows the latest. first
    and second are (high, low) if the high comes before the low or a date is
    missing, else (low, high). Null prices are left out.
    """
    day = -F.unix_date(F.col(date))
    both = F.struct(F.col(price).alias("p"), day.alias("d"))
    found = df.where(F.col(price).isNotNull()).groupBy(*keys).agg(F.max(both).alias("h"), F.min(both).alias("l"))
    when = lambda c: F.date_from_unix_date(-F.col(f"{c}.d"))
    out = found.withColumns({"high": F.col("h.p"), "high_date": when("h"), "low": F.col("l.p"), "low_date": when("l")}).drop("h", "l")
    high_first = F.coalesce(F.col("high_date") < F.col("low_date"), F.lit(True))
    return out.withColumns({"first_price": F.when(high_first, F.col("high")).otherwise(F.col("low")), "second_price": F.when(high_first, F.col("low")).otherwise(F.col("high"))})


def weekly_high_low(df: DataFrame, date: str = "date", price: str = "price", series: Sequence[str] = (), first: str = "monday") -> DataFrame:
    """high_low of every week of every series; column week is the week's first day."""
    keys = [*series, F.to_date(week(F.col(date).cast("timestamp"), first)["start"]).alias("week")]
    return high_low(df, keys, date, price)


def trend(bars: DataFrame, series: Sequence[str] = (), order: str = "week") -> DataFrame:
    """Adds prev_* of the bar before and sign: 1 rising, -1 falling, 0 mixed or unchanged, null for the first bar."""
    w = Window.partitionBy(*series).orderBy(order)
    out = bars.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("high", "high_date", "low", "low_date")})
    step = lambda c: F.signum(F.col(c) - F.col(f"prev_{c}"))
    return out.withColumn("sign", F.signum(step("high") + step("low")).cast("int"))


def reversals(trended: DataFrame, series: Sequence[str] = (), order: str = "week") -> DataFrame:
    """Adds reversal (date, price): the bar before's high where the sign drops, its low where it rises, else null."""
    w = Window.partitionBy(*series).orderBy(order)
    before = F.lag("sign").over(w)
    return trended.withColumn("prev_sign", before).withColumn(
        "reversal",
        F.when(F.col("sign") < F.col("prev_sign"), F.struct(F.col("prev_high_date").alias("date"), F.col("prev_high").alias("price"))).when(
            F.col("sign") > F.col("prev_sign"), F.struct(F.col("prev_low_date").alias("date"), F.col("prev_low").alias("price"))
        ),
    )


def stacked(bars: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """(series, date, price): highs and lows of all bars as one column, read once."""
    pair = lambda d, p: F.struct(F.col(d).alias("date"), F.col(p).alias("price"))
    return bars.select(*series, F.inline(F.array(pair("high_date", "high"), pair("low_date", "low"))))


def last_price_direction(df: DataFrame, date: str, price: str, order: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """(series, common_friday, price, direction): last price of each week, 1.0 if above the week before's, else 0.0.

    order breaks ties of date. The first week has direction 0.0.
    """
    last = df.where(F.col(price).isNotNull()).groupBy(*series, week(F.col(date)).alias("w")).agg(F.max_by(price, F.struct(date, *order)).alias("price"))
    lag = F.lag("price").over(Window.partitionBy(*series).orderBy("w.start"))
    return last.select(*series, common_friday(F.col("w.end")).alias("common_friday"), "price", F.when(F.col("price") > lag, 1.0).otherwise(0.0).alias("direction"))


def weekly_text(df: DataFrame, date: str, text: str) -> DataFrame:
    """(common_friday, text): all texts of the weeks that end with a Friday, sorted and joined by blanks."""
    return df.where(F.col(text).isNotNull()).groupBy(F.date_sub(F.to_date(week(F.col(date), "friday")["end"]), 0).alias("common_friday")).agg(
        F.array_join(F.sort_array(F.collect_list(text)), " ").alias("text")
    )


def price_direction(texts: DataFrame, prices: DataFrame) -> DataFrame:
    """(common_friday, text, direction, ...): every week's text with the direction of its prices; weeks that lack one of them are left out.

    texts is what weekly_text gives, prices what last_price_direction gives (a
    row for every series and week).
    """
    return texts.join(prices, "common_friday")


def minute_sum(df: DataFrame, ts: str, tag: str, value: str) -> DataFrame:
    """(tag, minute, total): sum of value for every tag and minute."""
    return df.groupBy(F.col(tag).alias("tag"), F.date_trunc("minute", ts).alias("minute")).agg(F.sum(value).alias("total"))


def count_metrics(df: DataFrame, name: str, ts: str, tags: Sequence[str]) -> DataFrame:
    """(name, day, value, tags): rows for every combination of tags and day."""
    return df.groupBy(*tags, F.to_date(ts).alias("day")).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), "day", "value", *tags)


def mean_metrics(df: DataFrame, name: str, ts: str, value: str | Column, tags: Sequence[str]) -> DataFrame:
    """(name, day, value, tags): mean for every combination of tags and day."""
    return df.groupBy(*tags, F.to_date(ts).alias("day")).agg(F.avg(value).alias("value")).select(F.lit(name).alias("name"), "day", "value", *tags)


def visibility(tone: Column) -> Column:
    """SECRET for a tone in (0, 1.5], INTERNAL in (1.5, 2.5], else CONFIDENTIAL (null too)."""
    return F.when((tone > 0) & (tone <= 1.5), "SECRET").when((tone > 1.5) & (tone <= 2.5), "INTERNAL").otherwise("CONFIDENTIAL")


def metric_line(name: Column, ts: Column, value: Column, tags: Column, viz: Column | None = None) -> Column:
    """``put name millis value k=v ...`` with the visibility first and tags by name."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    if viz is not None:
        pairs = F.concat(F.when(viz.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("viz="), viz))), pairs)
    return F.concat_ws(" ", F.lit("put"), name, F.unix_millis(ts.cast("timestamp")).cast("string"), value.cast("string"), F.array_join(pairs, " "))


def aligned(points: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """(key, day, value): every key on every day from the first to the last of the table; null where it has no point."""
    days = points.agg(F.explode(F.sequence(F.min(day), F.max(day))).alias("day"))
    spine = points.select(F.col(key).alias("key")).distinct().crossJoin(F.broadcast(days))
    return spine.join(points.select(F.col(key).alias("key"), F.col(day).alias("day"), F.col(value).alias("value")), ["key", "day"], "left")


def sliding_counts(df: DataFrame, ts: str, key: str, length: str = "48 hours", slide: str = "12 hours") -> DataFrame:
    """(window_start, window_end, key, n): rows of every key in every sliding window."""
    return df.groupBy(F.window(ts, length, slide).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "n"
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of every group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
