"""Calendar slices, budgets and stuck rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar_slices(ranges: DataFrame, months: int = 1) -> DataFrame:
    """Half-open slices of ``months`` (a divisor of 12) counted from each year's start that cover [start_date, end_date);
    first and last are clipped."""
    return _aligned(ranges.withColumn("_months", _divisor(months)))


def _divisor(months: int) -> Column:
    if 12 % months:
        raise ValueError(f"slices of {months} months don't part a year evenly")
    return F.lit(months)


def _aligned(ranges: DataFrame) -> DataFrame:
    """Slices of ranges whose width stands in ``_months``, which goes."""
    first = F.add_months(F.trunc("start_date", "YEAR"), (F.floor((F.month("start_date") - 1) / F.col("_months")) * F.col("_months")).cast("int"))
    starts = F.sequence(first, F.date_sub("end_date", 1), F.make_ym_interval(F.lit(0), F.col("_months")))
    rows = ranges.where("start_date < end_date").withColumn("month", F.explode(starts))
    return rows.select(
        *[c for c in ranges.columns if c not in ("start_date", "end_date", "_months")], F.greatest("month", "start_date").alias("slice_start"),
        F.least(F.add_months("month", F.col("_months")), F.col("end_date")).alias("slice_end"),
    )


def fixed_day_slices(ranges: DataFrame, days: int) -> DataFrame:
    rows = ranges.where("start_date < end_date").withColumn("day", F.explode(F.expr(f"sequence(start_date, date_sub(end_date, 1), INTERVAL {days} DAYS)")))
    return rows.select(
        *[c for c in ranges.columns if c not in ("start_date", "end_date")], F.col("day").alias("slice_start"),
        F.least(F.date_add("day", days), F.col("end_date")).alias("slice_end"),
    )


def split_slices(slices: DataFrame, items: str, cap: int) -> DataFrame:
    """Full slices of more than a day become two halves."""
    span = F.datediff("slice_end", "slice_start")
    middle = F.date_add("slice_start", F.floor(span / 2).cast("int"))
    whole = F.array(F.struct(F.col("slice_start").alias("a"), F.col("slice_end").alias("b")))
    halves = F.array(F.struct(F.col("slice_start").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("slice_end").alias("b")))
    cut = F.explode(F.when((F.col(items) >= cap) & (span > 1), halves).otherwise(whole)).alias("s")
    return slices.select(*[c for c in slices.columns if c not in ("slice_start", "slice_end")], cut).select("*", F.col("s.a").alias("slice_start"), F.col("s.b").alias("slice_end")).drop("s")


def stuck_rows(runs: DataFrame, *, as_of: str, minutes: int, final: list[str]) -> DataFrame:
    """Runs that have not ended within the timeout, failed with their duration."""
    age = (F.lit(as_of).cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")) / 60
    return runs.where(~F.col("status").isin(final) & (age > minutes)).select(*runs.columns, F.lit("FAILED").alias("new_status"), age.alias("minutes"))


def row_age(at: Column, as_of: str, stale_days: int = 14) -> tuple[Column, Column]:
    days = F.datediff(F.lit(as_of).cast("timestamp"), at)
    return days, days > stale_days


# Months a slice spans by source and kind of query, days of a GDELT slice and of its whole window, days that
# queries of seeded entities look back.
WIDTH_MONTHS = {
    "google_news": {"brand": 1, "risk": 3, "executive": 12, "competitor": 3, "product": 12, "seed_risk": 12},
    "youtube": {"brand": 1, "risk": 12, "executive": 12, "competitor": 12, "product": 12},
    "hn": {"brand": 12, "executive": 12, "competitor": 12, "product": 12},
}
GDELT_DAYS, GDELT_WINDOW, SEEDED_DAYS = 15, 90, 730
SOURCES = ["google_news", "youtube", "gdelt", "hn"]
SLICE_KEY = ["client_id", "source", "query", "slice_start", "slice_end"]


def plan_slices(specs: DataFrame, *, start: str, end: str, youtube_year: int, sources: list[str] = SOURCES, planned: DataFrame | None = None) -> DataFrame:
    """client_id, source, kind, entity_id, query, slice_start, slice_end still to plan over [start, end).

    ``specs`` (client_id, kind, entity_id, seeded, and a query for each source, null or empty for none) meet a table of source
    and width. GDELT holds its last GDELT_WINDOW days only, in slices of GDELT_DAYS; a kind without a width is not asked of a
    source; seeded entities look back SEEDED_DAYS, YouTube to the first day of ``youtube_year``. Slices that ``planned``
    (SLICE_KEY) holds are left out."""
    widths = [(s, k, m) for s, ks in WIDTH_MONTHS.items() for k, m in ks.items()]
    table = specs.sparkSession.createDataFrame(widths, "source string, kind string, _months int")
    query = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(s).alias("query")) for s in sources))).alias("q")
    rows = specs.select("client_id", "kind", "entity_id", "seeded", query).select("client_id", "kind", "entity_id", "seeded", "q.*").where("query <> ''")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    window = F.greatest(first, F.date_sub(last, GDELT_WINDOW - 1))
    kept = ["client_id", "source", "kind", "entity_id", "query"]
    gdelt = fixed_day_slices(rows.where("source = 'gdelt'").select(*kept, window.alias("start_date"), last.alias("end_date")), GDELT_DAYS)
    since = F.greatest(first, F.when(F.col("seeded"), F.date_sub(last, SEEDED_DAYS)), F.when(F.col("source") == "youtube", F.make_date(F.lit(youtube_year), F.lit(1), F.lit(1))))
    monthly = _aligned(rows.join(table, ["source", "kind"]).select(*kept, since.alias("start_date"), last.alias("end_date"), "_months"))
    out = monthly.unionByName(gdelt)
    return out if planned is None else out.join(planned.select(*SLICE_KEY).distinct(), SLICE_KEY, "left_anti")
