"""Table functions for SQL users."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class CalendarSlices:
    """Half-open slices of ``months`` calendar months (a divisor of 12, counted from each year's start) that tile [start, end)."""

    def eval(self, start: date, end: date, months: int) -> Iterator[tuple[date, date]]:
        if start is None or end is None:
            return
        at, month = start, start.year * 12 + (start.month - 1) // months * months
        while at < end:
            month += months
            after = min(date(month // 12, month % 12 + 1, 1), end)
            yield at, after
            at = after


class Sentences:
    """Sentences of a text with their numbers; a sentence ends at . ! or ? before white space."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for k, s in enumerate(x for x in re.split(r"(?<=[.!?])\s+", text or "") if x.strip()):
            yield k, s


def register(spark: SparkSession) -> None:
    """calendar_slices(start, end, months) and sentences(text) for this session's SQL."""
    spark.udtf.register("calendar_slices", udtf(CalendarSlices, returnType="slice_start date, slice_end date"))
    spark.udtf.register("sentences", udtf(Sentences, returnType="number int, sentence string"))
