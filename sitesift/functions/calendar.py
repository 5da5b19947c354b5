"""Dates, wall clocks and month arithmetic."""

from pyspark.sql import Column, functions as F


def month_start(year: Column, month: Column) -> Column:
    """First of the month; a missing month reads as January, an impossible one as null."""
    m = F.coalesce(month, F.lit(1)).cast("int")
    return F.when(m.between(1, 12) & year.isNotNull(), F.make_date(year.cast("int"), m, F.lit(1)))


def days_in_month(month: Column) -> Column:
    """Days of a 'yyyy-MM' month."""
    return F.day(F.last_day(F.to_date(F.concat(month, F.lit("-01")))))


def year_hours(year: Column) -> Column:
    return F.dayofyear(F.make_date(year.cast("int"), F.lit(12), F.lit(31))) * 24


def parse_end(col: Column, year_only_month: int) -> Column:
    """YYYY → first of the given month, YYYY-MM → first of it, longer → its first ten characters; junk → null."""
    s = F.trim(col)
    text = (F.when(F.length(s) == 4, F.concat(s, F.lit(f"-{year_only_month:02d}-01")))
            .when(F.length(s) == 7, F.concat(s, F.lit("-01")))
            .otherwise(F.substring(s, 1, 10)))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def years_left(end: Column, as_of: Column) -> Column:
    return F.bround(F.datediff(end, as_of) / F.lit(365.25), 2)


def history_window(today: Column, cfg: dict) -> tuple[Column, Column]:
    """(start, end): end lags today, start is 36 months back but not before the history floor."""
    w = cfg["market_window"]
    end = F.date_sub(today, cfg["market"]["lag_days"])
    return F.greatest(F.to_date(F.lit(w["history_floor"])), F.add_months(end, -w["months"])), end


def localize(wall: Column, repeated: Column | None, tz: str) -> Column:
    """Wall clock → UTC instant (session zone UTC). The repeated autumn hour needs its flag: true is the second pass;
    without a flag column it stays null, and so does the hour skipped in spring."""
    first = F.to_utc_timestamp(wall, tz)
    exists = F.from_utc_timestamp(first, tz) == wall
    later = first + F.expr("INTERVAL 1 HOUR")
    ambiguous = F.from_utc_timestamp(later, tz) == wall
    if repeated is None:
        return F.when(exists & ~ambiguous, first)
    return F.when(exists, F.when(ambiguous & repeated, later).otherwise(first))
