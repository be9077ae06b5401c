"""Is a scheduled crawl due in a given hour?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.times import epoch_seconds

# Schedule names and their step. Months step by calendar, the rest by hours.
STEP_HOURS = {"HOURLY": 1, "DAILY": 24, "WEEKLY": 168}
STEP_MONTHS = {"MONTHLY": 1, "QUARTERLY": 3, "SIXMONTHLY": 6, "ANNUAL": 12}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_due(frequency: Column | str, start: Column | str, end: Column | str, hour: Column) -> Column:
    """True when ``hour`` (a whole hour) equals start's hour plus a whole number of steps, within start..end.

    A month step keeps the day of the start; where the month is too short its last day counts.
    """
    frequency, start, end = _col(frequency), _col(start), _col(end)
    start_hour = epoch_seconds(start) - F.pmod(epoch_seconds(start), F.lit(3600))
    now = epoch_seconds(hour)
    elapsed_hours = F.floor((now - start_hour) / 3600)
    begun = (now >= start_hour) & (end.isNull() | (hour <= end))
    months = (F.year(hour) - F.year(start)) * 12 + F.month(hour) - F.month(start)
    same_clock = F.hour(hour) == F.hour(start)
    same_day = F.add_months(F.to_date(start), months) == F.to_date(hour)

    due = F.lit(False)
    for name, step in STEP_HOURS.items():
        due = due | ((frequency == name) & (F.pmod(elapsed_hours, F.lit(step)) == 0))
    for name, step in STEP_MONTHS.items():
        due = due | ((frequency == name) & (F.pmod(months, F.lit(step)) == 0) & same_day & same_clock)
    return F.coalesce(begun & due, F.lit(False))
