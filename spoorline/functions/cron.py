"""Schedules as five-field cron text, as a column expression; what cron can't say is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of schedules (None: none of fixed times) and the fields' bounds.
PRESETS: dict[str, str | None] = {
    "@once": None,
    "@hourly": "0 * * * *",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@weekly": "0 0 * * 0",
    "@monthly": "0 0 1 * *",
    "@quarterly": "0 0 1 */3 *",
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@continuous": None,
    "hourly": "0 * * * *",
    "daily": "0 0 * * *",
    "weekly": "0 0 * * 0",
    "monthly": "0 0 1 * *",
}
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")


def _number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))


def _valid_field(field: Column, low: int, high: int) -> Column:
    """Comma-separated *, n, a-b, each with an optional /step within the bounds."""

    def valid(item: Column) -> Column:
        base, step = F.substring_index(item, "/", 1), F.regexp_extract(item, r"^[^/]*/(.*)$", 1)
        ok_step = ~item.contains("/") | F.coalesce(_number(step).between(1, high - low + 1), F.lit(False))
        a, b = _number(F.substring_index(base, "-", 1)), _number(F.substring_index(base, "-", -1))
        span = base.rlike(r"^[0-9]+(-[0-9]+)?$") & a.between(low, high) & b.between(low, high) & (a <= b)
        return ok_step & ((base == "*") | F.coalesce(span, F.lit(False)))

    return F.forall(F.split(field, ","), valid)


def _valid_cron(text: Column) -> Column:
    fields = F.split(F.upper(text), r"\s+")
    out = F.size(fields) == 5
    for k, (low, high) in enumerate(BOUNDS):
        field = F.get(fields, k)
        for i, name in enumerate(MONTHS if k == 3 else DAYS if k == 4 else ()):
            field = F.replace(field, F.lit(name), F.lit(str(i + (k == 3))))
        out = out & _valid_field(field, low, high)
    return out


def normalize_cron(text: Column) -> Column:
    """Presets, five fields, `daily HH:MM [UTC]`, `every N minutes/hours/days` that divide evenly."""
    t = F.regexp_replace(F.trim(text), r"""^["']+|["']+$""", "")
    low = F.lower(t)
    preset = F.lit(None).cast("string")
    for name, cron in PRESETS.items():
        preset = F.when(low == name, F.lit(cron).cast("string")).otherwise(preset)
    hour, minute = _number(F.regexp_extract(low, r"^daily\s+([0-9]{1,2}):([0-9]{2})", 1)), _number(F.regexp_extract(low, r"^daily\s+([0-9]{1,2}):([0-9]{2})", 2))
    daily = F.when((hour < 24) & (minute < 60), F.concat_ws(" ", minute.cast("string"), hour.cast("string"), F.lit("* * *")))
    n = _number(F.regexp_extract(low, r"^every\s+([0-9]+)", 1))
    unit = F.regexp_extract(low, r"^every\s+[0-9]+\s*(minute|min|hour|day)s?$", 1)
    stars = lambda a, b: F.concat(F.lit(a), n.cast("string"), F.lit(b))
    every = (
        F.when(unit.startswith("min") & n.between(1, 59) & (60 % F.greatest(n, F.lit(1)) == 0), stars("*/", " * * * *"))
        .when((unit == "hour") & n.between(1, 23) & (24 % F.greatest(n, F.lit(1)) == 0), stars("0 */", " * * *"))
        .when((unit == "day") & (n == 1), F.lit("0 0 * * *"))
    )
    return (
        F.when(low.isin(*PRESETS), preset)
        .when(_valid_cron(t), F.array_join(F.split(t, r"\s+"), " "))
        .when(low.rlike(r"^daily\s+[0-9]{1,2}:[0-9]{2}(\s+utc)?$"), daily)
        .when(unit != "", every)
    )
