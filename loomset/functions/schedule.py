"""Retry delays, blackout windows and categories of failures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exponential_delay(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def linear_delay(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(base) * (attempt + 1), F.lit(most))


def fibonacci_delay(attempt: Column, base: float, most: float) -> Column:
    pair = F.aggregate(F.sequence(F.lit(0), attempt), F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b")), lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")))
    return F.least(F.lit(base) * pair["b"], F.lit(most))


def in_blackout(time: Column, start: str, end: str) -> Column:
    """Whether the time of day lies between two others; a window doesn't wrap over midnight."""
    return F.date_format(time, "HH:mm:ss").between(start, end)


def http_category(status: Column) -> Column:
    return (
        F.when(status == 429, "rate_limit").when(status.isin(401, 403), "auth").when(status == 404, "not_found")
        .when(status == 408, "timeout").when(status >= 500, "server").when(status >= 400, "client").otherwise("none")
    )


# What a refused answer says, by category, the first that holds.
RESPONSE_WORDS = {
    "captcha": ["captcha", "recaptcha", "hcaptcha", "verify you are human"],
    "blocked": ["access denied", "forbidden", "blocked", "banned"],
    "rate_limit": ["rate limit", "too many requests", "slow down"],
}


def response_category(content: Column) -> Column:
    low = F.lower(content)
    out = None
    for name, terms in RESPONSE_WORDS.items():
        holds = low.contains(terms[0])
        for t in terms[1:]:
            holds = holds | low.contains(t)
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


#: Least and greatest value of each field of a schedule: minute, hour, day, month, day of the week (0 and 7: Sunday).
CRON_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def cron_values(expression: str) -> list[list[int]]:
    """The values that each of five fields allows: `*`, `a`, `a-b`, lists of these, and steps after a slash."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"a schedule has five fields: {expression!r}")
    out = []
    for field, (least, most) in zip(fields, CRON_FIELDS, strict=True):
        allowed: set[int] = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            low, high = (least, most) if span == "*" else (int(a), int(b or (most if step else a)))
            if not least <= low <= high <= most:
                raise ValueError(f"{part!r} is outside {least} to {most}")
            allowed.update(range(low, high + 1, int(step or 1)))
        out.append(sorted(allowed))
    out[4] = sorted({d % 7 for d in out[4]})
    return out


def _on_day(day: Column, values: list[list[int]]) -> Column:
    """Of the two day fields, if both are limited, one has to hold."""
    week, month_day = (F.dayofweek(day) - 1).isin(values[4]), F.dayofmonth(day).isin(values[2])
    either = week | month_day if len(values[2]) < 31 and len(values[4]) < 7 else week & month_day
    return F.month(day).isin(values[3]) & either


def cron_matches(time: Column, expression: str) -> Column:
    values = cron_values(expression)
    return F.minute(time).isin(values[0]) & F.hour(time).isin(values[1]) & _on_day(F.to_date(time), values)


def cron_next(time: Column, expression: str, days: int = 366) -> Column:
    """The first time after `time` that matches, within so many days; null if there is none."""
    values = cron_values(expression)
    minutes = [60 * h + m for h in values[1] for m in values[0]]
    today = F.to_date(time)
    now = F.hour(time) * 60 + F.minute(time)
    later = F.array_min(F.filter(F.array(*(F.lit(m) for m in minutes)), lambda m: m > now))
    ahead = F.array_min(F.filter(F.sequence(F.date_add(today, 1), F.date_add(today, days)), lambda d: _on_day(d, values)))
    day = F.when(_on_day(today, values) & later.isNotNull(), today).otherwise(ahead)
    at = F.when(_on_day(today, values) & later.isNotNull(), later).otherwise(F.lit(minutes[0]))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), at, F.lit(0))
