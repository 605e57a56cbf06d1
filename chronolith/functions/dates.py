"""Calendar expressions, relevance in time and periodic rules."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def iso_week(d: Column) -> Column:
    """YYYY-Www of the ISO week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_start(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def week_end(d: Column) -> Column:
    return F.date_add(week_start(d), 6)


def clipped_week(d: Column) -> Column:
    """The ISO week within its month: YYYY-MM/YYYY-Www."""
    return F.concat_ws("/", F.date_format(d, "yyyy-MM"), iso_week(d))


def month_checkpoint(d: Column, end: Column) -> Column:
    """The month's last day, or the timeline's end in the last month."""
    return F.least(F.last_day(d), end)


def widened(c: Column, end: bool = False) -> Column:
    """A partial date string as a date: its first day, or its last."""
    year = F.try_to_date(F.concat(c, F.lit("-12-31" if end else "-01-01")), "yyyy-MM-dd")
    month = F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")
    return F.when(F.length(c) == 4, year).when(F.length(c) == 7, F.last_day(month) if end else month).otherwise(F.try_to_date(c, "yyyy-MM-dd"))


def parsed_time(c: Column) -> Column:
    """A timestamp from any of the usual notations; null otherwise."""
    patterns = ("h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMM, yyyy", "yyyy/MM/dd (EEE) HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
    return F.coalesce(*[F.try_to_timestamp(F.regexp_replace(c, r" \([A-Z][a-z]{2}\)", "") if "EEE" in p else c, F.lit(p.replace(" (EEE)", ""))) for p in patterns])


def temporal_relevance(t: Column, start: Column, end: Column) -> Column:
    """0.7 to 1 by nearness to the window's centre inside of it; 0.6, 0.4, 0.2 or 0.1 by the days outside."""
    seconds = lambda c: c.cast("timestamp").cast("long").cast("double")
    t, start, end = seconds(t), seconds(start), seconds(end)
    width = end - start
    inside = F.when(width > 0, F.greatest(F.lit(0.7), F.least(F.lit(1.0), 1.0 - F.abs(t - (start + width / 2)) / (width / 2)))).otherwise(0.9)
    days = F.greatest(start - t, t - end) / 86400
    return F.when(t.isNull(), 0.5).when(t.between(start, end), inside).when(days <= 1, 0.6).when(days <= 7, 0.4).when(days <= 30, 0.2).otherwise(0.1)


def freshness_bonus(d: Column, as_of: Column) -> Column:
    """A bonus for rows of the last day, week or month before ``as_of``."""
    age = F.datediff(as_of, d)
    return F.when(age <= 1, 0.1).when(age <= 7, 0.05).when(age <= 30, 0.02).otherwise(0.0)


def retention(days: Column, strength: Column) -> Column:
    """The forgetting curve exp(-t / 5S)."""
    return F.exp(-days / (5 * strength))


def relative_window(phrase: str, as_of: str) -> tuple[str, str]:
    """(start, end) days of a phrase seen from ``as_of``: yesterday, today, last week or month (up to the day before),
    N units ago (a unit to either side); else the last 30 days."""
    day = dt.date.fromisoformat(as_of)
    back = lambda n, m=0: ((day - dt.timedelta(n)).isoformat(), (day - dt.timedelta(m)).isoformat())
    p = phrase.lower().strip()
    if p in ("today", "yesterday"):
        n = int(p == "yesterday")
        return back(n, n)
    if p in ("last week", "last month"):
        return back(7 if "week" in p else 30, 1)
    if m := re.fullmatch(r"(\d+)\s+(day|week|month|year)s?\s+ago", p):
        n, unit = int(m[1]), {"day": 1, "week": 7, "month": 30, "year": 365}[m[2]]
        return back((n + 1) * unit, (n - 1) * unit)
    return back(30)


def calendar_spine(spark, start: str, end: str) -> DataFrame:
    """Every day of a range with its week, month and year."""
    d = F.col("day")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.select("day", iso_week(d).alias("week"), F.date_format(d, "yyyy-MM").alias("month"), F.year(d).alias("year"))


# Rules: the value on a day, ``offset`` days after the rule's anchor (null before it).


def _at(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def phase_weekly(offset: Column, n: int) -> Column:
    return F.when(offset >= 0, F.floor(offset / 7) % n)


def rule_weekly_alternate(offset: Column, values: list[str]) -> Column:
    return F.when(offset >= 0, _at(values, phase_weekly(offset, len(values))))


def phase_cycle(offset: Column, segments: list[tuple[str, int]]) -> Column:
    at = offset % sum(d for _, d in segments)
    out, done = None, 0
    for i, (_, days) in enumerate(segments):
        done += days
        out = F.when(at < done, i) if out is None else out.when(at < done, i)
    return F.when(offset >= 0, out)


def rule_n_day_cycle(offset: Column, segments: list[tuple[str, int]]) -> Column:
    return F.when(offset >= 0, _at([v for v, _ in segments], phase_cycle(offset, segments)))


def rule_day_of_week(d: Column, values: dict[str, str]) -> Column:
    return _at([values[k] for k in WEEKDAYS], F.weekday(d))


def rule_value(rule: dict, d: Column, anchor: Column, context: dict[str, Column] | None = None) -> Column:
    """Any rule as an expression, nested rules within: constant, weekly_alternate, n_day_cycle, day_of_week, nested, conditional."""
    offset = F.datediff(d, anchor)
    kind = rule["type"]
    if kind == "constant":
        return F.when(offset >= 0, F.lit(rule["value"]))
    if kind == "weekly_alternate":
        return rule_weekly_alternate(offset, rule["values"])
    if kind == "n_day_cycle":
        return rule_n_day_cycle(offset, [(s["value"], s["days"]) for s in rule["segments"]])
    if kind == "day_of_week":
        return F.when(offset >= 0, rule_day_of_week(d, rule["map"]))
    if kind == "nested":
        block = F.floor(offset / rule["block_days"]) % len(rule["blocks"])
        out = None
        for i, b in enumerate(rule["blocks"]):
            value = rule_value(b, d, anchor, context)
            out = F.when(block == i, value) if out is None else out.when(block == i, value)
        return F.when(offset >= 0, out)
    if kind == "conditional":
        key, out = context[rule["condition"]], None
        for case, sub in rule["cases"].items():
            if case != "default":
                value = F.lit(sub) if isinstance(sub, str) else rule_value(sub, d, anchor, context)
                out = F.when(key == case, value) if out is None else out.when(key == case, value)
        default = rule["cases"].get("default")
        if default is not None:
            value = F.lit(default) if isinstance(default, str) else rule_value(default, d, anchor, context)
            out = value if out is None else out.otherwise(value)
        return F.when(offset >= 0, out)
    raise ValueError(f"unknown rule {kind}")


# The season of each month, the weather of known cities by month, and a season's weather elsewhere.
SEASONS = ("winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "fall", "fall", "fall", "winter")
CLIMATE = {
    "austin": ("mild", "mild", "mild", "warm", "hot", "hot", "hot", "hot", "hot", "warm", "mild", "mild"),
    "chicago": ("snowy", "snowy", "cold", "mild", "mild", "warm", "hot", "hot", "warm", "mild", "cold", "snowy"),
    "denver": ("snowy", "snowy", "cold", "cold", "mild", "warm", "hot", "warm", "warm", "mild", "cold", "snowy"),
    "pittsburgh": ("snowy", "snowy", "cold", "rainy", "rainy", "warm", "hot", "warm", "mild", "mild", "cold", "snowy"),
    "seattle": ("rainy", "rainy", "rainy", "rainy", "mild", "mild", "warm", "warm", "mild", "rainy", "rainy", "rainy"),
}
SEASON_WEATHER = {"winter": "cold", "spring": "mild", "summer": "hot", "fall": "mild"}


def season(d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEASONS)), F.month(d))


def is_workday(d: Column) -> Column:
    return F.weekday(d) < 5


def weather(d: Column, city: Column) -> Column:
    """A known city's weather in the month (what stands before the first comma names it), else the season's."""
    key = F.lower(F.trim(F.split_part(F.coalesce(city, F.lit("")), F.lit(","), F.lit(1))))
    out = F.element_at(F.create_map(*[F.lit(x) for kv in SEASON_WEATHER.items() for x in kv]), season(d))
    for name, months in CLIMATE.items():
        out = F.when(key == name, F.element_at(F.array(*map(F.lit, months)), F.month(d))).otherwise(out)
    return out


def day_number(d: Column, start: Column) -> Column:
    """Days from 1 on."""
    return F.datediff(d, start) + 1


def day_date(n: Column, start: Column) -> Column:
    return F.date_add(start, n - 1)


def previous_week(d: Column) -> Column:
    return F.date_sub(week_start(d), 7)


def previous_month(d: Column) -> Column:
    return F.add_months(F.trunc(d, "month"), -1)


def latest_named(c: Column) -> Column:
    """The last day that a text names: ISO dates, and the ends of months like "March 2026"."""
    names = "January|February|March|April|May|June|July|August|September|October|November|December"
    days = F.transform(F.regexp_extract_all(c, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0)), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    months = F.transform(F.regexp_extract_all(c, F.lit(rf"\b(?:{names})\s+\d{{4}}\b"), F.lit(0)), lambda x: F.last_day(F.try_to_date(F.regexp_replace(x, r"\s+", " "), "MMMM yyyy")))
    return F.array_max(F.array_compact(F.concat(days, months)))


PERIODS = {"week": r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])$", "month": r"^\d{4}-(0[1-9]|1[0-2])$", "year": r"^\d{4}$", "lifetime": r"^lifetime$"}


def period_kind(c: Column) -> Column:
    """week, month, year or lifetime by the form of a period's id; null for any other."""
    out = F.lit(None).cast("string")
    for kind, pattern in PERIODS.items():
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    return out


def period_start(c: Column) -> Column:
    """The first day of a week, month or year by its id."""
    kind = period_kind(c)
    fourth = F.make_date(F.substring(c, 1, 4).cast("int"), F.lit(1), F.lit(4))  # lies in the ISO year's first week
    week = F.date_add(week_start(fourth), 7 * (F.substring(c, 7, 2).cast("int") - 1))
    return F.when(kind == "week", week).when(kind == "month", F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")).when(kind == "year", F.try_to_date(F.concat(c, F.lit("-01-01")), "yyyy-MM-dd"))


def rule_values(rule: dict) -> list[str]:
    """The different values that a rule can give, in the order in which it names them."""
    kind = rule["type"]
    if kind == "constant":
        found = [rule["value"]]
    elif kind == "weekly_alternate":
        found = rule["values"]
    elif kind == "n_day_cycle":
        found = [s["value"] for s in rule["segments"]]
    elif kind == "day_of_week":
        found = [rule["map"][d] for d in WEEKDAYS]
    elif kind == "nested":
        found = [v for b in rule["blocks"] for v in rule_values(b)]
    else:
        found = [v for case in rule["cases"].values() for v in ([case] if isinstance(case, str) else rule_values(case))]
    return list(dict.fromkeys(found))


def rule_text(rule: dict) -> str:
    """A rule in words."""
    kind = rule["type"]
    if kind == "constant":
        return f"always {rule['value']}"
    if kind == "weekly_alternate":
        return "a week each of " + ", ".join(rule["values"])
    if kind == "n_day_cycle":
        return "in turn " + ", ".join(f"{s['value']} for {s['days']} days" for s in rule["segments"])
    if kind == "day_of_week":
        return ", ".join(f"{rule['map'][d]} on {d.capitalize()}s" for d in WEEKDAYS)
    if kind == "nested":
        return f"blocks of {rule['block_days']} days: " + "; ".join(rule_text(b) for b in rule["blocks"])
    return f"by {rule['condition']}: " + "; ".join(f"{k}: {v if isinstance(v, str) else rule_text(v)}" for k, v in rule["cases"].items())
