"""Date intervals and calendar grids as column expressions.

An interval is a struct (kind, date_a, date_b), half open. Kinds: date, week (ISO), month, year, custom.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text formats of typed dates, finest last.
FORMATS = {"year": "yyyy", "month": "yyyy-MM", "date": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH", "minute": "yyyy-MM-dd'T'HHmm", "second": "yyyy-MM-dd'T'HHmmss"}
#: Characters of an interval's text by kind.
SIZES = {"year": 4, "month": 7, "week": 8, "date": 10, "custom": 21}
#: Seconds of each unit in a duration's text.
UNITS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}


def _interval(kind: str, a: Column, b: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), a.cast("date").alias("date_a"), b.cast("date").alias("date_b"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def week_start(year: Column, week: Column) -> Column:
    """Monday of an ISO week; null for a week 53 that the year hasn't, and for weeks outside 1 to 53."""
    monday = F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (week - 1) * 7)
    return _let(monday, lambda start: F.when((week >= 1) & (F.extract(F.lit("YEAROFWEEK"), start) == year), start))


def parse_interval(text: Column) -> Column:
    """Year YYYY, month YYYY-MM, week YYYY-Www, date, or date-date; null if the text is none of them or no such date."""
    shape = r"^(\d{4}(?:-W\d{2}|-\d{2}(?:-\d{2}(?:-\d{4}-\d{2}-\d{2})?)?)?)$"

    def ends(form: Column) -> Column:
        """One match has told the form: its length is another one for each kind, and 0 for none."""
        n = F.length(form)
        monday = week_start(F.substring(form, 1, 4).try_cast("int"), F.substring(form, 7, 2).try_cast("int"))
        rest = F.when(n == SIZES["year"], "-01-01").when(n == SIZES["month"], "-01").otherwise("")
        start = F.when(n == SIZES["week"], monday).otherwise(F.concat(F.substring(form, 1, 10), rest).try_cast("date"))
        return F.when(n > 0, _let(start, lambda a: named(form, n, a)))  # a cast that fails costs an exception

    def named(form: Column, n: Column, a: Column) -> Column:
        of = lambda kind, b: _interval(kind, a, b)
        last = F.when(n == SIZES["custom"], F.substring(form, 12, 10).try_cast("date"))
        return (
            F.when(a.isNull(), None).when(n == SIZES["year"], of("year", F.add_months(a, 12))).when(n == SIZES["month"], of("month", F.add_months(a, 1)))
            .when(n == SIZES["week"], of("week", F.date_add(a, 7))).when(n == SIZES["date"], of("date", F.date_add(a, 1))).when(last.isNotNull(), of("custom", last))
        )

    return _let(F.regexp_extract(text, shape, 1), ends)


def interval_text(interval: Column) -> Column:
    """The inverse of ``parse_interval``."""
    kind, a, b = interval["kind"], interval["date_a"], interval["date_b"]
    iso = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), a), F.weekofyear(a))
    return (
        F.when(kind == "year", F.date_format(a, "yyyy")).when(kind == "month", F.date_format(a, "yyyy-MM")).when(kind == "week", iso)
        .when(kind == "date", F.date_format(a, "yyyy-MM-dd")).otherwise(F.concat_ws("-", F.date_format(a, "yyyy-MM-dd"), F.date_format(b, "yyyy-MM-dd")))
    )


def interval_of(kind: str, day: Column) -> Column:
    """The date, week, month or year that holds ``day``."""
    if kind == "date":
        return _interval(kind, day, F.date_add(day, 1))
    start = F.date_trunc(kind, day).cast("date")
    after = {"week": F.date_add(start, 7), "month": F.add_months(start, 1), "year": F.add_months(start, 12)}[kind]
    return _interval(kind, start, after)


def interval_days(interval: Column) -> Column:
    """All dates of an interval as an array; empty if it holds none."""
    a, b = interval["date_a"], interval["date_b"]
    return F.when(b > a, F.sequence(a, F.date_sub(b, 1))).otherwise(F.array().cast("array<date>"))


def interval_hours(interval: Column) -> Column:
    """All whole hours of an interval as an array of timestamps without zone."""
    a, b = interval["date_a"].cast("timestamp_ntz"), interval["date_b"].cast("timestamp_ntz")
    hour = F.make_dt_interval(hours=F.lit(1))
    return F.when(b > a, F.sequence(a, b - hour, hour)).otherwise(F.array().cast("array<timestamp_ntz>"))


def interval_next(interval: Column) -> Column:
    """The interval of the same kind that follows; null for custom ones, which have none."""
    return _by_kind(interval, interval["date_b"])


def interval_prev(interval: Column) -> Column:
    """The interval of the same kind before; null for custom ones, which have none."""
    return _by_kind(interval, F.date_sub(interval["date_a"], 1))


def _by_kind(interval: Column, day: Column) -> Column:
    kind = interval["kind"]
    return F.when(kind == "date", interval_of("date", day)).when(kind == "week", interval_of("week", day)).when(kind == "month", interval_of("month", day)).when(kind == "year", interval_of("year", day))


def interval_contains(interval: Column, day: Column) -> Column:
    return (day >= interval["date_a"]) & (day < interval["date_b"])


def interval_before(left: Column, right: Column) -> Column:
    """Whether ``left`` sorts before ``right``; null for different kinds, which don't compare."""
    key = lambda i: F.struct(i["date_a"], i["date_b"])
    return F.when(left["kind"] == right["kind"], key(left) < key(right))


def clamp_date(day: Column, unit: str, every: int = 1, start: str = "1970-01-01") -> Column:
    """Floor to every N days, months or years from ``start``, also before it."""
    origin = F.lit(start).cast("date")
    if unit == "day":
        return F.date_sub(day, F.pmod(F.datediff(day, origin), F.lit(every)).cast("int"))
    months = (F.year(day) - F.year(origin)) * 12 + F.month(day) - F.month(origin)
    step = every * (12 if unit == "year" else 1)
    return F.add_months(F.date_trunc("month", origin).cast("date"), (months - F.pmod(months, F.lit(step))).cast("int"))


def clamp_timestamp(ts: Column, seconds: int, start: str = "1970-01-01 00:00:00") -> Column:
    """Floor a timestamp without zone to every N seconds from ``start``, also before it."""
    origin = F.lit(start).cast("timestamp_ntz")
    gone = F.timestamp_diff("SECOND", origin, F.date_trunc("second", ts).cast("timestamp_ntz"))
    return F.timestamp_add("SECOND", (gone - F.pmod(gone, F.lit(seconds))).cast("int"), origin)


def next_on_grid(day: Column, unit: str, every: int = 1) -> Column:
    return F.date_add(day, every) if unit == "day" else F.add_months(day, every * (12 if unit == "year" else 1))


def parse_typed_date(text: Column, kind: str) -> Column:
    """Text in FORMATS[kind] as a timestamp; minutes may also be written T12H30. Null if it isn't."""
    parsed = F.try_to_timestamp(text, F.lit(FORMATS[kind]))
    if kind == "minute":
        parsed = F.coalesce(parsed, F.try_to_timestamp(F.regexp_replace(text, r"T(\d{2})H(\d{2})$", "T$1$2"), F.lit(FORMATS[kind])))
    return parsed


def format_typed_date(value: Column, kind: str) -> Column:
    return F.date_format(value, FORMATS[kind])


def parse_duration(text: Column) -> Column:
    """Seconds of a bare number, of ISO PnDTnHnMnS or PnW, or of words such as "1 week 2 days"; null otherwise."""
    iso = r"^P(?:(\d+)W|(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?)$"
    # Possessive: what follows a number or spaces is never a digit or a space, so that no text is matched anew from its middle.
    words = r"^\s*+(?:(\d++)\s*+(?:w|weeks?))?\s*+(?:(\d++)\s*+(?:d|days?))?\s*+(?:(\d++)\s*+(?:h|hours?))?\s*+(?:(\d++)\s*+(?:m|minutes?))?\s*+(?:(\d++)\s*+(?:s|seconds?))?\s*+$"

    def total(pattern: str) -> Column:
        """The units' numbers by one match, with an empty text for those that aren't there: a cast that fails costs an
        exception, many times the match."""
        parts = F.split(F.regexp_replace(text, pattern, "$1,$2,$3,$4,$5"), ",")
        seconds = F.array(*(F.lit(n).cast("long") for n in UNITS.values()))
        each = F.zip_with(parts, seconds, lambda part, n: F.when(part.rlike(r"^\d"), F.coalesce(part.try_cast("long"), F.lit(0)) * n).otherwise(0))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    some = text.rlike(r"\d")
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long")).when(text.rlike(iso) & some, total(iso)).when(text.rlike(words) & some, total(words))


def duration_text(seconds: Column) -> Column:
    """``{w} w {d} d {h} h {m} m {s} s``, units that are 0 left out; "0 s" for none."""
    parts, rest = [], seconds
    for unit, n in UNITS.items():
        value = F.floor(rest / n).cast("long")
        parts.append(F.when(value > 0, F.concat(value.cast("string"), F.lit(f" {unit}"))))
        rest = rest % n
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", "0 s").otherwise(joined)
