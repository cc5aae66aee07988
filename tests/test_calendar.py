"""Interval and duration texts, and what their queries compute for each row."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import calendar as cal
from millrace.plans.queries import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hours_are_told_once_an_order(spark, sf):
    plan = optimized(QUERIES["d4_expand"](spark, sf))
    above, below = plan.split("Generate", 1)
    assert "sequence" not in above and "lambda" not in plan, plan
    days = spark.sql("SELECT * FROM VALUES (date'2024-02-28', date'2024-03-02'), (date'2024-01-02', date'2024-01-02'), (null, null) AS t(date_a, date_b)")
    got = [r.h for r in days.select(cal.interval_hours(F.struct("date_a", "date_b")).alias("h")).collect()]
    assert got == [[datetime(2024, 2, 28) + timedelta(hours=h) for h in range(72)], [], []]


def test_a_text_is_parsed_once(spark, sf):
    assert optimized(QUERIES["d2_interval_text"](spark, sf)).count("regexp_extract") == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024", ("year", date(2024, 1, 1), date(2025, 1, 1))), ("2024-02", ("month", date(2024, 2, 1), date(2024, 3, 1))), ("2020-W53", ("week", date(2020, 12, 28), date(2021, 1, 4))),
        ("2024-02-29", ("date", date(2024, 2, 29), date(2024, 3, 1))), ("2024-02-29-2024-02-01", ("custom", date(2024, 2, 29), date(2024, 2, 1))),
        *((x, None) for x in ("2021-W53", "2024-W00", "2024-13", "2023-02-29", "2024-01-01-2023-02-29", "2023-02-29-2024-01-01", "", "x", "20245", "2024-W1", "2024-01-01 ", None)),
    ],
)
def test_interval_texts(spark, text, want):
    row = spark.createDataFrame([(text,)], "text string").select(cal.parse_interval(F.col("text")).alias("i")).first()
    assert (row.i and tuple(row.i)) == want


def test_duration_texts(spark):
    want = {
        "P3DT2H": 266400, "P2W": 1209600, "PT1H2M3S": 3723, "P": None, "PT": None, "5": 5, " 5": None, "": None, "1 week 2 days": 777600, "  1w2d3h4m5s ": 788645, "3 weeks 3 minutes": 1814580,
        "5 days or so": None, "2 days 1 week": None, "12 h\n": 43200, "P1D\n": 86400, "99999999999999999999 s": 0, None: None,
    }
    rows = spark.createDataFrame([(x,) for x in want], "text string").select("text", cal.parse_duration(F.col("text")).alias("s"))
    assert {r.text: r.s for r in rows.collect()} == want
    # One match a form, and no cast of a text that is no number.
    assert optimized(rows).count("regexp_extract") == 0
