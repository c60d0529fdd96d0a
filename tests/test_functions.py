from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brindle.functions import numbers, periods, text
from brindle.operators import quantiles

NUMBERS = {
    "₹12.5 lakh": (1250000, "INR", False, None, "lakh", False),
    "1,44,879": (144879, None, False, None, None, False),
    "(1,200)": (-1200, None, False, None, None, False),
    "18.4%": (Decimal("18.4"), None, True, None, None, False),
    "450 km": (450, None, False, "km", None, False),
    "Rs. 8,50,000/-": (850000, "INR", False, None, None, False),
    "$3.2bn": (3200000000, "USD", False, None, "billion", False),
    "~ 40": (40, None, False, None, None, False),
    "−5": (-5, None, False, None, None, False),
    ".5": (Decimal("0.5"), None, False, None, None, False),
    "1 234 567": (1234567, None, False, None, None, False),
    "₹11 – ₹26 Lakh": (1100000, "INR", False, None, "lakh", True),
    "10 to 20 km": (10, None, False, "km", None, True),
    "5%*": (5, None, True, None, None, False),
}
NOT_NUMBERS = ["N/A", "—", "", None, "2019-2020", "10-12", "Contact us", "12,34", "5 apples and 6 pears", "20 km - 10 km", "1.2.3"]


def test_numbers(spark):
    cells = [*NUMBERS, *NOT_NUMBERS]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {r["c"]: r["n"] for r in numbers.add_number(df, "c", "n").collect()}
    for cell, want in NUMBERS.items():
        n = got[cell]
        assert n is not None, cell
        assert (n["value"], n["currency"], n["percent"], n["suffix"], n["scale"], n["ranged"]) == want, cell
    for cell in NOT_NUMBERS:
        assert got[cell] is None, cell


PERIODS = {
    "2024": ("2024", "year"), "FY 2024-25": ("FY2024-25", "fiscal"), "FY25": ("FY2024-25", "fiscal"), "Q1 2024": ("2024-Q1", "quarter"), "2024 Q3": ("2024-Q3", "quarter"),
    "2024-01-14": ("2024-01-14", "day"), "14/01/2026": ("2026-01-14", "day"), "01/14/2026": ("2026-01-14", "day"), "Jan-24": ("2024-01", "month"), "2024/3": ("2024-03", "month"),
    "14th Jan 2026": ("2026-01-14", "day"), "March 4, 2020": ("2020-03-04", "day"), "february": ("M02", "monthName"), "2024-02-30": None, "1850": None, "banana": None, "13/13/2020": None, "": None,
}


def test_periods(spark):
    df = spark.createDataFrame([(c,) for c in PERIODS], "c string").select("c", periods.parse_period(F.col("c")).alias("p"))
    got = {r["c"]: r["p"] and (r["p"]["key"], r["p"]["grain"]) for r in df.collect()}
    assert got == PERIODS


def test_ambiguous_days(spark):
    df = spark.createDataFrame([("04/05/2024",), ("04/04/2024",), ("25/05/2024",)], "c string").select(periods.parse_period(F.col("c"))["ambiguous"])
    assert [r[0] for r in df.collect()] == [True, False, False]


DATES = {
    "2025-02-04": date(2025, 2, 4), "04/02/2025": date(2025, 2, 4), "02/14/2025": date(2025, 2, 14), "4-Feb-2025": date(2025, 2, 4), "February 4, 2025": date(2025, 2, 4), "Feb 2025": date(2025, 2, 1),
    "2015 [60]": date(2015, 1, 1), "2015-16": date(2015, 1, 1), "31/02/2024": None, "soon": None,
}


def test_dates(spark):
    df = spark.createDataFrame([(c,) for c in DATES], "c string").select("c", periods.parse_date(F.col("c")).alias("d"))
    assert {r["c"]: r["d"] for r in df.collect()} == DATES


@pytest.mark.parametrize(("words", "want"), [
    ("sales between 2010 and 2025", (date(2010, 1, 1), date(2025, 12, 31))),
    ("last 5 years", (date(2019, 6, 15), date(2024, 6, 15))),
    ("since 2015", (date(2015, 1, 1), None)), ("after 2015", (date(2016, 1, 1), None)), ("before 2020", (None, date(2019, 12, 31))), ("until 2020", (None, date(2020, 12, 31))),
    ("in 2023", (date(2023, 1, 1), date(2023, 12, 31))), ("all of them", None),
])
def test_limits(words, want):
    assert periods.limit_of(words, date(2024, 6, 15)) == want


def test_buckets_and_ordinals(spark):
    keys = ["2024-03-14", "2024-03", "2024-Q1", "2024", "FY2024-25", "M02"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = df.select(*[periods.bucket(F.col("k"), b).alias(b) for b in ("year", "quarter", "month")], periods.ordinal(F.col("k")).alias("o")).collect()
    assert [r["year"] for r in rows] == ["2024", "2024", "2024", "2024", "FY2024-25", "M02"]
    assert [r["quarter"] for r in rows] == ["2024-Q1", "2024-Q1", "2024-Q1", "2024", "FY2024-25", "M02"]
    assert [r["month"] for r in rows] == ["2024-03", "2024-03", "2024-Q1", "2024", "FY2024-25", "M02"]
    assert [r["o"] for r in rows] == [19796, 24290, 8096, 2024, 2024, 1]


def test_text(spark):
    df = spark.createDataFrame([("https://www.Example.com/a?b", " N/A ", "A\u00a0 B")], "u string, m string, s string")
    r = df.select(text.site_of(F.col("u")).alias("site"), text.is_missing(F.col("m")).alias("gone"), text.group_key(F.col("s")).alias("key"), text.group_key(F.col("m")).alias("none"), text.guarded(F.lit("=1+1")).alias("g")).first()
    assert (r["site"], r["gone"], r["key"], r["none"], r["g"]) == ("example.com", True, "a b", None, "'=1+1")


def test_emails(spark):
    r = spark.createDataFrame([("Write to Bob [at] site (dot) org or x.y@z.co.uk, x.y@z.co.uk",)], "c string").select(text.emails(F.col("c"))).first()[0]
    assert r == ["bob@site.org", "x.y@z.co.uk"]


def test_half_even_and_quantile(spark):
    df = spark.createDataFrame([(Decimal("0.5"), 2), (Decimal("1.5"), 2)], "t decimal(10,2), n int")
    assert [str(r[0]) for r in df.select(numbers.half_even(F.col("t"), F.col("n"), 1)).collect()] == ["0.2", "0.8"]
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "v double")
    assert quantiles.exclusive_quantile(df, [], "v", 0.9).first()["quantile"] == 5.0


@pytest.mark.parametrize("q", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
def test_ranks_of_uneven_groups(spark, q):
    import random

    rng = random.Random(7)
    rows = [("big", rng.randrange(5000)) for _ in range(30_000)] + [("one", 3)] + [(None, rng.randrange(3)) for _ in range(50)] + [("none", None)] * 3
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r["k"]: r["ranked"] for r in quantiles.at_ranks(df, ["k"], "v", q, lambda n: [F.floor((n - 1) * q)]).collect()}
    want = {}
    for k in ("big", "one", None):
        own = sorted(v for a, v in rows if a == k)
        want[k] = [own[int((len(own) - 1) * q)]]
    assert got == want


def test_durations(spark):
    df = spark.createDataFrame([("1 hour 30 min",), ("45 min",), ("soon",)], "c string").select(numbers.duration_minutes(F.col("c")).alias("m"))
    assert [r["m"] and float(r["m"]) for r in df.collect()] == [90.0, 45.0, None]
