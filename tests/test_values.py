"""Values named in questions, out of columns of many kinds."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import typing
from brindle.plans import values
from brindle.plans.ask import read_question
from brindle.plans.query import Filter


@pytest.fixture(scope="module")
def asked(spark):
    n = 5_000
    rows = spark.range(n).select(
        F.col("id").alias("_row"), F.concat(F.lit("Maker Number "), F.col("id").cast("string")).alias("maker"), F.element_at(F.array(*[F.lit(c) for c in ("New Delhi", "Pune", "Navi Mumbai", "Mumbai")]), (F.col("id") % 4 + 1).cast("int")).alias("city"),
        (F.col("id") * 3 % 1000 + 1).cast("string").alias("price"),
    )
    profile = typing.collect_profile(rows, ["maker", "city", "price"])
    typed = typing.add_typed(rows, profile, ["maker", "city", "price"])
    return spark, values.value_index(typed, profile), profile


@pytest.mark.parametrize(("question", "want"), [
    ("average price of maker number 4321", {"maker": ("Maker Number 4321",)}),
    ("average price of Maker-Number 4321?", {"maker": ("Maker Number 4321",)}),
    ("average price of makr number 4321", {"maker": ("Maker Number 4321",)}),
    ("average price in navi mumbai", {"city": ("Navi Mumbai",)}),
    ("average price in Mumbay and pune!", {"city": ("Mumbai", "Pune")}),
    ("average price in new delhi", {"city": ("New Delhi",)}),
    ("average price in nowhere", {}),
    ("maker number 99999", {}),
    ("", {}),
    ("of the and", {}),
])
def test_values_of_a_question(asked, question, want):
    spark, index, profile = asked
    assert profile["maker"].distinct == 5000
    assert values.understood(spark, index, profile, question)[1].values == want


def test_a_question_with_a_typing_error_gets_the_right_filter(asked):
    spark, index, profile = asked
    text, vocabulary = values.understood(spark, index, profile, "Average price for makr number 17?")
    plan = read_question(text, vocabulary).plan
    assert text == "Average price for Maker Number 17?" and plan.agg == "avg" and Filter("in", "maker", ("Maker Number 17",)) in plan.filters


def test_two_values_equally_near_are_no_answer(spark):
    rows = spark.createDataFrame([(0, "kettle a"), (1, "kettle b")] * 3, "_row long, item string")
    profile = typing.collect_profile(rows, ["item"])
    index = values.value_index(typing.add_typed(rows, profile, ["item"]), profile)
    assert values.named_values(spark, index, "kettle c") == [] and [v[3] for v in values.named_values(spark, index, "kettle b")] == ["kettle b"]


def test_a_category_that_had_its_share_waits_until_no_other_does(spark):
    import random
    from collections import deque
    from math import ceil

    from brindle.operators import reports

    rng = random.Random(3)
    rows = [(q, rng.choice("abc") if q else "a", i, rng.choice([0, 1, 3])) for i, q in enumerate([0] * 30 + [1] * 60 + [2] * 60)]
    want = {}
    for q in range(3):
        target, mine = 40, [r for r in rows if r[0] == q]
        terms = {r[1] for r in mine}
        cap, on, total, had = ceil(target * 1.5 / len(terms)), len(terms) > 1, 0, dict.fromkeys(terms, 0)
        tasks, later, n = deque(mine), [], 0
        while tasks or later:
            if not tasks:
                tasks, later, on = deque(later), [], False
            task = tasks.popleft()
            if on and had[task[1]] >= cap:
                later.append(task)
                continue
            n += 1
            want[task[2]] = (not on and len(terms) > 1, n, total < target)
            had[task[1]] += task[3]
            total += task[3]
    got = reports.capped_turns(spark.createDataFrame(rows, "q int, term string, at int, n int"), "q", "term", "at", "n", 40)
    assert {r["at"]: (r["deferred"], r["position"], r["ran"]) for r in got.collect()} == want
    assert any(w[0] for w in want.values()) and not all(w[2] for w in want.values())
