"""An index of cell values, asked by questions: which values of which columns does a question name, typing errors included.

The index is a table, however many values there are: every value stands under
its plain name and, if long enough, under that name with each one character
left out. A question's word runs, varied the same way, are a handful of rows;
they are sent to the index, so nothing of it is shuffled or collected. Two
names that differ by one edit share a variant, and all that meet are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import plain_name
from brindle.operators.typing import ColumnProfile
from brindle.plans.ask import FILLER, Vocabulary
from brindle.tables import written

#: Most words of a value that a question can name, and letters from which a typing error is forgiven.
MOST_WORDS, LEAST_LETTERS = 8, 5
#: Kinds of columns whose values are words.
WORDED = ("category", "text")


def _variants(name: Column) -> Column:
    """A plain name and, where it is long enough, the name without each of its characters."""
    n = F.char_length(name)
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, n)))
    return F.array_distinct(F.when(n >= LEAST_LETTERS, F.concat(F.array(name), without)).otherwise(F.array(name)))


def value_index(typed: DataFrame, profile: dict[str, ColumnProfile], columns: Iterable[str] | None = None) -> DataFrame:
    """(variant, name, column, label): every value of the worded columns of a typed table, written once for many questions.

    Values of more than ``MOST_WORDS`` words can't be named and are left out;
    blank ones have no key. One shuffle, of distinct values.
    """
    chosen = [c for c in (columns or profile) if profile[c].kind in WORDED]
    if not chosen:
        return typed.sparkSession.createDataFrame([], "variant string, name string, column string, label string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__key").alias("key"), F.col(f"{c}__label").alias("label")) for c in chosen])
    values = typed.select(F.explode(cells).alias("v")).filter("v.key is not null").groupBy("v.column", "v.key").agg(F.min("v.label").alias("label"))
    named = values.select("column", "label", plain_name(F.col("key")).alias("name")).filter((F.col("name") != "") & (F.size(F.split("name", " ")) <= MOST_WORDS))
    return written(named.select(F.explode(_variants(F.col("name"))).alias("variant"), "name", "column", "label"))


def _runs(question: str) -> list[tuple[int, int, str]]:
    """(first character, end, plain name) of each run of the question's words that is not of filler words alone."""
    words = [(m.start(), m.end(), re.sub(r"[^a-z0-9]", "", m[0].lower())) for m in re.finditer(r"\S+", question)]
    words = [w for w in words if w[2]]
    out = []
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + MOST_WORDS) + 1):
            if any(w not in FILLER for _, _, w in words[i:j]):
                out.append((words[i][0], words[j - 1][1], " ".join(w for _, _, w in words[i:j])))
    return out


def named_values(spark: SparkSession, index: DataFrame, question: str) -> list[tuple[int, int, str, str]]:
    """(first character, end, column, label) of the values that a question names, longest runs first and none inside another.

    A run that is a value's name counts before one that is an edit away. Where
    a run names values of several columns, all are given; of several values an
    edit away in one column, none: the question doesn't say which.
    """
    runs = _runs(question)
    if not runs:
        return []
    asked = spark.createDataFrame(runs, "start int, stop int, run string")
    asked = asked.withColumn("variant", F.explode(_variants(F.col("run"))))
    met = index.join(F.broadcast(asked), "variant").select("start", "stop", "column", "label", F.levenshtein("run", "name", 1).alias("edits")).filter("edits >= 0").distinct()
    # One label a run and column comes back, or none where several are equally near.
    best = met.groupBy("start", "stop", "column", "edits").agg(F.min("label").alias("label"), F.max("label").alias("other")).collect()
    nearest: dict[tuple[int, int, str], int] = {}
    for r in best:
        key = (r["start"], r["stop"], r["column"])
        nearest[key] = min(nearest.get(key, 9), r["edits"])
    exact = {(r["start"], r["stop"]) for r in best if r["edits"] == 0}
    fit = [r for r in best if r["edits"] == nearest[r["start"], r["stop"], r["column"]] and r["label"] == r["other"] and (r["edits"] == 0 or (r["start"], r["stop"]) not in exact)]
    taken: list[tuple[int, int]] = []
    out = []
    for r in sorted(fit, key=lambda r: (r["edits"], r["start"] - r["stop"], r["start"], r["column"])):
        span = (r["start"], r["stop"])
        if span in taken or all(span[1] <= a or b <= span[0] for a, b in taken):
            taken.append(span)
            out.append((*span, r["column"], r["label"]))
    return out


def understood(spark: SparkSession, index: DataFrame, profile: dict[str, ColumnProfile], question: str) -> tuple[str, Vocabulary]:
    """The question with its values written as the table has them, and the vocabulary of just these: what ``read_question`` and ``fast_plan`` read."""
    found = named_values(spark, index, question)
    text = question
    for start, stop, label in sorted({(a, b, label) for a, b, _, label in found}, reverse=True):
        ending = re.search(r"[?!.,;:]*$", question[start:stop])[0]
        text = text[:start] + label + ending + text[stop:]
    values: dict[str, list[str]] = {}
    for _, _, column, label in found:
        values.setdefault(column, []).append(label)
    return text, Vocabulary(profile, {c: tuple(sorted(set(v))) for c, v in values.items()})
