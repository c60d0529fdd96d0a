"""Mixing sources to target weights (native).

Tokens are summed per source, a repetition rate follows from each source's
target, and every document is emitted floor(rate) times plus one hash-seeded
Bernoulli copy with probability equal to the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD_CLASS, materialize, salted_join


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): water-filling of ``share`` of all sizes.

    Sources in code-point order, null last, take the weights in turn. A target
    stops at ``most`` times its source's size; sorted by cap over weight, the
    capped sources are a prefix, and the rest split what remains by weight.
    The windows here run over one short row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn(
        "cap", F.lit(most) * F.col("source_size")
    )
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = ranked.withColumn(
        "lam",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    ).withColumn("pos", F.row_number().over(order))
    open_at = F.min(F.when(F.col("cap") > F.col("w") * F.col("lam"), F.struct("pos", "lam"))).over(every)
    return level.withColumn("open", open_at).select(
        "source",
        "source_size",
        F.when(F.col("open").isNull() | (F.col("pos") < F.col("open.pos")), F.col("cap")).otherwise(F.col("w") * F.col("open.lam")).alias("target"),
    )


def _unit(seed: Column) -> Column:
    """A number in [0, 1) from the document's id and a seed."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), seed), 11) / F.lit(float(1 << 53))


def mix_rates(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seeds: int = 16) -> DataFrame:
    """(source, _mix): target, whole copies, fraction and hash seed of each source of ``sizes`` (doc_id, source, size).

    Of ``seeds`` hash seeds each source uses the one whose Bernoulli draws come
    closest to its target, so sources of few long documents come near it too.
    """
    rates = materialize(
        source_targets(sizes, weights, share, most)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("rate"))
        .withColumn("part", F.col("rate") - F.col("whole"))
    )
    rated = salted_join(sizes, rates.select("source", "part"), ["source"], F.col("doc_id"))
    draws = rated.groupBy("source").agg(*[F.sum(F.when(_unit(F.lit(k)) < F.col("part"), F.col("size")).otherwise(F.lit(0))).alias(f"s{k}") for k in range(seeds)])
    miss = F.array_min(F.array(*[F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{k}") - F.col("target")).alias("miss"), F.lit(k).alias("seed")) for k in range(seeds)]))
    chosen = rates.alias("r").join(draws.withColumnRenamed("source", "s"), F.col("r.source").eqNullSafe(F.col("s")))
    return materialize(chosen.select("source", F.struct("source_size", "target", "whole", "part", miss["seed"].alias("seed")).alias("_mix")))


def _copies() -> Column:
    return (F.col("_mix.whole") + F.when(_unit(F.col("_mix.seed")) < F.col("_mix.part"), 1).otherwise(0)).cast("int")


def mix_plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seeds: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Draws depend on doc_id and seed alone: reruns agree, rows repeated with one
    doc_id share their draw. Null text counts 0 words and null source is a
    source. Other columns are neither read nor kept; an empty table gives an
    empty plan.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    planned = salted_join(sizes, mix_rates(sizes, weights, share, most, seeds), ["source"], F.col("doc_id"))
    return planned.select("doc_id", "source", "size", "_mix.source_size", "_mix.target", _copies().alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seeds: int = 16) -> DataFrame:
    """The mixed corpus: every row of ``docs``, all its columns, as often as ``mix_plan`` says (at most ``most`` times, rounded up)."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))
    planned = salted_join(packed, mix_rates(sizes, weights, share, most, seeds), ["source"], F.col("doc_id"))
    taken = planned.select("_whole", _copies().alias("_times")).filter("_times > 0")
    copies = taken.select("_whole", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    return copies.select(*[F.col("_whole").getField(c).alias(c) for c in docs.columns])
