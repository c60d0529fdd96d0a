"""Quality rules (native): robust multivariate outliers.

For each language and source a minimum-covariance-determinant estimate is
reached by concentration steps from two starts; documents whose transformed statistics lie far
by Mahalanobis distance are rejected. Everything is grouped DataFrame
aggregation: one scan of the texts, then small jobs over narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import SPACE_CHARS, WORD_CLASS, let, materialize, salted_join, without, words_of

FEATURES = ("len", "mean", "sym", "dup", "rep")
#: Smallest spread that counts, in each feature's own unit; a group's own spread
#: counts where it is larger. It keeps a feature that is constant in a group (no
#: symbols anywhere) from judging what a repeated line or phrase or two change.
FLOOR = {"len": 0.30, "mean": 0.05, "sym": 0.15, "dup": 0.08, "rep": 0.08}
#: Features are held as whole multiples of 1/UNIT, so sums are exact and reruns agree.
UNIT = 1024
#: Share of a group's rows in the concentrated subset.
CORE = 0.75
#: 0.75 and 0.9999 quantiles of chi-square with 5 degrees of freedom (fixed values).
CHI2_CORE, CHI2_CUT = 6.626, 25.745
#: Rows that a group needs for an estimate of its own.
LEAST = 100


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in ``words``.

    Windows are hashed and sorted with their places; a window with an equal
    neighbour is repeated. For the repeated places p in order, the windows
    [p, p + 2] cover the sum of min(3, next p - p), and 3 for the last one.
    """
    def covered(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

        def places(s: Column) -> Column:
            flagged = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]).eqNullSafe(F.lit(True)) | (F.get(s, i + 1)["h"] == x["h"]).eqNullSafe(F.lit(True)))
            return F.sort_array(F.transform(flagged, lambda x: x["p"]))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return let(F.sort_array(hashed), lambda s: let(places(s), total))

    return F.when(F.size(words) >= 3, covered(words)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(*keep, text.alias("text")).select(
        *keep,
        (F.char_length(F.translate("text", SPACE_CHARS, ""))).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CLASS)).alias("lines"),
        words_of(F.col("text")).alias("words"),
    )
    return lines.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("words"), repeat_words).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    value = {
        "len": F.log1p(F.col("n_words").cast("double")),
        "mean": F.log(chars / n),
        "sym": F.log1p(20.0 * F.col("n_symbols") / chars),
        "dup": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "rep": F.sqrt(F.col("n_repeat_words") / n),
    }
    return stats.select("*", *[F.round(v * UNIT).cast("long").alias(f"x_{k}") for k, v in value.items()])


def _pools(rows: DataFrame) -> DataFrame:
    """(lang, source, g): the group that judges a row. Small (lang, source) pairs pool by language, small languages all together."""
    counts = rows.filter("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= LEAST
    by_lang = Window.partitionBy("lang")
    return counts.withColumn("n_lang", F.sum(F.when(~own, F.col("n")).otherwise(0)).over(by_lang)).select(
        "lang",
        "source",
        F.when(own, F.to_json(F.struct("lang", "source"))).when(F.col("n_lang") >= LEAST, F.to_json(F.struct("lang"))).otherwise(F.lit("{}")).alias("g"),
    )


def _whitened(moments: DataFrame) -> DataFrame:
    """From count n, sums s_i and s_i_j of each (g, start): means m_i, the inverse Cholesky factor w_i_j of the covariance, and the logarithm of its determinant."""
    out = moments
    for i in FEATURES:
        out = out.withColumn(f"m_{i}", F.col(f"s_{i}") / F.col("n"))
    for a, i in enumerate(FEATURES):
        for j in FEATURES[: a + 1]:
            cov = F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")
            out = out.withColumn(f"c_{i}_{j}", F.greatest(cov, F.lit(float((FLOOR[i] * UNIT) ** 2))) if i == j else cov)
    for a, i in enumerate(FEATURES):
        for b, j in enumerate(FEATURES[: a + 1]):
            rest = F.col(f"c_{i}_{j}")
            for k in FEATURES[:b]:
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for b, j in enumerate(FEATURES):
        for a in range(b, len(FEATURES)):
            i = FEATURES[a]
            if i == j:
                out = out.withColumn(f"w_{i}_{j}", 1.0 / F.col(f"l_{i}_{i}"))
            else:
                dot = sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in FEATURES[b + 1 : a]), F.col(f"l_{i}_{j}") * F.col(f"w_{j}_{j}"))
                out = out.withColumn(f"w_{i}_{j}", -dot / F.col(f"l_{i}_{i}"))
    size = sum((2 * F.log(f"l_{i}_{i}") for i in FEATURES[1:]), 2 * F.log(f"l_{FEATURES[0]}_{FEATURES[0]}"))
    return out.select("g", "start", size.alias("logdet"), *[f"m_{i}" for i in FEATURES], *[f"w_{i}_{j}" for a, i in enumerate(FEATURES) for j in FEATURES[: a + 1]])


def _distance() -> Column:
    total = F.lit(0.0)
    for a, i in enumerate(FEATURES):
        z = F.lit(0.0)
        for j in FEATURES[: a + 1]:
            z = z + F.col(f"w_{i}_{j}") * (F.col(f"x_{j}") - F.col(f"m_{j}"))
        total = total + z * z
    return total


def _medians(core: DataFrame) -> DataFrame:
    """The first start: medians and scaled interquartile ranges of each group. The values are whole numbers of few kinds, so exact percentiles are counted, not collected."""
    quarts = core.groupBy("g").agg(*[F.percentile((F.col(f"x_{i}") / 16).cast("long"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{i}") for i in FEATURES])
    cols = [(F.get(f"q_{i}", F.lit(1)) * 16).alias(f"m_{i}") for i in FEATURES]
    for a, i in enumerate(FEATURES):
        for j in FEATURES[: a + 1]:
            spread = (F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) * 16 / 1.349
            cols.append((1.0 / F.greatest(spread, F.lit(FLOOR[i] * UNIT)) if i == j else F.lit(0.0)).alias(f"w_{i}_{j}"))
    return quarts.select("g", F.lit(0).alias("start"), F.lit(float("inf")).alias("logdet"), *cols)


def _sums() -> list[Column]:
    return [F.sum(f"x_{i}").alias(f"s_{i}") for i in FEATURES] + [F.sum(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"s_{i}_{j}") for a, i in enumerate(FEATURES) for j in FEATURES[: a + 1]]


def _moments(core: DataFrame) -> DataFrame:
    """The second start: mean and covariance of all rows of each group."""
    return _whitened(core.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *_sums()).withColumn("start", F.lit(1)))


def _core_bins(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """Bins of distance (on a log scale, of fixed width) that hold the nearest CORE of each key's rows, so no group is ever sorted."""
    bins = rows.groupBy(*keys, F.floor(F.log1p("d2") * 32).alias("bin")).agg(F.count(F.lit(1)).alias("n"), *sums)
    w = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bins.withColumn("below", below).withColumn("all", F.sum("n").over(w)).filter(F.col("below") < F.col("all") * CORE)


def _concentrate(core: DataFrame, params: DataFrame) -> DataFrame:
    """One step: moments of each group's nearest rows, for every start at once."""
    d = salted_join(core, params, ["g"], F.col("doc_id"), how="inner").withColumn("d2", _distance())
    near = _core_bins(d, ["g", "start"], *_sums())
    return near.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s_{i}" for i in FEATURES], *[f"s_{i}_{j}" for a, i in enumerate(FEATURES) for j in FEATURES[: a + 1]]]])


def fit(rows: DataFrame, most_steps: int = 12) -> DataFrame:
    """(lang, source, _fit): location, whitening, edge and size of the group that judges each language and source.

    ``rows`` are featured (see ``_features``) and hold base_failed; the rows
    that pass the base rules are fitted, pooled for small groups. Steps go on
    from both starts until no determinant moves; of each group's two ends the
    one with the smaller determinant counts. The edge is the core's largest
    distance, which scales distances to chi-square.
    """
    pools = materialize(_pools(rows))
    core = salted_join(rows.filter("not base_failed"), pools, ["lang", "source"], F.col("doc_id"), how="inner")
    core = materialize(core.select("doc_id", "g", *[f"x_{i}" for i in FEATURES]))
    params = materialize(_medians(core).unionByName(_moments(core)))
    for _ in range(most_steps):
        after = materialize(_whitened(_concentrate(core, params)))
        moved = after.join(params.select("g", "start", F.col("logdet").alias("was")), ["g", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        params = after
        if moved is None or moved < 0.01:
            break
    least = params.groupBy("g").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    params = materialize(params.join(least, ["g", "start"]))
    d = salted_join(core, params, ["g"], F.col("doc_id"), how="inner").withColumn("d2", _distance())
    edge = _core_bins(d, ["g"]).groupBy("g").agg(F.expm1((F.max("bin") + 1) / 32.0).alias("edge"), F.max("all").alias("n_group"))
    final = params.drop("start", "logdet").join(edge, "g")
    return materialize(pools.join(final, "g").select("lang", "source", F.struct(*[c for c in final.columns if c != "g"]).alias("_fit")))


def _judged(rows: DataFrame, fitted: DataFrame, cut: float) -> DataFrame:
    """Adds distance and kept to featured rows. A group below LEAST rows rejects nothing."""
    total = F.lit(0.0)
    for a, i in enumerate(FEATURES):
        z = F.lit(0.0)
        for j in FEATURES[: a + 1]:
            z = z + F.col(f"_fit.w_{i}_{j}") * (F.col(f"x_{j}") - F.col(f"_fit.m_{j}"))
        total = total + z * z
    scaled = total * CHI2_CORE / F.greatest(F.col("_fit.edge"), F.lit(CHI2_CORE))
    out = salted_join(rows, fitted, ["lang", "source"], F.col("doc_id")).withColumn("distance", F.when(F.col("_fit.n_group") >= LEAST, scaled))
    # One CASE, so that no part of it is pushed below the join and counted a second time there.
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance"), F.lit(0.0)) <= cut))


def judge(docs: DataFrame, cut: float = CHI2_CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, source, the counts, base_failed, distance, kept.

    Null text has no words and fails the base rules; null lang and source are
    values of their own; repeated rows are judged alike; an empty table gives
    an empty result and extra columns are not read.
    """
    rows = materialize(_features(statistics(docs)).withColumn("base_failed", base_failed()))
    return _judged(rows, fit(rows), cut).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"
    )


def accept(docs: DataFrame, cut: float = CHI2_CUT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns. Texts are counted once; the rejected ones are listed by id, language, source and text hash, and taken out."""
    named = docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))
    keys = ["_h", "doc_id", "lang", "source"]
    narrow = materialize(_features(statistics(named, (*keys,))).withColumn("base_failed", base_failed()))
    gone = materialize(_judged(narrow, fit(narrow), cut).filter("not kept").select(*keys).distinct())
    return without(named.select(*keys, "_whole"), gone, keys).select(*[F.col("_whole").getField(c).alias(c) for c in docs.columns])
