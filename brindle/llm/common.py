"""Helpers shared by the operators: words, scratch tables, skew-safe joins."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-space characters (empty for null)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure-ASCII texts take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``: Catalyst can't inline it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


# ---------------------------------------------------------------- scratch tables
_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A folder for this application in ``spark.checkpoint.dir``, removed when Python ends.

    Where that setting is absent and all runs on one machine, a temporary folder stands in; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="brindle-")
        _folders[app] = f"{base.rstrip('/')}/brindle-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared scratch folder and reads it back.

    The lineage is cut by files that every executor can read, so a lost
    executor costs no recomputation and repeated reads prune columns.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a materialized table that no later step reads."""
    for file in df.inputFiles()[:1]:
        _remove(df.sparkSession, file.rsplit("/", 1)[0])


#: Bytes of the Arrow batches that steps on whole texts get. Spark's own bound, 10,000 rows, makes batches of tens of MB of texts; each is held several times, in the JVM and by the worker.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send rows to Python in Arrow batches of about BATCH_BYTES, unless the session sets a size itself."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows of at most ``most`` bytes in column ``text``, or one longer row: bounds what a worker makes of a batch at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    row = 0
    while row < batch.num_rows:
        before = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


# ---------------------------------------------------------------- rows
#: The column that ``numbered`` adds.
ROW = "_brindle_row"


def numbered(docs: DataFrame) -> DataFrame:
    """A copy of ``docs`` in the scratch folder with ROW, a number of its own for every row. Written once, it is the same in every job, whatever executors are lost."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()))


# ---------------------------------------------------------------- joins
#: Most keys of a list that is sent to every task; longer lists are joined by merge.
SENT_KEYS = 500_000


def _listed(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    named = keys.select(*[F.col(c).alias(f"_brindle_k{i}") for i, c in enumerate(on)], *[c for c in keys.columns if c not in on])
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_brindle_k{i}"))
    few = keys.limit(SENT_KEYS + 1).count() <= SENT_KEYS
    return rows.join(F.broadcast(named) if few else named.hint("merge"), same, how)


def only(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows in a materialized list of keys (null meets null). A list of checked length is broadcast, so that texts are not shuffled for it; a longer one is joined by merge."""
    return _listed(rows, keys.select(*on), on, "left_semi")


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows not in a materialized list of keys (see ``only``)."""
    return _listed(rows, keys.select(*on), on, "left_anti")


def looked_up(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows in a materialized list of distinct keys, with the list's other columns (see ``only``)."""
    return _listed(rows, keys, on, "inner").drop(*[f"_brindle_k{i}" for i in range(len(on))])


def looked_up_or_null(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """All rows, with the other columns of a materialized list of distinct keys, null for rows that it lacks (see ``only``)."""
    return _listed(rows, keys, on, "left").drop(*[f"_brindle_k{i}" for i in range(len(on))])


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 32, how: str = "left") -> DataFrame:
    """Joins per-key values to many rows where one key may hold most rows.

    Each key's row is repeated once for each salt and the rows draw a salt
    from ``spread``, so no key lands in one task. Null keys match null keys.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit(17)), F.lit(salts)).cast("int"))
    right = small.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[c for c in small.columns if c not in keys],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"),
    )
    on = F.col("_salt") == F.col("_s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(right, on, how).drop("_salt", "_s", *[f"_k_{k}" for k in keys])


# ---------------------------------------------------------------- components
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set stands still.
    Every step is a grouped minimum joined back, so no neighbourhood is
    collected; edges live in scratch tables between the rounds.
    """
    def stats(df: DataFrame):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        return (row["n"], row["x"])

    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    seen = stats(now)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select(F.col("a"), F.col("m").alias("b")))
            .filter("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        now = materialize(small)
        after = stats(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps now instead of at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
