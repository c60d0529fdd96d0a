"""A table with one current row a key, kept by small steps: merge on read, by bucket of the key.

A batch writes only its own rows, one file or so for each bucket that it
touches, and a manifest that names, for every bucket, its base and the deltas
since. Readers take the manifest's files and, in buckets with deltas, the last
row of each key. A bucket with many deltas is rewritten as a new base; no
other bucket is. A version is whole or absent: it is there once its manifest
is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.tables import file_system


class KeyedTable:
    """The table at ``path``: columns of ``schema``, one row for each value of ``key`` (null is a value).

    Of a key's rows the one of the latest batch counts, within a batch the one
    with the largest ``order`` (null the smallest, ties any one row). One
    writer at a time: a second one fails instead of losing rows.
    ``buckets`` is fixed when the table is made; ``most`` deltas of a bucket
    start its rewriting; the files of the last ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, schema: T.StructType | None = None, buckets: int = 32, most: int = 8, keep: int = 3):
        self.spark, self.path, self.key, self.order, self.most, self.keep = spark, path.rstrip("/"), key, order, most, keep
        self._fs, self._kind = file_system(spark, path)
        now = self._versions()
        if not now and schema is None:
            raise ValueError(f"{path} holds no table yet: its schema is needed")
        self._empty = {"version": 0, "key": key, "order": order, "buckets": buckets, "schema": schema and schema.jsonValue(), "batch": -1, "files": {}}
        if now:
            state = self._state()
            if (state["key"], state["order"]) != (key, order):
                raise ValueError(f"{path} is kept by {state['key']} and {state['order']}")

    # ------------------------------------------------------------ manifests
    def _versions(self) -> list[int]:
        folder = self._kind(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._kind(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self) -> dict:
        versions = self._versions()
        return self._load(versions[-1]) if versions else dict(self._empty)

    def _commit(self, state: dict) -> None:
        target = self._kind(f"{self.path}/manifests/{state['version']:012d}.json")
        draft = self._kind(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(json.dumps(state).encode())
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"another writer has made version {state['version']} of {self.path}")

    # ------------------------------------------------------------ reading
    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _schema(self, state: dict) -> T.StructType:
        return T.StructType.fromJson(state["schema"])

    def _rows(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        """The current rows, of all buckets or of those named."""
        schema = self._schema(state)
        files = {b: f for b, f in state["files"].items() if buckets is None or b in buckets}
        alone = [f[0] for f in files.values() if len(f) == 1]
        many = [p for f in files.values() if len(f) > 1 for p in f]
        none = self.spark.createDataFrame([], schema)
        plain = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in alone]) if alone else none
        if not many:
            return plain
        steps = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in many])
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/step=(\d+)-", 1).cast("long")
        cells = F.struct(*[F.col(f"`{c}`") for c in schema.names])
        last = steps.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(cells, F.struct(at.alias("a"), F.col(self.order).alias("b"))).alias("_row"))
        return plain.union(last.select("_row.*"))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or as of an earlier version that is still kept."""
        return self._rows(self._state() if version is None else self._load(version))

    @property
    def version(self) -> int:
        return self._state()["version"]

    # ------------------------------------------------------------ writing
    def apply(self, batch: DataFrame, number: int, on_new: Callable[[DataFrame], None] | None = None) -> bool:
        """Takes in batch ``number``; False if it, or a later one, is in already, so a batch that is run again changes nothing.

        ``on_new`` gets the rows of keys that the table lacks, before the batch
        counts: a batch that fails and is run again may announce them twice,
        none is left out. Only the keys of touched buckets are read for it.
        """
        state = self._state()
        state["schema"] = state["schema"] or batch.schema.jsonValue()
        if number <= state["batch"]:
            return False
        schema, step = self._schema(state), state["version"] + 1
        cells = F.struct(*[F.col(f"`{c}`") for c in schema.names])
        last = batch.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(cells, F.struct(F.col(self.order).alias("b"))).alias("_row")).select("_row.*")
        folder = f"data/step={step:012d}-{uuid.uuid4().hex}"
        touched = self._write(last, folder, state["buckets"])
        if on_new:
            mine = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in touched.values()]) if touched else last.limit(0)
            known = self._rows(state, list(touched)).select(F.col(self.key).alias("_known"))
            on_new(mine.join(known, F.col(self.key).eqNullSafe(F.col("_known")), "left_anti"))
        files = {**state["files"], **{b: [*state["files"].get(b, []), p] for b, p in touched.items()}}
        state = state | {"version": step, "batch": number, "files": files}
        self._commit(state)
        self._compact(state)
        return True

    def _write(self, rows: DataFrame, folder: str, buckets: int) -> dict[str, str]:
        """Writes rows by bucket; bucket -> its folder."""
        named = rows.withColumn("_bucket", self._bucket(buckets))
        named.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._kind(f"{self.path}/{folder}"))]
        return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in found if n.startswith("_bucket=")}

    def _compact(self, state: dict) -> None:
        """Rewrites the buckets with too many deltas, and drops files that no kept version names."""
        full = [b for b, f in state["files"].items() if len(f) > self.most]
        if full:
            step = state["version"] + 1
            made = self._write(self._rows(state, full), f"data/step={step:012d}-{uuid.uuid4().hex}", state["buckets"])
            self._commit(state | {"version": step, "files": {**state["files"], **{b: [p] for b, p in made.items()}}})
        versions = self._versions()
        for v in versions[: -self.keep]:
            self._fs.delete(self._kind(f"{self.path}/manifests/{v:012d}.json"), False)
        named = {p.rsplit("/", 1)[0] for v in versions[-self.keep :] for f in self._load(v)["files"].values() for p in f}
        for f in self._fs.listStatus(self._kind(f"{self.path}/data")):
            if f"data/{f.getPath().getName()}" not in named:
                self._fs.delete(f.getPath(), True)


def keep_current(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, on_new: Callable[[DataFrame], None] | None = None, interval: str = "2 seconds", **layout):
    """A running query that keeps the table at ``path`` current with each micro-batch of ``stream``; ``stop()`` ends it.

    A batch that is run again after a failure changes nothing (see ``KeyedTable.apply``).
    """
    schema = stream.schema

    def run(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, path, key, order, schema, **layout).apply(batch, number, on_new)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
