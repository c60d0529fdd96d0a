"""Exact dedup of a batch against an immutable snapshot.

Static binary-fuse filters, one for each digest bucket of the snapshot, screen
the batch's distinct digests. Positives join the snapshot's exact groups;
negatives can only repeat inside the batch, where they are grouped on their
own. Rows that share a digest are then compared byte for byte with the row
that stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import ascii_lower, looked_up, materialize, only, text_of, without

#: Keys of one filter: bounds the memory of the task that builds or probes it.
BUCKET_KEYS = 32_768


# ---------------------------------------------------------------- the filter
def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and seed (wrapping arithmetic)."""
    x = keys ^ np.uint64(int(seed) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return x ^ (x >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of each hash, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    return np.stack([(first + np.uint64(i)) * np.uint64(segment) + ((h >> np.uint64(11 * i)) & mask) for i in range(3)], axis=1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, segments, table) of a 3-wise binary-fuse filter of 16-bit fingerprints.

    Slots touched once are peeled in rounds; fingerprints are then set round by
    round backwards. Slots peeled in one round never touch each other's keys,
    so a round is a few array operations.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(11, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    for seed in range(1, 200):
        size = max(n * (1.125 + 0.25 * max(0.0, 1 - np.log10(max(n, 10)) / 6) + 0.02 * (seed // 10)), 1) + 8
        segments = max(3, int(np.ceil(size / segment)) + 2)
        h = _mix(keys, seed)
        slots = _slots(h, segment, segments)
        count = np.bincount(slots.ravel(), minlength=segment * segments)
        owner = np.zeros(segment * segments, np.int64)
        for i in range(3):
            np.bitwise_xor.at(owner, slots[:, i], np.arange(n))
        live, rounds = np.ones(n, bool), []
        ones = np.flatnonzero(count == 1)
        while len(ones):
            key, at = np.unique(owner[ones], return_index=True)
            place = ones[at]
            fresh = live[key]
            key, place = key[fresh], place[fresh]
            if not len(key):
                break
            live[key] = False
            rounds.append((key, place))
            touched = slots[key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(owner, touched, np.repeat(key, 3))
            ones = np.unique(touched)
            ones = ones[count[ones] == 1]
        if live.any():
            continue
        table, want = np.zeros(segment * segments, np.uint16), _prints(h)
        for key, place in reversed(rounds):
            table[place] = 0
            table[place] = want[key] ^ np.bitwise_xor.reduce(table[slots[key]], axis=1)
        return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed peels the filter")


def probe_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """True for every key of the filter, and for about 1 in 65,536 others."""
    h = _mix(keys.astype(np.uint64), seed)
    return np.bitwise_xor.reduce(np.frombuffer(table, np.uint16)[_slots(h, segment, segments)], axis=1) == _prints(h)


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter for each bucket of a snapshot's distinct digests (column key)."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(pdf["h"].to_numpy())
        return pd.DataFrame([[pdf["bucket"].iloc[0], *made]], columns=["bucket", "seed", "segment", "segments", "table"])

    return digests.select(*_bucketed(buckets)).groupBy("bucket").applyInPandas(build, "bucket int, seed long, segment long, segments long, table binary")


def _bucketed(buckets: int) -> list[Column]:
    return [F.pmod(F.xxhash64("key", F.lit(1)), F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64("key", F.lit(2)).alias("h")]


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Adds ``maybe`` to the batch's groups (key, n, top): false means surely not in the snapshot."""
    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(left), bool)
        if len(right) and len(left):
            f = right.iloc[0]
            maybe = probe_filter(left["h"].to_numpy(), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["table"])
        return left[["key", "n", "top"]].assign(maybe=maybe)

    return (
        batch.select("key", "n", "top", *_bucketed(buckets)).groupBy("bucket").cogroup(filters.groupBy("bucket"))
        .applyInPandas(probe, "key binary, n long, top long, maybe boolean")
    )


# ---------------------------------------------------------------- the operator
def _snapshot_or_batch() -> Column:
    """By default a quarter of the ids, by hash, is the batch and the rest the snapshot."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0


def _judged(docs: DataFrame, incoming: Column | None, key_bytes: int, bucket_keys: int) -> DataFrame:
    """doc_id, digest, keep_id and group_size of every row. Only texts whose key repeats are read again."""
    hashed = docs.select("doc_id", ascii_lower(text_of()).alias("text"), (_snapshot_or_batch() if incoming is None else incoming).alias("incoming")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    hashed = hashed.withColumn("key", F.substring("digest", 1, key_bytes))
    narrow = materialize(hashed.select("doc_id", "incoming", "digest", "key"))

    def grouped(df: DataFrame) -> DataFrame:
        return materialize(df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")))

    snapshot, batch = grouped(narrow.filter("not coalesce(incoming, false)")), grouped(narrow.filter("incoming"))
    buckets = max(1, -(-max(snapshot.count(), batch.count()) // bucket_keys))
    filters = materialize(snapshot_filters(snapshot, buckets))
    screened = materialize(screen(batch, filters, buckets))
    known = snapshot.join(screened.filter("maybe").select("key", F.col("n").alias("n2"), F.col("top").alias("top2")), "key", "full")
    groups = known.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("top", "top2").alias("top")).union(
        screened.filter("not maybe").select("key", "n", "top")
    )
    repeated = materialize(groups.filter("n > 1"))
    once = without(narrow, repeated, ["key"]).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return once.union(_byte_checked(looked_up(hashed.select("doc_id", "digest", "key", "text"), repeated, ["key"])))


def _byte_checked(again: DataFrame) -> DataFrame:
    """Compares the rows of each repeated key with the row that stays; unequal ones form groups by their own text."""
    again = materialize(again.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n") / 2000)).cast("int")))
    stays = again.filter("doc_id <=> top").groupBy("key", "n").agg(F.min("text").alias("kept_text"))
    stays = stays.select("key", "kept_text", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 2000).cast("int") - 1)).alias("part"))
    same = F.coalesce(F.col("text") == F.col("kept_text"), F.lit(False))
    checked = materialize(again.join(stays, ["key", "part"], "left").select("doc_id", "digest", "key", "n", "top", F.when(~same, F.col("text")).alias("other")))
    if checked.filter("other is not null").isEmpty():
        return checked.select("doc_id", "digest", F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
    split = checked.groupBy("key", "other").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    s = split.select(F.col("key").alias("_k"), F.col("other").alias("_o"), "group_size", "keep_id")
    return checked.join(s, (F.col("key") == F.col("_k")) & F.col("other").eqNullSafe(F.col("_o"))).select("doc_id", "digest", "keep_id", "group_size")


def dedup(docs: DataFrame, incoming: Column | None = None, key_bytes: int = 32, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest doc_id
    stays. ``incoming`` marks the batch, the other rows are the snapshot (by
    default a quarter of the ids, by hash, is the batch). ``key_bytes`` cuts
    the SHA-256 that groups rows; the byte check holds for any length. Null
    text is the empty text, null doc_id sorts below all others, equal rows
    under one doc_id share ``kept``, rows that repeat a doc_id with other texts
    are judged each by its own text; an empty table gives an empty result and
    other columns are not read.
    """
    return _judged(docs, incoming, key_bytes, bucket_keys).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_last(docs: DataFrame, incoming: Column | None = None, key_bytes: int = 32, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``docs`` without exact copies: of each group of equal texts one row with the largest doc_id stays, whole and by its own text."""
    many = materialize(_judged(docs, incoming, key_bytes, bucket_keys).filter("group_size > 1").groupBy("doc_id", "digest", "keep_id").agg(F.count(F.lit(1)).alias("times")))
    whole = docs.select("doc_id", F.unhex(F.sha2(ascii_lower(text_of()), 256)).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))
    gone = materialize(many.filter("not doc_id <=> keep_id").select("doc_id", "digest"))
    left = without(whole, gone, ["doc_id", "digest"])
    equal = materialize(many.filter("doc_id <=> keep_id and times > 1").select("doc_id", "digest"))  # rows repeated under one doc_id
    if not equal.isEmpty():
        left = without(left, equal, ["doc_id", "digest"]).union(only(left, equal, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]))
    return left.select(*[F.col("_whole").getField(c).alias(c) for c in docs.columns])
