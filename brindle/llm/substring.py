"""Substring dedup by seed and extend.

Seeds are winnowed anchors: every window of the threshold length holds the
anchor that is least by hash among its short word runs, so two documents that
share a window share its anchor. Anchors found in two documents or more are
extended both ways to each threshold-long window around them; windows that
start in a smaller document are repeats, and overlapping repeats merge into
maximal ones when their words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, looked_up, materialize, release, text_of

#: Words of a window, and of an anchor. A window holds WINDOW - ANCHOR + 1 anchors' places.
WINDOW, ANCHOR = 13, 6
#: Words handled at once.
CHUNK_WORDS = 500_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, distinct words, word numbers, word hashes, offsets of the rows) for runs of rows."""
    split = pc.ascii_split_whitespace(texts)
    words, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    coded = words.filter(pa.array(real)).dictionary_encode()
    kinds, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in kinds), np.uint64, len(kinds))
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_WORDS, side="right")) - 1))
        part = index[offsets[row] : offsets[stop]]
        yield row, kinds, part, hashes[part], offsets[row : stop + 1] - offsets[row]
        row = stop


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h *= _MULT
        h += words[j : j + n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _windows(words: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, anchor place, anchor hash) of each window that lies inside one row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = max(0, len(words) - window + 1)
    grams = _grams(words, anchor)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - anchor + 1):
        here = grams[j : j + n]
        lower = here < least
        np.copyto(least, here, where=lower)
        at[lower] = j
    start = np.flatnonzero(row[:n] == row[window - 1 :]) if n else np.zeros(0, np.int64)
    return start, row[start], start + at[start], least[start]


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(a, doc_id, t): each text's winnowed anchors."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, words, offsets in _chunks(batch.column(2)):
                _, row, place, h = _windows(words, offsets, window, anchor)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                own = batch.select([0, 1]).take(pa.array(row[new] + first))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), *own.columns], names=["a", "doc_id", "t"])

    return docs.select("doc_id", "t", "text").mapInArrow(find, "a long, doc_id long, t long")


def _sets(column: pa.Array, row: int) -> np.ndarray:
    value = column[row]
    return np.zeros(0, np.uint64) if not value.is_valid else value.values.to_numpy(zero_copy_only=False).view(np.uint64)


def extend(docs: DataFrame, seeds: DataFrame, window: int, anchor: int) -> DataFrame:
    """(w, doc_id, t): hashes of the windows around each text's shared anchors (seeds.found)."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(3)
            for first, _, _, words, offsets in _chunks(batch.column(2)):
                start, row, _, h = _windows(words, offsets, window, anchor)
                whole = _grams(words, window)[start]
                edges = np.searchsorted(row, np.arange(len(offsets)))
                keep = np.zeros(len(start), bool)
                for r in range(len(offsets) - 1):
                    keep[edges[r] : edges[r + 1]] = np.isin(h[edges[r] : edges[r + 1]], _sets(found, first + r))
                own = batch.select([0, 1]).take(pa.array(row[keep] + first))
                yield pa.RecordBatch.from_arrays([pa.array(whole[keep].view(np.int64)), *own.columns], names=["w", "doc_id", "t"])

    return docs.join(seeds, ["doc_id", "t"]).select("doc_id", "t", "text", "found").mapInArrow(grow, "w long, doc_id long, t long")


def whole_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, t) of each text that a smaller document has as a whole."""
    digests = docs.select("doc_id", "t", F.unhex(F.sha2("text", 256)).alias("digest"))
    least = materialize(digests.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("digest", "lo"))
    return looked_up(digests, least, ["digest"]).filter("lo < doc_id").select("doc_id", "t").distinct()


def cut(docs: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256: each text without its repeats.

    ``repeats`` holds a document's window hashes (found), or null where the
    whole document repeats a smaller one.
    """
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, copied = batch.column(0), batch.column(2), batch.column(3).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for first, kinds, index, words, offsets in _chunks(batch.column(1)):
                kinds_at = np.array(kinds, object)
                whole = _grams(words, window)
                for r in range(len(offsets) - 1):
                    lo, hi = offsets[r], offsets[r + 1]
                    hashes = _sets(found, first + r)
                    numbers = index[lo:hi]
                    if copied[first + r] and hi - lo >= window:
                        numbers = numbers[:0]
                    elif len(hashes) and hi - lo >= window:
                        starts = np.flatnonzero(np.isin(whole[lo : hi - window + 1], hashes))
                        gone = np.zeros(hi - lo + 1, np.int64)
                        gone[starts] += 1
                        np.subtract.at(gone, starts + window, 1)
                        numbers = numbers[np.cumsum(gone)[:-1] == 0]
                    text = " ".join(kinds_at[numbers].tolist())
                    for column, value in zip(out, (ids[first + r].as_py(), int(hi - lo), int(hi - lo) - len(numbers), text, hashlib.sha256(text.encode()).hexdigest()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    marked = docs.join(repeats.withColumn("hit", F.lit(True)), ["doc_id", "t"], "left")
    copied = F.coalesce(F.col("hit") & F.col("found").isNull(), F.lit(False)).alias("copied")
    return marked.select("doc_id", "text", "found", copied).mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text, kept_sha256.

    Removes each word covered by a ``window``-word window whose words also
    start in a document with a smaller doc_id, judged on the input. A repeat
    inside one document, or between rows with one doc_id, is left; such rows are cut each by its own text (t, its hash). Anchors and
    windows meet as (hash, smallest doc_id) pairs summed before the shuffle, so
    a passage in a third of all documents costs a row for each task, not pairs.
    A document that repeats a smaller one as a whole is found by digest; it is
    cut whole and adds nothing that the smaller one lacks.
    Null and wordless texts have no words and keep the empty text; rows without
    a doc_id are neither cut nor a source; an empty table gives an empty result
    and other columns are not read.
    """
    if not 1 <= anchor < window:
        raise ValueError("an anchor must be shorter than a window")
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("t", F.xxhash64("text"))
    owned = texts.filter("doc_id is not null")
    copies = materialize(whole_copies(owned))
    found = anchors(owned, window, anchor)
    # What is shared is written before it is joined back: the sums' shuffle files can go, and the join's two plain exchanges let Spark split a hot hash.
    shared = materialize(found.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("a"))
    release(spark)
    seeds = materialize(found.join(shared.hint("merge"), "a").groupBy("doc_id", "t").agg(F.collect_set("a").alias("found")).join(copies, ["doc_id", "t"], "left_anti"))
    discard(shared)
    release(spark)
    windows = materialize(extend(owned, seeds, window, anchor))
    discard(seeds)
    release(spark)
    least = materialize(windows.groupBy("w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("w", "lo"))
    release(spark)
    repeats = materialize(windows.join(least.hint("merge"), "w").filter("lo < doc_id").groupBy("doc_id", "t").agg(F.collect_set("w").alias("found")))
    discard(windows)
    discard(least)
    release(spark)
    return cut(texts, repeats.unionByName(copies.withColumn("found", F.lit(None).cast("array<bigint>"))), window)
