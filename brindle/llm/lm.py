"""LM scoring with a log-frequency Bloom filter.

Counts of all words and word pairs of the training documents are summed in
buckets of their hashes. Every n-gram enters a Bloom filter once for each level of its
logarithmically quantised count; a count is read back by probing level after
level until one is missing. The filter is made in segments, as many as all
n-grams need to leave it half empty. Up to a bound it is broadcast to the
workers; beyond it the hashes that runs of texts ask for are sent to the segments
and the levels come back, so no n-gram is left out at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, materialize, release, small_batches, text_of

#: Bits of a segment that one task fills, probes of one level, and the largest filter that is broadcast.
SEGMENT_BITS, PROBES, BROADCAST_BITS = 1 << 19, 5, 1 << 29
#: Bits of the part of a larger filter that one task holds while texts ask for levels, and tasks among which the texts of a part are spread.
PART_SEGMENTS, SPREAD = 128, 8
#: Text bytes whose n-grams make a bucket of the counts, and n-grams in a row of a bucket.
BUCKET, HELD = 8 << 20, 256
#: Most words whose exact counts are broadcast for the base score; rarer ones are joined.
FREQUENT = 250_000
#: Weight of the pair's relative frequency against the single word's.
PAIR_WEIGHT = 0.6
#: Text bytes that a worker tokenizes at once, and text bytes that ask a larger filter together, in lists of so many hashes.
SLICE, ASKED, LISTED = 1 << 20, 4 << 20, 1024
#: The end of a document, counted as a token. No word is empty.
END = ""
_MULT = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column, modulus: int = 5, remainder: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus)) == remainder


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _pair(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return _mix(before * _MULT + now)


def _streams(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct tokens, token numbers of all rows with ends, offsets): token 0 is the end. A-Z are lower-cased."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    coded = words.filter(pa.array(real)).dictionary_encode()
    stream = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, offsets[1:], 0)
    return [END, *coded.dictionary.to_pylist()], stream, offsets + np.arange(len(offsets))


def _slices(batch: pa.RecordBatch, text: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``most`` text bytes, or one longer row: bounds what a worker holds at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    row = 0
    ends = np.cumsum(sizes)
    while row < len(sizes):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] - sizes[row] + most, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


def gram_counts(docs: DataFrame) -> DataFrame:
    """Counts of words (ends included) and of hashed pairs of neighbouring tokens, in buckets of the hash, summed exactly.

    Rows are of two kinds: (token, h, c) for a word, and (bucket, buckets,
    entries, hs, qs) for a run of at most HELD hashes of a bucket's n-grams
    with their levels. ``entries`` sums the levels. A document's first token
    follows an end. Each slice is summed and sent as one row to each bucket; buckets are as
    many as BUCKET bytes of text each need, so a task's share does not grow.
    """
    docs = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _slices(batch, 0, ASKED)):
            kinds, stream, _ = _streams(part.column(0))
            of, times = _hash(kinds), np.bincount(stream, minlength=len(kinds))
            h = of[stream]
            before = np.empty_like(h)
            before[1:], before[:1] = h[:-1], _hash([END])
            pair, n = _summed(_pair(before, h))
            to = segment_of(pair, buckets)
            order = np.argsort(to.astype(np.uint16) if buckets <= 1 << 16 else to, kind="stable")
            at = np.searchsorted(to[order], np.arange(buckets + 1))
            seen = np.flatnonzero(times)
            word_to = segment_of(of[seen], buckets)
            seen = seen[np.argsort(word_to, kind="stable")]
            word_at = np.searchsorted(np.sort(word_to), np.arange(buckets + 1))
            tokens = pa.ListArray.from_arrays(pa.array(word_at, pa.int32()), pa.array(kinds).take(pa.array(seen)))
            columns = [pa.array(np.arange(buckets, dtype=np.int32)), _blobs(pair[order], at), _blobs(n[order].astype(np.uint32), at), tokens, _blobs(times[seen].astype(np.uint32), word_at)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "hs", "ns", "tokens", "times"])
            pa.default_memory_pool().release_unused()

    def total(group: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        pair, n = _summed(joined("hs", np.uint64), joined("ns", np.uint32))
        flat = pa.table({"token": pc.list_flatten(group.column("tokens")), "c": joined("times", np.uint32).astype(np.int64)}).group_by("token").aggregate([("c", "sum")])
        h, c = _hash(flat.column("token").to_pylist()), flat.column("c_sum").to_numpy()
        grams, levels = np.concatenate([pair, h]), _level(np.concatenate([n, c])).astype(np.uint8)
        at = np.append(np.arange(0, len(grams), HELD), len(grams))
        runs, words = len(at) - 1, len(h)
        both = lambda first, last, kind: pa.concat_arrays([first.cast(kind), pa.nulls(runs, kind)] if last is None else [pa.nulls(words, kind), last.cast(kind)])
        return pa.table({
            "token": both(flat.column("token").combine_chunks(), None, pa.string()), "h": both(pa.array(h.view(np.int64)), None, pa.int64()), "c": both(pa.array(c), None, pa.int64()),
            "bucket": both(None, pa.array(np.full(runs, group.column("bucket")[0].as_py())), pa.int32()), "buckets": both(None, pa.array(np.full(runs, buckets)), pa.int32()),
            "entries": both(None, pa.array(np.add.reduceat(levels, at[:-1], dtype=np.int64)), pa.int64()), "hs": both(None, _blobs(grams, at), pa.binary()), "qs": both(None, _blobs(levels, at), pa.binary()),
        })

    sent = docs.mapInArrow(count, "bucket int, hs binary, ns binary, tokens array<string>, times binary")
    return sent.groupBy("bucket").applyInArrow(total, "token string, h long, c long, bucket int, buckets int, entries long, hs binary, qs binary")


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of ``n``, or how often each occurs)."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def _level(n: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7 and so on."""
    return np.frexp(n.astype(np.float64))[1]


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary value for the values between each two places."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


# ---------------------------------------------------------------- the filter
def _places(h: np.ndarray, level: int, segment_bits: int) -> Iterator[np.ndarray]:
    """Bit numbers inside the segment of each of a level's probes."""
    base = _mix(h + np.uint64(level * int(_MULT) & (2**64 - 1)))
    step = (base >> np.uint64(32)) | np.uint64(1)
    for p in range(PROBES):
        yield (base + np.uint64(p) * step) & np.uint64(segment_bits - 1)


def fill_segment(h: np.ndarray, levels: np.ndarray, segment_bits: int) -> bytes:
    bits = np.zeros(segment_bits, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(h[levels >= level], level, segment_bits):
            bits[place] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (_mix(h ^ _MULT) % np.uint64(segments)).astype(np.int64)


def read_levels(table: np.ndarray, h: np.ndarray, segment_bits: int, segments: int | None = None, first: int = 0) -> np.ndarray:
    """The quantised count of each hash: probes go on while every bit of a level is set. ``table`` holds the filter of ``segments`` from segment ``first`` on."""
    segments = len(table) * 8 // segment_bits if segments is None else segments
    start = ((segment_of(h, segments) - first) * segment_bits).astype(np.uint64)
    out, live, level = np.zeros(len(h), np.int64), np.arange(len(h)), 1
    while len(live) and level <= 64:
        hit = np.ones(len(live), bool)
        for place in _places(h[live], level, segment_bits):
            bit = start[live] + place
            hit &= ((table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        live = live[hit]
        out[live] = level
        level += 1
    return out


def value_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level: 2^(q-1) to 2^q - 1; 0 for none."""
    return np.where(levels > 0, (1.5 * np.exp2(levels - 1.0)) - 0.5, 0.0)


def filter_segments(grams: DataFrame, segment_bits: int) -> tuple[DataFrame, int]:
    """(s, bits) of every segment that holds an n-gram of ``grams`` (see ``gram_counts``), and the number of segments.

    Segments are as many as leave half of all bits unset when every n-gram has
    entered all of its levels, rounded up to a multiple of the buckets: then a
    segment's n-grams lie in one bucket and nothing is shuffled. A bucket that is
    read in two parts gives its segments twice; readers join their bits.
    """
    held = grams.filter("bucket is not null")
    told = held.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("n"), F.coalesce(F.max("buckets"), F.lit(1)).alias("b")).first()
    buckets = told["b"]
    segments = buckets * max(1, -(-int(told["n"] * PROBES / 0.69) // (segment_bits * buckets)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            h = np.frombuffer(b"".join(run.column(1).to_pylist()), np.uint64)
            q = np.frombuffer(b"".join(run.column(2).to_pylist()), np.uint8)
            s = segment_of(h, segments)
            order = np.argsort(s, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
                bits = fill_segment(h[some], q[some], segment_bits)
                yield pa.RecordBatch.from_arrays([pa.array(s[some[:1]], pa.int32()), pa.array([bits], pa.binary())], names=["s", "bits"])

    return held.select("bucket", "hs", "qs").mapInArrow(fill, "s int, bits binary"), segments


def whole_filter(parts: DataFrame, segments: int, segment_bits: int) -> np.ndarray:
    """The filter as bytes on the driver, for a broadcast of checked size."""
    table, width = np.zeros(segments * segment_bits // 8, np.uint8), segment_bits // 8
    for r in parts.toLocalIterator():
        table[r["s"] * width : (r["s"] + 1) * width] |= np.frombuffer(r["bits"], np.uint8)
    return table


def in_slices(texts: DataFrame) -> DataFrame:
    """(slice, k, doc_id, text, train): rows in runs of at most ASKED text bytes, numbered inside each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for part in (p for batch in batches for p in _slices(batch, 1, ASKED)):
            columns = [pa.array(np.full(len(part), number)), pa.array(np.arange(len(part), dtype=np.int32)), *part.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "k", "doc_id", "text", "train"])
            number += 1

    return texts.select("doc_id", "text", "train").mapInArrow(run, "slice long, k int, doc_id long, text string, train boolean")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (slice, ..) that follow each other as runs of one slice."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
            if held and b > a and held[0].column(0)[0].as_py() != numbers[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def asked_levels(rows: DataFrame, parts: DataFrame, segments: int, segment_bits: int) -> DataFrame:
    """(slice, k, part, list, levels) for rows (slice, k, .., text): the levels of the distinct n-grams of each run of a slice that was read together, k its first row, in the order of ``_asked``.

    A part's bits and the requests for it meet in SPREAD tasks: both are dealt
    by (part, spread) and sorted, the bits first, so a task streams the
    requests past one part of the filter. An n-gram is asked for once for a
    run of texts, and all requests of a batch are read at once.
    """
    n_parts = -(-segments // PART_SEGMENTS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            need, part = _asked(run.column(2).combine_chunks(), segments)
            cuts = np.searchsorted(part, np.arange(n_parts + 1))
            lists = -(-np.diff(cuts) // LISTED)
            at = np.repeat(np.arange(n_parts), lists)
            number = np.arange(len(at)) - np.repeat(np.cumsum(lists) - lists, lists)
            starts = cuts[at] + number * LISTED
            hashes = pa.ListArray.from_arrays(pa.array(np.append(starts, len(need)), pa.int32()), pa.array(need.view(np.int64)))
            same = lambda c, n=len(at): pa.array(np.full(n, run.column(c)[0].as_py()), run.schema.field(c).type)  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array(at, pa.int32()), pa.array(number, pa.int32()), hashes], names=["slice", "k", "part", "list", "h"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, np.zeros(0, np.uint8)
        for batch in batches:
            numbers = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                if a == b:
                    continue
                if numbers[a] != now:
                    now, table = int(numbers[a]), np.zeros(PART_SEGMENTS * segment_bits // 8, np.uint8)
                some = batch.slice(a, b - a)
                there = some.filter(pc.is_valid(some.column(4)))
                for s, bits in zip(there.column(4).to_pylist(), there.column(5), strict=True):
                    at = (s - now * PART_SEGMENTS) * (segment_bits // 8)
                    table[at : at + segment_bits // 8] |= np.frombuffer(bits.as_py(), np.uint8)
                some = some.filter(pc.is_null(some.column(4)))
                levels = read_levels(table, some.column(6).flatten().to_numpy().view(np.uint64), segment_bits, segments, now * PART_SEGMENTS)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(some.column(6)).to_numpy())]).astype(np.int32)
                found = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(levels.astype(np.uint8))])
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in range(4)], found], names=["slice", "k", "part", "list", "levels"])

    none = lambda kind: F.lit(None).cast(kind)
    asked = rows.select("slice", "k", "text").mapInArrow(ask, "slice long, k int, part int, list int, h array<long>")
    asked = asked.select("slice", "k", "part", "list", none("int").alias("s"), none("binary").alias("bits"), "h", F.pmod(F.xxhash64("slice", "k"), F.lit(SPREAD)).cast("int").alias("x"))
    held = parts.select(
        none("long").alias("slice"), none("int").alias("k"), F.floor(F.col("s") / PART_SEGMENTS).cast("int").alias("part"), none("int").alias("list"), "s", "bits", none("array<bigint>").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("x")
    )
    met = held.union(asked).repartition("part", "x").sortWithinPartitions("part", "x", F.col("s").asc_nulls_last())
    return met.drop("x").mapInArrow(answer, "slice long, k int, part int, list int, levels binary")


def _asked(texts: pa.Array, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, parts): the distinct n-grams of texts in the order of the filter's parts, then of the hashes."""
    kinds, stream, _ = _streams(texts)
    h = _hash(kinds)
    before = np.concatenate([[0], stream[:-1]])
    both = np.unique(before * np.int64(len(kinds)) + stream)
    need = np.unique(np.concatenate([h, _pair(h[both // len(kinds)], h[both % len(kinds)])]))
    part = segment_of(need, segments) // PART_SEGMENTS
    order = np.argsort(part, kind="stable")
    return need[order], part[order]


# ---------------------------------------------------------------- the operator
def score(docs: DataFrame, train: Column | None = None, segment_bits: int = SEGMENT_BITS, frequent: int = FREQUENT, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` marks the rows that counts are learned from. The base score uses
    exact counts: those of the most frequent words (at most ``frequent``) are
    broadcast, other words join the counts. ``score`` is log10 of the product
    of PAIR_WEIGHT * c(before, now) / c(before) + (1 - PAIR_WEIGHT) * p(now),
    with counts read from the filter, which is broadcast up to ``broadcast_bits``
    and asked by exchange beyond, with equal results; words after an unseen one
    use p alone.
    Null text is empty and has the end token alone, a null doc_id is hashed as
    the empty text, repeated rows count and are scored as often as they occur,
    an empty table gives an empty result, and other columns are not read.
    """
    spark = docs.sparkSession
    train = ~held_out(F.col("doc_id")) if train is None else train
    texts = docs.select("doc_id", text_of().alias("text"), train.alias("train"))
    with small_batches(spark):
        grams = materialize(gram_counts(texts.filter("train")))
    release(spark)
    words = materialize(grams.filter("token is not null").select("token", "h", "c"))
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, floor = int(totals["n"]), 0.5 * (int(totals["v"]) + 1)
    parts, segments = filter_segments(grams, segment_bits)
    parts = materialize(parts)
    discard(grams)
    release(spark)
    sent = segments * segment_bits <= broadcast_bits
    table = spark.sparkContext.broadcast(whole_filter(parts, segments, segment_bits) if sent else None)

    tally = {r["q"]: r["n"] for r in words.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 8).alias("q")).agg(F.count(F.lit(1)).alias("n")).collect()}
    room, cut = frequent, 10_000
    for q in sorted(tally, reverse=True):
        room -= tally[q]
        if room < 0:
            break
        cut = q
    top = words.filter(F.floor(F.log2(F.col("c").cast("double")) * 8) >= cut).select("h", "c").toArrow()  # at most ``frequent`` rows of two longs
    keys, counts = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(keys)
    common = spark.sparkContext.broadcast((keys[order], counts[order]))

    def scores(batch: pa.RecordBatch, level_of) -> pa.RecordBatch:
        """Scores of a batch (doc_id, text, train) with counts read by ``level_of`` (hashes -> levels)."""
        keys, counts = common.value
        kinds, stream, offsets = _streams(batch.column(1))
        h = _hash(kinds)
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        exact = np.where(found, counts[at] if len(keys) else 0, -1)
        base = np.where(found, np.log10((np.maximum(exact, 0) + 0.5) / (total + floor)), 0.0)
        seen = value_of(level_of(h))
        single = (seen + 0.5) / (total + floor)
        before = np.empty_like(stream)
        before[1:], before[:1] = stream[:-1], 0
        both, back = np.unique(before * np.int64(len(kinds)) + stream, return_inverse=True)
        b, a = both // len(kinds), both % len(kinds)
        joint = value_of(level_of(_pair(h[b], h[a])))
        share = np.minimum(1.0, joint / np.maximum(seen[b], 1.0))
        p = np.where(seen[b] > 0, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * single[a], single[a])
        logs = np.log10(p)[back]
        starts = offsets[:-1]
        unknown = np.flatnonzero(~found[stream])
        row = np.searchsorted(offsets, unknown, side="right") - 1
        once, n = np.unique(row * np.int64(len(kinds)) + stream[unknown], return_counts=True)
        tokens = pa.array(kinds).take(pa.array(once % len(kinds)))
        bounds = np.searchsorted(once // len(kinds), np.arange(len(offsets)))
        rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([tokens, pa.array(n)], names=["token", "n"]))
        columns = [
            batch.column(0), batch.column(2), pa.array(np.diff(offsets)),
            pa.array(np.add.reduceat(found[stream].astype(np.int64) * (exact[stream] > 0), starts) if len(starts) else np.zeros(0, np.int64)),
            pa.array(np.add.reduceat(base[stream], starts) if len(starts) else np.zeros(0)),
            pa.array(np.add.reduceat(logs, starts) if len(starts) else np.zeros(0)),
            rare,
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "train", "n_tokens", "known", "base", "score", "rare"])

    def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for part in (p for batch in batches for p in _slices(batch, 1)):
            yield scores(part, lambda x: read_levels(bits, x, segment_bits))
            pa.default_memory_pool().release_unused()

    def by_answers(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """Scores of a slice's rows (slice, k, doc_id, text, train) by the levels (slice, k, part, list, levels) of its runs."""
        rows, answers = rows.sort_by("k"), answers.sort_by([("k", "ascending"), ("part", "ascending"), ("list", "ascending")])
        firsts, made = answers.column("k").unique().to_pylist(), []
        for first, stop in zip(firsts, [*firsts[1:], len(rows)], strict=True):
            run = rows.slice(first, stop - first).select(["doc_id", "text", "train"]).combine_chunks().to_batches()[0]
            need, _ = _asked(run.column(1), segments)
            levels = np.frombuffer(b"".join(answers.filter(pc.equal(answers.column("k"), first)).column("levels").to_pylist()), np.uint8)
            order = np.argsort(need)
            need, levels = need[order], levels[order].astype(np.int64)
            made.append(scores(run, lambda x, need=need, levels=levels: levels[np.searchsorted(need, x)]))
        return pa.Table.from_batches(made)

    ddl = "doc_id long, train boolean, n_tokens long, known long, base double, score double, rare array<struct<token:string,n:long>>"
    if sent:
        made = texts.select("doc_id", "text", "train").mapInArrow(by_broadcast, ddl)
    else:
        with small_batches(spark):
            rows = materialize(in_slices(texts))
        answers = materialize(asked_levels(rows, parts, segments, segment_bits))
        release(spark)
        made = rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(by_answers, ddl)
    with small_batches(spark):
        scored = materialize(made.withColumn("row", F.monotonically_increasing_id()))
    tokens = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(total + floor))
    rest = tokens.join(words, "token", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum(F.col("n") * log).alias("base2")
    )
    return scored.join(rest, "row", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        "score",
    )
