"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two
fingerprints within the radius share a variant, and fingerprints that share
one are within the radius of each other, so linking each to the variant's
smallest keeps every group whole without emitting all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import ROW, ascii_lower, components, discard, let, materialize, only, release, small_batches, text_of, without, words_of


def shingle_hashes(text: Column, size: int) -> Column:
    """XXH64 (seed 42) of each run of ``size`` words; of the whole sequence where it is shorter."""
    def of(w: Column) -> Column:
        at = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - size), at))

    return let(words_of(text), of)


def majority_bits(values: np.ndarray, offsets: np.ndarray, width: int = 64) -> np.ndarray:
    """For each slice of uint64 hashes: the low ``width`` bits set in over half of them; 0 for an empty slice."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    row, rows, limit = 0, len(sizes), 200_000
    while row < rows:
        stop = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1))
        full = np.flatnonzero(sizes[row:stop]) + row
        if len(full):
            block = values[offsets[row] : offsets[stop]]
            starts = offsets[full] - offsets[row]
            count = np.zeros((len(full), 64), np.int64)
            for k in range(width // 8):
                bits = np.unpackbits(((block >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
                count[:, 8 * k : 8 * k + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            set_ = (2 * count > sizes[full, None]).astype(np.uint8)
            out[full] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
        row = stop
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and its 64-bit fingerprint (as long). Hashes are built in the JVM, bits are counted in array blocks."""
    hashed = docs.select("doc_id", shingle_hashes(ascii_lower(text_of()), shingle).alias("h"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            fp = majority_bits(values, offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return hashed.mapInArrow(vote, "doc_id long, fp long")


def ball_links(prints: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """Links (a, b), a > b, between distinct values of ``prints.fp`` that together connect all within an even ``radius``."""
    if radius % 2:
        raise ValueError("the radius must be even: variants are taken within half of it")
    masks = [0]
    for k in range(1, radius // 2 + 1):
        masks += [sum(1 << i for i in c) for c in combinations(range(bits), k)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    balls = prints.select("fp", F.explode(F.lit(signed).cast("array<bigint>")).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("v"))
    least = F.min("fp").over(Window.partitionBy("v"))
    links = balls.select(F.col("fp").alias("a"), least.alias("b")).filter("a <> b").distinct()
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints are linked at ``radius`` or fewer differing bits; component_id
    is the smallest doc_id that links reach. Equal fingerprints are folded
    before balls are made, so copies cost one ball. Null and wordless texts
    have fingerprint zero and are linked like any other; null doc_ids get the
    component's smallest id; an empty table gives an empty result, and other
    columns are not read.
    """
    prints = materialize(fingerprints(docs, shingle))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(ball_links(nodes.select("fp"), radius))
    rooted = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- by similarity
#: Of so many documents one is counted to learn which shingles are common: those in LEAST_SEEN counted ones or more, the MOST_TOLD most common.
SAMPLE, LEAST_SEEN, MOST_TOLD = 32, 3, 250_000
#: Least bits of a document's parity sketch, and words and documents that one numpy step takes.
SKETCH, STEP_WORDS, STEP_DOCS = 1024, 300_000, 2_000
#: Longs to which the sketches that rows of the last round carry are folded.
FOLDED = 8
#: A hash with more linked groups than this is crowded: its rows are offered to HEADS more of its rows, one after the other, before all pairs are.
CROWD, HEADS = 4, 2
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, sorted distinct hashes of each row's word shingles) for slices of bounded size.

    A-Z are lower-cased. A shingle's hash joins the XXH64 of its words; a text
    of fewer words has one hash, of all its words, and a wordless text none.
    """
    bounds = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(bounds), 0
    while start < len(texts):
        stop = min(start + STEP_DOCS, max(start + 1, int(np.searchsorted(ends, ends[start] - bounds[start] + 7 * STEP_WORDS, side="right"))), len(texts))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(start, stop - start)))
        words, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        coded = words.filter(pa.array(real)).dictionary_encode()
        kinds = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        h = kinds[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(stop - start), np.diff(offsets))
        n = max(0, len(h) - size + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(size):
            grams = grams * _MULT + h[j : j + n]
        whole = row[:n] == row[size - 1 :] if n else np.zeros(0, bool)
        values, rows = [_mixed(grams[whole])], [row[:n][whole]]
        lengths = np.diff(offsets)
        for few in range(1, size):
            at = np.flatnonzero(lengths == few)
            short = np.full(len(at), few, np.uint64)
            for j in range(few):
                short = short * _MULT + h[offsets[at] + j]
            values.append(_mixed(short))
            rows.append(at)
        values, rows = np.concatenate(values), np.concatenate(rows)
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[new], rows[new]
        yield start, stop, np.searchsorted(rows, np.arange(stop - start + 1)), values
        start = stop


def _prints(texts: DataFrame, size: int) -> DataFrame:
    """(row, fp): the 64-bit fingerprint of each row's set of shingles; wordless texts have none."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, offsets, values in shingle_sets(batch.column(1), size):
                there = pa.array(np.diff(offsets) > 0)
                made = pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.array(majority_bits(values, offsets).view(np.int64))], names=["row", "fp"])
                yield made.filter(there)

    return texts.select("row", "text").mapInArrow(vote, "row long, fp long")


def _ball_offers(texts: DataFrame, size: int, repeated: bool, radius: int = 2) -> DataFrame:
    """Offers (a, b) that ball hashing makes: rows of one fingerprint to the smallest of them, and the smallest rows of fingerprints that balls link."""
    prints = materialize(_prints(texts, size).distinct() if repeated else _prints(texts, size))
    nodes = materialize(prints.groupBy("fp").agg(F.min("row").alias("least")))
    same = prints.join(nodes, "fp").filter("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    balls = ball_links(nodes.select("fp"), radius)
    side = lambda x: nodes.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}"))
    near = balls.join(side("a"), "a").join(side("b"), "b").select(F.greatest("least_a", "least_b").alias("a"), F.least("least_a", "least_b").alias("b"))
    return same.union(near).distinct()


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and their counts in a sample. They only order the shingles: any order gives the same pairs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, values in shingle_sets(batch.column(0), size):
                kinds, n = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = texts.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(count, "h long, n long")
    seen = some.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SEEN).orderBy(F.desc("n"), "h").limit(MOST_TOLD).toArrow()
    keys, counts = seen.column(0).to_numpy().view(np.uint64), seen.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _prefixes(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(row, n, pos, h): of each set of n hashes, in one order for all with common ones last, the first n - ceil(similarity n) + 1.

    Sets that are similar enough share a hash in these parts.
    """
    told = texts.sparkSession.sparkContext.broadcast(_common(texts, size))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = told.value
        for batch in batches:
            for first, stop, offsets, values in shingle_sets(batch.column(1), size):
                sizes = np.diff(offsets)
                rows = np.repeat(np.arange(stop - first), sizes)
                level = np.zeros(len(values), np.int64)
                if len(keys) and len(values):
                    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                    level = np.where(keys[at] == values, counts[at], 0)
                order = np.lexsort((level, rows))  # stable, so equal counts stay in the order of the hashes
                pos = np.arange(len(values)) - offsets[rows]
                part = pos < (sizes - np.ceil(sizes * similarity - 1e-6).astype(np.int64) + 1)[rows]
                ids = batch.column(0).slice(first, stop - first).take(pa.array(rows[part]))
                cols = [ids, pa.array(sizes[rows[part]].astype(np.int32)), pa.array(pos[part].astype(np.int32)), pa.array(values[order][part].view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "n", "pos", "h"])

    return texts.select("row", "text").mapInArrow(cut, "row long, n int, pos int, h long")


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """(row, n, sketch): a set's size, and the parities of the counts of hashes that fall on each bit of a sketch of about n bits, a power of two.

    Two sketches of one length differ in no more bits than the sets do in
    hashes, and a sketch folds to half its length by XOR of its halves.
    """
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, offsets, values in shingle_sets(batch.column(1), size):
                sizes = np.diff(offsets)
                bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
                starts = np.concatenate([[0], np.cumsum(bits)])
                rows = np.repeat(np.arange(stop - first), sizes)
                place = starts[rows] + ((((values * _MULT) >> np.uint64(32)).astype(np.int64)) & (bits[rows] - 1))
                odd = (np.bincount(place, minlength=starts[-1]) & 1).astype(np.uint8)
                longs = np.packbits(odd).view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(starts // 64, pa.int32()), pa.array(longs))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.array(sizes, pa.int32()), sketch], names=["row", "n", "sketch"])

    return texts.select("row", "text").mapInArrow(draw, "row long, n int, sketch array<long>")


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded to the other's length; null where one is over twice as long."""
    def folded(x: Column, y: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(row, h): the distinct hashes of its word shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, offsets, values in shingle_sets(batch.column(1), size):
                sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), sets], names=["row", "h"])

    return texts.select("row", "text").mapInArrow(run, "row long, h array<long>")


def _verified(texts: DataFrame, offers: DataFrame, shingle: int, similarity: float, repeated: bool) -> DataFrame:
    """Of the offered pairs (a, b) those whose sets are similar enough: first by sketches, which reject no such pair, then by the sets of those that are left."""
    def of(df: DataFrame, pairs: DataFrame, make) -> DataFrame:
        ids = materialize(pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct())
        made = make(only(df, ids, ["row"]), shingle)
        made = materialize(made.dropDuplicates(["row"]) if repeated else made)
        discard(ids)
        return made

    def both(pairs: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
        side = lambda x: facts.select(F.col("row").alias(x), *[F.col(c).alias(f"{c}{x}") for c in names])
        return pairs.join(side("a"), "a").join(side("b"), "b")

    pairs = materialize(offers)
    release(texts.sparkSession)
    drawn = of(texts, pairs, _sketches)
    most = (F.col("na") + F.col("nb")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    fit = both(pairs, drawn, "n", "sketch").filter(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-6)
    near = fit.filter(F.coalesce(_apart(F.col("sketcha"), F.col("sketchb")), F.lit(0)) <= most)
    near = materialize(near.select("a", "b"))
    discard(pairs)
    discard(drawn)
    release(texts.sparkSession)
    sets = of(texts, near, _sets)
    shared = F.size(F.array_intersect("ha", "hb"))
    links = materialize(both(near, sets, "h").filter(shared >= F.lit(similarity) * (F.size("ha") + F.size("hb") - shared)).select("a", "b"))
    discard(near)
    discard(sets)
    release(texts.sparkSession)
    return links


def near_pairs(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, repeated: bool = False) -> DataFrame:
    """Verified links (a, b), a > b, between rows of ``texts`` (row, text) that connect exactly what all pairs of at least ``similarity`` (Jaccard of word shingles) connect.

    Ball hashing comes first: rows whose SimHash fingerprints are within two
    bits are offered and, if similar enough, linked. Many pairs at the
    threshold lie further apart, so what balls leave apart is found by an exact
    way. Two such sets share a hash in their prefixes (see ``_prefixes``), and at
    the first one enough hashes are left in both. In a first round the rows of
    each prefix hash are offered to the smallest of them, so a group of
    near-copies costs one offer a row. In crowded hashes, rows that are not
    linked with it yet are then offered to a row drawn by hash, another one for
    each hash: copies that differ from the smallest find each other so. In a
    last round, each two rows of a hash that are not linked yet are compared,
    whatever their number: those outside the hash's largest linked group with
    all others. There the rows carry their parity sketches, folded to FOLDED
    longs, so only pairs that these don't reject are formed. ``repeated`` says that equal rows occur.
    """
    spark = texts.sparkSession
    index = materialize(_prefixes(texts, shingle, similarity).dropDuplicates(["h", "row"]) if repeated else _prefixes(texts, shingle, similarity))
    least = materialize(index.groupBy("h").agg(F.min("row").alias("least"), F.max("row").alias("most")).filter("least < most").select("h", "least"))
    release(spark)
    shared = materialize(index.join(least.hint("merge"), "h"))
    discard(index)
    discard(least)
    release(spark)

    def fits(n1: str, pos1: str, n2: str, pos2: str) -> Column:
        return F.least(F.col(n1) - F.col(pos1), F.col(n2) - F.col(pos2)) >= (F.col(n1) + F.col(n2)) * F.lit(similarity / (1 + similarity)) - 1e-6

    def rooted_by(links: DataFrame) -> DataFrame:
        roots = components(links).withColumnRenamed("node", "row")
        return materialize(shared.join(roots, "row", "left").select("h", "row", "n", "pos", "least", F.coalesce("root", "row").alias("root")))

    links = _fewer(_verified(texts, _ball_offers(texts, shingle, repeated), shingle, similarity, repeated))
    balled = rooted_by(links)
    heads = balled.filter("row = least").select("h", F.col("n").alias("n0"), F.col("pos").alias("pos0"), F.col("root").alias("root0"))
    stars = balled.join(heads, "h").filter("root <> root0").filter(fits("n", "pos", "n0", "pos0"))
    links = _fewer(links.union(_verified(texts, stars.select(F.greatest("row", "least").alias("a"), F.least("row", "least").alias("b")).distinct(), shingle, similarity, repeated)))
    discard(balled)

    rooted = rooted_by(links)
    for turn in range(HEADS):
        crowded = rooted.groupBy("h", "root").agg(F.min(F.struct(F.xxhash64("h", "row", F.lit(turn)).alias("draw"), "row", "n", "pos")).alias("head"))
        crowded = materialize(crowded.groupBy("h").agg(F.min(F.struct("head", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter(F.col("roots") > CROWD).select(
            "h", F.col("top.head.row").alias("row0"), F.col("top.head.n").alias("n0"), F.col("top.head.pos").alias("pos0"), F.col("top.root").alias("root0")
        ))
        if crowded.isEmpty():
            break
        drawn = rooted.join(crowded, "h").filter("root <> root0").filter(fits("n", "pos", "n0", "pos0"))
        more = _verified(texts, drawn.select(F.greatest("row", "row0").alias("a"), F.least("row", "row0").alias("b")).distinct(), shingle, similarity, repeated)
        discard(crowded)
        if more.isEmpty():
            break
        links = _fewer(links.union(more))
        discard(rooted)
        rooted = rooted_by(links)
    discard(shared)
    groups = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("rows")).groupBy("h").agg(F.max(F.struct("rows", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"))
    split = materialize(rooted.join(groups.filter("roots > 1").select("h", "main"), "h"))
    discard(rooted)
    release(spark)
    ids = materialize(split.select("row").distinct())
    fold = lambda j: F.aggregate(F.sequence(F.lit(j), F.size("sketch") - 1, F.lit(FOLDED)), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.get("sketch", i)))
    folded = [f"s{j}" for j in range(FOLDED)]
    drawn = _sketches(only(texts, ids, ["row"]), shingle).select("row", *[fold(j).alias(c) for j, c in enumerate(folded)])
    drawn = materialize(drawn.dropDuplicates(["row"]) if repeated else drawn)
    split = split.join(drawn, "row")
    left = split.filter("root <> main").select("h", *[F.col(c).alias(f"{c}1") for c in ("row", "n", "pos", "root", *folded)])
    met = left.join(split, "h").filter("root <> root1").filter(fits("n", "pos", "n1", "pos1"))
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}1"))) for c in folded), F.lit(0))
    met = met.filter(differ <= (F.col("n") + F.col("n1")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6)
    second = _verified(texts, met.select(F.greatest("row", "row1").alias("a"), F.least("row", "row1").alias("b")).distinct(), shingle, similarity, repeated)
    discard(ids)
    discard(drawn)
    return links.union(_fewer(second))


def _fewer(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that connect the same rows: each row keeps its smallest partner, and its other partners are linked to that one."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(least.select("a", F.col("m").alias("b")).union(others).distinct())


def _with_nodes(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ROW, the node of each row, and whether nodes repeat.

    A node is a document: its doc_id, or, where rows of one doc_id have
    different texts, a hash of both. Rows without a doc_id have none.
    """
    digest = F.xxhash64(text_of())
    ids = docs.select("doc_id", digest.alias("t")).groupBy("doc_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    ids = materialize(ids.filter("n > 1 and doc_id is not null"))
    unlike = materialize(ids.filter("lo <> hi").select("doc_id"))
    if unlike.isEmpty():
        return docs.withColumn(ROW, F.col("doc_id")), not ids.isEmpty()
    alike = without(docs, unlike, ["doc_id"]).withColumn(ROW, F.col("doc_id"))
    return alike.unionByName(only(docs, unlike, ["doc_id"]).withColumn(ROW, F.xxhash64("doc_id", digest))), True


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near-copies: of each group that links reach, the document with the smallest doc_id stays.

    Rows that repeat a doc_id with other texts are documents of their own; equal
    rows of one doc_id are one document and stay or go together. Rows without a
    doc_id and wordless texts are in no group and stay.
    """
    rows, repeated = _with_nodes(docs)
    texts = rows.filter("doc_id is not null").select(F.col(ROW).alias("row"), text_of().alias("text"))
    with small_batches(docs.sparkSession):
        links = materialize(near_pairs(texts, shingle, similarity, repeated))
    group = materialize(components(links))
    ids = only(rows.select(F.col(ROW).alias("node"), "doc_id"), group, ["node"]).distinct()
    stays = group.join(ids, "node").groupBy("root").agg(F.min(F.struct("doc_id", "node"))["node"].alias("stays"))
    gone = materialize(group.join(stays, "root").filter("node <> stays").select(F.col("node").alias(ROW)))
    return without(rows, gone, [ROW]).drop(ROW)
