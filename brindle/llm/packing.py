"""Best-fit packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialize, slices, small_batches, text_of

if TYPE_CHECKING:
    import pandas as pd

CAPACITY = 2048
#: Pieces that one task packs together: bounds its memory and the half-filled last sequences.
GROUP_PIECES = 20_000
#: Words whose ids are laid out at once.
CHUNK_WORDS = 100_000
#: Text bytes that a worker tokenizes at once.
SLICE = 1 << 20

#: Words whose ids a worker keeps between batches, in flat arrays: bounds its memory; other words are encoded again.
CACHE_WORDS = 1_000_000
#: Words that are encoded as one text, and what stands between them: a word of its own with one id.
JOINED, SEPARATOR = 64, "\x01"

_loaded: dict[str, object] = {}
#: By tokenizer and type of text: the words, where their ids start (and the last ones end), all their ids, the words' sorted hashes, and the number of each hash's word.
_known: dict[tuple, tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _encoded(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids). Words are encoded JOINED at once and cut at the separators; one by one where a word holds the separator's id itself."""
    tokenizer = _tokenizer(path)
    mark = tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
    sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    step = 320 * JOINED
    for i in range(0, len(words), step):
        parts = [words[k : k + JOINED] for k in range(i, min(i + step, len(words)), JOINED)]
        for part, e in zip(parts, tokenizer.encode_batch_fast([f" {SEPARATOR} ".join(part) for part in parts], add_special_tokens=False), strict=True):
            found = np.array(e.ids, np.uint32)
            real = found != mark[0] if len(mark) == 1 else np.ones(len(found), bool)
            ends = np.flatnonzero(~real)
            if len(ends) == len(part) - 1:
                sizes.append(np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1)
                ids.append(found[real])
            else:
                alone = [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in alone], np.int64))
                ids += alone
    return np.concatenate(sizes), np.concatenate(ids)


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that start and are as long as told, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _ids_of(kinds: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, ids) of distinct words. Known words are found by hash and compared, so what is held beside them follows the words asked for, not those kept."""
    key = (path, str(kinds.type))
    words, bounds, flat, hashes, numbers = _known.get(key, (kinds.slice(0, 0), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    h = _hashed(kinds.to_pylist())
    at = np.searchsorted(hashes, h)
    found = np.flatnonzero(at < len(hashes))
    found = found[hashes[at[found]] == h[found]]
    known = numbers[at[found]]
    same = pc.equal(words.take(pa.array(known)), kinds.take(pa.array(found))).to_numpy(zero_copy_only=False)
    found, known = found[same], known[same]
    rest = np.ones(len(kinds), bool)
    rest[found] = False
    new = kinds.filter(pa.array(rest))
    more, ids = _encoded(new.to_pylist(), path)
    sizes = np.empty(len(kinds), np.int64)
    sizes[found], sizes[rest] = bounds[known + 1] - bounds[known], more
    starts = np.empty(len(kinds), np.int64)
    old = int(sizes[found].sum())
    starts[found], starts[rest] = np.cumsum(sizes[found]) - sizes[found], old + np.cumsum(more) - more
    mine = np.concatenate([_gathered(flat, bounds[known], sizes[found]), ids])
    room = min(len(new), CACHE_WORDS - len(words))
    if room > 0:
        ends = np.cumsum(more[:room])
        joined = np.concatenate([hashes, h[rest][:room]])
        order = np.argsort(joined, kind="stable")
        numbers = np.concatenate([numbers, np.arange(len(words), len(words) + room, dtype=np.int32)])[order]
        _known[key] = (pa.concat_arrays([words, new.slice(0, room)]), np.concatenate([bounds, bounds[-1] + ends]), np.concatenate([flat, ids[: ends[-1]]]), joined[order], numbers)
    return starts, sizes, mine


def token_ids(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, uint32 ids) of each text, equal to encoding the whole text.

    The tokenizer never joins characters across white space, so every distinct
    space-separated word of a batch that no earlier batch had is encoded once
    and texts are put together from the words' ids.
    """
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    index, kinds = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    del split, coded
    starts, sizes, flat = _ids_of(kinds, path)
    del kinds
    base = offsets[0]
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_WORDS, side="right")) - 1)
        stop = min(stop, rows)
        words = index[offsets[row] - base : offsets[stop] - base]
        length = sizes[words]
        ids = _gathered(flat, starts[words], length)
        ends = np.concatenate([[0], np.cumsum(length)])
        for r in range(row, stop):
            yield r, ids[ends[offsets[r] - offsets[row]] : ends[offsets[r + 1] - offsets[row]]]
        row = stop


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document, cut only where it is longer than a sequence."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            ids_of = batch.column(0)
            texts = batch.column(1)
            out: list[list] = [[], [], [], [], []]
            kept = []
            for row, ids in token_ids(texts, path):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                doc = ids_of[row].as_py()
                for k in range(-(-len(ids) // capacity)):
                    part = ids[k * capacity : (k + 1) * capacity]
                    for column, value in zip(out, (doc, k, k * capacity, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = [pa.array(c, f.type) for c, f in zip(out, schema, strict=False)]
            if keep_ids:
                columns.append(pa.array(kept, schema.field("ids").type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            pa.default_memory_pool().release_unused()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, ddl)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.

    A bin starts with the longest piece left and takes the longest that fits
    until none does. Then its smallest piece may give way to two unpacked
    pieces that fill the gap it leaves more tightly, as often as that helps.
    """
    n = len(lengths)
    where, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.argsort(lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order:
        stacks.setdefault(int(lengths[i]), []).append(int(i))
    left = sorted(stacks)

    def take(size: int) -> int:
        item = stacks[size].pop()
        if not stacks[size]:
            del left[bisect_left(left, size)]
        return item

    def give(size: int, item: int) -> None:
        if not stacks[size]:
            insort(left, size)
        stacks[size].append(item)

    def pair(room: int, above: int) -> tuple[int, int] | None:
        """Two lengths left with the largest sum in (above, room]."""
        sizes = np.array(left[: bisect_right(left, room - left[0])] if left else [], np.int64)
        if not len(sizes):
            return None
        at = np.searchsorted(sizes, room - sizes, side="right") - 1
        single = (at >= 0) & (sizes[at] == sizes)
        for i in np.flatnonzero(single):
            if len(stacks[int(sizes[i])]) < 2:
                at[i] -= 1
        sums = np.where(at >= 0, sizes + sizes[at], 0)
        best = int(np.argmax(sums))
        return (int(sizes[best]), int(sizes[at[best]])) if sums[best] > above else None

    number = 0
    while left:
        first = left[-1]
        chosen = [(first, take(first))]
        gap = capacity - first
        while gap > 0 and left and left[0] <= gap:
            size = left[bisect_right(left, gap) - 1]
            chosen.append((size, take(size)))
            gap -= size
        while gap > 0 and left:
            small = min(range(len(chosen)), key=lambda k: chosen[k][0])
            size, item = chosen[small]
            better = pair(gap + size, size)
            if better is None:
                break
            new = [(s, take(s)) for s in better]
            give(size, item)
            chosen[small : small + 1] = new
            gap += size - better[0] - better[1]
        at = 0
        for size, item in chosen:
            where[item], offset[item] = number, at
            at += size
        number += 1
    return where, offset


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Pieces are dealt at random to groups of about ``group_pieces`` and packed
    group by group, so no task holds more and the loss is at most the last
    sequences of each group. Only lengths travel, unless ids are kept. Null
    text is empty: it is the end id alone. Repeated rows are packed as often as
    they occur, null doc_ids stay null, an empty table gives an empty result,
    and other columns are not read.
    """
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, path or tokenizer_path(), capacity, keep_ids=keep_ids))
    groups = max(1, -(-cut.count() // group_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        where, offset = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["g"].to_numpy(np.int64) * (1 << 32) + where, offset=offset).drop(columns="g")

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    dealt = cut.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").applyInPandas(place, ddl)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in place order, from a layout packed with its ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
