"""Prefix trie of conversations: one node for each distinct run of first turns.

A turn's id is 16 bytes of the SHA-256 of its role and text, so a conversation
is a byte key of fixed-width turns. Keys are sorted by range over the cluster
and cut into runs of bounded size; each run grows an adaptive radix tree
(layouts of 4, 16, 48 and 256 children, compressed paths) whose turn-aligned
depths are the trie's nodes. A node that lies inside one run is finished
there. A node that runs share is reported by each of them in parts that add
up: a run knows how many turns it shares with its neighbours, so each turn's
size, child and leaf is counted by exactly one of them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import looked_up, materialize

#: Bytes of a turn id.
WIDTH = 16
#: Most conversations of a run, and key bytes beyond which a run ends.
RUN, RUN_BYTES = 4096, 1 << 20


# ---------------------------------------------------------------- the tree
class _Few:
    """Up to 4 or 16 children: their bytes in order, beside them the children."""

    __slots__ = ("most", "bytes", "kids")

    def __init__(self, most: int = 4) -> None:
        self.most, self.bytes, self.kids = most, bytearray(), []

    def find(self, byte: int) -> Node | None:
        i = self.bytes.find(byte)
        return None if i < 0 else self.kids[i]

    def put(self, byte: int, kid: Node) -> _Few | _Indexed:
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.kids[i] = kid
            return self
        if len(self.kids) == self.most:
            larger = _Few(16) if self.most == 4 else _Indexed()
            for b, k in zip(self.bytes, self.kids, strict=True):
                larger.put(b, k)
            return larger.put(byte, kid)
        self.bytes.insert(i, byte)
        self.kids.insert(i, kid)
        return self

    def ordered(self) -> list[Node]:
        return self.kids


class _Indexed:
    """Up to 48 children, found through a table of 256 places."""

    __slots__ = ("place", "kids")

    def __init__(self) -> None:
        self.place, self.kids = bytearray(b"\xff" * 256), []

    def find(self, byte: int) -> Node | None:
        i = self.place[byte]
        return None if i == 255 else self.kids[i]

    def put(self, byte: int, kid: Node) -> _Indexed | _Full:
        i = self.place[byte]
        if i != 255:
            self.kids[i] = kid
            return self
        if len(self.kids) == 48:
            larger = _Full()
            for b in range(256):
                if self.place[b] != 255:
                    larger.put(b, self.kids[self.place[b]])
            return larger.put(byte, kid)
        self.place[byte] = len(self.kids)
        self.kids.append(kid)
        return self

    def ordered(self) -> list[Node]:
        return [self.kids[i] for i in self.place if i != 255]


class _Full:
    """A child for every byte."""

    __slots__ = ("kids",)

    def __init__(self) -> None:
        self.kids: list[Node | None] = [None] * 256

    def find(self, byte: int) -> Node | None:
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> _Full:
        self.kids[byte] = kid
        return self

    def ordered(self) -> list[Node]:
        return [k for k in self.kids if k is not None]


class Node:
    """A compressed path, the members that end below it at its foot, and its children by their next byte."""

    __slots__ = ("path", "members", "layout")

    def __init__(self, path: bytes) -> None:
        self.path, self.members, self.layout = path, [], _Few()

    def insert(self, key: bytes, member: int) -> None:
        node, at = self, 0
        while True:
            same = _shared(node.path, key, at)
            if same < len(node.path):
                foot = Node(node.path[same:])
                foot.members, foot.layout = node.members, node.layout
                node.path, node.members, node.layout = node.path[:same], [], _Few()
                node.layout = node.layout.put(foot.path[0], foot)
            at += same
            if at == len(key):
                node.members.append(member)
                return
            kid = node.layout.find(key[at])
            if kid is None:
                kid = Node(key[at:])
                kid.members.append(member)
                node.layout = node.layout.put(key[at], kid)
                return
            node = kid


def _shared(path: bytes, key: bytes, at: int = 0) -> int:
    """How many first bytes of ``path`` stand in ``key`` from ``at`` on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if path[:mid] == key[at : at + mid] else (low, mid - 1)
    return low


def grow(keys: list[bytes]) -> Node:
    """The adaptive radix tree of ``keys``; members are their positions."""
    root = Node(b"")
    for i, key in enumerate(keys):
        root.insert(key, i)
    return root


# ---------------------------------------------------------------- sequences
SEQUENCES = "conv_id long, key binary, sizes binary"


def sequences(conversations: DataFrame, donor: Column | None = None, taken: Column | None = None) -> DataFrame:
    """(conv_id, key, sizes): each conversation as its turn ids and its texts' UTF-8 bytes.

    Turns follow ``turn`` (null first), ties their role, then their turn id;
    null role or text is empty and rows without a conv_id belong to no
    conversation. With ``donor``, an id for each conv_id that is its own
    donor, the first ``taken`` turns are the donor's (none where it is absent)
    and only the turns after the conversation's own first ``taken`` follow.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = F.col("conv_id").cast("long")
    turns = conversations.filter("conv_id is not null").select(
        (own if donor is None else donor.cast("long")).alias("donor"), own.alias("conv_id"), (F.lit(0) if taken is None else taken).cast("int").alias("taken"), "turn", role.alias("role"),
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH).alias("id"), F.octet_length(text).cast("long").alias("size"),
    )
    dealt = turns.repartition("donor").sortWithinPartitions("donor", F.col("conv_id") != F.col("donor"), "conv_id", "turn", "role", "id")
    return dealt.select("donor", "conv_id", "taken", "id", "size").mapInArrow(_rebuild, SEQUENCES)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, keys, sizes, held = [], [], [], 0
    for donor, conv, taken, key, size, given in _conversations(batches):
        whose, first, bytes_of = given if given and given[0] == donor else (None, b"", np.zeros(0, np.int64))
        ids.append(conv)
        keys.append(first[: WIDTH * taken] + key[WIDTH * taken :] if conv != whose else key)
        sizes.append((np.concatenate([bytes_of[:taken], size[taken:]]) if conv != whose else size).tobytes())
        held += len(keys[-1])
        if len(ids) == RUN or held >= RUN_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.binary())], names=["conv_id", "key", "sizes"])
            ids, keys, sizes, held = [], [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.binary())], names=["conv_id", "key", "sizes"])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(donor, conv_id, taken, key, sizes, the donor's (id, key, sizes)) of each conversation of sorted turns."""
    now, keys, sizes, given = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        donor, conv, taken, size = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
        key = b"".join(batch.column(3).to_pylist())
        cuts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            which = (int(donor[a]), int(conv[a]), int(taken[a]))
            if which != now and now is not None:
                whole = (b"".join(keys), np.concatenate(sizes))
                given = (now[0], *whole) if now[0] == now[1] else given
                yield *now, *whole, given
                keys, sizes = [], []
            now = which
            keys.append(key[WIDTH * a : WIDTH * b])
            sizes.append(size[a:b])
    if now is not None:
        whole = (b"".join(keys), np.concatenate(sizes))
        yield *now, *whole, (now[0], *whole) if now[0] == now[1] else given


# ---------------------------------------------------------------- runs
def _runs(found: DataFrame) -> DataFrame:
    """Sorted sequences in runs of bounded size, one row each, with the turns shared with the run before and after (-1: there is none)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, keys, sizes, held = 0, 0, [], [], [], 0

        def packed() -> pa.RecordBatch:
            row = {"part": part, "idx": number, "first": keys[0], "last": keys[-1], "keys": b"".join(keys), "lengths": np.array([len(k) for k in keys], np.int64).tobytes(), "ids": np.array(ids, np.int64).tobytes(), "sizes": b"".join(sizes)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("idx", pa.int32()), *[(c, pa.binary()) for c in ("first", "last", "keys", "lengths", "ids", "sizes")]]))

        for batch in batches:
            for part_, conv, key, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = part_
                ids.append(conv)
                keys.append(key)
                sizes.append(size)
                held += len(key)
                if len(ids) == RUN or held >= RUN_BYTES:
                    yield packed()
                    number, ids, keys, sizes, held = number + 1, [], [], [], 0
        if ids:
            yield packed()

    @F.pandas_udf("int")
    def turns_shared(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([-1 if a is None or b is None else _shared(a, b) // WIDTH for a, b in zip(one, other, strict=True)], dtype="int32")

    dealt = found.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select(F.spark_partition_id().alias("part"), "conv_id", "key", "sizes")
    runs = materialize(dealt.mapInArrow(pack, "part int, idx int, first binary, last binary, keys binary, lengths binary, ids binary, sizes binary"))
    inside, across = Window.partitionBy("part").orderBy("idx"), Window.orderBy("part")
    ends = runs.groupBy("part").agg(F.min_by("first", "idx").alias("f"), F.max_by("last", "idx").alias("l"))
    ends = ends.select("part", F.lag("l").over(across).alias("left"), F.lead("f").over(across).alias("right"))  # a row for each task of the sort
    sides = runs.select("part", "idx", "first", "last").join(ends, "part").select(
        "part", "idx", turns_shared(F.coalesce(F.lag("last").over(inside), "left"), "first").alias("before"), turns_shared("last", F.coalesce(F.lead("first").over(inside), "right")).alias("after")
    )
    return looked_up(runs, materialize(sides), ["part", "idx"])


# ---------------------------------------------------------------- nodes
PARTS = "node binary, parent binary, part int, idx int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, some string"


def _prefixes(key: bytes, turns: int) -> list[bytes]:
    """Digests of the first 0, 1, ... ``turns`` turns."""
    h, out = hashlib.sha256(), []
    for d in range(turns + 1):
        out.append(h.copy().digest())
        h.update(key[WIDTH * d : WIDTH * (d + 1)])
    return out


def _nodes_of(keys: list[bytes], ids: np.ndarray, sizes: np.ndarray, before: int, after: int) -> list[tuple]:
    """Rows of PARTS without part and idx. ``node`` is set where other runs share the node; ``parent`` where they share its parent."""
    starts = np.concatenate([[0], np.cumsum([len(k) // WIDTH for k in keys])])
    first, last = keys[0], keys[-1]
    shared_first, shared_last = _prefixes(first, before), _prefixes(last, after)
    rows: list[list] = []
    root = grow(keys)
    # Each frame: node, byte depth of its foot, whether it lies on the first key's and on the last key's path, what its children have summed up.
    stack = [[root, len(root.path), None, None]]
    while stack:
        frame = stack[-1]
        node, foot = frame[0], frame[1]
        if frame[2] is None:
            frame[2] = iter(node.layout.ordered())
            own = node.members
            frame[3] = [len(own), int(ids[own].min()) if own else None, own[0] if own else None, 0, 0, 0, []]  # members, smallest, one of them, leaves, saved, children counted, rows that wait for a parent
        kid = next(frame[2], None)
        if kid is not None:
            stack.append([kid, foot + len(kid.path), None, None])
            continue
        stack.pop()
        n, least, one, leaves, saved, heads, wait = frame[3]
        top = foot - len(node.path)
        key = keys[one] if one is not None else b""
        to_first, to_last = (_shared(key, first), _shared(key, last))
        for depth in range(foot // WIDTH, (top // WIDTH if node is not root else -1), -1):
            bytes_of = int(sizes[starts[one] + depth - 1]) if depth else 0
            left, right = WIDTH * depth <= to_first and depth <= before, WIDTH * depth <= to_last and depth <= after
            ending = node.members if WIDTH * depth == foot else []
            if len(ending) == n and not right:
                leaves += 1
            saved += (n - (not left)) * bytes_of
            name = shared_first[depth] if left else shared_last[depth] if right else None
            said = ",".join(map(str, sorted(ids[ending].tolist())))
            for r in wait:
                rows[r][1], rows[r][4] = name, least if name is None else None
            rows.append([name, None, depth, least, None, n, heads, leaves, saved, hashlib.sha256(said.encode()).hexdigest() if name is None else None, said if name is not None and ending else None])
            heads, wait = int(not left), [len(rows) - 1]
        if stack:
            s = stack[-1][3]
            s[0] += n
            s[1] = least if s[1] is None else min(s[1], least)
            s[2] = one if s[2] is None else s[2]
            s[3] += leaves
            s[4] += saved
            s[5] += heads
            s[6] += wait
    return rows


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PARTS.split(", ")]
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in PARTS.split(", ")])
    for batch in batches:
        for i in range(batch.num_rows):
            run = {c: batch.column(c)[i].as_py() for c in ("part", "idx", "keys", "lengths", "ids", "sizes", "before", "after")}
            ends = np.cumsum(np.frombuffer(run["lengths"], np.int64)).tolist()
            keys = [run["keys"][a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            rows = _nodes_of(keys, np.frombuffer(run["ids"], np.int64), np.frombuffer(run["sizes"], np.int64), run["before"], run["after"])
            for at in range(0, len(rows), 10_000):
                columns = list(zip(*rows[at : at + 10_000], strict=True))
                columns[2:2] = [[run["part"]] * len(columns[0]), [run["idx"]] * len(columns[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, columns, strict=True)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256): one running hash, whatever the number of ids."""
    now, h, out = None, None, []
    for batch in batches:
        for node, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                out += [(now, h.hexdigest())] if h else []
                now, h = node, hashlib.sha256(some.encode())
            else:
                h.update(b"," + some.encode())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.string())], names=["node", "ends_sha256"])
        out = []
    last = [(now, h.hexdigest())] if h else []
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in last], pa.binary()), pa.array([b for _, b in last], pa.string())], names=["node", "ends_sha256"])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(found: DataFrame) -> DataFrame:
    """One row for each trie node of ``sequences``: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A member of a node starts with its turns. ``saved_tokens`` sums, over the
    node's subtree, each node's (n_convs - 1) times the bytes of its last
    text; ``ends_sha256`` hashes the comma-joined ids of the members that end
    at the node. No conversations, no nodes: an empty table has not even a
    root. A conversation's key (16 bytes a turn) must fit a task; a group of
    equal conversations is dealt over tasks.
    """
    made = materialize(_runs(materialize(found)).mapInArrow(_tree, PARTS))
    pieces = made.filter("node is not null")
    shared = materialize(pieces.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ))
    ends = pieces.filter("some is not null").select("node", "part", "idx", "some").repartition("node").sortWithinPartitions("node", "part", "idx").select("node", "some").mapInArrow(_hashed, "node binary, ends_sha256 string")
    parents = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("least"))
    whole = made.filter("node is null").drop("node", "part", "idx", "some")
    inner = whole.filter("parent is null").select(*COLUMNS)
    below = looked_up(whole.filter("parent is not null").drop("parent_conv_id"), parents, ["parent"]).withColumnRenamed("least", "parent_conv_id").select(*COLUMNS)
    top = (
        shared.join(ends, "node", "left").join(parents, "parent", "left").withColumn("parent_conv_id", F.col("least"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).select(*COLUMNS)
    )
    return inner.union(below).union(top)
