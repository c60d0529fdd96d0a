"""Records of one entity from several sources: keys, the ordered fold, twins, back-fill."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brindle.functions.text import plain_name, row_hash
from brindle.tables import discard, written

#: A first column of this shape names a date or a number, not an entity (fixed value).
VALUE_LIKE = r"(?i)^[\d\s.,/:%₹$€£+-]+$|^\d{1,2}[\s-][a-z]{3,9}[\s-]\d{2,4}$"


def merge_key(name: Column, *cells: Column) -> Column:
    """Key of an entity: its plain name without spaces; rows that start with a date or number are keyed by their values."""
    key = F.replace(plain_name(name), F.lit(" "), F.lit(""))
    return F.when(F.trim(name).rlike(VALUE_LIKE), F.concat(F.lit("v"), row_hash(name, *cells))).when(key != "", key)


def coalesce_fold(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: each column's first non-blank cell in order. Map-side minima, so nothing is collected."""
    def first(c: str) -> Column:
        there = F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
        return F.min_by(F.when(there, F.col(c)), F.when(there, F.col(order))).alias(c)

    return df.groupBy(key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_rows"), *[first(c) for c in columns])


def split_same_source(df: DataFrame, key: str, source: str, order: str, cells: list[str]) -> DataFrame:
    """Adds entity: a different row of the same key from the key's first source is an entity of its own.

    Of each key, distinct rows of the first row's source are numbered by first
    appearance; the second and later ones get their own entity, and rows of
    other sources join the first.
    """
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_first", F.first(source).over(w)).withColumn("_h", row_hash(*[F.col(c) for c in cells]))
    own = F.col("_first").eqNullSafe(F.col(source))
    seen = marked.filter(own).groupBy(key, "_h").agg(F.min(order).alias("_at"))
    ranked = seen.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).select(F.col(key).alias("_key"), F.col("_h").alias("_hash"), "_k")
    on = (F.col(key) == F.col("_key")) & (F.col("_h") == F.col("_hash")) & own
    entity = F.when(F.coalesce(F.col("_k"), F.lit(1)) > 1, F.concat(F.col(key), F.lit("#"), F.col("_k").cast("string"))).otherwise(F.col(key))
    return marked.join(ranked, on, "left").withColumn("entity", entity).drop("_first", "_h", "_key", "_hash", "_k")


#: Most columns that ``twins`` compares: a row of a crowded block stands under each set of its cells.
MOST_CELLS = 10
#: Most different rows of a block that one task folds in order; larger blocks are decided by rounds.
TOGETHER = 20_000
#: Different rows that one group of small blocks holds on average, and rows of a block that are compared with its kept rows at once.
GROUPED, STEP = 5_000, 256


def twins(df: DataFrame, block: str, source: str, order: str, cells: list[str], least: int = 2, share: float = 0.6, long: int = 25, alike: bool = True, together: int = TOGETHER) -> DataFrame:
    """Adds twin_of: the order of the first kept row of the block, from another source, that is the same item.

    Rows are taken in order (ties by their cells). Two are one item if, of the
    cells that both have, at least ``least`` and at least ``share`` agree, and
    none differs where both are longer than ``long`` characters. Cells agree
    whose plain names are equal or, with ``alike``, similar (one inside the
    other without spaces, or half of the words in common). A row with an earlier kept twin is not kept and is nobody's
    twin. Rows without a block have none; a null source is a source of its own.

    Equal rows of one source are decided once. A block with at most ``together``
    different rows is folded in order by one task; those of larger blocks are
    decided by rounds without pairs of rows (``_by_rounds``), so no task holds
    more, whatever a block's size.
    """
    if len(cells) > MOST_CELLS:
        raise ValueError(f"at most {MOST_CELLS} cells are compared, not {len(cells)}")
    plain = [f"_cell{i}" for i in range(len(cells))]
    read = {"_block": F.col(block).cast("string"), "_source": F.col(source).cast("string")} | {p: F.col(c).cast("string") for p, c in zip(plain, cells, strict=True)}
    different = df.filter(F.col(block).isNotNull()).select(*[c.alias(k) for k, c in read.items()], F.col(order).alias("_at")).groupBy(*read).agg(F.min("_at").alias("_at"))
    names = [plain_name(F.coalesce(F.col(p), F.lit(""))) for p in plain]
    named = different.withColumn("_cells", F.array(*names)).withColumn("_origin", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")))
    bits = lambda test: sum((F.when(test(i), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(cells))), F.lit(0))
    has = lambda i: F.get("_cells", F.lit(i)) != ""
    named = named.withColumns({"_filled": bits(has), "_long": bits(lambda i: F.coalesce(F.char_length(plain[i]) > long, F.lit(False)) & has(i))})
    named = written(named.withColumn("_class", _digest(F.struct("_block", "_origin", "_cells", "_long"))))
    first = named.groupBy("_class", F.col("_block").alias("block"), "_cells", "_origin", "_filled", "_long").agg(F.min("_at").alias("at"))
    kinds = written(first.withColumn("at", F.struct("at", F.col("_class").alias("by"))))
    crowded = written(kinds.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > together).select("block"))
    if crowded.isEmpty():
        found = [_folded(kinds, least, share, alike)]
    else:
        found = [_folded(kinds.join(crowded, "block", "left_anti"), least, share, alike), _by_rounds(kinds.join(crowded, "block", "left_semi"), len(cells), least, share, alike)]
    dropped = named.join(found[0] if len(found) == 1 else found[0].union(found[1]), "_class").select(F.xxhash64(*read).alias("_hash"), *read, "twin_of")
    dropped = written(dropped)
    discard(named, kinds, crowded, *found[1:])
    same = [F.xxhash64(*read.values()) == F.col("_hash"), *[c.eqNullSafe(F.col(k)) for k, c in read.items()]]
    return df.join(dropped, same, "left").select(*[df[c] for c in df.columns], "twin_of")


def _folded(kinds: DataFrame, least: int, share: float, alike: bool) -> DataFrame:
    """(_class, twin_of) of the rows that have a twin, each block folded in order; a group holds blocks of one hash."""
    groups = -(-kinds.count() // GROUPED) or 1
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")
    place = F.row_number().over(Window.partitionBy("group").orderBy("block", "at")).alias("place")
    rows = kinds.select(group, "*").select("group", place, "block", "_class", F.col("at.at").alias("at"), "_cells", "_origin", "_filled", "_long")
    schema = StructType([StructField("_class", kinds.schema["_class"].dataType), StructField("twin_of", rows.schema["at"].dataType)])
    fold = _fold(least, share)
    if not alike:
        return rows.groupBy("group").applyInArrow(lambda table: fold(table, None), schema)
    links = similar_values(kinds.select("block", F.posexplode("_cells").alias("cell", "v")), "block", "cell", "v").select(group, "cell", "v", "other")
    return rows.groupBy("group").cogroup(links.groupBy("group")).applyInArrow(lambda table, links: fold(table, links), schema)


def _fold(least: int, share: float) -> Callable[[pa.Table, pa.Table | None], pa.Table]:
    """The fold of a group's blocks: each row's first kept twin, for those that have one."""

    def fold(table: pa.Table, links: pa.Table | None) -> pa.Table:
        table = table.take(pc.sort_indices(table["place"]))
        n, cells = table.num_rows, pc.list_flatten(table["_cells"].combine_chunks()).dictionary_encode()
        codes = cells.indices.to_numpy().reshape(n, -1).T.copy() if n else np.empty((0, 0), np.int32)
        bit = np.arange(len(codes))[:, None]
        filled, long = (table[c].to_numpy() >> bit & 1 == 1 for c in ("_filled", "_long"))
        origin, block = (table[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("_origin", "block"))
        linked: list[dict[int, np.ndarray]] = [{} for _ in codes]
        for c in range(len(codes) if links is not None and links.num_rows else 0):
            own = links.filter(pc.equal(links["cell"], c))
            v, other = (pc.index_in(own[k], cells.dictionary).to_numpy() for k in ("v", "other"))
            by = np.argsort(v, kind="stable")
            values, starts = np.unique(v[by], return_index=True)
            linked[c] = dict(zip(values.tolist(), np.split(other[by], starts[1:]), strict=True)) if len(v) else {}
        need = np.maximum(max(least, 1), np.ceil(np.arange(len(codes) + 1) * share - 1e-9))

        def one_item(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
            agree, both, veto = np.zeros((len(rows), len(others)), np.int8), np.zeros((len(rows), len(others)), np.int8), origin[rows][:, None] == origin[others]
            for c, known in enumerate(linked):
                mine, theirs = codes[c, rows], codes[c, others]
                same = mine[:, None] == theirs
                for v in (set(mine.tolist()) & known.keys()) if known else ():
                    same[mine == v] |= np.isin(theirs, known[v])
                there = filled[c, rows][:, None] & filled[c, others]
                same &= there
                agree += same
                both += there
                if long[c, rows].any():
                    veto |= ~same & long[c, rows][:, None] & long[c, others]
            return (agree >= need[both]) & ~veto

        twin = np.full(n, -1)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            kept = np.empty(0, np.int64)
            for step in range(start, end if (origin[start:end] != origin[start]).any() else start, STEP):
                rows = np.arange(step, min(step + STEP, end))
                if len(kept):
                    hits = one_item(rows, kept)
                    known = hits.any(axis=1)
                    twin[rows[known]] = kept[hits[known].argmax(axis=1)]
                    rows = rows[~known]
                hits, stays = np.tril(one_item(rows, rows), -1), np.ones(len(rows), bool)
                for i in np.flatnonzero(hits.any(axis=1)):
                    earlier = np.flatnonzero(hits[i] & stays)
                    if len(earlier):
                        twin[rows[i]], stays[i] = rows[earlier[0]], False
                kept = np.concatenate([kept, rows[stays]])
        have = np.flatnonzero(twin >= 0)
        return pa.table({"_class": table["_class"].take(have), "twin_of": table["at"].take(twin[have])})

    return fold


def _by_rounds(kinds: DataFrame, n: int, least: int, share: float, alike: bool) -> DataFrame:
    """(_class, twin_of) of the rows that have a twin, in a table of its own, without a task that holds a block.

    No pair of rows is formed. A row stands under each set of its cells and asks
    under the same sets, similar values put in for its own; so a row that asks
    where another stands is its twin, if the set is large enough for the cells
    that both have; and of all rows under a set, only the earliest of two
    sources for each pattern of filled cells can be anyone's first twin. Each
    round keeps every row that no undecided earlier row can displace, so a
    block's size doesn't matter.
    Rounds end when the longest chain of rows that wait for each other has ended.
    """
    stands = _under(kinds, n, least)
    asks = stands if not alike else stands.union(_under(_alternatives(kinds), n, least)).distinct()
    shared = stands.select("key", "_origin").union(asks.select("key", "_origin")).groupBy("key").agg(F.min("_origin").alias("a"), F.max("_origin").alias("b")).filter("a < b").select("key")
    shared = written(shared)
    stands, asks = written(stands.join(shared, "key", "left_semi")), written(asks.join(shared, "key", "left_semi"))
    everyone = stands.select("_class", "at").union(asks.select("_class", "at")).distinct()
    state = written(everyone.select("_class", "at", F.lit("open").alias("state"), F.lit(None).cast(kinds.schema["at"].dataType).alias("twin")))
    discard(shared)
    while not state.filter("state in ('open', 'late')").isEmpty():
        before, state = state, written(_decided(stands, asks, state, least, share))
        discard(before)
    discard(stands, asks)
    found = written(state.filter("twin is not null").select("_class", F.col("twin.at").alias("twin_of")))
    discard(state)
    return found


def _digest(values: Column) -> Column:
    """16 bytes of SHA-256 that stand for a struct: every row of the tables between the rounds carries three of them."""
    return F.substring(F.unhex(F.sha2(F.to_json(values), 256)), 1, 16)


def _under(kinds: DataFrame, n: int, least: int) -> DataFrame:
    """Each kind of row under each set of at least ``least`` of its ``n`` cells; the key names block, set and the values in it."""
    sets = [s for s in range(1, 1 << n) if s.bit_count() >= least]
    spread = kinds.withColumn("set", F.explode(F.filter(F.array(*[F.lit(s) for s in sets]), lambda s: s.bitwiseAND(F.col("_filled")) == s)))
    inside = F.transform("_cells", lambda c, i: F.when(F.getbit(F.col("set"), i) == 1, c))
    return spread.select("_class", "at", "_origin", "_filled", "_long", "set", _digest(F.struct("block", "set", inside)).alias("key"))


def _alternatives(kinds: DataFrame) -> DataFrame:
    """Each kind of row again with every choice of similar values for its cells."""
    n = kinds.select(F.max(F.size("_cells"))).first()[0] or 0
    cells = kinds.select("_class", "block", F.posexplode("_cells").alias("cell", "v"))
    links = similar_values(cells, "block", "cell", "v")
    more = cells.join(links, ["block", "cell", "v"]).groupBy("_class", "cell").agg(F.collect_list("other").alias("others"))
    wide = more.groupBy("_class").agg(F.map_from_entries(F.collect_list(F.struct("cell", "others"))).alias("_others"))
    out = kinds.join(wide, "_class").withColumn("_chosen", F.array().cast("array<string>"))
    for i in range(n):
        own = F.array(F.get("_cells", F.lit(i)))
        out = out.withColumn("_pick", F.explode(F.concat(own, F.coalesce(F.try_element_at("_others", F.lit(i)), F.array().cast("array<string>"))))).withColumn("_chosen", F.array_append("_chosen", F.col("_pick")))
    return out.drop("_cells").withColumnRenamed("_chosen", "_cells").select(*kinds.columns)


def similar_values(df: DataFrame, block: str, cell: str, value: str) -> DataFrame:
    """(block, cell, value, other): pairs, both ways, of different plain names in one cell of one block that are similar.

    A value can only lie inside another that has its rarest run of three
    characters (or itself, if shorter); half of the words can only be common
    where the rarer half of each shares one. Pairs that meet so are compared.
    """
    keys = [block, cell]
    values = df.select(*keys, F.col(value).alias("v")).filter("v <> ''").distinct().withColumn("s", F.replace("v", F.lit(" "), F.lit("")))
    n = F.char_length("s")
    runs = F.flatten(F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("s"), i, k))).otherwise(F.array().cast("array<string>"))))
    grams = values.withColumn("g", F.explode(F.array_distinct(runs)))
    often = grams.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("n"))
    anchors = grams.filter(F.char_length("g") == F.least(n, F.lit(3))).join(often, [*keys, "g"]).groupBy(*keys, "v", "s").agg(F.min(F.struct("n", "g")).alias("rarest"))
    inner = anchors.select(*keys, F.col("v").alias("a"), F.col("s").alias("inner"), F.col("rarest.g").alias("g"))
    inside = grams.join(inner, [*keys, "g"]).filter((F.col("v") != F.col("a")) & F.contains("s", "inner")).select(*keys, "a", F.col("v").alias("b"))
    words = values.select(*keys, "v", F.array_distinct(F.split("v", " ")).alias("all")).withColumn("w", F.explode("all"))
    common = words.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "v").orderBy("n", "w"))
    rare = words.join(common, [*keys, "w"]).withColumn("r", rank).filter(F.col("r") <= F.floor(F.size("all") / 2) + 1)
    one, other = rare.select(*keys, "w", F.col("v").alias("a"), F.col("all").alias("x")), rare.select(*keys, "w", F.col("v").alias("b"), F.col("all").alias("y"))
    overlap = one.join(other, [*keys, "w"]).filter((F.col("a") != F.col("b")) & (F.size(F.array_intersect("x", "y")) * 2 >= F.size(F.array_union("x", "y"))))
    pairs = inside.union(inside.select(*keys, F.col("b"), F.col("a"))).union(overlap.select(*keys, "a", "b")).distinct()
    return pairs.select(*keys, F.col("a").alias(value), F.col("b").alias("other"))


def _decided(stands: DataFrame, asks: DataFrame, state: DataFrame, least: int, share: float) -> DataFrame:
    """The state after one round: open rows become kept or dropped where the earlier ones that could be their twins are known; a dropped row is late while its first twin isn't."""
    now = state.select("_class", "state")
    first = stands.join(now, "_class").filter("state in ('open', 'kept')").groupBy("key", "set", "_filled", "_long", "state", "_origin").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("key", "set", "_filled", "_long", "state").orderBy("at"))
    heads = first.withColumn("_n", rank).filter("_n <= 2").select("key", F.col("at").alias("other"), F.col("state").alias("how"), F.col("_origin").alias("from"), F.col("_filled").alias("theirs"), F.col("_long").alias("long_theirs"))
    both = F.bit_count(F.col("_filled").bitwiseAND(F.col("theirs")))
    enough = F.bit_count("set") >= F.greatest(F.lit(least), F.ceil(both * F.lit(share) - F.lit(1e-9)))
    no_veto = F.col("_long").bitwiseAND(F.col("long_theirs")).bitwiseAND(F.bitwise_not(F.col("set"))) == 0
    met = asks.join(now, "_class").filter("state in ('open', 'late')").join(heads, "key").filter((F.col("_origin") != F.col("from")) & (F.col("other") < F.col("at")) & enough & no_veto)
    seen = met.groupBy("_class").agg(F.min(F.when(F.col("how") == "kept", F.col("other"))).alias("kept"), F.min(F.when(F.col("how") == "open", F.col("other"))).alias("open"))
    waits = F.col("state").isin("open", "late")
    known = F.col("kept").isNotNull() & (F.col("open").isNull() | (F.col("kept") < F.col("open")))
    return state.join(seen, "_class", "left").select(
        "_class", "at",
        F.when(~waits, F.col("state")).when(known, F.lit("dropped")).when(F.col("kept").isNotNull(), F.lit("late")).when(F.col("open").isNotNull(), F.lit("open")).otherwise(F.lit("kept")).alias("state"),
        F.when(~waits, F.col("twin")).when(known, F.col("kept")).alias("twin"),
    )


def back_fill(table: DataFrame, reference: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Reference rows that the table lacks are added, and blanks of known keys are filled."""
    r = reference.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = table.join(r, F.col(key) == F.col("_k"), "full")
    fill = lambda c: F.coalesce(F.when(F.trim(F.col(c)) != "", F.col(c)), F.col(f"_r_{c}")).alias(c)
    return joined.select(F.coalesce(key, "_k").alias(key), *[fill(c) for c in columns])


def duplicate_ids(df: DataFrame, page: str, ident: str, cells: list[str]) -> DataFrame:
    """An id that occurs twice on a page gets the hash of its row behind it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(page, ident))
    return df.withColumn(ident, F.when(n > 1, F.concat_ws("|", ident, row_hash(*[F.col(c) for c in cells]))).otherwise(F.col(ident)))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row of each key, with is_new for keys that ``old`` lacks."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key)
    ranked = both.withColumn("is_new", F.min("_new").over(w) == 1).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("_new"), F.desc(order))))
    return ranked.filter("_rn = 1").drop("_rn", "_new")


def fill_if_empty(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Conditional upsert: a cell is overwritten only where the old one is null, blank or an empty list."""
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    weak = lambda c: F.col(c).isNull() | F.trim(F.col(c)).isin("", "[]", "{}")
    return old.join(n, F.col(key) == F.col("_k"), "full").select(F.coalesce(key, "_k").alias(key), *[F.when(weak(c), F.coalesce(F.col(f"_n_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in columns])
