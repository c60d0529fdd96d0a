"""WARC archives, the conversation trie and whitening against plain versions of themselves."""

import gzip
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import queries, trie, warc, whitening

DATA = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- warc
LONG = "x" * 60 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 50
PAGES = [
    (3, "http://a/b c\r\n", LONG), (1, "u", LONG), (1, "u", LONG), (1, None, LONG), (None, "u", LONG), (None, None, None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, None, "y" * 100),
    (9, None, "y" * 100), (9, None, "y" * 100), (10, "z", "q" * 99), (11, "z", "q" * 99), (12, "l", "long\n" * 300_000), (13, "l", "\n"), (14, "l", "\r\n\r\n"), (15, "", " " * 200), (16, "", " " * 200),
]


def expected_records(pages):
    groups = defaultdict(list)
    for i, (page, url, html) in enumerate(pages):
        groups[(html or "").encode()].append((page is None, page or 0, url is None, url or "", i))
    out = [None] * len(pages)
    for payload, members in groups.items():
        first = min(members)
        for m in members:
            later = len(payload) >= 100 and m != first
            out[m[4]] = (pages[m[4]][0], len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if later else "response", pages[first[4]][0] if later else None)
    return Counter(out)


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, times int").repartition(3)
    folder = str(tmp_path_factory.mktemp("warc"))
    return folder, warc.archive(pages, folder)


def test_records_come_back_from_their_offsets(archived):
    folder, index = archived
    found = warc.read_records(index, folder).collect()
    got = Counter((r["page_id"] and int(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in found)
    assert got == expected_records(PAGES)
    ids = Counter(r["record_id"] for r in found)
    assert max(ids.values()) == 1 and all(r["refers_to_id"] in ids for r in found if r["record_type"] == "revisit")
    assert Counter(bytes(r["payload"]) for r in found if r["payload"] is not None)[LONG.encode()] == 1
    assert {r["uri"] for r in found if r["page_id"] == "3"} == {"http://a/b%20c%0D%0A"} and all(r["uri"] is None for r in found if r["page_id"] in ("15", "16"))


def test_members_tile_their_archive(archived):
    folder, index = archived
    by_archive = defaultdict(list)
    for r in index.collect():
        by_archive[r["archive"]].append((r["start"], r["length"]))
    assert {f for f in os.listdir(folder) if f.endswith(".warc.gz")} == set(by_archive)
    for name, members in by_archive.items():
        raw, at = open(f"{folder}/{name}", "rb").read(), 0
        for start, length in sorted(members):
            assert start == at and gzip.decompress(raw[start : start + length]).startswith(b"WARC/1.1\r\n")
            at = start + length
        assert at == len(raw)
    assert not [f for f in os.listdir(folder) if f.startswith("streams")]


def test_monolithic_stream_of_another_writer(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"a\nb\r\n" * 20
    record = b"WARC/1.0\r\nWARC-Type: response\r\nwarc-record-id: <x>\r\nWARC-Payload-Digest: sha256:0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/one.warc.gz", "wb") as f:
        f.write(record * 7 + b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    index = warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert Counter(r["record_type"] for r in index) == {"response": 7, "warcinfo": 1}
    raw = {r["start"]: gzip.decompress(open(tmp_path / "out" / r["archive"], "rb").read()[r["start"] : r["start"] + r["length"]]) for r in index}
    assert [raw[s] for s in sorted(raw)][:7] == [record] * 7


def test_broken_stream_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/one.warc.gz", "wb") as f:
        f.write(b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")
    with pytest.raises(Exception, match="ends inside a record"):
        warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_warc_of_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id int, url string, html string")
    out = warc.round_trip(none, str(tmp_path / "w"))
    assert out.count() == 0 and dict(out.dtypes)["page_id"] == "int"


# ---------------------------------------------------------------- trie
def plain_trie(rows, forked):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said = hashlib.sha256((str(len((r or "").encode())) + ":" + (r or "") + (x or "")).encode()).digest()[:16]
            convs[c].append((t is not None, t or 0, r or "", said, x or ""))
    convs = {c: [(r, x) for _, _, r, _, x in sorted(q)] for c, q in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if forked else 0
        built[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, q in built.items():
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in children
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


def conversations(seed=5):
    rng, rows = random.Random(seed), []
    for c in [*range(-7, 120), 5000, 10**12]:
        style = rng.randrange(4)
        for t in range(rng.choice([1, 1, 2, 5, 9]) if style else 3):
            text = rng.choice(["hello", "a", "é", "", None]) if style else f"same {t}"
            rows.append((c, rng.choice([t, t, None, 0]) if style == 1 else t, rng.choice(["user", "assistant", None]) if style else "user", text))
    rows += [(200, t, "user", f"deep {t}") for t in range(300)] + [(201, t, "user", f"deep {t}") for t in range(250)] + [(202, t, None, "x" * 1000) for t in range(40)]
    rows += [(203, 1, "user", "twice"), (203, 1, "user", "twice"), (None, 1, "user", "nobody's")]
    rows += [(c, t, "system", f"one of many {t}") for c in range(300, 420) for t in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("run, forked", [(4096, True), (7, True), (1, False), (40, False)])
def test_trie(spark, monkeypatch, run, forked):
    monkeypatch.setattr(trie, "RUN", run)
    rows = conversations()
    df = spark.createDataFrame([(*r, b"k", "d") for r in rows], "conv_id long, turn int, role string, text string, key binary, donor string").repartition(5)
    c = F.col("conv_id")
    found = trie.sequences(df, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9) if forked else trie.sequences(df)
    assert Counter(tuple(r[n] for n in trie.COLUMNS) for r in trie.nodes(found).collect()) == plain_trie(rows, forked)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.nodes(trie.sequences(none)).count() == 0
    assert trie.nodes(trie.sequences(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string"))).count() == 0


def test_layouts_grow_and_paths_split():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice([0, 1, 2, 255, rng.randrange(256)]) for _ in range(rng.choice([0, 1, 2, 3, 16, 40]))) for _ in range(3000)})
    rng.shuffle(keys)
    root, kinds, seen, stack = trie.grow(keys), Counter(), {}, []
    stack = [(root, root.path)]
    while stack:
        node, path = stack.pop()
        kinds[type(node.layout).__name__, getattr(node.layout, "most", 0)] += 1
        for m in node.members:
            seen[m] = path
        for kid in node.layout.ordered():
            stack.append((kid, path + kid.path))
    assert seen == dict(enumerate(keys))
    assert {("_Few", 4), ("_Few", 16), ("_Indexed", 0), ("_Full", 0)} <= set(kinds)


# ---------------------------------------------------------------- whitening
def check_whitened(spark, rows, kept, most=16):
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<float>, x int, n string").repartition(3)
    got = whitening.whiten(df, most).toPandas()
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in rows if kept(v)]).astype(np.int64) + 1_000_000
    ids = [i for i, v in rows if kept(v)]
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    rank = min(most, int((values > 1e-9 * values[-1]).sum()))
    assert len(got) == len(ids) * rank and set(got["component"]) == set(range(1, rank + 1)) and set(got["n"]) == {n}
    want = Counter((i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True))) for i, r in zip(ids, x, strict=True))
    one = got[got["component"] == 1]
    assert Counter((None if math.isnan(i) else i, int(v)) for i, v in zip(one["vec_id"], one["deviation"], strict=True)) == want
    assert got["explained"].groupby(got["component"]).first().to_numpy() == pytest.approx(values[::-1][:rank] / values.sum(), rel=1e-9)
    assert got["identity_error"].max() < 1e-9
    return got, x, fit, values[::-1], vectors[:, ::-1], rank, ids


def test_whitening_with_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + j / 4) for j in range(20)]) for i in range(90)]
    rows += [(100, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (101, None), (102, []), (103, [1.0] * 19), (104, [*[1.0] * 19, None]), (105, [*[1.0] * 19, math.nan]), (106, [*[1.0] * 19, math.inf])]
    got, x, fit, values, vectors, rank, ids = check_whitened(spark, rows, lambda v: v is not None and len(v) == 20 and None not in v and all(map(math.isfinite, v)))
    mine = got[got["vec_id"].between(0, 89)].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    own = (x[:90] - fit.mean(axis=0)) @ vectors[:, :rank] / np.sqrt(values[:rank])
    assert np.abs(np.abs(mine) - np.abs(own)).max() < 1e-7 and rank == 16


def test_whitening_with_repeated_and_missing_eigenvalues(spark):
    corners = [[s if i == j else 0.0 for i in range(6)] for j in range(4) for s in (1.0, -1.0)]
    check_whitened(spark, [(i, [float(c) for c in v]) for i, v in enumerate(corners)], lambda v: True)


def test_whitening_without_spread(spark):
    kinds = "vec_id int, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kinds)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kinds)).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [1.0])], kinds))


def test_polynomial_roots_and_null_vectors(spark):
    rng = np.random.default_rng(3)
    b = rng.integers(-50, 50, (9, 7))
    m = (b.T @ b).astype(object).tolist()
    poly = whitening.characteristic(spark, m)
    exact, step = [1], [[0] * 7 for _ in range(7)]  # by traces: M_k = A M_{k-1} + c_{k-1} I, c_k = -tr(A M_k) / k
    for k in range(1, 8):
        step = [[sum(m[i][q] * step[q][j] for q in range(7)) + exact[-1] * (i == j) for j in range(7)] for i in range(7)]
        exact.append(-sum(m[i][q] * step[q][i] for i in range(7) for q in range(7)) // k)
    assert poly == exact
    roots = whitening.largest_roots(poly, 7, 100)
    assert [r / 2**100 for r, _ in roots] == pytest.approx(np.linalg.eigvalsh(np.array(m, float))[::-1], rel=1e-10)
    assert whitening.largest_roots([1, -7, 15, -9, 0], 4, 40) == [(3 << 40, 2), (1 << 40, 1)]
    for root, times in roots:
        (v,) = whitening.null_vectors(m, root, times, 100)
        assert np.linalg.norm(np.array(m, float) @ v - root / 2**100 * np.array(v)) < 1e-8


# ---------------------------------------------------------------- the queries against SQL
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["op12_warc", "op13_trie"])
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert Counter(found.fetchall()) == Counter(tuple(r[n] for n in names) for r in df.collect()) and sorted(names) == sorted(df.columns)
