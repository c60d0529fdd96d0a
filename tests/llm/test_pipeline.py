"""The pipeline's stages on one small corpus, each against brute force over its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 4000, n))
    rows = [(i, text(int(rng.integers(60, 300))), ["en", "de"][i % 2], f"s{i % 3}") for i in range(240)]
    rows += [(300 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s0") for i in range(15)]
    for i in range(15):
        words = rows[20 + i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((400 + i, " ".join(words), "en", "s1"))
    rows += [(500 + i, " ".join(f"x{k}***" for k in rng.integers(0, 900, 80)), "en", "s2") for i in range(5)]
    rows += [(600, None, "en", "s0"), (601, "", None, None), (602, "too short", "en", None), (603, "same same " * 200, "de", "s0")]
    folder = tmp_path_factory.mktemp("corpus")
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(folder)).write.parquet(f"{folder}/{n}")
        out.append(spark.read.parquet(f"{folder}/{n}"))
    return str(folder), out, [df.collect() for df in out]


def test_columns(corpus):
    _, frames, _ = corpus
    assert all(f.columns == frames[0].columns for f in frames[:-1])


def test_quality(corpus):
    _, _, rows = corpus
    kept = {r["doc_id"] for r in rows[1]}
    assert not kept & {600, 601, 602, 603, *range(500, 505)}
    assert len(kept & {*range(240)}) >= 237 and {r[:] for r in rows[1]} <= {r[:] for r in rows[0]}


def test_exact(corpus):
    _, _, rows = corpus
    last = {}
    for r in rows[1]:
        last[low(r["text"])] = max(last.get(low(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(last.values())


def test_near(corpus):
    _, _, rows = corpus
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [WORD.findall(low(r["text"]))] for i in range(len(w) - 4)} for r in rows[2]}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in rows[3]) == sorted({find(i) for i in ids})


def test_mix(corpus):
    _, _, rows = corpus
    sizes, taken, copies = defaultdict(int), defaultdict(int), Counter(r["doc_id"] for r in rows[4])
    for r in rows[3]:
        n = len(WORD.findall(r["text"]))
        sizes[r["source"]] += n
        taken[r["source"]] += n * copies[r["doc_id"]]
    assert max(copies.values()) <= 2 and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())


def test_pack(corpus):
    _, _, rows = corpus
    tok = packing._tokenizer(packing.tokenizer_path())
    want = Counter()
    for r in rows[4]:
        ids = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        want.update((r["doc_id"], k, zlib.crc32(ids[k * 2048 : k * 2048 + 2048].tobytes())) for k in range(-(-len(ids) // 2048)))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows[5]) == want
    filled = Counter()
    for r in rows[5]:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= sum(filled.values()) / 2048 + 2


def test_run_is_the_chain(spark, corpus):
    folder, _, rows = corpus
    got = corpus_pipeline.run(spark, folder)
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got.collect()) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows[5])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
