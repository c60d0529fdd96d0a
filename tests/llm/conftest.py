import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, g string, bin string, fp string, part string"


def small_documents():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, near-copies, shared passages."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "The", "ÉTÉ", "x&y", "it's", "a|b", "don't"]
    rows = []
    passage = " ".join(rng.choice(words) + str(i) for i in range(30))
    for i in range(1, 41):
        n = rng.choice([1, 2, 3, 12, 13, 60, 90])
        text = " ".join(rng.choice(words) + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(n))
        if i % 5 == 0:
            text = text + "\n" + passage + "\t" + text[:40]
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None])))
    base = " ".join(f"w{rng.randint(0, 500)}" for _ in range(120))
    rows += [(50, base, "en", "s0"), (51, base.upper(), "en", "s1"), (52, base.replace("w1", "v1", 1), "en", "s0"), (53, base + " tail", None, None)]
    rows += [(60, None, "en", "s0"), (61, "", None, "s1"), (62, " \n\t ", "de", None), (63, "word " * 3000, "en", "s2"), (64, "line one\nline one\n\nline two\nline one", "en", "s0")]
    rows += [(70, "same row", "en", "s0"), (70, "same row", "en", "s0"), (None, "no id here at all", "en", "s0"), (71, "ａｂｃ ÀÉ 你好 world \u0085 next", "de", "s1")]
    return [(d, t, la, s, len(t or ""), "k", "g", "b", "f", "p") for d, t, la, s in rows]


@pytest.fixture(scope="session")
def rows():
    return small_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
