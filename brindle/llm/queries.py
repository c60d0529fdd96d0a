"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import exact, extract, langid, lm, mixing, packing, quality, simhash, substring, trie, urls, warc, whitening
from brindle.llm.common import documents, pages, scratch_folder


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(pages(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir), shingle=3, radius=2)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(pages(spark, sf_dir))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(documents(spark, sf_dir))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(pages(spark, sf_dir), f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}").drop("uri")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("long")
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie.nodes(trie.sequences(conversations, donor=conv - conv % 5, taken=F.crc32(conv.cast("string").cast("binary")) % 9))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_quality": op2_quality,
    "op3_langid": op3_langid,
    "op4_urls": op4_urls,
    "op5_simhash": op5_simhash,
    "op6_substring": op6_substring,
    "op7_lm": op7_lm,
    "op8_extract": op8_extract,
    "op9_exact": op9_exact,
    "op10_pack": op10_pack,
    "op11_whiten": op11_whiten,
    "op12_warc": op12_warc,
    "op13_trie": op13_trie,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Unsigned CRC-32 of the decimal form of a number ``c``, bit by bit.
CRC32 = """xor(list_reduce([4294967295::BIGINT] || [ord(s)::BIGINT FOR s IN string_split(c::VARCHAR, '')],
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""

ORACLE_SQL = {
    "op6_substring": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM s),
        f AS (SELECT words, min(doc_id) AS lo FROM g GROUP BY words),
        c AS (SELECT DISTINCT doc_id, i + o AS p FROM g JOIN f USING (words), range(0, 13) AS r(o) WHERE lo < doc_id),
        x AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
        k AS (SELECT t.doc_id, len(w) AS n_words, len(coalesce(gone, [])) AS n_removed,
                     [w[p] FOR p IN list_sort(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(coalesce(gone, []), p)))] AS kept
              FROM t LEFT JOIN x ON t.doc_id = x.doc_id)
        SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
    """,
    "op9_exact": f"""
        WITH t AS (SELECT doc_id, {LOWERED} AS low FROM documents),
        g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY low)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.low) AS text_sha256
        FROM t JOIN g ON t.low = g.low
    """,
    "op12_warc": """
        WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest, min(page_id) AS first_id FROM t WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM t LEFT JOIN g USING (payload_digest)
    """,
    "op13_trie": f"""
        WITH t AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS q FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c, q, {CRC32} % 9 AS h FROM t),
        r AS (SELECT h.c, list_concat(coalesce(b.q[:h.h], []), h.q[h.h + 1:]) AS q FROM h LEFT JOIN t b ON b.c = h.c - h.c % 5),
        n AS (SELECT q[:d] AS p, d, c, len(q) = d AS ends FROM (SELECT q, c, unnest(range(0, len(q) + 1)) AS d FROM r)),
        g AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM n GROUP BY p, d),
        k AS (SELECT p[:d - 1] AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
        o AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(g.p[d].x) END AS own FROM g LEFT JOIN k ON g.p = k.p),
        s AS (SELECT p[:e] AS p, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT p, own, n_children, unnest(range(0, d + 1)) AS e FROM o) GROUP BY 1)
        SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(o.ids) AS ends_sha256
        FROM o JOIN s ON o.p = s.p LEFT JOIN o u ON o.d > 0 AND u.p = o.p[:o.d - 1]
    """,
}
