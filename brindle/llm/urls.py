"""URL filters (native): a path-template tree with smoothed labelled purity.

Per host, path segments that vary become wildcards, branches of one parent
whose labels do not differ statistically are pooled, and a template is
rejected when its smoothed share of blocked labels is above one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import ascii_lower, materialize, salted_join

#: (verdict, host, path prefix): a host fits itself and its subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Children of one node above which its segments count as variable.
CHILDREN = 32
#: Labels that a child of a wide node needs to be told from its siblings.
LEAST_LABELS = 8
#: Weight of a parent's purity, in labelled urls.
SMOOTHING = 4.0
#: Two-sided 5 % point of the normal distribution (fixed value).
Z = 1.96


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lower-cased; both empty without one."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Rules are configuration, so they become one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _segment(s: Column) -> Column:
    """A segment with its runs of digits and long hexadecimal runs generalised."""
    return F.regexp_replace(F.regexp_replace(s, r"(?i)[0-9a-f]{8}[0-9a-f-]{8,}", "{h}"), r"[0-9]+", "{n}")


def template_tree(urls: DataFrame, children: int = CHILDREN) -> tuple[DataFrame, int]:
    """(``urls`` with ts, the array of its template's prefixes down to the whole template; the number of levels).

    Level by level, the distinct children of each (host, prefix) are counted
    from distinct paths; the children of a wide node become ``*``, but for
    those whose labels differ from their siblings' (z test). Levels go on until
    no path has a segment left. The tree is built over distinct templates with
    their label counts, one row each, and joined back to the urls.
    """
    shape = F.concat_ws("/", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _segment))
    rows = materialize(urls.withColumn("shape", shape))
    tree = rows.groupBy("host", "shape").agg(F.sum(F.coalesce("label", F.lit(0))).alias("k"), F.count("label").alias("n"))
    tree = materialize(tree.withColumn("s", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))).withColumn("ts", F.array(F.lit(""))))
    depth = tree.agg(F.coalesce(F.max(F.size("s")), F.lit(0))).first()[0]
    for i in range(depth):
        here = tree.filter(F.size("s") > i).select("host", F.element_at("ts", -1).alias("up"), F.get("s", F.lit(i)).alias("child"), "k", "n")
        own = here.groupBy("host", "up", "child").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
        all_ = own.groupBy("host", "up").agg(F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("ak"), F.sum("n").alias("an")).filter(F.col("kinds") > children)
        wide = materialize(all_)
        rest_k, rest_n = F.col("ak") - F.col("k"), F.col("an") - F.col("n")
        apart = (F.col("n") >= LEAST_LABELS) & (rest_n > 0) & ~_alike(F.col("k"), F.col("n"), rest_k, rest_n)
        kept = own.join(wide, ["host", "up"]).filter(apart).select("host", "up", "child", F.lit(True).alias("_own"))
        keyed = tree.withColumn("up", F.element_at("ts", -1)).withColumn("child", F.get("s", F.lit(i)))
        marked = keyed.join(wide.select("host", "up", F.lit(True).alias("_wide")), ["host", "up"], "left").join(kept, ["host", "up", "child"], "left")
        name = F.when(F.col("_wide") & F.col("_own").isNull(), F.lit("*")).otherwise(F.col("child"))
        tree = materialize(marked.withColumn("ts", F.when(F.size("s") > i, F.concat("ts", F.array(F.concat("up", F.lit("/"), name)))).otherwise(F.col("ts"))).select("host", "shape", "k", "n", "s", "ts"))
    return salted_join(rows, tree.select("host", "shape", "ts"), ["host", "shape"], F.col("page_id")), depth


def _alike(k: Column, n: Column, rest_k: Column, rest_n: Column) -> Column:
    """Whether a branch's share of blocked labels is no different from the rest's (two-sided z test)."""
    pooled = (k + rest_k) / F.greatest(n + rest_n, F.lit(1))
    gap = F.abs(k / F.greatest(n, F.lit(1)) - rest_k / F.greatest(rest_n, F.lit(1)))
    return gap <= Z * F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))


def _smoothed(k: Column, n: Column, prior: Column) -> Column:
    return (F.coalesce(k, F.lit(0)) + SMOOTHING * prior) / (F.coalesce(n, F.lit(0)) + SMOOTHING)


def template_purity(rows: DataFrame, depth: int) -> DataFrame:
    """(host, leaf, purity) from rows (host, ts, label: 1 blocked, 0 allowed, null unlabelled).

    A node's prior is its parent's purity, down from the host; a host's is that
    of all hosts. At every level, branches of one parent whose shares do not
    differ are merged and share one purity; what differs keeps its own. A leaf
    is first smoothed with the same template on all hosts, so a host without
    labels borrows from equal templates elsewhere.
    """
    k, n = F.sum(F.coalesce("label", F.lit(0))), F.count("label")
    leaves = materialize(rows.groupBy("host", "ts").agg(k.alias("k"), n.alias("n")))
    total = leaves.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    p_all = _smoothed(F.lit(total["k"] or 0), F.lit(total["n"] or 0), F.lit(0.5))
    level = leaves.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).select("host", F.lit("").alias("node"), _smoothed(F.col("k"), F.col("n"), p_all).alias("p"))
    level = materialize(level)
    found = [level]
    for i in range(1, depth + 1):
        node = leaves.filter(F.size("ts") > i).groupBy("host", F.get("ts", F.lit(i - 1)).alias("up"), F.get("ts", F.lit(i)).alias("node")).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
        same = node.groupBy("node").agg(F.sum("k").alias("same_k"), F.sum("n").alias("same_n"))
        up = level.select("host", F.col("node").alias("up"), F.col("p").alias("p_up"))
        c = node.join(up, ["host", "up"]).join(same, "node").withColumn("same_k", F.col("same_k") - F.col("k")).withColumn("same_n", F.col("same_n") - F.col("n"))
        siblings = Window.partitionBy("host", "up")
        c = c.withColumn("rest_k", F.sum("k").over(siblings) - F.col("k")).withColumn("rest_n", F.sum("n").over(siblings) - F.col("n"))
        c = c.withColumn("alike", (F.col("n") > 0) & (F.col("rest_n") > 0) & _alike(F.col("k"), F.col("n"), F.col("rest_k"), F.col("rest_n")))
        merged = Window.partitionBy("host", "up", "alike")
        own_k, own_n = (F.when(F.col("alike"), F.sum(x).over(merged)).otherwise(F.col(x)) for x in ("k", "n"))
        prior = F.when(F.col("same_n") > 0, _smoothed(F.col("same_k"), F.col("same_n"), F.col("p_up"))).otherwise(F.col("p_up"))
        level = materialize(c.select("host", "node", _smoothed(own_k, own_n, prior).alias("p")))
        found.append(level)
    every = found[0]
    for df in found[1:]:
        every = every.union(df)
    leaf = leaves.select("host", F.element_at("ts", -1).alias("node")).distinct()
    return leaf.join(every, ["host", "node"]).select("host", F.col("node").alias("leaf"), F.col("p").alias("purity"))


def judge(urls: DataFrame, rules=RULES, labels: DataFrame | None = None, children: int = CHILDREN) -> DataFrame:
    """One row per row of ``urls`` (page_id, url): page_id, host, path, rule, verdict, template, purity.

    A rule decides where one fits, the longest first; elsewhere the url's
    template is blocked when its purity is above one half. Labels are the
    rules' verdicts, or ``labels`` (page_id, label 1 for blocked, one row per
    page) where given. A null url or one without ``://`` has empty host and
    path and hangs under the empty host; repeated rows are judged alike; an
    empty table gives an empty result and other columns are not read.
    """
    host, path = split_url(F.col("url"))
    rows = urls.select("page_id", host.alias("host"), path.alias("path")).withColumn("match", match_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("label", F.when(F.col("match.verdict") == "block", 1).when(F.col("match.verdict") == "allow", 0))
    if labels is not None:
        own = labels.select(F.col("page_id").alias("_p"), F.col("label").alias("_l"))
        rows = rows.join(own, F.col("page_id") == F.col("_p"), "left").withColumn("label", F.coalesce("_l", "label")).drop("_p", "_l")
    tree, depth = template_tree(rows.select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("by_rule"), "label"), children)
    tree = materialize(tree.withColumn("leaf", F.element_at("ts", -1)))
    purity = materialize(template_purity(tree, depth))
    judged = salted_join(tree, purity, ["host", "leaf"], F.col("page_id"))
    learned = F.when(F.col("purity") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", learned).alias("verdict"), F.col("leaf").alias("template"), "purity")
