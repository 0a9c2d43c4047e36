"""URL filters: rules first, else gradient-boosted trees on lexical features, in DataFrame operations only (operator 2)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import join_one, stash

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The trees are fitted on at most so many labelled URLs, those with the smallest md5.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "host_labels", "suffix_share", "suffix_hosts")
#: Up to so many suffixes their statistics are broadcast; beyond, they are joined by shuffling.
BROADCAST_SUFFIXES = 100_000
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, else null: its host or a subdomain of it, and a path that starts with the rule's."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, rest = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _lexical(df: DataFrame) -> DataFrame:
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(u)
    counts = F.transform(F.array_distinct(F.split(u, "")), lambda c: n - F.length(F.replace(u, c, F.lit(""))))
    entropy = F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda a, k: a - (k / n) * F.log2(k / n))
    return df.withColumns({
        "length": n.cast("double"),
        "depth": F.regexp_count("path", F.lit("[^/]+")).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "params": F.regexp_count(u, F.lit("[?&][^?&=#]+=")).cast("double"),
        "host_labels": F.when(F.col("host") == "", 0.0).otherwise(F.regexp_count("host", F.lit("[.]")) + 1.0),
        "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
    })


@dataclass(frozen=True)
class Node:
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    value: float = 0.0


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> tuple[float, list[Node]]:
    """Boost regression trees on the logistic loss by Newton steps over quantile histograms: (bias, trees)."""
    if not len(y):
        return 0.0, []
    share = (y.sum() + 1) / (len(y) + 2)
    bias = math.log(share / (1 - share))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin, out = np.full(len(y), bias), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Node:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if left and len(rows) >= 20:
            for k, c in enumerate(cuts):
                if len(c):
                    gb = np.bincount(binned[rows, k], g[rows], len(c) + 1).cumsum()[:-1]
                    hb = np.bincount(binned[rows, k], h[rows], len(c) + 1).cumsum()[:-1]
                    gain = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
                    i = int(gain.argmax())
                    if gain[i] > best[0] and hb[i] > 1e-3 and hs - hb[i] > 1e-3:
                        best = (gain[i], (k, i))
        if best[1] is None:
            return Node(value=float(-rate * gs / (hs + 1)))
        k, i = best[1]
        low = binned[rows, k] <= i
        return Node(k, float(cuts[k][i]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    def value(node: Node) -> np.ndarray:
        return np.full(len(y), node.value) if node.feature < 0 else np.where(x[:, node.feature] <= node.cut, value(node.low), value(node.high))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        margin += value(tree)
        out.append(tree)
    return bias, out


def tree_column(node: Node) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    return F.when(F.col(FEATURES[node.feature]) <= node.cut, tree_column(node.low)).otherwise(tree_column(node.high))


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """A verdict for each URL: its longest fitting rule's, else that of boosted trees trained on the URLs that rules label.

    Returns one row per input row: id, host, path, rule (null if none fits), verdict (allow or block), score (the
    trees' probability of block). A null URL or one without :// has empty host and path; no rule fits it and the
    trees judge it like any other. Without labelled URLs every score is 0.5 and the verdict allow. Repeated rows
    and null ids are judged row by row; other columns are ignored; an empty table gives no rows. Features read the
    URL alone, besides two figures of its suffix over all URLs. The trees become one column expression.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = _lexical(base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    hosts = base.groupBy("suffix", "host").agg(F.count("*").alias("n"))
    stats = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("hosts"))
    stats = stash(stats.select(F.col("suffix"), F.log1p("n").alias("suffix_share"), F.log1p("hosts").alias("suffix_hosts"), "n"), "op2-suffixes")
    rows = join_one(base, stats, "suffix", "n", keys=BROADCAST_SUFFIXES, hot=0)
    of = dict(rules)
    labelled = rows.where(F.col("rule").isNotNull())
    blocked = F.col("rule").isin([r for r, v in of.items() if v == "block"])
    # the smallest keys: only rows below a bound that leaves about twice as many come to the driver's sort
    bound = 2.0 * SAMPLE / max(1, base.where(F.col("rule").isNotNull()).count())
    keyed = labelled.select(*FEATURES, blocked.cast("double").alias("y"), F.md5("url").alias("k"))
    near = keyed.where(F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / 2.0**32 < bound)
    first = lambda x: x.orderBy("k", *FEATURES).limit(SAMPLE).collect()
    sample = first(near)
    if bound < 1 and len(sample) < SAMPLE:  # keys that are not spread, such as few distinct URLs
        sample = first(keyed)
    x = np.array([[r[f] for f in FEATURES] for r in sample], dtype=np.float64).reshape(len(sample), len(FEATURES))
    bias, trees = fit_trees(x, np.array([r["y"] for r in sample], dtype=np.float64))
    margin = F.lit(bias)
    for t in trees:
        margin = margin + tree_column(t)
    rows = rows.withColumn("score", 1 / (1 + F.exp(-margin)))
    verdict = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules], F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
