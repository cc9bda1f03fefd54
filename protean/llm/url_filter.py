"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

Rules decide where one fits. Elsewhere a small model of boosted trees judges length, depth, digit
ratio, entropy, parameter counts and statistics of suffixes and host words. URLs that a blocking rule
fits or whose host holds a word of a blocklist count as block, all others as allow. The statistics
count all different URLs but those of the URL's own fold, so a URL's own label is never among its
features, and are joined by host and fold. Features are SQL expressions; the trees see whole columns,
are fitted on a bounded sample, and travel to the executors with the function, a few kilobytes.

Defined results: null urls and urls without ``://`` have an empty host and path, no rule and a
verdict of the method (``allow`` without a model); repeated rows get equal results; null identifiers
pass through; very long urls are treated whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, sampled, stored

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of hosts that blocklists are full of.
BAD_WORDS = ("spam", "pills", "casino", "viagra", "porn", "xxx", "malware", "phish", "cheap", "gamble", "adult", "bets", "ads-", "-track")
#: About so many different labelled URLs are fitted on, at most twice as many: those with the smallest hashes.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "longest_label", "vowel_ratio", "suffix_rate", "suffix_count", "host_word_rate", "has_fragment")
STATISTICS = ("suffix_rate", "suffix_count", "host_word_rate")
#: Parts of the URLs; statistics for one are counted on the others.
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(u, F.lit("://")), F.regexp_replace(u, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(bare, r"(?s)^([^/]*)", 1)
    return ascii_lower(host), F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first in text order), and its verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name = verdict = None
    for v, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return name, verdict


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(FOLDS)).cast("int")


def features(url: str = "url", host: str = "host", path: str = "path") -> list[Column]:
    """FEATURES as columns, from the columns of that name and of STATISTICS."""
    u = f"coalesce({url}, '')"
    query = f"substring_index(if(instr({u}, '?') > 0, substr({u}, instr({u}, '?') + 1), ''), '#', 1)"
    count = lambda s, kind: f"regexp_count({s}, '{kind}')"
    # a Java string is split into characters between which nothing stands
    entropy = lambda s: f"coalesce(element_at(transform(array(split({s}, '')), c -> -aggregate(array_distinct(c), 0D, (a, x) -> a + size(filter(c, y -> y = x)) / size(c) * log2(size(filter(c, y -> y = x)) / size(c)))), 1), 0D)"
    made = {
        "url_length": f"length({u})", "host_length": f"length({host})", "path_length": f"length({path})", "depth": count(path, "/"), "labels": f"size(split({host}, '[.]'))",
        "digit_ratio": f"{count(u, '[0-9]')} / greatest(1, length({u}))", "host_digit_ratio": f"{count(host, '[0-9]')} / greatest(1, length({host}))", "hyphens": count(host, "-"),
        "entropy": entropy(u), "host_entropy": entropy(host), "parameters": f"{count(query, '=')} + 0.01D * {count(query, '&')}", "query_length": f"length({query})",
        "longest_label": f"array_max(transform(split({host}, '[.]'), x -> length(x)))", "vowel_ratio": f"{count(host, '[aeiou]')} / greatest(1, {count(host, '[a-z]')})",
        "suffix_rate": "suffix_rate", "suffix_count": "ln(1 + suffix_count)", "host_word_rate": "host_word_rate", "has_fragment": f"int(instr({u}, '#') > 0)",
    }
    return [F.expr(made[name]).cast("double").alias(name) for name in FEATURES]


class BoostedTrees:
    """Logistic gradient boosting of shallow trees over binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.model: list[list[tuple]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        b, p = self._binned(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-6)
            leaf = np.zeros(len(y), dtype=np.int64)
            splits: list[tuple] = []
            for _ in range(self.depth):
                best = None
                for j in range(b.shape[1]):  # one split for a whole level: an oblivious tree
                    n_leaf, n_bin = int(leaf.max()) + 1, len(self.edges[j]) + 1
                    at = leaf * n_bin + b[:, j]
                    g = np.bincount(at, grad, n_leaf * n_bin).reshape(n_leaf, n_bin)
                    h = np.bincount(at, hess, n_leaf * n_bin).reshape(n_leaf, n_bin)
                    gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                    gain = (gl**2 / (hl + 1) + (g.sum(1, keepdims=True) - gl) ** 2 / (h.sum(1, keepdims=True) - hl + 1)).sum(0)
                    if gain.size and (best is None or gain.max() > best[0] + 1e-12):
                        best = (gain.max(), j, int(gain.argmax()))
                if best is None:
                    break
                splits.append(best[1:])
                leaf = leaf * 2 + (b[:, best[1]] > best[2])
            n = 1 << len(splits)
            value = self.rate * np.bincount(leaf, grad, n) / (np.bincount(leaf, hess, n) + 1)
            self.model.append((splits, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of block."""
        b, score = self._binned(x), np.full(len(x), self.base)
        for splits, value in self.model:
            leaf = np.zeros(len(x), dtype=np.int64)
            for j, t in splits:
                leaf = leaf * 2 + (b[:, j] > t)
            score += value[leaf]
        return 1 / (1 + np.exp(-score))


def _urls(pages: DataFrame, url_col: str) -> DataFrame:
    return pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"))


def _labelled(urls: DataFrame, rules, bad_words) -> DataFrame:
    """url, host, path and y."""
    host, path = host_and_path(F.col("url"))
    _, verdict = rule_for(host, path, rules)
    verdict = F.coalesce(verdict, F.lit("")) if verdict is not None else F.lit("")
    bad = host.rlike("|".join(map(re.escape, bad_words)))
    return urls.select("url", host.alias("host"), path.alias("path"), (((verdict == "block") | bad) & (verdict != "allow")).cast("double").alias("y"))


def statistics(pages: DataFrame, url_col: str = "url", rules=RULES, bad_words=BAD_WORDS) -> DataFrame:
    """(host, fold, suffix_rate, suffix_count, host_word_rate) for the URLs of a host in a fold, counted over all different URLs of the other folds."""
    urls = _labelled(_urls(pages, url_col).distinct(), rules, bad_words).withColumn("fold", fold(F.col("url")))
    hosts = stored(urls.groupBy("host", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "url-hosts").withColumn("suffix", F.substring_index("host", ".", -1))
    total = [F.sum("n").alias("n"), F.sum("s").alias("s")]

    def others(table: DataFrame, key: str) -> DataFrame:
        """Counts of ``key`` in the other folds."""
        own = table.groupBy(key, "fold").agg(*total)
        every = own.groupBy(key).agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
        return own.join(every, key).select(key, "fold", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_s") - F.col("s")).alias("s"))

    suffixes = others(hosts, "suffix").select("suffix", "fold", ((F.col("s") + 0.5) / (F.col("n") + 1)).alias("suffix_rate"), F.col("n").cast("double").alias("suffix_count"))
    words = hosts.select("host", "fold", "n", "s", F.explode(F.array_distinct(F.split("host", r"[.\-]"))).alias("word")).where("word <> ''")
    rates = others(words, "word").where("n > 0").select("word", "fold", ((F.col("s") + 0.1) / (F.col("n") + 1)).alias("r"))
    best = words.join(rates, ["word", "fold"]).groupBy("host", "fold").agg(F.max("r").alias("host_word_rate"))
    out = hosts.join(suffixes, ["suffix", "fold"]).join(best, ["host", "fold"], "left")
    return stored(out.select("host", "fold", "suffix_rate", "suffix_count", F.coalesce("host_word_rate", F.lit(0.0)).alias("host_word_rate")), "url-statistics")


def fit(pages: DataFrame, url_col: str = "url", rules=RULES, bad_words=BAD_WORDS, sample: int = SAMPLE, stats: DataFrame | None = None):
    """The trees, from about ``sample`` different URLs (twice as many at most), and the statistics they use; None without any."""
    stats = statistics(pages, url_col, rules, bad_words) if stats is None else stats
    urls = _urls(pages, url_col)
    total = urls.agg(F.approx_count_distinct("url").alias("n")).first().n
    some = sampled(urls, F.col("url"), sample, total).distinct()
    # the documented bound of the fitting sample; the filter gives about that many
    met = _labelled(some.limit(2 * sample), rules, bad_words).withColumn("fold", fold(F.col("url"))).join(stats, ["host", "fold"])
    rows = sorted(met.select("url", *features(), "y").collect())
    if not rows:
        return None
    x = np.array([r[1:] for r in rows], dtype=float)
    return BoostedTrees().fit(x[:, :-1], x[:, -1]), stats


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5, **options) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the model's block probability."""
    model = fit(pages, url_col, rules, **options)
    trees = model[0] if model else None
    host, path = host_and_path(F.col(url_col))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    src = src.select("*", (name if name is not None else F.lit(None).cast("string")).alias("rule"), (verdict if verdict is not None else F.lit(None).cast("string")).alias("ruled"))
    if model:
        src = src.withColumn("fold", fold(F.col("url"))).join(model[1], ["host", "fold"], "left")
    unseen = {"suffix_rate": 0.5, "suffix_count": 0.0, "host_word_rate": 0.0}
    names = ["id", "host", "path", "rule", "ruled"]
    src = src.select(*names, "url", *[F.coalesce(F.col(c), F.lit(unseen[c])).alias(c) if model else F.lit(unseen[c]).alias(c) for c in STATISTICS])
    src = src.select(*names, F.array(*features()).alias("x"))
    schema = src.drop("x").withColumn("p_block", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("x").flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, len(FEATURES))
            p = trees.predict(x) if trees and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p)], names=schema.names)

    out = src.mapInArrow(score, schema)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block")
