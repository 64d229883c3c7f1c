"""Operator 10: URL filters, rules first and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import batches

#: Fixed values: (verdict, rule) with the rule's host before the first slash and its path from there.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs that trees are fitted on, at most about so many, taken by a hash of the URL.
FIT_URLS = 20_000
ROUNDS, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path after the first "://"; both empty for null or without it."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, at = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(at)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(url: str) -> list[float]:
    """Lexical features of one URL but for those of its suffix."""
    rest = url.partition("://")[2]
    n = len(url)
    head, _, query = rest.partition("?")
    host, _, path = head.partition("/")
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    segments = [s for s in path.split("/") if s]
    return [
        n, len(host), host.count("."), host.count("-"), len(segments), len(segments[0]) if segments else 0,
        sum(c.isdigit() for c in url) / n if n else 0.0, sum(c.isdigit() for c in host), entropy,
        query.count("=") if query else 0, len(query), sum(not c.isalnum() for c in url) / n if n else 0.0,
    ]


def suffixes(url: str) -> list[str]:
    """Host endings and the directory that suffix statistics are kept of."""
    host, _, path = url.partition("://")[2].partition("?")[0].lower().partition("/")
    labels = host.split(".")
    return [labels[-1], ".".join(labels[-2:]), f"{labels[-1]}/{path.partition('/')[0]}"]


@dataclass
class Trees:
    """Boosted trees of fixed depth. A tree is (feature, cut) for each inner node by level and a value for each leaf."""

    prior: float
    stats: dict[str, float]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def features(self, urls: list[str]) -> np.ndarray:
        rows = [[*lexical(u), *(self.stats.get(s, self.prior) for s in suffixes(u))] for u in urls]
        return np.array(rows, np.float64).reshape(len(urls), -1)

    def probability(self, urls: list[str]) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        x = self.features(urls)
        total = np.full(len(urls), math.log(self.prior / (1 - self.prior)))
        for feature, cut, value in self.trees:
            at = np.zeros(len(urls), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(urls)), feature[at]] > cut[at])
            total += value[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray) -> tuple[tuple, np.ndarray]:
    """One tree by best gain over histograms, level by level, and the value that each row gets."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), np.int64)
    for level in range(DEPTH):
        for node in range(2**level - 1, 2 ** (level + 1) - 1):
            own = np.flatnonzero(at == node)
            best = (1e-9, 0, np.inf)
            g, h = slope[own].sum(), curve[own].sum()
            if len(own) >= 2 * LEAST:
                for f, edge in enumerate(edges):
                    b = bins[own, f]
                    left = [np.cumsum(np.bincount(b, v, BINS + 1))[: len(edge)] for v in (slope[own], curve[own], np.ones(len(own)))]
                    gain = left[0] ** 2 / (left[1] + 1) + (g - left[0]) ** 2 / (h - left[1] + 1) - g**2 / (h + 1)
                    gain[(left[2] < LEAST) | (len(own) - left[2] < LEAST)] = 0
                    if len(edge) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), f, float(edge[k]))
            feature[node], cut[node] = best[1], best[2]
            at[own] = 2 * node + 1 + (x[own, best[1]] > best[2])
    leaf = at - inner
    value = np.bincount(leaf, slope, 2**DEPTH) / (np.bincount(leaf, curve, 2**DEPTH) + 1) * RATE
    return (feature, cut, value), value[leaf]


def fit_rows(urls: list[str], block: np.ndarray) -> Trees:
    """Fits on labelled URLs; without both labels, a model that has no trees and takes the one it has seen (allow if none)."""
    n = len(urls)
    prior = float((block.sum() + 0.5) / (n + 2)) if n else 0.01
    seen, bad = Counter(), Counter()
    for u, b in zip(urls, block.tolist(), strict=True):
        for s in suffixes(u):
            seen[s] += 1
            bad[s] += b
    model = Trees(prior, {s: (bad[s] + 2 * prior) / (c + 2) for s, c in seen.items() if c >= LEAST}, [])
    if n == 0 or block.all() or not block.any():
        return model
    x = model.features(urls)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    total = np.full(n, math.log(prior / (1 - prior)))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        tree, change = grow(x, bins, edges, block - p, p * (1 - p))
        model.trees.append(tree)
        total += change
    return model


def fit(labelled: DataFrame, url_col: str, verdict_col: str, most: int = FIT_URLS) -> Trees:
    """Fits on URLs with verdict allow or block. Of more than `most` distinct ones, a share of about that size is taken by a hash of the URL, with one of each verdict at least where there is one."""
    rows = labelled.select(F.col(f"`{url_col}`").alias("u"), F.col(f"`{verdict_col}`").alias("v")).where("u is not null and v in ('allow', 'block')")
    got = sorted((r["u"], r["v"]) for r in batches.sampled(rows, "v", ["u"], most).distinct().collect())
    return fit_rows([u for u, _ in got], np.array([v == "block" for _, v in got], np.float64))


def judge(df: DataFrame, rules=RULES, model: Trees | None = None, id_col: str = "page_id", url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row.

    The longest rule that fits gives the verdict; other URLs are judged by
    trees, fitted (without a given model) on the URLs of df that rules decide.
    score is the trees' probability of block, for URLs with a rule 1 or 0. A
    null URL counts as empty: host and path are empty and the trees judge it.
    Repeated rows each give a row, a null id stays null, other columns are not
    read.
    """
    src = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{url_col}`").alias("u"))
    host, path = host_path(F.col("u"))
    ruled = src.withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = ruled.withColumns({"rule": rule, "by_rule": verdict})
    if model is None:
        model = fit(ruled, "u", "by_rule")
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def block(url: pd.Series, known: pd.Series) -> pd.Series:
        out = (known == "block").astype(float)
        open_ = known.isna()
        if open_.any():
            out[open_] = held.value.probability([u if isinstance(u, str) else "" for u in url[open_]])
        return out

    scored = ruled.withColumn("score", block("u", "by_rule"))
    return scored.select(F.col("i").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > cut, "block").otherwise("allow")).alias("verdict"), "score")
